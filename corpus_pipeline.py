"""The corpus pipeline: five stages over documents, each written as Parquet before the next one reads it.

Stages that send whole texts to Python keep the session's Arrow batches small, as the caller writes what they return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.llm import jaccard, langid, linededup, packing, quality
from finsift.llm._shared import fresh, keep_batches_small, read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose best language has a smaller share of the corrected counts are rejected, as are texts without a letter.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages that their own labels teach; texts without a letter go.

    Every row is judged by itself, so repeated rows and rows without a doc_id are like any others.
    """
    keep_batches_small(spark)
    lang, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    told = langid.predict(docs, langid.fit(docs), lang_to=lang, score_to=score)
    return told.where((F.col(lang) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the quality rules; null and empty texts fail them. Repeated rows share their fate."""
    return quality.quality_rules(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes frequent lines; n_chars follows the text. Rows without a doc_id hold no line and lose none."""
    keep_batches_small(spark)
    cleaned = linededup.LineIndex.build(docs).apply(docs.select(COLUMNS))
    return cleaned.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that of the smallest doc_id, of equal ones the first by a hash of the row.

    Rows are told apart by a hash of doc_id and text. So a row without a doc_id takes part like any other and comes
    last in its component, and rows that repeat a doc_id are compared by their texts: copies go, different texts stay.
    Rows without words are linked with nothing; of those that are equal in all columns one stays, as of any others.
    """
    keep_batches_small(spark)
    own, whole = F.xxhash64("doc_id", "text"), F.xxhash64(*COLUMNS)
    rows = docs.select(own.alias("own"), whole.alias("whole"), *COLUMNS)
    parts = jaccard.similar_components(rows.select("own", "text"), "own").selectExpr("doc_id AS own", "component_id")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "whole", "own").alias("place")
    first = parts.distinct().join(rows.select("own", place), "own").groupBy("component_id").agg(F.min("place").alias("place"))
    return rows.join(first.select("place.own", "place.whole"), ["own", "whole"], "left_semi").dropDuplicates(["own", "whole"]).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences; rows that repeat a document are packed each."""
    keep_batches_small(spark)
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", near_duplicates), ("packing", pack)]

#: No SQL learns the languages, tokenises or solves the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
