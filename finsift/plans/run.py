"""Whole runs over folders and stores: documents, re-scoring, and records."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.functions import text as T
from finsift.operators import embedding, formatting, graph, metrics, ml, risk, vectors
from finsift.operators.fitted import Fitted
from finsift.sources import readers, sinks
from finsift.sources.merge import MergeTable
from finsift.storage import exists, release, written

CHUNK_WORDS, CHUNK_OVERLAP = 512, 50
META = ("label", "company_id", "date")
#: The tables of a store and their keys.
TABLES = {"chunks": ["chunk_id"], "vertices": ["label", "name"], "edges": ["src_label", "src", "dst_label", "dst", "type"], "documents": ["label", "name"], "formatted": ["document_id"]}


def stored(spark: SparkSession, store: str, table: str) -> MergeTable:
    """A table of a store, which rows are merged into: a second run over the same files leaves it as it was."""
    return MergeTable(spark, f"{store}/{table}", TABLES[table])


def run_documents(spark: SparkSession, folder: str, store: str, limit: int | None = None, embeddings: bool = True, build_graph: bool = True, scoring: bool = True, batch: str | None = None, embed=None) -> dict[str, int]:
    """Reads text files; writes chunks, vertices, edges and formatted documents below store; returns counters.

    Each part can be left out by itself. A batch name also writes an export. embed: text column to vector column; the
    store's own encoder (fit_encoder()) or hashed words, if none is given.
    """
    embed = embed or store_encoder(spark, store)
    docs = written(readers.text_documents(spark, folder, limit=limit), "documents")
    out = {"documents": docs.count(), "chunks": 0, "entities": 0, "nodes": 0, "edges": 0, "high_risk": 0}
    if embeddings:
        chunks = T.chunk_documents(docs, CHUNK_WORDS, CHUNK_OVERLAP, text_col="content").join(docs.select("doc_id", *META), "doc_id")
        rows = chunks.withColumn("embedding", embed(F.col("text")))
        sinks.upsert_vectors(rows, f"{store}/chunks")
        out["chunks"] = readers.VectorStore(spark, f"{store}/chunks").count()
    if build_graph:
        ents = written(graph.entities(docs, extra=graph.named(F.col("content"))), "entities")
        nodes, edges = graph.graph(docs, ents, graph.relations(docs))
        stored(spark, store, "vertices").merge(nodes)
        stored(spark, store, "edges").merge(edges)
        stored(spark, store, "documents").merge(graph.document_vertices(docs), "fill")
        out |= {"entities": ents.count(), "nodes": stored(spark, store, "vertices").count(), "edges": stored(spark, store, "edges").count()}
    if scoring:
        source = docs
        if embeddings:
            ids = readers.VectorStore(spark, f"{store}/chunks").read().groupBy("doc_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))
            source = docs.join(ids, "doc_id", "left")
        formatted = written(formatting.formatted_documents(source), "formatted")
        stored(spark, store, "formatted").merge(formatted)
        out["high_risk"] = formatted.where("risk_assessment.overall_score >= 60").count()
        if batch:
            sinks.export_batch(formatted, f"{store}/exports/{batch}", batch)
    return out


def fit_encoder(spark: SparkSession, folder: str, store: str, dims: int = embedding.DIMS) -> embedding.Encoder:
    """An encoder fitted to the texts of a folder, saved with the store; chunks and questions are embedded by it from then on."""
    encoder = embedding.fitted_encoder(readers.text_documents(spark, folder), "content", dims)
    encoder.save(spark, f"{store}/encoder")
    return encoder


def store_encoder(spark: SparkSession, store: str):
    return embedding.Encoder.load(spark, f"{store}/encoder") if exists(spark, f"{store}/encoder/encoder.npz") else vectors.hashing_embedding


def status(spark: SparkSession, store: str) -> dict[str, object]:
    """Rows of each table that there is, and settings."""
    tables = {t: stored(spark, store, t).count() for t in ("chunks", "vertices", "edges", "formatted")}
    return tables | {"chunk_words": CHUNK_WORDS, "chunk_overlap": CHUNK_OVERLAP, "embedding_model": formatting.EMBEDDING_MODEL}


def reset(spark: SparkSession, store: str, confirm: bool = False) -> bool:
    """Deletes all of a store, if confirmed."""
    if confirm:
        release(spark, store)
    return confirm


def search(spark: SparkSession, store: str, question: str, k: int = 5, embed=None, **where) -> DataFrame:
    """(chunk_id, distance, text) of the chunks nearest to a question."""
    embed = embed or store_encoder(spark, store)
    asked = spark.createDataFrame([(question,)], "q string").select(embed(F.col("q")).alias("v")).first()["v"]
    chunks = readers.VectorStore(spark, f"{store}/chunks").get(**where)
    return vectors.nearest(chunks, list(asked), k, id_col="chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").orderBy("distance", "chunk_id")


def rescore(spark: SparkSession, store: str, limit: int | None = None) -> DataFrame:
    """Formatted documents from the stores alone: properties of the vertices, content rejoined from the chunks in order.

    The chunks' text was cleaned and overlaps, so that scores may differ from those of the first run.
    """
    props = F.col("props")
    docs = stored(spark, store, "documents").read().select(F.col("name").alias("doc_id"), *(F.try_element_at(props, F.lit(c)).alias(c) for c in META), F.try_element_at(props, F.lit("file_name")).alias("file_path"))
    chunks = stored(spark, store, "chunks").read().select("doc_id", "chunk_index", "chunk_id", "text")
    whole = graph.with_chunks(docs, chunks)
    return formatting.formatted_documents(whole.orderBy("doc_id").limit(limit) if limit else whole)


def load_models(spark: SparkSession, path: str) -> tuple[dict[str, object], DataFrame]:
    """The saved classifiers below path by name, and their weights (model, auc)."""
    registry = readers.model_registry(spark, path)
    found = {}
    for r in registry.collect():  # a few models
        folder = r["path"].rsplit("/", 1)[0]
        if exists(spark, f"{folder}/model"):
            found[r["model"]] = Fitted.load(spark, f"{folder}/model") or PipelineModel.load(f"{folder}/model")
    return found, registry.select("model", "auc")


def run_records(spark: SparkSession, table: str, models: str, columns: list[str], label: str = "is_fraudulent", detectors: tuple[str, ...] = (), batch: str | None = None, out: str | None = None) -> DataFrame:
    """Risk of the records of a CSV file by all saved models and some detectors, exported where asked."""
    rows = written(readers.financial_table(spark, table, label, null_labels="keep").withColumn("record_id", F.monotonically_increasing_id()), "records")
    name = label if label in rows.columns else "misstate"
    fitted, weights = load_models(spark, models)
    each = written(ml.stacked(rows, columns, "record_id", fitted | dict.fromkeys(detectors), name), "predictions")
    features = rows.select("record_id", F.array(*columns).alias("features"))
    scored = risk.record_routing(risk.record_risk(each, metrics.ensemble(each, weights), features))
    formatted = formatting.formatted_records(scored, each, rows.select("record_id", *columns))
    if batch and out:
        sinks.write_json(formatted, f"{out}/{batch}")
    return formatted
