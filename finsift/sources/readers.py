"""Sources: tables, text documents and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.functions.numeric import cleaned
from finsift.functions.text import file_name_metadata
from finsift.sources.merge import MergeTable
from finsift.storage import exists, release


def financial_table(spark: SparkSession, path: str, label: str = "is_fraudulent", null_labels: str = "drop") -> DataFrame:
    """A CSV with header, read as text and made numeric."""
    return cleaned(spark.read.csv(path, header=True), label, null_labels=null_labels)


def decoded(content: Column) -> Column:
    """UTF-8 text; bytes that are none are left out."""
    kept, bad, own = content.cast("string"), "\ufffd", "\ue0ff\ue0fe"  # a mark that the text itself holds stays
    marked = F.make_valid_utf8(F.replace(kept, F.lit(bad), F.lit(own)))
    return F.replace(F.replace(marked, F.lit(bad), F.lit("")), F.lit(own), F.lit(bad))


def text_documents(spark: SparkSession, path: str, pattern: str = "*.txt", limit: int | None = None) -> DataFrame:
    """(doc_id, content, file_path, file_name, label, company_id, date, submission_id), a row a file; limit is by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").load(path)
    if limit:
        files = files.orderBy("path").limit(limit)
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), decoded(F.col("content")).alias("content"), F.col("path").alias("file_path"), name.alias("file_name"))
    return out.withColumns(file_name_metadata(F.col("doc_id")))


def valid_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the files below path that may hold filings: known suffixes or none, or anything that isn't empty.

    Contents are not read. Hidden and system files are left out, and folders named unstructured_data.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1))
    hidden = name.startswith(".") | name.isin("desktop.ini") | F.array_contains(F.split("path", "/"), "unstructured_data")
    return files.where(~hidden & (suffix.isin(".txt", ".htm", ".html", "") | (F.col("length") > 0)))


def folder_counts(spark: SparkSession, path: str) -> DataFrame:
    """(folder, n) of the files below each folder that lies directly in path; hidden files are left out, and empty ones, which Spark does not list."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    parts = F.split(F.substring_index("path", path.split(":")[-1].rstrip("/") + "/", -1), "/")
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith(".")).where(F.size(parts) > 1).groupBy(F.url_decode(F.get(parts, 0)).alias("folder")).agg(F.count("*").alias("n"))


# Names that the two kinds of dataset may have, the likeliest first.
DATASETS = {
    "fraud": ("Fraudulent Dataset", "Fraudulant Dataset", "fraudulent", "Fraudulent"),
    "non_fraud": ("Non Fraudulent Dataset", "Non-Fraudulent Dataset", "non_fraudulent", "NonFraudulent"),
}


def dataset_counts(folders: DataFrame) -> DataFrame:
    """(kind, folder, n) of the first of its names that each kind of dataset has."""
    rank = F.coalesce(*(F.when(F.col("folder") == name, F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("rank"))) for kind, names in DATASETS.items() for i, name in enumerate(names)))
    some = folders.select(rank.alias("r"), "folder", "n").where("r IS NOT NULL")
    return some.groupBy(F.col("r.kind").alias("kind")).agg(F.min_by("folder", "r.rank").alias("folder"), F.min_by("n", "r.rank").alias("n"))


def metrics_files(spark: SparkSession, path: str) -> DataFrame:
    """(model, metric, value) of all metrics.txt files in folders `name_timestamp`."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="metrics.txt").select("value", F.col("_metadata.file_path").alias("file"))
    told = lines.select(_model_of("file").alias("model"), F.regexp_extract("value", r"^\s+(\w+):\s*(\S+)\s*$", 1).alias("metric"), F.regexp_extract("value", r"^\s+(\w+):\s*(\S+)\s*$", 2).try_cast("double").alias("value"))
    return told.where("metric <> '' AND value IS NOT NULL")


def _model_of(file: str) -> Column:
    return F.regexp_replace(F.element_at(F.split(file, "/"), -2), r"_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}$", "")


def literal_table(spark: SparkSession, text: str, numbers: tuple[str, ...] = ()) -> DataFrame:
    """A small table written in the code: names and rows, fields parted by blanks."""
    head, *rows = (line.split() for line in text.strip().splitlines())
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in head)).select(*(F.col(f"`{c}`").cast("double").alias(c) if c in numbers else F.col(f"`{c}`") for c in head))


class VectorStore:
    """Chunks with embeddings and metadata, as a table at path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """The chunks of a table with keys, or of a plain one."""
        rows = MergeTable(self.spark, self.path, ["chunk_id"]).read()
        return rows if rows is not None else self.spark.read.parquet(self.path)

    def get(self, **where) -> DataFrame:
        """The chunks whose metadata has these values."""
        out = self.read()
        for c, value in where.items():
            out = out.where(F.col(c) == value)
        return out

    def count(self) -> int:
        """0 where there is no table yet."""
        return self.read().count() if exists(self.spark, self.path) else 0

    def reset(self) -> None:
        release(self.spark, self.path)


def model_registry(spark: SparkSession, path: str) -> DataFrame:
    """(model, auc, path) from folders `name_timestamp` with a metrics.txt; an AUC that is not there is 0.5."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="metrics.txt").select("value", F.col("_metadata.file_path").alias("file"))
    auc = F.max(F.regexp_extract("value", r"auc_roc:\s*([0-9.]+)", 1).try_cast("double"))
    return lines.groupBy("file").agg(F.coalesce(auc, F.lit(0.5)).alias("auc")).select(_model_of("file").alias("model"), "auc", F.col("file").alias("path"))


def document_statistics(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Counts of files; names with `Fraud` include those with `NonFraud`."""
    return files.agg(F.count("*").alias("total"), F.count_if(F.col(name_col).contains("Fraud")).alias("fraud_labeled"), F.count_if(F.col(name_col).contains("NonFraud")).alias("nonfraud_labeled"))
