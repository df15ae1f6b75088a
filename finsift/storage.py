"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch while a table is written.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="finsift-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/finsift-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: written as Parquet to the shared folder and read again."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = table_path(spark, name)
    schema = df.schema
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def keep_batches_small(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most BATCH_ROWS rows or BATCH_BYTES: for tables of whole texts that the caller writes."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    least = int(spark.conf.get(rows))
    spark.conf.set(rows, str(min(least, BATCH_ROWS) if least > 0 else BATCH_ROWS))  # 0 and less: no limit
    spark.conf.set(size, str(BATCH_BYTES))


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows or BATCH_BYTES while a table is written, so that whole texts fit Python's memory."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {name: spark.conf.get(name) for name in (rows, size)}
    keep_batches_small(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing needs any more."""
    for path in paths:
        at, fs = _file_system(spark, path)
        fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> str:
    """One small file, on any file system that Spark can write."""
    at, fs = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def create_bytes(spark: SparkSession, path: str, content: bytes) -> str:
    """One small new file; fails if there is one at path already."""
    at, fs = _file_system(spark, path)
    out = fs.create(at, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One small file."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder."""
    at, fs = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)]
