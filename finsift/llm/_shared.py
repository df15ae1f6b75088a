"""Column helpers that the operators of this subpackage have in common; tables in the shared folder come from storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.storage import keep_batches_small, release, shared_dir, small_batches, written, written_at

__all__ = ["ASCII_SPACE", "crc_mod", "fresh", "keep_batches_small", "read", "release", "shared_dir", "small_batches", "written", "written_at"]

#: ASCII white space as the contracts define it: blank, and tab to carriage return.
ASCII_SPACE = r"\x20\x09-\x0D"


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def fresh(taken: list[str], name: str) -> str:
    """name, lengthened until no column of taken has it (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
