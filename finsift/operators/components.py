"""Connected components of a link table, by alternating large-star and small-star steps.

Each step sends every node's larger (smaller) neighbours to its smallest one; the number of rounds grows with the
logarithm of the longest chain. Every round is written to the shared folder, and the table
before it is deleted. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsift.storage import release, written_at


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); component is the smallest node that links reach."""
    spark = links.sparkSession
    edges, path = written_at(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        small, small_path = written_at(_small(_large(edges)), "star")
        done = _same(edges, small)
        release(spark, path)
        if done:
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges, path = small, small_path


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, linked with the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, linked with the smallest of them (u > v in every row)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _same(before: DataFrame, after: DataFrame) -> bool:
    def told(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()

    return told(before) == told(after)
