"""A sentence encoder fitted to a corpus: TF-IDF weights of hashed words, then latent directions by a randomised SVD.

The SVD takes two passes over all texts. The first sums what the texts' words have in common with random directions, as a
matrix of one row a hash bucket, whose orthogonal basis spans the strongest directions; the second sums the texts' products
in that basis, a small square matrix whose eigenvectors turn it. Tasks add up their rows' matrices block of buckets by
block, so that the driver gets buckets * directions numbers, whatever the number of texts.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finsift.storage import read_bytes, write_bytes

BUCKETS, DIMS, SPARE, GROUP, TOKENS = 1 << 15, 64, 10, 2048, 20_000


def buckets_of(text: Column, buckets: int = BUCKETS) -> Column:
    """The hash buckets of a text's words, with repeats, in JVM code; null texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def weighted(lists: pa.Array, idf: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row of each word, bucket, weight) of some texts at a time; a text's weights have length 1."""
    at, flat = np.asarray(lists.offsets).astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
    i = 0
    while i < len(lists):
        j = max(i + 1, int(np.searchsorted(at, at[i] + TOKENS, "right")) - 1)
        rows = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
        key, n = np.unique(rows * len(idf) + flat[at[i] : at[j]], return_counts=True)
        row, bucket = key // len(idf), key % len(idf)
        w = (1 + np.log(n)) * idf[bucket] if len(n) else np.zeros(0)
        length = np.sqrt(np.bincount(row, w * w, j - i))
        yield slice(i, j), row, bucket, w / np.maximum(length[row], 1e-12)
        i = j


def times(rows: int, row: np.ndarray, bucket: np.ndarray, w: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The product of sparse rows with a matrix of one row a bucket."""
    out = np.zeros((rows, matrix.shape[1]))
    if len(row):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[first]] = np.add.reduceat(w[:, None] * matrix[bucket], first)
    return out


def spread(total: np.ndarray, row: np.ndarray, bucket: np.ndarray, w: np.ndarray, matrix: np.ndarray) -> None:
    """Adds the product of the transposed sparse rows with a matrix of one row a text to total, each bucket once."""
    if len(row):
        order = np.argsort(bucket, kind="stable")
        row, bucket = row[order], bucket[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        total[bucket[first]] += np.add.reduceat(w[order][:, None] * matrix[row], first)


@dataclass
class Encoder:
    """Weights by bucket and directions; embeddings have length 1, those of texts without known words are 0."""

    idf: np.ndarray
    axes: np.ndarray

    def column(self, text: Column) -> Column:
        idf, axes = self.idf, self.axes

        @F.pandas_udf("array<double>")
        def embedded(lists: pd.Series) -> pd.Series:
            arrow = pa.array([np.asarray(x, np.int32) for x in lists], pa.list_(pa.int32()))
            out = [times(s.stop - s.start, r, b, w, axes) for s, r, b, w in weighted(arrow, idf)]
            rows = np.concatenate([*out, np.zeros((0, axes.shape[1]))])
            return pd.Series(list(rows / np.maximum(np.sqrt((rows * rows).sum(1)), 1e-12)[:, None]))

        return embedded(buckets_of(text, len(idf)))

    __call__ = column

    def save(self, spark: SparkSession, path: str) -> None:
        out = io.BytesIO()
        np.savez_compressed(out, idf=self.idf, axes=self.axes)
        write_bytes(spark, f"{path}/encoder.npz", out.getvalue())

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        with np.load(io.BytesIO(read_bytes(spark, f"{path}/encoder.npz"))) as stored:
            return Encoder(stored["idf"], stored["axes"])


def _summed(rows: DataFrame, shape: tuple[int, int], add) -> np.ndarray:
    """The sum of matrices that add(lists, total) makes of the rows, added up by groups of their rows."""
    n, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            add(batch.column(0), total)
        for g in range(0, n, GROUP):
            if total[g : g + GROUP].any():
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([total[g : g + GROUP].tobytes()], pa.binary())], ["g", "m"])

    def added(table):
        whole = sum(np.frombuffer(m, "<f8") for m in table.column("m").to_pylist())
        return pa.table({"g": table.column("g").slice(0, 1), "m": pa.array([whole.tobytes()], pa.binary())})

    out = np.zeros(shape)
    for r in rows.mapInArrow(run, "g long, m binary").groupBy("g").applyInArrow(added, "g long, m binary").collect():  # n / GROUP rows
        out[r["g"] : r["g"] + GROUP] = np.frombuffer(r["m"], "<f8").reshape(-1, width)
    return out


def fitted_encoder(docs: DataFrame, text_col: str = "text", dims: int = DIMS, buckets: int = BUCKETS, seed: int = 42) -> Encoder:
    """An encoder from all texts."""
    rows = docs.select(buckets_of(F.col(f"`{text_col}`"), buckets).alias("b"))
    counts = rows.select(F.explode(F.array_distinct("b")).alias("b")).groupBy("b").count().collect()  # a row a bucket
    n = docs.count()
    idf = np.zeros(buckets)
    for r in counts:
        idf[r["b"]] = np.log((1 + n) / (1 + r["count"])) + 1
    width = dims + SPARE
    directions = np.random.default_rng(seed).normal(size=(buckets, width))

    def common(lists: pa.Array, total: np.ndarray) -> None:
        for s, r, b, w in weighted(lists, idf):
            spread(total, r, b, w, times(s.stop - s.start, r, b, w, directions))

    basis = np.linalg.qr(_summed(rows, (buckets, width), common))[0]

    def squares(lists: pa.Array, total: np.ndarray) -> None:
        for s, r, b, w in weighted(lists, idf):
            y = times(s.stop - s.start, r, b, w, basis)
            total += y.T @ y

    value, turn = np.linalg.eigh(_summed(rows, (width, width), squares))
    best = np.argsort(-value)[:dims]
    return Encoder(idf, basis @ turn[:, best])
