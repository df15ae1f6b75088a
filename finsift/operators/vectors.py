"""Nearest neighbours in a vector table, exact, by squared Euclidean distance."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int = 5, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors nearest to query; ties to the smaller id. Only k rows a partition are gathered."""
    some = vectors.where(where) if where is not None else vectors
    return some.select(id_col, squared_distance(F.col(vector_col), F.array(*map(F.lit, query))).alias("distance")).orderBy("distance", id_col).limit(k)


#: Bytes of query vectors that are sent to the executors in one piece, at most.
QUERY_BYTES = 32 << 20
#: Pairs of vectors whose differences a task holds at a time.
PAIRS = 1 << 12


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", skip_self: bool = False, max_queries: int | None = None, block: int = 10_000) -> DataFrame:
    """(query_id, rank, id, distance) of each query row's k nearest vectors, ties to the smaller id.

    Up to `block` queries of QUERY_BYTES go to the executors in one piece, and each task gives k rows a query; more are
    joined with the vectors by lists (lists.py), both sides in Spark. Both ways give the same rows. Any number of queries is
    searched, unless the caller sets max_queries. Vectors that are null or of another size than a query are not among its
    neighbours.
    """
    from finsift.operators.lists import nearest_by_lists

    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v"))
    n, size = asked.agg(F.count("*"), F.sum(F.size("v"))).first()
    if max_queries is not None and n > max_queries:
        raise ValueError(f"more than {max_queries} queries")
    given = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    if n > block or 8 * (size or 0) > QUERY_BYTES:
        ranked = nearest_by_lists(given, asked, k, skip_self)
    else:
        rows = asked.toPandas()  # one block
        sent = vectors.sparkSession.sparkContext.broadcast({d: (part["query_id"].to_numpy(np.int64), np.array(part["v"].tolist(), float).reshape(len(part), d)) for d, part in rows.groupby(rows["v"].map(len))} if len(rows) else {})
        ranked = best_ranked(given.mapInPandas(_searching(sent, k, skip_self), "query_id long, id long, distance double"), k)
    return ranked.select("query_id", F.col("id").alias(id_col), "distance", "rank")


def best_ranked(found: DataFrame, k: int) -> DataFrame:
    """found with the rank of each query's k best rows."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rank") <= k)


def _searching(sent, k: int, skip_self: bool):
    def search(batches):
        best = {d: (np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)) for d, (_, q) in sent.value.items()}
        for batch in batches:
            for d, part in batch.groupby(batch["v"].map(len)):
                if d in best:
                    ids, v = part["id"].to_numpy(np.int64), np.array(part["v"].tolist(), float).reshape(len(part), d)
                    (q_ids, q), (far, who) = sent.value[d], best[d]
                    for at, of in itertools.product(range(0, len(ids), 512), range(0, len(q), 2048)):
                        some = slice(of, of + 2048)
                        closest(q_ids[some], q[some], ids[at : at + 512], v[at : at + 512], far[some], who[some], skip_self)
        for d, (far, who) in best.items():
            row, place = np.nonzero(np.isfinite(far))
            yield pd.DataFrame({"query_id": sent.value[d][0][row], "id": who[row, place], "distance": far[row, place]})

    return search


def closest(q_ids, q, ids, v, far, who, skip_self: bool, most: np.ndarray | None = None) -> None:
    """Merges a block of vectors into each query's best distances and ids, both in order; those beyond `most` may be left out."""
    k = far.shape[1]
    # By products first: what may be nearer than the k-th, with room for rounding; the sums of squares are then exact.
    rough = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T)
    room = 1e-9 * (1 + (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :])
    edge = np.partition(rough, k - 1, 1)[:, [k - 1]] if not skip_self and k <= rough.shape[1] else (np.partition(rough, k, 1)[:, [k]] if k < rough.shape[1] else np.full((len(q), 1), np.inf))
    limit = np.minimum(edge + room.max(), far[:, [k - 1]])
    row, col = np.nonzero(rough - room <= (limit if most is None else np.minimum(limit, most[:, None])))
    if skip_self:
        other = q_ids[row] != ids[col]
        row, col = row[other], col[other]
    if not len(row):
        return
    exact = np.zeros(len(row))
    for at in range(0, len(row), PAIRS):  # copies of a vector make as many pairs as there are rows times vectors
        gap, part = q[row[at : at + PAIRS]] - v[col[at : at + PAIRS]], exact[at : at + PAIRS]
        for i in range(gap.shape[1]):  # in order, as equal vectors must get equal sums
            part += gap[:, i] * gap[:, i]
    touched = np.unique(row)
    of = np.concatenate([np.repeat(np.arange(len(touched)), k), np.searchsorted(touched, row)])
    d, n = np.concatenate([far[touched].ravel(), exact]), np.concatenate([who[touched].ravel(), ids[col]])
    order = np.lexsort((n, d, of))  # all queries at once
    best = order[np.searchsorted(of[order], np.arange(len(touched)))[:, None] + np.arange(k)]
    far[touched], who[touched] = d[best], n[best]


def kth_distance(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, distance) of each query's k-th nearest vector, itself included."""
    return nearest_batch(vectors, queries, k, id_col, vector_col).groupBy("query_id").agg(F.sqrt(F.max("distance")).alias("distance"))


def centroid_distance(vectors: DataFrame, centroids: list[list[float]], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, distance) to the nearest of a few centroids."""
    each = [F.sqrt(squared_distance(F.col(vector_col), F.array(*map(F.lit, c)))) for c in centroids]
    return vectors.select(id_col, (F.least(*each) if len(each) > 1 else each[0]).alias("distance"))


def hashing_embedding(text: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for a sentence encoder: signed word counts by hash, scaled to length 1."""

    @F.pandas_udf("array<double>")
    def embedded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _counted_words(t or "", dims))

    return embedded(text)


def _counted_words(text: str, dims: int) -> np.ndarray:
    out = np.zeros(dims)
    words = re.findall(r"\w+", text.lower())
    if words:
        h = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
        np.add.at(out, h % dims, np.where(h >> 16 & 1, 1.0, -1.0))
    return out / (np.sqrt((out * out).sum()) or 1.0)
