"""Exact top-k inner products over quantised vectors, retrieved bucket by bucket of similar length.

Components become floor(scale * x). Vectors are sorted by length, longest first, into buckets of bounded size, and so
are the queries into blocks. Each block first meets the bucket of the longest vectors, which gives every query a
threshold: its k-th best score so far. A block is paired with a bucket only if some query with threshold t may reach it
there: if t <= |q| * longest, by the lengths stored with both. In a bucket, a query needs a cosine of
t / (|q| * longest): where that local threshold is high, candidates must also have a feasible value in the query's
largest coordinate (coordinate pruning); where it is low, those long enough to reach t (length pruning). What is left
is verified by integer products, and tightens the threshold for the buckets that follow.

Buckets are dealt over slots, as many as there are tasks or pairs of buckets, each bucket to one. A block goes to each slot once, goes
through its buckets from long to short, and gives k rows a query for the slot: so neither what is shuffled nor what is
given grows with the number of pairs.

Ties go to the smaller id. A row is no candidate for its own query. An id that several rows have is one candidate and
one query: the best score of its vectors counts. Vectors of different sizes meet as if the shorter one had zeros at
its end; an empty vector's scores are 0. Vectors that are null or hold null or non-finite components take no part,
neither do rows without an id. Equal vectors and equal lengths need no special case, as buckets are cut by number. An
empty table gives no rows. Scores must fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from finsift.llm._bytes import trim
from finsift.llm._shared import read, written

SCALE, K, QUERY_MODULUS = 64, 20, 20
BUCKET, QUERY_BLOCK = 4096, 1024
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM = 0.6


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, norm) of the vectors that take part."""
    v = F.col(f"`{vector_col}`")
    whole = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    out = vectors.where(F.col(f"`{id_col}`").isNotNull() & whole).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), ints.alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def packed(rows: np.ndarray) -> bytes:
    """Integer rows in as few bytes as their values need, after a byte that says how many."""
    top = int(np.abs(rows).max(initial=0))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind[2].encode() + rows.astype(kind).tobytes()


def unpacked(stored: bytes, number: int) -> np.ndarray:
    return np.frombuffer(stored[1:], f"<i{stored[:1].decode()}").reshape(number, -1).astype(np.int64)


def _blocks(size: int):
    """Rows, in order, as blocks of at most size vectors: ids, components, and the largest length."""

    def block(ids: list[np.ndarray], rows: list[list[int]], norms: list[np.ndarray]) -> pa.RecordBatch:
        width = max(1, max(map(len, rows)))
        out = np.zeros((len(rows), width), np.int64)
        for i, x in enumerate(rows):
            out[i, : len(x)] = x
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([packed(out)], pa.binary()), pa.array([float(np.concatenate(norms).max())])], ["ids", "v", "longest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, norms = [], [], []
        for batch in batches:
            done = 0
            while done < len(batch):
                part = batch.slice(done, size - len(rows))
                ids.append(part.column(0).to_numpy())
                rows += [np.array(x, np.int64) for x in part.column(1).to_pylist()]
                norms.append(part.column(2).to_numpy())
                done += len(part)
                if len(rows) == size:
                    yield block(ids, rows, norms)
                    ids, rows, norms = [], [], []
        if rows:
            yield block(ids, rows, norms)

    return cut


def same_width(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with zeros up to the width of the wider."""
    width = max(q.shape[1], v.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where all partial sums are exact there."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ v.T.astype(float)).astype(np.int64) if size < 2**53 else q @ v.T


def best_of(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query, candidates of this bucket and their scores: at most k, none below floor."""
    norms = np.sqrt((v.astype(float) ** 2).sum(1))
    q_norms = np.sqrt((q.astype(float) ** 2).sum(1))
    longest = norms.max(initial=0)
    reach = q_norms * longest * (1 + 1e-9)
    live = np.flatnonzero((floor <= reach) | (floor <= 0))
    if not len(live):
        return
    unit = v / np.maximum(norms, 1e-300)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, floor / reach, 0)
    low = live[local[live] < COORDINATE_FROM]
    # Length pruning comes first: what is too short for each of these queries isn't multiplied.
    need = (np.maximum(floor[low], 0) / np.maximum(q_norms[low], 1e-300)).min(initial=np.inf)
    long = np.flatnonzero(norms * (1 + 1e-9) >= need)
    scores = products(q[low], v[long]) if len(low) else None
    for at, j in enumerate(live):
        if local[j] >= COORDINATE_FROM:
            # cos >= c and a unit query component u bound the candidate's component: u*c -+ sqrt((1-u^2)(1-c^2))
            c, focus = min(1.0, local[j]), int(np.abs(q[j]).argmax())
            u = q[j, focus] / q_norms[j]
            spread = np.sqrt(max(0.0, (1 - u * u) * (1 - c * c))) + 1e-9
            w = unit[:, focus]
            # above u (below -u, for the sign) any value up to 1 may still have a cosine of at least c
            lower, upper = (u * c - spread, u + spread + (1 - u)) if u >= 0 else (u - spread - (1 + u), u * c + spread)
            rows = np.flatnonzero((w >= lower) & (w <= upper) & (norms * q_norms[j] * (1 + 1e-9) >= floor[j]))
            s = products(q[j : j + 1], v[rows])[0]
        else:
            held = norms[long] * q_norms[j] * (1 + 1e-9) >= floor[j]
            rows, s = long[held], scores[np.searchsorted(low, j)][held]
        keep = (ids[rows] != q_ids[j]) & (s >= floor[j])
        yield int(j), *firsts(ids[rows[keep]], s[keep], k)


def firsts(ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids with their best scores, ties to the smaller id."""
    if len(s) > 4 * k and len(np.unique(ids)) == len(ids):
        edge = np.partition(s, len(s) - k)[len(s) - k]
        ids, s = ids[s >= edge], s[s >= edge]
    order = np.lexsort((ids, -s))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[order], s[order]


class Best:
    """The best candidates of a block's queries so far."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.q_ids, self.q, self.floor, self.k = q_ids, q, floor.copy(), k
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        q, v = same_width(self.q, v)
        for j, more, s in best_of(self.q_ids, q, self.floor, ids, v, self.k):
            if j in self.held:
                more, s = firsts(np.concatenate([self.held[j][0], more]), np.concatenate([self.held[j][1], s]), self.k)
            self.held[j] = more, s
            if len(s) == self.k:
                self.floor[j] = max(self.floor[j], s[-1])

    def rows(self) -> pa.RecordBatch:
        n = [len(self.held[j][1]) for j in self.held]
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in self.held.values())]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.q_ids[list(self.held)], n).astype(np.int64)), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


NONE = np.iinfo(np.int64).min


def _seeded(first: tuple[bytes, bytes], k: int):
    """Blocks of queries with their thresholds from the first bucket, and the length that a bucket must have for any of them."""
    ids = np.frombuffer(first[0], "<i8")
    v = unpacked(first[1], len(ids))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors, least = [], []
            for q_ids, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q_ids = np.frombuffer(q_ids, "<i8")
                best = Best(q_ids, unpacked(q, len(q_ids)), np.full(len(q_ids), NONE), k)
                best.meet(ids, v)
                norms = np.sqrt((best.q.astype(float) ** 2).sum(1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(best.floor > 0, np.where(norms > 0, best.floor / norms, np.inf), 0.0)
                floors.append(best.floor.astype("<i8").tobytes())
                least.append(float(need.min()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors, pa.binary()), pa.array(least)], ["q_ids", "q", "floor", "least"])

    return seed


def _searched(k: int):
    """Rows of a block and a bucket, the blocks one after the other, to the k best candidates of each query for the slot."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for key, q_ids, q, floor, ids, v in zip(*(batch.column(c).to_pylist() for c in ("key", "q_ids", "q", "floor", "ids", "v")), strict=True):
                if key != now:
                    if best is not None:
                        yield best.rows()
                    q_ids = np.frombuffer(q_ids, "<i8")
                    now, best = key, Best(q_ids, unpacked(q, len(q_ids)), np.frombuffer(floor, "<i8"), k)
                ids = np.frombuffer(ids, "<i8")
                best.meet(ids, unpacked(v, len(ids)))
        if best is not None:
            yield best.rows()
        trim()

    return search


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_modulus: int = QUERY_MODULUS, k: int = K, scale: int = SCALE, bucket: int = BUCKET, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row whose id query_modulus divides, against all others."""
    spark = vectors.sparkSession
    whole = written(quantised(vectors, id_col, vector_col, scale), "quantised")
    # As many slots as give each two buckets, up to the number of tasks: more would only give more rows to merge.
    slots = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole.count() // (2 * bucket))))

    def cut(rows: DataFrame, size: int) -> DataFrame:
        return rows.repartitionByRange(slots, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id").mapInArrow(_blocks(size), "ids binary, v binary, longest double")

    buckets = written(cut(whole, bucket).withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    first = buckets.orderBy(F.desc("longest"), "bucket").limit(1).collect()  # one bucket
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = cut(whole.where(F.col("vec_id") % query_modulus == 0), query_block).selectExpr("ids AS q_ids", "v AS q")
    queries = written(asked.mapInArrow(_seeded((bytes(first[0]["ids"]), bytes(first[0]["v"])), k), "q_ids binary, q binary, floor binary, least double").withColumn("qblock", F.monotonically_increasing_id()), "queries")

    # A block goes to every slot once, a bucket to one; of their pairs only those that the lengths allow are made.
    at = F.pmod(F.xxhash64("bucket"), F.lit(slots))
    left = queries.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    right = buckets.withColumn("slot", at).repartition(slots, "slot").sortWithinPartitions("slot", F.desc("longest"), "bucket")
    pairs = left.join(right.hint("merge"), (left["slot"] == right["slot"]) & (right["longest"] * (1 + 1e-9) >= left["least"]))
    found = pairs.select(F.xxhash64("qblock", left["slot"]).alias("key"), "q_ids", "q", "floor", "ids", "v").mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def oracle() -> str:
    return f"""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
          FROM e q JOIN e c ON q.vec_id % {QUERY_MODULUS} = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
    """
