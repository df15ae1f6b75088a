"""Exact nearest neighbours of many queries by inverted lists, with both sides in Spark.

1. Centres come from k-means on about SAMPLE vectors; every vector and every query goes to the list of its nearest centre.
   Lists are cut into buckets of at most BUCKET vectors by a hash of the id, so a list may hold any share of the rows; the
   queries into blocks. A bucket has a centre of its own and a radius.
2. Each block meets one bucket of its own list, which gives a bound for the k-th distance of its queries.
3. A list is needed by a query if its distance to the centre less the list's radius is within that bound. So by the
   triangle inequality nothing is lost. Lists are dealt over slots (and the buckets of a large slot over cuts), blocks over
   groups, all of a bounded size; a block goes once to each slot that holds a list any of its queries needs. A tile, a group
   and a cut, is held by one task, so vectors are sent once a tile and not once a block and bucket. A block is kept from
   buckets that are too far, and gives k rows a query.

With `probes`, each query sees its nearest lists alone, which is approximate: recall is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finsift.llm._bytes import trim
from finsift.operators.vectors import best_ranked, closest
from finsift.storage import release, written, written_at

SAMPLE, MOST_LISTS, BUCKET, BLOCK = 20_000, 1024, 1024, 1024
#: Queries of a block that meet a bucket at a time; bytes of differences to centres that are held at a time, about.
AT_ONCE, GAP_BYTES = 128, 4 << 20
#: Bytes of vectors in a slot or a group of blocks, both of which a task holds in memory, about; and those that are worth a task.
SLOT_BYTES, LEAST_BYTES = 16 << 20, 1 << 20
#: Partitions for the tiles, at most.
MOST_PARTS = 4096

#: By size of vectors: the number of the first list, and the centres.
Centres = dict[int, tuple[int, np.ndarray]]


def centres_of(vectors: DataFrame, n: int, lists: int | None = None, rounds: int = 6, seed: int = 42) -> Centres:
    """k-means on a sample (by a hash of the id) for each size of vectors; square root of n lists, MOST_LISTS at most."""
    step = max(1, n // SAMPLE)
    rows = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(step)) == 0).limit(2 * SAMPLE).select("v").toPandas()["v"]
    out, first, rng = {}, 0, np.random.default_rng(seed)
    for d, part in rows.groupby(rows.map(len)):
        if not d:
            continue
        x = np.nan_to_num(np.array(part.tolist(), float).reshape(len(part), d))
        c = x[rng.choice(len(x), min(len(x), lists or min(MOST_LISTS, max(1, round(np.sqrt(n))))), replace=False)]
        for _ in range(rounds):
            near = _nearest(x, c)[0]
            sums, counts = np.zeros_like(c), np.bincount(near, minlength=len(c))
            np.add.at(sums, near, x)
            c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
        out[int(d)] = first, c
        first += len(c)
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the distance to it."""
    near = np.concatenate([((c * c).sum(1)[None, :] - 2 * x[i : i + 2048] @ c.T).argmin(1) for i in range(0, len(x), 2048)] or [np.zeros(0, np.int64)])
    return near, np.sqrt(((x - c[near]) ** 2).sum(1))


def _place(sent, d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List and distance of rows of size d; a size that the sample lacks is a list of its own around 0."""
    if d in sent.value:
        first, c = sent.value[d]
        near, far = _nearest(np.nan_to_num(x), c)
        return near + first, far
    return np.full(len(x), -1 - d), np.sqrt((x * x).sum(1))


def listed(rows: DataFrame, id_col: str, sent) -> DataFrame:
    """(list, far, id, d, v) of rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            sizes = np.diff(np.asarray(v.offsets))
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = np.array(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), d)
                near, far = _place(sent, d, x)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(far), batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), d, np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["list", "far", "id", "d", "v"])
        trim()

    return rows.select(id_col, "v").mapInArrow(run, "list int, far double, id long, d int, v binary")


def packed(rows: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    """(list, part, d, ids, v, centre, radius): rows of a list in binary columns, about `size` of them together."""
    parts = F.create_map(*(F.lit(x) for item in counts.items() for x in (item[0], -(-item[1] // size)))) if counts else F.create_map().cast("map<int,int>")

    def run(table):
        v = np.frombuffer(b"".join(table.column("v").to_pylist()), "<f8").reshape(table.num_rows, -1)
        order = np.argsort(table.column("id").to_numpy(), kind="stable")
        v, ids = v[order], table.column("id").to_numpy()[order]
        centre = v.mean(0)
        radius = float(np.sqrt(((v - centre) ** 2).sum(1)).max()) if v.shape[1] else 0.0
        cells = [table.column("list").slice(0, 1), table.column("part").slice(0, 1), table.column("d").slice(0, 1), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([centre.tobytes()], pa.binary()), pa.array([radius])]
        return pa.table(cells, ["list", "part", "d", "ids", "v", "centre", "radius"])

    part = F.pmod(F.xxhash64("id"), F.coalesce(F.try_element_at(parts, F.col("list")), F.lit(1))).cast("int")
    return rows.select("list", "id", "d", "v", part.alias("part")).groupBy("list", "part").applyInArrow(run, "list int, part int, d int, ids binary, v binary, centre binary, radius double")


def _matrix(ids: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(v, "<f8").reshape(len(ids), -1)


def nearest_by_lists(vectors: DataFrame, queries: DataFrame, k: int, skip_self: bool = False, lists: int | None = None, probes: int | None = None) -> DataFrame:
    """(query_id, id, distance, rank) of queries (query_id, v) among vectors (id, v)."""
    spark = vectors.sparkSession
    n = vectors.count()
    sent = spark.sparkContext.broadcast(centres_of(vectors, n, lists))  # at most MOST_LISTS centres a size
    own, own_path = written_at(listed(vectors, "id", sent), "listed")
    asked, asked_path = written_at(listed(queries, "query_id", sent), "asked")
    told = own.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.sum(F.length("v")).alias("held")).collect()  # as many rows as lists
    by_list = {r["list"]: (r["n"], r["far"]) for r in told}
    by_query = {r["list"]: r["count"] for r in asked.groupBy("list").count().collect()}
    held, sought = sum(r["held"] for r in told), asked.agg(F.sum(F.length("v"))).first()[0] or 0
    size = lambda x: max(LEAST_BYTES, min(SLOT_BYTES, int(x / (2 * spark.sparkContext.defaultParallelism) ** 0.5)))
    slots, groups = max(1, min(-(-held // size(held)), len(by_list))), max(1, -(-sought // size(sought)))
    cuts = dict.fromkeys(range(slots), 0)
    for r in told:
        cuts[r["list"] % slots] += r["held"]
    cuts = {x: max(1, -(-b // (2 * size(held)))) for x, b in cuts.items()}

    # Blocks and buckets are made where they are used: read from Parquet, thousands of such rows would be in memory at once.
    buckets = packed(own, {x: n for x, (n, _) in by_list.items()}, BUCKET).withColumns({"b_ids": F.col("ids"), "b_v": F.col("v")}).drop("ids", "v")
    blocks = packed(asked, by_query, BLOCK).withColumn("block", F.shiftleft(F.col("list").cast("long"), 31) + F.col("part"))
    one = buckets.where("part = 0").select(F.col("list").alias("l"), "b_ids", "b_v")
    met = blocks.join(one, blocks["list"] == one["l"], "left").select("block", "d", "ids", "v", "b_ids", "b_v")
    needy = met.mapInArrow(_needs(sent, by_list, slots, k, skip_self, probes), "block long, slot int, need array<int>, ids binary, v binary, most binary")
    left, right = _tiles(needy, buckets, cuts, groups)
    found = left.groupBy(*TILE).cogroup(right.groupBy(*TILE)).applyInArrow(_searched(k, skip_self), "query_id long, id long, distance double")
    out = written(found, "found")
    release(spark, own_path, asked_path)
    return best_ranked(out, k)


TILE = ("slot", "cut", "group")


def _tiles(needy: DataFrame, buckets: DataFrame, cuts: dict[int, int], groups: int) -> tuple[DataFrame, DataFrame]:
    """Blocks once for each cut of their slots, and buckets once for each group of blocks; both dealt by tile."""
    number = F.element_at(F.create_map(*(F.lit(x) for item in cuts.items() for x in item)), F.col("slot"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = needy.withColumns({"group": F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")}).withColumn("cut", every(number))
    right = buckets.withColumn("slot", F.pmod("list", F.lit(len(cuts))).cast("int")).withColumn("cut", F.pmod(F.xxhash64("list", "part"), number).cast("int")).withColumn("group", every(F.lit(groups)))
    parts = min(MOST_PARTS, 4 * groups * sum(cuts.values()))
    return left.select(*TILE, "block", "need", "ids", "v", "most").repartition(parts, *TILE), right.select(*TILE, "list", "b_ids", "b_v", "centre", "radius").repartition(parts, *TILE)


def _searched(k: int, skip_self: bool):
    """A tile: its blocks, one after the other, meet its buckets that they need."""
    search = _searching(k, skip_self)

    def rows(table: pa.Table) -> list[pa.RecordBatch]:
        return [b.slice(i, 1) for b in table.to_batches() for i in range(b.num_rows)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        buckets = [(b.column("list")[0].as_py(), b) for b in rows(right)]

        def pairs() -> Iterator[pa.RecordBatch]:
            for a in rows(left):
                need = set(a.column("need")[0].as_py())
                for x, b in buckets:
                    if x in need:
                        yield pa.RecordBatch.from_arrays([*(a.column(c) for c in ("block", "ids", "v", "most")), *(b.column(c) for c in ("b_ids", "b_v", "centre", "radius"))], ["key", "ids", "v", "most", "b_ids", "b_v", "centre", "radius"])

        return pa.Table.from_batches(list(search(pairs())), pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())]))

    return run


def _met(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, far: np.ndarray, who: np.ndarray, skip_self: bool, most: np.ndarray | None = None) -> None:
    """`closest` for some queries at a time: the pairs of a whole block and a bucket take many times as much as both."""
    for at in range(0, len(q), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        closest(q_ids[some], q[some], ids, v, far[some], who[some], skip_self, None if most is None else most[some])


def _gaps(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of each query to each centre, by sums of squares of some queries at a time."""
    step = max(1, GAP_BYTES // (8 * max(1, c.size)))
    return np.concatenate([np.sqrt(((q[i : i + step, None] - c[None]) ** 2).sum(2)) for i in range(0, len(q), step)] or [np.zeros((0, len(c)))])


def _needs(sent, by_list: dict[int, tuple[int, float]], slots: int, k: int, skip_self: bool, probes: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for block, d, ids, v, b_ids, b_v in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                q_ids, q = _matrix(ids, v)
                far, who = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
                if b_ids is not None:
                    _met(q_ids, q, *_matrix(b_ids, b_v), far, who, skip_self)
                most = far[:, k - 1]
                if d in sent.value:
                    first, c = sent.value[d]
                    held = [i for i in range(len(c)) if first + i in by_list]
                    radius = np.array([by_list[first + i][1] for i in held])
                    gap = _gaps(q, c[held])
                    if probes is None:
                        use = (gap - radius <= np.sqrt(most)[:, None] * (1 + 1e-9) + 1e-9).any(0)
                    else:
                        use = np.zeros(len(held), bool)
                        use[np.argsort(gap, 1)[:, :probes].ravel()] = True
                    need = [first + i for i, u in zip(held, use.tolist(), strict=True) if u]
                else:
                    need = [-1 - d] if -1 - d in by_list else []
                edge = (most if probes is None else np.full(len(q), np.inf)).astype("<f8").tobytes()
                for slot in sorted({x % slots for x in need}):  # a row at a time, as each holds the block once more
                    row = block, slot, [x for x in need if x % slots == slot], ids, v, edge
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["block", "slot", "need", "ids", "v", "most"])
        trim()

    return run


def _searching(k: int, skip_self: bool):
    """Rows of a block and a bucket, the blocks one after the other, to the k best vectors of each query for the slot."""

    def told(q_ids: np.ndarray, far: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
        row, place = np.nonzero(np.isfinite(far))
        return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(who[row, place]), pa.array(far[row, place])], ["query_id", "id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for key, ids, v, most, b_ids, b_v, centre, radius in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if key != now:
                    if now is not None:
                        yield told(q_ids, far, who)
                    now = key
                    q_ids, q = _matrix(ids, v)
                    limit = np.frombuffer(most, "<f8")
                    far, who = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
                centre = np.frombuffer(centre, "<f8")
                edge = np.sqrt(np.minimum(limit, far[:, k - 1]))
                near = np.flatnonzero(np.sqrt(((q - centre) ** 2).sum(1)) - radius <= edge * (1 + 1e-9) + 1e-9)
                if len(near):
                    some, names = far[near], who[near]
                    _met(q_ids[near], q[near], *_matrix(b_ids, b_v), some, names, skip_self, limit[near] * (1 + 1e-9) + 1e-12)
                    far[near], who[near] = some, names
        if now is not None:
            yield told(q_ids, far, who)
        trim()

    return run
