"""Nearest neighbours by lists against brute force: ties, repeats, sizes, one full list; recall of few lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from finsift.operators import lists as L
from finsift.operators import vectors as V


def brute(rows, asked, k, skip_self):
    out = []
    for q, x in asked:
        far = []
        for i, y in rows:
            if len(x) == len(y) and not (skip_self and q == i):
                total = 0.0
                for a, b in zip(x, y, strict=True):
                    total += (a - b) * (a - b)
                far.append((total, i))
        out += [(q, i, d, r + 1) for r, (d, i) in enumerate(sorted(far)[:k])]
    return sorted(out)


@pytest.mark.parametrize("skip_self", [False, True])
def test_equals_brute_force(spark, monkeypatch, skip_self):
    monkeypatch.setattr(L, "BUCKET", 20)
    monkeypatch.setattr(L, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.3, (60, 3)) for c in (0, 3, 7)] + [np.full((90, 3), 1.5)])  # a third are equal
    rows = [(i, r.tolist()) for i, r in enumerate(np.round(x, 2))] + [(900, [1.0, 2.0]), (901, [1.0, 2.5]), (902, [4.0]), (903, [])]
    asked = [r for r in rows if r[0] % 3 == 0] + [(5000, [100.0, 0.0, 0.0]), (5001, [1.0, 2.2])]
    frame = lambda r, name: spark.createDataFrame(r, f"{name} long, v array<double>").repartition(3)
    got = L.nearest_by_lists(frame(rows, "id"), frame(asked, "query_id"), 4, skip_self)
    assert sorted((r.query_id, r.id, r.distance, r["rank"]) for r in got.collect()) == brute(rows, asked, 4, skip_self)
    none = frame(rows, "id").limit(0)
    assert L.nearest_by_lists(none, frame(asked, "query_id"), 4).count() == 0
    assert L.nearest_by_lists(frame(rows, "id"), frame(asked, "query_id").limit(0), 4).count() == 0


def test_lists_are_skipped_and_few_suffice(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 6
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    whole = V.nearest_batch(df, df, 5, skip_self=True, block=10)
    exact = {(r.query_id, r.vec_id) for r in whole.collect()}
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(gap, np.inf)
    assert exact == {(q, int(i)) for q in range(4000) for i in np.argsort(gap[q])[:5]}
    given = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = given.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    some = {(r.query_id, r.id) for r in L.nearest_by_lists(given, asked, 5, skip_self=True, probes=4).collect()}
    want = {p for p in exact if p[0] % 10 == 0}
    assert len(some & want) >= 0.9 * len(want)
    sent = spark.sparkContext.broadcast(L.centres_of(given, 4000))
    bounds = {r["list"]: (r["n"], r["far"]) for r in L.listed(given, "id", sent).groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    one = L.packed(L.listed(asked.withColumnRenamed("query_id", "id"), "id", sent), {}, 256).limit(5)
    own = L.packed(L.listed(given, "id", sent), {}, 1024)
    met = one.join(own.select(F.col("list").alias("l"), F.col("ids").alias("b_ids"), F.col("v").alias("b_v")), F.col("list") == F.col("l")).select(F.lit(1).cast("long"), "d", "ids", "v", "b_ids", "b_v")
    needs = met.mapInArrow(L._needs(sent, bounds, 1, 5, True, None), "block long, slot int, need array<int>, ids binary, v binary, most binary").select(F.size("need")).collect()
    assert all(r[0] < 0.7 * len(bounds) for r in needs)


def test_copies_are_compared_in_bounded_parts(spark, monkeypatch):
    """A block of copies against a bucket of copies makes pairs of all rows, of which a task holds PAIRS differences at a time."""
    monkeypatch.setattr(V, "PAIRS", 100)
    sizes = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            out = super().__getitem__(at)
            if isinstance(at, np.ndarray) and out.ndim == 2:
                sizes.append(len(out))
            return out

    x = np.ones((50, 3)).view(Seen)
    far, who = np.full((50, 2), np.inf), np.full((50, 2), np.iinfo(np.int64).max)
    V.closest(np.arange(50), x, np.arange(50), x, far, who, True)
    assert (far == 0).all() and who.tolist() == [[1, 2], [0, 2]] + [[0, 1]] * 48
    assert sizes and max(sizes) <= 100


def test_a_block_and_a_bucket_take_little_memory():
    """Many near copies, so that all pairs count: results as by one product, in a fraction of its memory."""
    import tracemalloc

    import pyarrow as pa

    from finsift.operators import lists
    from finsift.operators.vectors import closest

    rng = np.random.default_rng(5)
    q, v = np.round(rng.normal(size=(1024, 64)), 1), np.round(rng.normal(size=(1024, 64)), 1)
    q[:512] = v[:512] = q[0]
    ids, other = np.arange(1024), np.arange(1024) + 512
    most = np.full(1024, 1e9)
    row = [7, ids.astype("<i8").tobytes(), q.tobytes(), most.tobytes(), other.astype("<i8").tobytes(), v.tobytes(), v.mean(0).tobytes(), 1e9]
    batch = pa.RecordBatch.from_arrays([pa.array([x]) for x in row], list("abcdefgh"))
    tracemalloc.start()
    got = pa.Table.from_batches(lists._searching(5, True)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    far, who = np.full((1024, 5), np.inf), np.full((1024, 5), np.iinfo(np.int64).max)
    closest(ids, q, other, v, far, who, True)
    assert got.column("id").to_numpy().tolist() == who.ravel().tolist() and got.column("distance").to_numpy().tolist() == far.ravel().tolist()
    assert peak < 16 << 20


def test_tiles_are_bounded_also_for_one_full_list(spark, monkeypatch):
    """Vectors of one list and of many, in tiles of a few kB: the rows of brute force, and no tile holds many times the bound."""
    monkeypatch.setattr(L, "BUCKET", 20)
    monkeypatch.setattr(L, "BLOCK", 20)
    monkeypatch.setattr(L, "SLOT_BYTES", 4096)
    monkeypatch.setattr(L, "LEAST_BYTES", 4096)
    rng = np.random.default_rng(3)
    x = np.vstack([np.full((700, 3), 1.5), np.round(rng.normal(size=(200, 3)), 1)])
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(2000, [1.0]), (2001, [3.0])]
    made, tiles = [], L._tiles
    monkeypatch.setattr(L, "_tiles", lambda *a: made.append(tiles(*a)) or made[-1])
    monkeypatch.setattr(L, "release", lambda *a: None)
    frame = lambda name: spark.createDataFrame(rows, f"{name} long, v array<double>").repartition(3)
    got = L.nearest_by_lists(frame("id"), frame("query_id"), 3, True)
    assert sorted((r.query_id, r.id, r.distance, r["rank"]) for r in got.collect()) == brute(rows, rows, 3, True)
    for side, v in zip(made[0], ("v", "b_v"), strict=True):
        sizes = [r[0] for r in side.groupBy(*L.TILE).agg(F.sum(F.length(v))).select("sum(length(%s))" % v).collect()]
        assert len(sizes) > 4 and max(sizes) < 4 * 4096


def test_queries_of_a_block_are_merged_at_once(monkeypatch):
    """Not query by query: one sort for all that a bucket's vectors come near, with the rows of a sort of each."""
    rng = np.random.default_rng(4)
    q, v = np.round(rng.normal(size=(60, 3)), 1), np.round(rng.normal(size=(300, 3)), 1)
    far, who = np.full((60, 4), np.inf), np.full((60, 4), np.iinfo(np.int64).max)
    calls, sort = [], np.lexsort
    monkeypatch.setattr(V.np, "lexsort", lambda keys: calls.append(1) or sort(keys))
    for at in range(0, 300, 100):
        V.closest(np.arange(60), q, np.arange(at, at + 100), v[at : at + 100], far, who, True)
    assert len(calls) == 3
    asked = [(i, x.tolist()) for i, x in enumerate(q)]
    want = brute([(i, x.tolist()) for i, x in enumerate(v)], asked, 4, True)
    assert sorted((i, int(who[i, r]), float(far[i, r]), r + 1) for i in range(60) for r in range(4)) == want
