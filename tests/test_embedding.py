"""The fitted encoder: directions of an exact SVD, near copies above unrelated texts, saving."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from finsift.operators import embedding as E


def corpus():
    draw = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(30)] for k in range(6)]
    return [" ".join(draw.choice(topics[i % 6]) if draw.random() < 0.8 else f"c{draw.randrange(40)}" for _ in range(60)) for i in range(180)]


def test_directions_equal_an_exact_svd(spark):
    texts = corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    enc = E.fitted_encoder(docs, dims=5, buckets=512)
    lists = docs.select(E.buckets_of(F.col("text"), 512).alias("b")).toArrow().column("b").combine_chunks()
    a = np.zeros((len(texts), 512))
    for s, r, b, w in E.weighted(lists, enc.idf):
        a[s][r, b] = w
    df = (a > 0).sum(0)
    assert np.allclose(enc.idf[df > 0], (np.log(181 / (1 + df)) + 1)[df > 0]) and np.allclose((a * a).sum(1), 1)
    v = np.linalg.svd(a)[2][:5].T
    # The strongest directions span nearly the same space.
    assert np.linalg.svd(v.T @ enc.axes)[1].min() > 0.97
    assert np.allclose(E.times(len(texts), *np.nonzero(a), a[np.nonzero(a)], enc.axes), a @ enc.axes)


def test_near_copies_rank_first(spark, tmp_path):
    texts = corpus()
    copies = [" ".join(w for i, w in enumerate(t.split()) if i % 10) for t in texts[:30]]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(copies)] + [(5000, None), (5001, ""), (5002, "Ünknown !!!")]
    docs = spark.createDataFrame(rows, "id long, text string")
    enc = E.fitted_encoder(docs, dims=24, buckets=4096)
    enc.save(spark, f"file://{tmp_path}/e")
    again = E.Encoder.load(spark, f"file://{tmp_path}/e")
    got = {r.id: np.array(r.v) for r in docs.select("id", again.column(F.col("text")).alias("v")).collect()}
    assert all(len(v) == 24 for v in got.values()) and not got[5000].any() and not got[5001].any()
    x = np.stack([got[i] for i in range(180)])
    assert np.mean([int((x @ got[1000 + i]).argmax()) == i for i in range(30)]) > 0.9
    same = np.mean([(x[i] @ x[(i + 6) % 180]) for i in range(180)])
    other = np.mean([(x[i] @ x[(i + 1) % 180]) for i in range(180)])
    assert same > 0.5 > 0.2 > other


def test_empty(spark):
    docs = spark.createDataFrame([], "text string")
    enc = E.fitted_encoder(docs, dims=4, buckets=64)
    assert enc.axes.shape == (64, 4) and docs.select(enc.column(F.col("text"))).count() == 0
    assert list(E.weighted(pa.array([], pa.list_(pa.int32())), enc.idf)) == []


def test_products_are_added_by_bucket():
    import numpy as np

    rng = np.random.default_rng(4)
    row, bucket, w, y = np.sort(rng.integers(0, 9, 200)), rng.integers(0, 30, 200), rng.random(200), rng.normal(size=(9, 5))
    total = rng.normal(size=(32, 5))
    wanted = total.copy()
    np.add.at(wanted, bucket, w[:, None] * y[row])
    E.spread(total, row, bucket, w, y)
    assert np.allclose(total, wanted)
    E.spread(total, row[:0], bucket[:0], w[:0], y)
    assert np.allclose(total, wanted)
