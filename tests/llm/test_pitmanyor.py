"""The Pitman-Yor model: counts and base scores against brute force, seating against enumerated partitions."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from finsift.llm import pitmanyor as P

SCHEMA = "doc_id long, text string, held string, word int, part string"


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x20\x09-\x0d]+", text or "")] + [None]


def brute(rows):
    """(held_out, tokens, known, training tokens, base score) by document."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, t in rows:
        w = words(t)
        out[i] = (held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))
    return out


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]
        yield [[items[0]], *rest]


def test_stirling_numbers_count_seatings():
    d = 0.4
    table = np.exp(P.log_stirling(d, 8))
    for c in range(1, 8):
        by = Counter()
        for p in partitions(list(range(c))):
            by[len(p)] += math.prod(math.prod(k - d for k in range(1, len(t))) for t in p)
        assert all(abs(table[c, t] - by[t]) < 1e-9 * by[t] for t in range(1, c + 1))


def exact(c, others, h, theta, d):
    logs = np.array([P.log_stirling(d, max(c, P.EXACT))[c, t] + sum(math.log((theta + d * (others + i)) * h) for i in range(t)) for t in range(1, c + 1)])
    weight = np.exp(logs - logs.max())
    return weight / weight.sum()


@pytest.mark.parametrize(("c", "others", "h", "theta", "d"), [(2, 3, 0.2, 1.0, 0.5), (5, 0, 0.5, 3.0, 0.3), (40, 100, 0.01, 10.0, 0.7), (400, 50, 0.05, 5.0, 0.5)])
def test_tables_follow_the_conditional(c, others, h, theta, d):
    n = 40_000
    t = P.drawn(np.full(n, c), np.full(n, others), np.full(n, h), theta, d, np.random.default_rng(1).random(n))
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / n - exact(c, others, h, theta, d)).max() < 0.01


@pytest.mark.parametrize(("others", "h", "theta", "d"), [(50, 0.05, 5.0, 0.5), (2000, 0.1, 1.0, 0.7), (3, 0.3, 100.0, 0.2)])
def test_many_customers_by_the_limit_law(others, h, theta, d):
    n, c = 4000, 1500
    t = P.drawn(np.full(n, c), np.full(n, others), np.full(n, h), theta, d, np.random.default_rng(2).random(n))
    p = exact(c, others, h, theta, d)
    mean = (p * np.arange(1, c + 1)).sum()
    assert t.min() >= 1 and t.max() <= c and abs(t.mean() - mean) < 0.1 * mean


def test_log_gamma_and_strength():
    x = np.array([0.05, 0.5, 1.0, 7.3, 1e6])
    assert np.allclose(P.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    told = P.strength_likelihood(np.array([4, 0, 9]), np.array([2, 0, 3]), 0.5)
    for theta, got in zip(P.GRID, told, strict=True):
        want = sum(sum(math.log(theta + 0.5 * i) for i in range(1, t)) - sum(math.log(theta + i) for i in range(1, c)) for c, t in ((4, 2), (9, 3)))
        assert abs(got - want) < 1e-6


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    after = {w: draw.sample([f"w{j}" for j in range(60)], 3) for w in (f"w{j}" for j in range(60))}
    rows = []
    for i in range(400):
        w = draw.choice(list(after))
        text = [w]
        for _ in range(draw.randrange(5, 60)):
            w = draw.choice(after[w])
            text.append(w.upper() if draw.random() < 0.1 else w)
        rows.append((i, draw.choice([" ", "\n", "\t"]).join(text)))
    return [*rows, (1000, None), (1001, ""), (1002, " \n "), (1003, "never seen words é Ü"), (None, "w1 w2"), (1004, "w1 " * 50_000)]


def test_counts_and_base(spark, corpus, tmp_path):
    docs = spark.createDataFrame([(i, t, "x", 1, None) for i, t in corpus], SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.op12_lm_scoring(spark, str(tmp_path)).collect()
    got = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows}
    assert got == brute(corpus)
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    # The next word is one of three, or the end: far below the unigram's perplexity of about 60 on held-out texts.
    tokens, model, base = (sum(x) for x in zip(*((r.n_tokens, r.score, r.base_score) for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400), strict=True))
    assert 10 ** (-model / tokens) < 5 and 10 ** (-base / tokens) > 30


def test_probabilities_add_up(spark):
    """All one-word continuations of a context, the end and a new word, from texts that differ in the last word alone."""
    rows = [(i, t) for i, t in enumerate(["a b a c", "a b a b", "c a", "b b b a", "a"] * 3)]
    train = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.lit(False))
    asked = spark.createDataFrame([(100 + k, f"c a {w}") for k, w in enumerate(["a", "b", "c", "new"])] + [(200, "c a")], "doc_id long, text string").withColumn("held", F.lit(True))
    got = {r.doc_id: 10**r.score for r in P.score(train.unionByName(asked), F.col("held")).collect() if r.held_out}
    # p(text) = p(c a ..) * p(w | a) * p(end | w); the end's share for a text of its own is known from the text "c a".
    ends = spark.createDataFrame([(300 + k, w) for k, w in enumerate(["a", "b", "c", "new"])] + [(400 + k, f"{w} {v}") for k, (w, v) in enumerate(itertools.product(["a", "b", "c", "new"], repeat=2))], "doc_id long, text string").withColumn("held", F.lit(True))
    assert 0 < sum(got[100 + k] for k in range(4)) + got[200] < 1
    more = {r.doc_id: 10**r.score for r in P.score(train.unionByName(ends), F.col("held")).collect() if r.held_out}
    first = [more[300 + k] for k in range(4)]
    assert all(p > 0 for p in first) and sum(more.values()) < 1


def test_copies_score_alike_and_hot_contexts_are_split(spark, monkeypatch):
    monkeypatch.setattr(P, "SAMPLE", 1)
    draw = random.Random(4)
    rows = [(i, " ".join(f"the w{draw.randrange(200)}" for _ in range(40))) for i in range(120)]
    rows += [(i + 1000, t) for i, t in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held", F.col("doc_id") % 5 == 1)
    parts, hot = P.layout(docs)
    the = P.pairs_of(*P.raw(P.pa.array(["the x"])))[0][1]
    assert the in hot and len(hot) <= 4 * parts
    told = {r.doc_id: r.score for r in P.score(docs, F.col("held")).collect()}
    assert len(told) == len(rows) and all(abs(told[i] - told[i + 1000]) < 1e-6 for i in range(20))
    monkeypatch.setattr(P, "layout", lambda d: (3, np.zeros(0, np.uint64)))
    whole = {r.doc_id: r.score for r in P.score(docs, F.col("held")).collect()}
    assert all(abs(told[i] - whole[i]) < 0.02 * abs(whole[i]) for i in told)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.score(docs, F.lit(False)).count() == 0
    one = P.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens, one.base_score, one.score) == (3, 0, 0, 0.0, 0.0)


def test_tasks_hold_little(monkeypatch):
    """What a task makes beside its part, and what it sends at once, by the numbers of pairs and bytes."""
    monkeypatch.setattr(P, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    w = np.random.default_rng(5).integers(0, 30_000, 500_000)
    texts = pa.array([" ".join(map(str, w[i : i + 500])) for i in range(0, len(w), 500)])
    batch = pa.record_batch([pa.array(range(len(texts))), texts, pa.array([i % 7 == 2 for i in range(len(texts))])], ["doc_id", "text", "held"])
    task = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda run, _: list(run(iter([batch])))))

    def most(f):
        tracemalloc.start()
        out = f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    none = np.zeros(0, np.uint64)
    many, peak = most(lambda: P.sent(task, 12, none, True))
    assert max(x.nbytes for x in many) < 3 << 20 and peak < 60 * len(w)
    whole = pa.Table.from_batches(P.sent(task, 1, none, True))
    pairs = sum((len(x) - 1) // x[0] for x in whole["trained"].to_pylist())
    pair_of, peak = most(lambda: P.Pairs.of(whole))
    assert len(pair_of.back) == pairs and peak < 85 * pairs
    made, peak = most(lambda: list(P.opened(whole, none)))
    assert peak < 90 * pairs
    made = pa.Table.from_batches(made).to_pylist()
    n = np.array([r["n"] for r in sorted((r for r in made if r["asks"] is not None), key=lambda r: r["word"] % 2**64)])
    heavy = len(P.wide(next(r["stored"] for r in made if r["stored"])[0]))
    known = pa.table({"answers": [[P.small(n), np.full(len(n), 1e-5, "<f4").tobytes()]], "stored": [[P.small(np.ones(heavy, np.int64))]]})
    told, peak = most(lambda: list(P.part_scores(whole, known, [1.0], 0.5, [{}])))
    assert sum(P.wide(x["tokens"][0].as_py()).sum() for x in told) == len(w) + len(texts) and peak < 100 * pairs


def test_score_leaves_batches_of_whole_texts_small(spark):
    """The caller writes the result, and with it the texts are sent once more."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "10000")
    try:
        P.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(False))
        assert int(spark.conf.get(rows)) <= 1000
    finally:
        spark.conf.set(rows, before)
