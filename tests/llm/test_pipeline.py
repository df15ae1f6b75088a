"""The pipeline's stages on null and repeated ids."""

import os

import pytest

import corpus_pipeline


def test_near_duplicates_with_null_and_repeated_ids(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(60)) for w in ("a", "b", "c", "d"))
    rows = [(1, one), (1, one), (2, one), (3, two + " more"), (None, two), (None, three), (None, three), (4, four), (4, one + " end"), (5, None)]
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df.repartition(3), "").collect()
    assert sorted(((r.doc_id or 0, r.text or "") for r in got)) == sorted([(1, one), (3, two + " more"), (0, three), (4, four), (5, "")])


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def test_stages_on_odd_rows(spark):
    """Each stage on nulls, empty texts, repeated rows and a column of its own; and on an empty table."""
    prose = "the house of the garden and the tree were there and it is a long way to the river in the north of the land "
    rows = [(i, (prose + f"number{i} word{i} thing{i} ") * 3, "en", "web", 1, "x") for i in range(8)]
    rows += [rows[0], (None, rows[1][1], "en", None, None, None), (50, None, "en", "web", 0, "x"), (51, "", None, "web", 0, "x"), (52, "12345 67890", "en", "web", 0, "x")]
    df = spark.createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        got = out.collect()
        if name == "packing":
            assert {r.doc_id for r in got} >= {0, 50, 51, None}
        else:
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "language_id":
            assert {r.doc_id for r in got} == {*range(8), None} and len(got) == 10
        if name == "line_dedup":
            assert len(got) == len(rows)
        assert stage(spark, df.limit(0), "").count() == 0


def test_whole_pipeline_keeps_clean_documents(spark):
    rng = __import__("numpy").random.default_rng(4)
    stop = "the of and to in a is that it for".split()

    def prose():
        return " ".join(w for _ in range(60) for w in (stop[rng.integers(10)], "".join(chr(97 + c) for c in rng.integers(0, 26, 6))))

    texts = [prose() for _ in range(12)]
    rows = [(i, t, "en", "web", len(t), "") for i, t in enumerate(texts)] + [(100, texts[0], "en", "web", 1, ""), (101, texts[1] + " more", "en", "web", 1, "")]
    docs = spark.createDataFrame(rows, COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
    assert sorted(r.doc_id for r in docs.collect()) == list(range(12))


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept of a whole table, against the plain way to do it."""
    import duckdb

    from finsift.llm import quality
    from finsift.llm._shared import written
    from tests.llm.test_operators import check_pieces, line_brute, sets

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    kept = written(corpus_pipeline.language_id(spark, docs, SF), "kept")
    own, told = texts(docs), texts(kept)
    assert all(told[i] == own[i] for i in told) and not any(t and any(c.isalpha() for c in t) and i not in told and len(t) > 200 for i, t in own.items())
    judged = written(corpus_pipeline.quality_rules(spark, kept, SF), "judged")
    con = duckdb.connect()
    con.register("documents", kept.toPandas())
    assert set(texts(judged)) == {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.oracle()}) WHERE kept").fetchall()}
    cleaned = written(corpus_pipeline.line_dedup(spark, judged, SF), "cleaned")
    assert texts(cleaned) == line_brute(texts(judged), 5)
    alone = written(corpus_pipeline.near_duplicates(spark, cleaned, SF), "alone")
    own = {i: sets(t) for i, t in texts(cleaned).items()}
    first = {i: i for i in own}
    for a in sorted(own):
        for b in sorted(own):
            if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]):
                first = {i: min(first[a], first[b]) if c in (first[a], first[b]) else c for i, c in first.items()}
    assert set(texts(alone)) == {i for i, c in first.items() if i == c}
    check_pieces(corpus_pipeline.pack(spark, alone, SF), texts(alone), 2048)


def test_stages_send_small_batches_to_python(spark):
    """Also where the caller writes what a stage returns; the languages are learnt from blocks of texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    df = spark.createDataFrame([(i, f"a text of some words {i}", "en", "web", 9, "x") for i in range(4)], COLUMNS)
    for key, stage in corpus_pipeline.STAGES:
        if key != "quality_rules":
            spark.conf.set(name, "10000")
            stage(spark, df, "")
            assert int(spark.conf.get(name)) <= 1000
    spark.conf.unset(name)


def test_language_counts_take_little_memory():
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    from finsift.llm import langid

    text = ["".join(chr(97 + (i * i + j * j * 7) % 26) for j in range(2000)) for i in range(700)]
    tracemalloc.start()
    told = list(langid.count_grams(iter([pa.RecordBatch.from_arrays([pa.array(text), pa.array(["en"] * 700)], ["t", "lang"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = Counter()
    for batch in told:
        for code, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            got[code] += n
    whole = Counter(int.from_bytes(x[i : i + n].encode(), "big") for x in text for n in langid.GRAMS for i in range(len(x) - n + 1))
    assert got == whole and peak < 64 << 20
