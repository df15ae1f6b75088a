"""Tables with keys: merges against brute force, a failed write, two writers, and stores that a second run leaves alone."""

import pytest
from pyspark.sql import functions as F

from finsift.plans import run
from finsift.sources import readers
from finsift.sources.merge import MergeTable

SCHEMA = "label string, name string, props map<string,string>, n int, at int"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def told(table, version=None):
    return {(r.label, r.name): ({k: v for k, v in sorted(r.props.items())} if r.props is not None else None, r.n) for r in table.read(version).collect()}


def test_fill_and_replace(spark, tmp_path):
    t = MergeTable(spark, f"file://{tmp_path}/t", ["label", "name"], 4)
    assert t.read() is None and t.count() == 0 and t.merge(rows(spark).limit(0)) == 0
    first = rows(spark, ("A", "x", {"p": "1", "q": "2"}, 1, 1), ("A", "x", {"p": "3", "r": None}, None, 2), ("B", None, None, 5, 1), *(("C", f"n{i}", {"i": str(i)}, i, 1) for i in range(40)))
    assert t.merge(first, "fill", "at") == 1
    assert told(t)["A", "x"] == ({"p": "3", "q": "2", "r": None}, 1) and told(t)["B", None] == ({}, 5) and t.count() == 42
    before = t.manifest()["folders"]
    assert t.merge(rows(spark, ("A", "x", {"q": None, "s": "9"}, 7, 1), ("B", None, {"z": "1"}, None, 1)), "fill", "at") == 2
    assert told(t)["A", "x"] == ({"p": "3", "q": "2", "r": None, "s": "9"}, 7) and told(t)["B", None] == ({"z": "1"}, 5) and t.count() == 42
    moved = [b for b, f in t.manifest()["folders"].items() if before[b] != f]
    assert 1 <= len(moved) <= 2 and told(t, 1)["A", "x"][1] == 1
    t.merge(rows(spark, ("A", "x", {"q": "1"}, None, 1), ("A", "x", {"q": "2"}, None, 5)), "replace", "at")
    assert told(t)["A", "x"] == ({"q": "2"}, None) and t.count() == 42
    t.merge(t.read().withColumn("at", F.lit(1)), "replace", "at")  # every bucket
    assert t.vacuum() >= 1 and t.count() == 42 and t.versions() == [4] and len(set(t.manifest()["folders"].values())) == 1


def test_a_failed_write_changes_nothing(spark, tmp_path):
    t = MergeTable(spark, f"file://{tmp_path}/t", ["label", "name"], 4)
    t.merge(rows(spark, ("A", "x", {"p": "1"}, 1, 1)))
    bad = rows(spark, ("A", "x", {"p": "2"}, 2, 1)).withColumn("n", F.when(F.col("n") == 2, F.raise_error("broken")).otherwise(F.col("n")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        t.merge(bad)
    assert t.versions() == [1] and told(t)["A", "x"] == ({"p": "1"}, 1)


def test_two_writers(spark, tmp_path, monkeypatch):
    t, other = (MergeTable(spark, f"file://{tmp_path}/t", ["label", "name"], 4) for _ in range(2))
    t.merge(rows(spark, ("A", "x", {"p": "1"}, 1, 1)))
    old = other.manifest()
    t.merge(rows(spark, ("A", "y", {"p": "1"}, 1, 1)))
    monkeypatch.setattr(other, "manifest", lambda version=None: old)
    with pytest.raises(Exception, match="exist"):
        other.merge(rows(spark, ("A", "z", {"p": "1"}, 1, 1)))
    assert {k[1] for k in told(t)} == {"x", "y"}


def test_new_columns(spark, tmp_path):
    t = MergeTable(spark, f"file://{tmp_path}/t", ["k"], 2)
    t.merge(spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"))
    t.merge(spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, y double"), "fill")
    assert sorted(map(tuple, t.read().select("k", "x", "y").collect())) == [(1, "a", None), (2, "b", 5.0), (3, None, 6.0)]


def test_second_run_leaves_the_same_store(spark, tmp_path):
    folder, store = tmp_path / "in", f"file://{tmp_path}/store"
    folder.mkdir()
    for i, text in enumerate(["Acme Corp. acquired Beta Inc. for $5 million in fraud.", "Nothing here. John concealed a restatement.", "A shell company of Gamma Ltd. in 2020."]):
        (folder / f"{'Fraud' if i % 2 else 'NonFraud'}_{i}_20230101_{i}.txt").write_text(text)
    one = run.run_documents(spark, str(folder), store, batch="b")
    tables = {t: sorted(map(str, run.stored(spark, store, t).read().drop("processing_metadata", "metadata").collect())) for t in run.TABLES}
    counts = run.status(spark, store)
    assert run.run_documents(spark, str(folder), store) == one and run.status(spark, store) == counts
    assert counts["chunks"] == 3 == counts["formatted"] and counts["vertices"] == one["nodes"] and counts["edges"] == one["edges"]
    for t in ("chunks", "vertices", "edges", "documents"):
        assert sorted(map(str, run.stored(spark, store, t).read().drop("processing_metadata", "metadata").collect())) == tables[t]
    (folder / "Fraud_1_20230101_1.txt").write_text("Nothing at all.")
    run.run_documents(spark, str(folder), store)
    assert run.status(spark, store)["chunks"] == 3 and readers.VectorStore(spark, f"{store}/chunks").get(text="Nothing at all.").count() == 1
    assert run.rescore(spark, store).count() == 3
