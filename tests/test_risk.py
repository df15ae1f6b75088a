"""Golden scores, and operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from finsift.functions import numeric, text
from finsift.operators import graph, metrics, ml, risk, stats, vectors


def component_row(spark, fraud, entity, financial, relationship):
    from finsift.functions import lexicon as L

    df = spark.createDataFrame([(fraud, entity, financial, relationship)], "f double, e double, m double, r double")
    return df.select(F.round(F.expr(L.sql_overall("f", "e", "m", "r")), 2).alias("s")).first()["s"]


@pytest.mark.parametrize(
    ("parts", "overall"),
    [((0.25625, 0.45, 0.30, 1.0), 42.72), ((0.28333333, 0.45, 0, 0), 21.17), ((0.2, 0, 0, 0), 7.0), ((0, 0, 0.3, 0), 7.5), ((0, 0, 0, 1.0), 15.0)],
)
def test_overall_scores(spark, parts, overall):
    assert component_row(spark, *map(float, parts)) == pytest.approx(overall, abs=0.006)


def test_one_low_term_scores_seven(spark):
    docs = spark.createDataFrame([(1, "Revenue recognition, in full."), (2, ""), (3, None)], "doc_id long, content string")
    rows = {r.doc_id: r for r in risk.document_risk(risk.features(docs)).collect()}
    assert rows[1].fraud == pytest.approx(0.2 * 0.4)  # severity times 0.3 + 0.1 for one hit
    assert rows[2].overall == 0 and rows[2].risk_level == "MINIMAL"
    assert 3 in rows


def test_money_units(spark):
    docs = spark.createDataFrame([(1, "$1.5 billion, $2 M, $3K, $4, $1,500 and $10 more")], "doc_id long, content string")
    from finsift.functions import lexicon as L

    assert docs.select(L.amounts(F.col("content")).alias("a")).first()["a"] == [1.5e9, 2e6, 3e3, 4.0, 1.0, 10e6]


def test_chunks_overlap(spark):
    docs = spark.createDataFrame([(1, "This is a test sentence. " * 100), (2, ""), (3, "word " * 60 + ".")], "doc_id long, text string")
    rows = text.chunk_documents(docs, 50, 10).collect()
    first = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.chunk_index)
    assert len(first) > 1 and [r.chunk_index for r in first] == list(range(len(first)))
    for a, b in zip(first, first[1:], strict=False):
        assert b.text.split()[:10] == a.text.split()[-10:]
    assert [r.doc_id for r in rows if r.doc_id == 2] == []
    assert len([r for r in rows if r.doc_id == 3]) == 1


def test_file_names(spark):
    names = ["NonFraud_1961_20200330_1376", "Unknown_full-submission_163", "Fraud_1024_10-K_0000950-01-000001_7", "x"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumns(text.file_name_metadata(F.col("name")))
    rows = {r.name: (r.label, r.company_id, r.date, r.submission_id) for r in df.collect()}
    assert rows == {names[0]: ("nonfraud", "1961", "20200330", "1376"), names[1]: ("unknown", None, None, "163"), names[2]: ("unknown", None, None, None), names[3]: ("unknown", None, None, None)}


def test_cleaning(spark):
    df = spark.createDataFrame([("1", "1d", "7"), ("inf", " 2.5 ", None), (None, "x", "1")], "a string, b string, is_fraudulent string")
    assert [tuple(r) for r in numeric.cleaned(df).collect()] == [(1.0, 0.0, 7.0), (0.0, 0.0, 1.0)]
    assert numeric.cleaned(df, null_labels="keep").where("is_fraudulent IS NULL").count() == 1
    assert numeric.aligned(df, ["z", "a"]).columns == ["z", "a"]
    with pytest.raises(ValueError, match="neither"):
        numeric.cleaned(df.drop("is_fraudulent"))


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.8), (1, 0, 0.8), (0, 0, 0.1)], "label int, pred int, prob double")
    assert metrics.roc_auc(df).first()["auc"] == pytest.approx(0.875)
    assert metrics.average_precision(df).first()["ap"] == pytest.approx((1.0 + 2 / 3) / 2)
    assert metrics.classification_metrics(df).first()["f1"] == 0.5
    weights = spark.createDataFrame([("m", 0.0)], "model string, auc double")
    p = spark.createDataFrame([(1, "m", 0.7)], "record_id int, model string, prob double")
    assert metrics.ensemble(p, weights).first()["probability"] == 0.0


def test_graph_upsert_and_ends(spark):
    nodes = spark.createDataFrame([("A", "x", {"p": "1"}, 1), ("A", "x", {"p": "2", "q": None}, 2), ("A", "y", {}, 1)], "label string, name string, props map<string,string>, ord int")
    rows = {r.name: r.props for r in graph.upsert(nodes).collect()}
    assert rows["x"]["p"] == "2" and rows["y"] == {}
    edges = spark.createDataFrame([("A", "x", "A", "y", "OWNS"), ("A", "x", "A", "gone", "OWNS")], "src_label string, src string, dst_label string, dst string, type string")
    assert graph.edges_between(edges, nodes).count() == 1
    assert [tuple(r) for r in graph.pattern(edges, nodes, "A", "OWNS", "A", "x").collect()] == [("x", "y")]


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vectors.nearest(v, [2.1, 0.0], 3).collect()] == [2, 3, 1]
    assert vectors.kth_distance(v, v.where("vec_id = 0"), 2).first()["distance"] == 1.0
    with pytest.raises(ValueError, match="queries"):
        vectors.nearest_batch(v, v, max_queries=2)
    made = ml.smote(v, "vec_id", "embedding", copies=2, k=2).collect()
    assert len(made) == 12 and all(0 <= r.embedding[0] <= 5 for r in made)


def test_statistics_of_constants(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    assert stats.histogram(df, "x").collect()[0].n == 2
    assert stats.missing_rates(df).first()["rate"] == pytest.approx(1 / 3)
    assert stats.benford_digits(df, F.col("x")).where("digit = 1").first()["observed"] == 2


def test_smote_takes_the_whole_minority_in_blocks(spark):
    from finsift.operators import ml
    from finsift.operators import vectors as V

    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)]) for i in range(23)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, V.nearest_batch(df, df, 3, skip_self=True).collect()))
    assert len(whole) == 69 and whole == sorted(map(tuple, V.nearest_batch(df, df, 3, skip_self=True, block=5).collect()))
    made = [r.from_id for r in ml.smote(df, "vec_id", "embedding", total=30, block=5).collect()]
    assert len(made) == 30 and {made.count(i) for i in range(23)} == {1, 2}
    assert ml.smote_total(1818, 182) == 727 and ml.smote_total(10, 9) == 0


def test_smote_rows_reach_the_ratio(spark):
    from finsift.plans import queries as q

    rows = [(i, [float(i), float(i % 5)], i % 10) for i in range(300, 800)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    old, q.table = q.table, lambda *_: frame
    try:
        made = q.QUERIES["smote_rows"](spark, "").collect()
    finally:
        q.table = old
    assert len(made) == 175 and {r.from_id for r in made} == {i for i, _, label in rows if label == 1}
