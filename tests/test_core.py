"""Sources, sinks, formats, runs and detectors on small inputs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from finsift.__main__ import main
from finsift.functions import text as T
from finsift.operators import anomaly, formatting, graph, metrics, ml, networks, risk, stats, vectors
from finsift.plans import run
from finsift.sources import readers, sinks
from finsift.storage import exists, write_bytes

E1 = """
        The company engaged in fictitious revenue recognition through
        special purpose entities. Management concealed off-balance sheet
        liabilities totaling $500 million. Round-trip transactions were
        used to manipulate earnings. The restatement revealed material
        weaknesses in internal controls.
        """
S1 = "Fabricated financial statements with material misstatement and concealment of liabilities"
S2 = "Multiple subsidiaries, joint ventures, and special purpose entities with derivative transactions"
S3 = "Transactions totaling $500 million, $250 million, and $100 million were recorded"
S4 = "Company concealed assets and transferred funds to offshore entities"


@pytest.mark.parametrize(
    ("content", "counts", "rels", "components", "overall", "level"),
    [
        (E1, (3, 3, 0, 1), [("concealed", "CONCEALED"), ("manipulated", "FRAUD_ACTION")], (25.625, 45, 30, 100), 42.72, "MEDIUM"),
        (S1, (0, 3, 0, 0), [], (28.333, 45, 0, 0), 21.17, "LOW"),
        (S2, (4, 0, 3, 0), [], (20, 0, 0, 0), 7.0, "MINIMAL"),
        (S3, (0, 0, 0, 3), [], (0, 0, 30, 0), 7.5, "MINIMAL"),
        (S4, (0, 0, 0, 0), [("concealed", "CONCEALED"), ("transferred", "TRANSFERRED")], (0, 0, 0, 100), 15.0, "MINIMAL"),
    ],
)
def test_golden_documents(spark, content, counts, rels, components, overall, level):
    """Contents, entity counts and relations as given; components, score and level worked out by hand."""
    docs = spark.createDataFrame([(1, content, rels)], "doc_id long, content string, rels array<struct<predicate: string, relation_type: string>>")
    given = {c: F.lit(n) for c, n in zip(("n_terms", "n_indicators", "n_orgs", "n_money"), counts, strict=True)}
    featured = risk.features(docs).withColumns(given)
    table = docs.select("doc_id", F.explode("rels").alias("r")).select("doc_id", "r.*")
    for how in (F.col("rels"), table):
        r = risk.document_risk(featured, how).first()
        assert [100 * r[c] for c in ("fraud", "entity", "financial", "relationship")] == pytest.approx(components, abs=1e-3)
        assert round(r.overall, 2) == pytest.approx(overall, abs=0.006) and r.risk_level == level


def test_scores_round_before_cuts(spark):
    df = spark.createDataFrame([(1, 59.996), (2, 59.994), (3, 80.0)], "doc_id long, overall double").withColumn("risk_level", F.lit("HIGH"))
    assert [r.doc_id for r in risk.high_risk(df).collect()] == [3, 1]
    s = risk.risk_summary(df).first()
    assert s.n_high_risk == 2 and s.highest == 80.0 and s["median"] == 60.0 and s.n_high == 3 and s.n_low == 0


def test_record_without_models(spark):
    none = spark.createDataFrame([], "record_id long, model string, pred int, prob double")
    r = risk.record_routing(risk.record_risk(none, spark.createDataFrame([(1, 0.9)], "record_id long, probability double"))).first()
    assert "low_model_consensus_needs_review" in r.processing_hints and r.agreement == 50.0 and r.strength == 90.0


def test_row_anomaly_leaves_gaps_out(spark):
    from finsift.functions.numeric import outlier_share

    rows = [([1.0] * 12 + [100.0, None, float("nan")],), ([None, None],), (None,), ([],)]
    got = [r.a for r in spark.createDataFrame(rows, "f array<double>").select(outlier_share(F.col("f")).alias("a")).collect()]
    assert got == [pytest.approx(100 / 13), 0.0, 0.0, 0.0]


def test_odd_bytes_are_left_out(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xe9 \xef\xbf\xbd ok \xff\xfe")
    (tmp_path / "b.txt").write_bytes("voilà".encode())
    got = {r.doc_id: r.content for r in readers.text_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": "caf � ok ", "b": "voilà"}


def test_valid_files(spark, tmp_path):
    for name in ("a.txt", "b.HTM", "noext", ".hid", "desktop.ini", "bin.dat", "empty.dat", "sub/c.html", "unstructured_data/d.txt"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"" if "empty" in name else b"\xff\x00\xfe")
    assert {r.path.rsplit("/", 1)[1] for r in readers.valid_files(spark, str(tmp_path)).collect()} == {"a.txt", "b.HTM", "noext", "bin.dat", "c.html"}
    assert {(r.folder, r.n) for r in readers.folder_counts(spark, str(tmp_path)).collect()} == {("sub", 1), ("unstructured_data", 1)}


def test_html(spark):
    pages = ["foo<b>bar</b><br>x", "<p>a  b</p>\n<script>no()</script><style>p{}</style>&lt;i&gt;t&lt;/i&gt; &eacute;&#233;&#xe9; &amp; <!-- c -->z", None, ""]
    got = [r.t for r in spark.createDataFrame([(p,) for p in pages], "h string").select(T.html_to_text(F.col("h")).alias("t")).collect()]
    assert got == ["foobarx", "a\nb\nt ééé & z", None, ""]


def test_places_of_matches(spark):
    docs = spark.createDataFrame([(1, "Paid $15 and then $1, $15 again; spe special Spe")], "doc_id long, content string")
    rows = {(r.ent_type, r.text): (r.start, r.end) for r in graph.entities(docs).collect()}
    assert rows["MONEY", "$15"] == (5, 8) and rows["MONEY", "$1"] == (18, 20) and rows["FINANCIAL_TERM", "spe"] == (33, 36)
    assert docs.select(T.term_places(F.lower("content"), "spe").alias("p")).first().p == [33, 37, 45]


def smart_split(text, most):
    """The packing of paragraphs and sentences, step by step."""
    if len(text) <= most:
        return [text]
    out, now, size = [], [], 0
    for paragraph in text.split("\n\n"):
        if size + len(paragraph) <= most:
            now, size = [*now, paragraph], size + len(paragraph)
            continue
        out += ["\n\n".join(now)] if now else []
        if len(paragraph) <= most:
            now, size = [paragraph], len(paragraph)
            continue
        pack, length = [], 0
        for sentence in paragraph.split(". "):
            if length + len(sentence) <= most:
                pack, length = [*pack, sentence], length + len(sentence)
            else:
                out += [". ".join(pack) + "."] if pack else []
                pack, length = [sentence], len(sentence)
        now, size = [". ".join(pack) + "."], sum(map(len, pack))
    return out + (["\n\n".join(now)] if now else [])


def test_smart_split(spark):
    rng = np.random.default_rng(1)
    texts = ["\n\n".join(". ".join("x" * int(n) for n in rng.integers(1, 30, int(rng.integers(1, 6)))) for _ in range(int(rng.integers(1, 7)))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.smart_split(F.col("t"), 40).alias("p"))
    for r in df.collect():
        assert r.p == smart_split(r.t, 40)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=501).tolist(), [0.0] * 300 + [1.0] * 3, [5.0], [1.0, 2.0], rng.integers(0, 4, 100).astype(float).tolist()):
        df = spark.createDataFrame([(v, None) for v in values] + [(None, None)], "a double, b double")
        got = {r.share: r.value for r in stats.exact_quantiles(df, ["a", "b"], [0.0, 0.05, 0.5, 0.95, 1.0]).where("column = 'a'").collect()}
        assert got == {q: pytest.approx(np.percentile(values, 100 * q)) for q in (0.0, 0.05, 0.5, 0.95, 1.0)}


def test_curve_with_piled_scores(spark):
    rng = np.random.default_rng(3)
    prob = np.round(np.concatenate([rng.random(200) * 1e-6, rng.random(50)]), 8)
    label = (rng.random(250) < prob + 0.1).astype(int)
    df = spark.createDataFrame(list(zip(label.tolist(), prob.tolist(), strict=True)), "label int, prob double")
    pairs = [(a > b) + 0.5 * (a == b) for a, y in zip(prob, label, strict=True) if y for b, z in zip(prob, label, strict=True) if not z]
    assert metrics.roc_auc(df).first().auc == pytest.approx(np.mean(pairs))


@pytest.mark.parametrize("skip_self", [False, True])
def test_neighbours_in_blocks(spark, skip_self):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(150, 3)), 1)  # many ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"], r.vec_id) for r in vectors.nearest_batch(df, df.where("vec_id < 60"), 4, skip_self=skip_self, block=25).collect()}
    want = set()
    for i in range(60):
        near = sorted((sum((a - b) ** 2 for a, b in zip(v[i], v[j], strict=True)), j) for j in range(150) if not (skip_self and i == j))
        want |= {(i, r + 1, j) for r, (_, j) in enumerate(near[:4])}
    assert got == want


def test_dbscan(spark):
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.normal(0, 0.05, (30, 2)), rng.normal(3, 0.05, (20, 2)), [[10, -10], [-8, 9]], [[0.0, 0.0]] * 6])
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double")
    z = (p - p.mean(0)) / p.std(0)
    near = ((z[:, None] - z[None]) ** 2).sum(2) <= 0.3**2
    core = near.sum(1) >= 5
    label = np.arange(len(p))
    for _ in p:
        for i in np.flatnonzero(core):
            label[i] = min(label[j] for j in np.flatnonzero(core & near[i]))
    got = {r.id: r for r in anomaly.dbscan(df, ["x", "y"], "id", eps=0.3).collect()}
    groups = {}
    for i in range(len(p)):
        assert got[i].core == core[i] and (got[i].flag == 1) == (not (core & near[i]).any())
        if core[i]:
            groups.setdefault(got[i].cluster, set()).add(label[i])
    assert all(len(x) == 1 for x in groups.values()) and len(groups) == len(set(label[core]))


def test_detectors_find_what_is_odd(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.normal(size=(190, 3)), rng.normal(0, 0.1, (6, 3)) + [[9, -9, 9]]])
    df = spark.createDataFrame([(i, int(i >= 190), *map(float, x)) for i, x in enumerate(p)], "id long, label int, a double, b double, c double")
    for made in (anomaly.isolation_forest(df, list("abc"), "id"), anomaly.one_class_machine(df, list("abc"), "id", "label"), anomaly.local_outlier_factor(df, list("abc"), "id", "label")):
        rows = made.collect()
        assert len(rows) == 196 and len({r.id for r in rows if r.flag == 1} & set(range(190, 196))) >= 4
    assert anomaly.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_autoencoder_learns():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(400, 2))
    x = np.hstack([base, base @ rng.normal(size=(2, 4))])
    w = networks.started(networks.autoencoder_shapes(6), 1)
    before, first, second = networks.autoencoder_error(w, x).mean(), 0.0, 0.0
    for step in range(1, 201):
        g = networks.autoencoder_gradient(w, x, None)[1] / len(x)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - 0.01 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    assert networks.autoencoder_error(w, x).mean() < 0.1 * before


def test_stratified_split(spark):
    df = spark.range(4000).withColumn("label", (F.col("id") % 40 == 0).cast("int"))
    train, test = ml.stratified_split(df, "id", "label")
    n = {r.label: r["count"] for r in test.groupBy("label").count().collect()}
    assert abs(n[1] - 20) <= 1 and abs(n[0] - 780) <= 8 and train.count() + test.count() == 4000
    assert test.join(train, "id").count() == 0


def test_embedding(spark):
    rows = spark.createDataFrame([("a b c",), ("c b a",), ("",), (None,)], "t string").select(vectors.hashing_embedding(F.col("t"), 16).alias("v")).collect()
    assert rows[0].v == rows[1].v and math.isclose(sum(x * x for x in rows[0].v), 1) and rows[2].v == [0.0] * 16 == rows[3].v


def filing(i):
    return f"Acme{chr(97 + i)} Corp met Beta Inc. Zeta owns Beta. It concealed ${i + 1} million through Acme Corp, a restatement and a fabricated goodwill." * (1 + i % 2)


@pytest.fixture
def folder(spark, tmp_path):
    for i in range(6):
        write_bytes(spark, f"{tmp_path}/in/NonFraud_{i}_20230101_{i}.txt", filing(i).encode())
    return tmp_path


def test_document_run_and_rescoring(spark, folder, capsys):
    store = str(folder / "store")
    assert main(["documents", str(folder / "in"), "--store", store, "--limit", "5", "--export-output", "b1", "--risk-summary"], spark) == 0
    told = capsys.readouterr().out
    assert "documents: 5" in told and "HIGH-RISK DOCUMENTS" in told and "CRITICAL" in told
    envelope = json.loads((folder / "store/exports/b1/batch.json").read_text())
    assert envelope["batch_metadata"]["total_documents"] == 5 == envelope["summary_statistics"]["total_documents"]
    assert "Documents: 5" in (folder / "store/exports/b1/summary.txt").read_text()
    docs = sinks.read_batch(spark, f"{store}/exports/b1").orderBy("document_id").collect()
    assert docs[0].metadata.company_id == "0" and docs[0].metadata.chunk_count == 1 and docs[0].retrieval_references.vector_db_chunks
    main(["status", "--store", store], spark)
    main(["search", "--store", store, "a restatement of goodwill", "-k", "2"], spark)
    main(["rescore", "--store", store, "--limit", "3", "--export-output", "b2"], spark)
    told = capsys.readouterr().out
    assert "formatted: 5" in told and "_chunk_0" in told and "Documents: 3" in told
    again = run.rescore(spark, store).collect()
    assert len(again) == 5 and all(r.metadata.label == "nonfraud" for r in again)
    main(["reset", "--store", store], spark)
    assert exists(spark, store)
    main(["reset", "--store", store, "--yes"], spark)
    assert not exists(spark, store) and readers.VectorStore(spark, f"{store}/chunks").count() == 0


def test_training_and_record_run(spark, tmp_path, capsys):
    rng = np.random.default_rng(8)
    lines = ["a,b,fyear,is_fraudulent", *(f"{x + 3 * y:.4f},{rng.normal():.4f},2001,{y}" for x, y in zip(rng.normal(size=300), rng.integers(0, 2, 300), strict=True))]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    common = ["--models", str(tmp_path / "m"), "--columns", "a,b"]
    main(["train", str(tmp_path / "t.csv"), *common, "--kinds", "logistic,kmeans"], spark)
    registry = {r.model: r.auc for r in readers.model_registry(spark, str(tmp_path / "m")).collect()}
    assert registry["logistic"] > 0.9 and set(registry) == {"logistic", "kmeans"}
    main(["records", str(tmp_path / "t.csv"), *common, "--detectors", "kmeans", "--out", str(tmp_path / "o"), "--batch", "r"], spark)
    assert sum(int(x.split(": ")[1]) for x in capsys.readouterr().out.strip().splitlines() if x.split(":")[0] in formatting.LEVELS) == 300
    rows = spark.read.json(str(tmp_path / "o/r"))
    assert rows.count() == 300 and rows.where("metadata.model_count = 2").count() == 300


def test_reports(spark):
    df = spark.createDataFrame([(1.0, "x", 0), (2.0, None, 1), (40.0, "y", 0), (3.0, "y", 1)], "a double, s string, label int")
    md = sinks.markdown_report(df, ["a"], "label")
    assert "Rows: 4, columns: 3" in md and "| a |" in md and "0.25" in md
    told = spark.createDataFrame([("m<1>", 0.91234)], "model string, auc double")
    assert sinks.metrics_text(told) == "model\tauc\nm<1>\t0.9123\n"
    page = sinks.html_report("T & U", told, df.select("a"), "a", 2)
    assert "T &amp; U" in page and "m&lt;1&gt;" in page and "40.0" not in page
    assert sinks.clustering_summary(df.withColumn("flag", F.col("label"))) == "Records: 4\nAnomalies: 2\nRate: 50.00%\n"
    assert sinks.corpus_text(spark.createDataFrame([("B", "2015", None)], "body string, year string, cik string")).first()["value"] == "YEAR: 2015\n" + "=" * 70 + "\nB"


def test_formats_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, content string")
    rows = formatting.formatted_documents(docs).collect()
    assert {r.document_id: r.extracted_data.entity_summary.total_entities for r in rows}["2"] == 0 and all(r.risk_assessment.overall_score == 0 for r in rows)
    empty = formatting.formatted_documents(docs.limit(0))
    assert formatting.batch_summary(empty).first().total_documents == 0 and "Documents: 0" in sinks.summary_report(empty)


def test_plots_and_indexed_tables(spark, tmp_path):
    from finsift.sources import excel, plots

    df = spark.createDataFrame([(0, 0, 5), (0, 1, 1), (1, 1, 4)], "label int, pred int, n long")
    svg = plots.confusion_plot(df, "a < b")
    assert svg.count("<rect") == 5 and "a &lt; b" in svg and ">5<" in svg
    path = excel.write_excel(spark.createDataFrame([(1, None, "x y"), (None, 2.5, " z")], "a long, b double, c string"), str(tmp_path / "t.xlsx"))
    assert [tuple(r) for r in excel.excel_table(spark, path).collect()] == [("1", None, "x y"), (None, "2.5", " z")]
    sinks.write_indexed(df, "nodes_by_label", ["label"], 4, str(tmp_path / "w"))
    joined = spark.table("nodes_by_label").join(spark.table("nodes_by_label").hint("merge"), "label")
    assert joined.count() == 5 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().sparkPlan().toString()
    spark.sql("DROP TABLE nodes_by_label")


def test_high_risk_scores_once(spark):
    """The bound isn't moved below the scores: the plan has no filter under the sort."""
    from finsift.operators import risk

    df = spark.createDataFrame([(1, 61.0), (2, 39.0), (3, 90.0), (4, None), (5, 60.0)], "doc_id long, raw double").withColumn("overall", F.col("raw") * 1)
    top = risk.high_risk(df, 3)
    assert [r.doc_id for r in top.collect()] == [3, 1, 5] == [r.doc_id for r in risk.high_risk(df, None).collect()]
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Sort") and plan.count("Filter") == 1


def test_sentences_keep_their_numbers(spark):
    """Sentences whose ends are digits of their own place, and blanks at the ends."""
    from finsift.functions import text as T

    text = "No. 1 of us. 2 of 22. 3 men.  4. x 5"
    got = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t"))).first()[0]
    assert got == ["No.", "1 of us.", "2 of 22.", "3 men.", "4.", "x 5"]
    assert spark.range(1).select(T.sentences(F.lit(" a.  b "))).first()[0] == ["a.", "b"]


def test_byte_sizes_up_to_a_unit(spark):
    from finsift.functions import text as T

    one = spark.range(1).select(T.byte_size(F.lit(1 << 40)).alias("a"), T.byte_size(F.lit(1 << 40), T.UNITS[:4]).alias("b"), T.byte_size(F.lit(1536)).alias("c")).first()
    assert tuple(one) == ("1.00 TB", "1024.00 GB", "1.50 KB")


def test_joined_edges(spark):
    """Pairs that share several keys come once; ends that aren't nodes, and null keys, give none."""
    rows = lambda label, xs: spark.createDataFrame([(label, n, k) for n, k in xs], "label string, name string, key int")
    left = rows("C", [("a", 1), ("a", 2), ("a", 2), ("b", 1), ("c", None), ("x", 1)])
    right = rows("S", [("p", 1), ("p", 2), ("q", 2), ("r", None), ("y", 1)])
    nodes = spark.createDataFrame([("C", "a"), ("C", "b"), ("C", "c"), ("S", "p"), ("S", "q"), ("S", "r"), ("C", "y"), ("S", "x")], "label string, name string")
    assert sorted((r.src, r.dst) for r in graph.joined_edges(left, right, nodes, "OWNS").collect()) == [("a", "p"), ("a", "q"), ("b", "p")]


def test_entities_are_computed_once(spark):
    """No filter by the size of a computed array comes before it is exploded."""
    df = spark.createDataFrame([(1, "Acme Corp concealed $5 million. Zeta owns Beta."), (2, ""), (3, None)], "doc_id long, content string")
    for rows, pattern, n in ((graph.entities(df), "Corp|", 2), (graph.relations(df), "owns|", 2)):
        assert rows.where("doc_id = 1").count() == n == rows.count()
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("size(") <= 1


def test_batches_tell_their_schema(spark, tmp_path):
    """A batch is read by the schema beside it, without a pass to find it: an empty one too."""
    docs = formatting.formatted_documents(spark.createDataFrame([], "doc_id long, content string"))
    sinks.write_batch(docs, str(tmp_path / "b"))
    assert sinks.read_batch(spark, str(tmp_path / "b")).columns == docs.columns


def test_batches_are_packed(spark, tmp_path):
    """Documents and high-risk list take a fraction of their JSON, and are read as they were written."""
    df = spark.createDataFrame([(i, "Acme Corp concealed $5 million in a restatement, an SEC investigation and fraud. " * 5) for i in range(200)], "doc_id long, content string").coalesce(1)
    docs = formatting.formatted_documents(df)
    path = sinks.write_batch(docs, str(tmp_path / "b"))
    told = sorted(r.value for r in formatting.as_json(docs).collect())
    assert sorted(r.value for r in formatting.as_json(sinks.read_batch(spark, path)).collect()) == told
    size = sum(f.stat().st_size for f in (tmp_path / "b" / "documents").glob("part-*"))
    assert size < sum(map(len, told)) / 5
    assert all(f.name.endswith(".gz") for f in (tmp_path / "b" / "high_risk").glob("part-*"))


def test_ranges_are_found_by_bisection(spark):
    """As many ends below a value as its range says, without a pass over all ends for each value."""
    from finsift.operators import stats
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 37) % 501).cast("double").alias("v"))
    for ranges in (2, 7, 64):
        placed = stats.in_ranges(df, ["k"], "v", ranges)
        assert "lambda" not in placed._jdf.queryExecution().optimizedPlan().toString()
        ends = {r["k"]: r["e"] for r in df.groupBy("k").agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10_000).alias("e")).collect()}
        assert all(r["range"] == sum(e < r["v"] for e in ends[r["k"]]) for r in placed.collect())


def test_a_mean_of_probabilities_does_not_hang_on_their_order(spark):
    """Every order of three values gives the mean of the sum that is rounded once."""
    import itertools
    import math

    sets = [(0.1, 0.7, 0.7), (0.3, 0.6, 0.1), (0.58, 0.07, 0.85), (0.1, 0.2, 0.3), (0.9, 0.35, 0.25)]
    rows = [(f"{i}{j}", p, k) for i, ps in enumerate(sets) for j, order in enumerate(itertools.permutations(ps)) for k, p in enumerate(order)]
    df = spark.createDataFrame(rows, "record_id string, prob double, k int").coalesce(1).sortWithinPartitions("k")
    got = {r.record_id: r.probability for r in metrics.ensemble(df).collect()}
    assert got == {i: math.fsum(sets[int(i[0])]) / 3 for i in got} and len(got) == 30
    odd = spark.createDataFrame([("a", None), ("b", None), ("b", 0.5), ("c", float("inf")), ("d", float("nan")), ("e", 3e300)], "record_id string, prob double")
    told = {r.record_id: r.probability for r in metrics.ensemble(odd).collect()}
    assert told["a"] is None and told["b"] == 0.5 and told["c"] == float("inf") and told["d"] != told["d"] and told["e"] == 3e300
