"""A few queries against their SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
NAMES = """doc_risk_score risk_summary_docs risk_factors doc_routing lexicon_counts entity_dedupe key_entities relation_dedupe chunk_documents html_to_text path_metadata
 ratio_features describe_numeric boxplot_stats roc_auc average_precision percentile_flag benford_chi2 record_risk record_routing knn_topk knn_batch
 csv_scans text_files valid_files folder_counts model_registry formatted_documents formatted_records batch_export level_shares rescored_from_chunks relation_edges graph_counts row_anomaly
 ensembles_compared dbscan local_outlier_factor balanced_rate""".split()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    from finsift.plans import more_queries  # noqa: F401
    from finsift.plans import queries as q

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = q.QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(q.ORACLES[name]).df()[list(ours.columns)]
    told = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    key = lambda df: sorted((tuple(told(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None)), key=str)
    assert key(ours) == key(theirs)


def test_stream(spark, tmp_path):
    from finsift.streaming.ingest import score_stream

    spark.createDataFrame([(1, "A restatement."), (2, "Nothing.")], "doc_id bigint, content string").write.parquet(str(tmp_path / "in"))
    score_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
