"""Command line: python -m finsift documents|rescore|records|status|search|reset|train ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from finsift.operators import ml
from finsift.plans import run
from finsift.session import local_session
from finsift.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="finsift")
    sub = p.add_subparsers(dest="command", required=True)
    d = sub.add_parser("documents", help="read, chunk, graph and score text files")
    d.add_argument("folder")
    d.add_argument("--store", required=True)
    d.add_argument("--limit", type=int)
    d.add_argument("--skip-embeddings", action="store_true")
    d.add_argument("--skip-graph", action="store_true")
    d.add_argument("--disable-risk-scoring", action="store_true")
    d.add_argument("--export-output", metavar="BATCH")
    d.add_argument("--risk-summary", action="store_true")
    d.add_argument("--fit-encoder", action="store_true", help="fit the store's sentence encoder to these files first")
    for name, text in (("status", "rows of a store's tables"), ("rescore", "score again from the stores"), ("search", "nearest chunks"), ("reset", "delete a store")):
        s = sub.add_parser(name, help=text)
        s.add_argument("--store", required=True)
        if name == "rescore":
            s.add_argument("--limit", type=int)
            s.add_argument("--export-output", metavar="BATCH")
        if name == "search":
            s.add_argument("question")
            s.add_argument("-k", type=int, default=5)
        if name == "reset":
            s.add_argument("--yes", action="store_true")
    r = sub.add_parser("records", help="risk of the rows of a table")
    r.add_argument("table")
    r.add_argument("--models", required=True)
    r.add_argument("--columns", required=True)
    r.add_argument("--detectors", default="")
    r.add_argument("--out")
    r.add_argument("--batch")
    t = sub.add_parser("train", help="fit, measure and save models")
    t.add_argument("table")
    t.add_argument("--models", required=True)
    t.add_argument("--columns", required=True)
    t.add_argument("--kinds", default="logistic,random_forest,kmeans")
    t.add_argument("--label", default="is_fraudulent")
    return p


def main(arguments: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or local_session()
    if a.command == "documents":
        if a.fit_encoder:
            run.fit_encoder(spark, a.folder, a.store)
        counts = run.run_documents(spark, a.folder, a.store, a.limit, not a.skip_embeddings, not a.skip_graph, not a.disable_risk_scoring, a.export_output)
        print("\n".join(f"{k}: {v}" for k, v in counts.items()))
        if a.risk_summary and not a.disable_risk_scoring:
            print(sinks.summary_report(run.stored(spark, a.store, "formatted").read()))
    elif a.command == "status":
        print("\n".join(f"{k}: {v}" for k, v in run.status(spark, a.store).items()))
    elif a.command == "reset":
        print("deleted" if run.reset(spark, a.store, a.yes) else "nothing deleted; say --yes")
    elif a.command == "search":
        for row in run.search(spark, a.store, a.question, a.k).collect():  # k rows
            print(f"{row['distance']:.4f}\t{row['chunk_id']}\t{row['text'][:80]}")
    elif a.command == "rescore":
        formatted = run.rescore(spark, a.store, a.limit)
        if a.export_output:
            sinks.export_batch(formatted, f"{a.store}/exports/{a.export_output}", a.export_output)
        print(sinks.summary_report(formatted))
    elif a.command == "records":
        out = run.run_records(spark, a.table, a.models, a.columns.split(","), detectors=tuple(filter(None, a.detectors.split(","))), batch=a.batch, out=a.out)
        for row in out.groupBy("risk_assessment.risk_level").count().orderBy("risk_level").collect():  # five levels
            print(f"{row['risk_level']}: {row['count']}")
    else:
        table = readers.financial_table(spark, a.table, a.label).withColumn("record_id", F.monotonically_increasing_id()).withColumn(a.label, F.col(a.label).cast("int"))
        for name, folder in ml.train_all(run.written(table, "train"), a.columns.split(","), "record_id", a.kinds.split(","), a.models, a.label).items():
            print(f"{name}: {folder}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
