"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from finsift.plans.queries import QUERIES
from finsift.session import local_session

HEADLINE = ["doc_risk_score", "risk_summary_docs", "entity_counts", "relation_dedupe", "chunk_documents", "html_to_text", "describe_numeric", "benford_chi2", "roc_auc", "ensemble_weighted", "record_risk", "knn_batch"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "4"), 8, "bench")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "total of median query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
