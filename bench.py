"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to the noop sink on a started session; the time is the median
of $BENCH_RUNS runs (default 1).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.catalog import load_all
from plumbline.session import get_spark

HEADLINE = [
    "sr05_semantic_search", "sr01_keyword_search", "sr03_tfidf_index", "cl01_permit_trades", "cl26_fence_signals", "sm10_trade_matrix", "wn15_best_trade",
    "ag15_relationships", "ag19_role_coverage", "gr04_relationship_edges", "wn02_best_per_key", "wn03_top_n_per_group", "jn05_project_children", "jn02_attach_contacts",
    "ex01_scope_items", "ex02_quantities", "ex16_page_contacts", "sc10_html_to_text", "dq01_duplicate_texts", "sk02_upsert_fields", "er05_duplicate_document_components",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = get_spark("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    queries, _ = load_all()
    spark.read.parquet(f"{sf}/nation.parquet").groupBy("n_regionkey").count().collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for i in range(runs):
            t0 = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - t0)
        times[name] = round(statistics.median(took), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
