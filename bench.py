"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from foldwise.plans import catalog
from foldwise.session import local_session

ONLY = os.environ.get("BENCH_ONLY", "").split()
HEADLINE = (
    "group_empty_summary",
    "support_sink_audit",
    "group_kfold",
    "lpt_bin_packing",
    "classification_summary",
    "regression_summary",
    "ks_two_sample",
    "gini",
    "label_shift_regression",
    "align_with_ordinal",
    "ordinary_reference_delta",
    "tail_enrichment_grouping_sets",
    "split_leakage",
    "leakage_metrics",
    "structural_metrics",
    "leader_assign_argmax",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_MEMORY", "12g"))
    queries = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in ONLY or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
