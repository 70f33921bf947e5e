"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the median of three runs each."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from strataledger import queries
from strataledger.plans.ledger import HIGH, LOW
from strataledger.session import session
from strataledger.sources.txo import txo

HEADLINE = [
    "segment_spent_stats", "segment_value_median", "lifespan_hist_right", "spent_unspent_compare", "top_ages", "resolve_spends", "unspent_antijoin", "in_batch_netting", "apply_batch_sequence", "state_at_height", "bulk_lookup", "bulk_delete",
    "dedup_last", "zone_map", "compaction_invariant", "batch_totals", "kaplan_meier", "survival_asof", "value_pct_in_block", "features17", "threshold_sweep", "access_summary",
]

#: What a query handles, as a sum over outputs; its rate counts this and nothing else. A fold handles every creation and every spend.
HANDLED = {
    "apply_batch_sequence": ("operations", "1 + CAST(event AS INT)"), "stream_fold": ("operations", "1 + CAST(event AS INT)"),
    "bulk_lookup": ("lookups", f"CAST(spent_block >= {LOW} AND spent_block < {HIGH} AS INT)"), "segment_spent_stats": ("outputs", "CAST(event AS INT)"), "unspent_antijoin": ("outputs", "1"),
}


def handled(spark, sf_dir: str, name: str) -> int:
    return txo(spark, sf_dir).selectExpr(f"coalesce(sum({HANDLED[name][1]}), 0)").first()[0]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"}
    )
    known = queries.queries()
    names = sys.argv[1:] or HEADLINE
    took = {}
    for name in names:
        runs = []
        for k in range(4):  # the first warms up
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    per_s = {f"{n} ({HANDLED[n][0]})": round(handled(spark, sf_dir, n) / took[n]) for n in HANDLED if took.get(n)}
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None, "input_rows": rows, "handled_per_sec": per_s}))
    spark.stop()


if __name__ == "__main__":
    main()
