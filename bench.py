"""Benchmark: run the headline queries on $BENCH_SF_DIR and print one JSON line.

Each query is executed in full through the ``noop`` sink (no collect to the
driver); the reported time per query is the best of $BENCH_REPEAT runs (default
1) after one untimed warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from propensity.plans import queries as Q  # noqa: E402
from propensity.session import get_spark  # noqa: E402

HEADLINE = [
    "feature_matrix",          # point-in-time features at one cut-off, all leads
    "training_dataset",        # per-lead cut-off PIT join + features + time split
    "load_summary",            # raw rows -> clean -> validate -> dedup -> summary
    "clean_leads",
    "sessionize_6h",
    "top_values",
    "numeric_histogram",
    "metric_auc_roc",
    "calibration_error",
    "sliding_window_throttle",
    "train_classifier",        # GBT fit (200 rounds) + holdout metrics
    "score_leads",             # batch scoring with the trained model
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    skip = set(filter(None, os.environ.get("BENCH_SKIP", "").split(",")))
    spark = get_spark(app="propensity-bench")
    run(Q.QUERIES["latest_event"](spark, sf_dir))  # warm-up: JVM, parquet footers
    times, errors = {}, {}
    for name in HEADLINE:
        if name in skip:
            continue
        best = None
        try:
            for _ in range(repeat):
                t0 = time.perf_counter()
                run(Q.QUERIES[name](spark, sf_dir))
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)
        except Exception as exc:  # keep measuring the others; report the failure
            times[name] = None
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total", "value": round(sum(v for v in times.values() if v is not None), 3),
           "unit": "sec", "queries": times, "sf": sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
