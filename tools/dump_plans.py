"""Write PLANS.md: the physical plan shape of the headline queries at sf0.1
(scans with pushed filters and read schema, exchanges, joins, aggregates).

usage: python tools/dump_plans.py [sf_dir]
"""
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from propensity.plans import queries as Q  # noqa: E402
from propensity.session import get_spark  # noqa: E402

NAMES = ["feature_matrix", "pit_join", "training_dataset", "load_summary", "sessionize_6h", "top_values",
         "metric_auc_roc", "partial_failures", "sliding_window_throttle", "latest_prediction_per_lead",
         "prediction_counts_of_version", "failed_feature_isolation"]
KEEP = re.compile(r"(Scan|Exchange|Join|HashAggregate|Window|Generate|MapInPandas|Sort |Expand|BroadcastExchange"
                  r"|ReusedExchange|AQEShuffleRead|Union|InMemory|LogicalRDD|ExistingRDD)")


def shape(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        line = re.sub(r"Location: InMemoryFileIndex\(1 paths\)\[file:[^\]]*/([a-z_]+\.parquet)\]", r"\1", line)
        line = re.sub(r"functions=\[[^\]]{120,}\]", "functions=[...]", line)
        out.append(line[:260])
    return out


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    lines = ["# Physical plan shapes", "",
             f"Generated by `tools/dump_plans.py` on `{os.path.basename(sf)}` (local session, AQE on; the",
             "final adaptive plan may replace sort-merge joins by broadcasts when measured sides are small).",
             "Only scans, exchanges, joins, aggregates and windows are kept.", ""]
    for name in NAMES:
        df = Q.QUERIES[name](spark, sf)
        lines += [f"## {name}", "", "```"] + shape(df) + ["```", ""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(lines))


if __name__ == "__main__":
    main()
