"""Times the headline queries and prints one JSON line.

Each query runs once to warm up, then ``BENCH_RUNS`` times; the median counts (one run by default).
The whole result is produced, into Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from groupstats.plans.catalog import QUERIES
from groupstats.session import local_session

HEADLINE = [
    "group_zscore", "group_zscore_new", "mixed_normalize", "margin_targets", "key_zscore_ratio", "target_set",
    "slot_zscore", "slot_agg3", "code_share", "target_encode", "target_encode_pairs", "fold_rare_others",
    "label_encode", "fill_global", "fill_group", "completeness", "popularity_order", "pred_rank", "top1_pick",
    "leave_one_out", "drop_groups_no_winner", "group_kfold", "row_kfold", "downsample_exact", "upsample_exact",
    "pad_groups", "group_tensor", "top1_report", "value_bet_report", "threshold_sweep", "pairwise_xent",
    "loo_reward",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = os.environ.get("BENCH_ONLY")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in only.split(",") if only else HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total of median seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
