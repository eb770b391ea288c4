"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then ``RUNS`` times; a run over 15 s is taken as it is. Results go to the
noop sink, so that whole tables are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from feedback_engine import catalog
from feedback_engine.session import clear_scratch, local_session

RUNS = 1
QUERIES = (
    "vw_source_summary",
    "rpt_monthly_sentiment",
    "rpt_theme_priority",
    "rpt_frequent_words",
    "fn_clean_text",
    "fn_classify_theme",
    "set_dedupe_text",
    "ml_roc_auc_ovr",
    "ml_stratified_kfold",
    "ml_tfidf_train",
    "ml_cluster_keywords",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("feedback_engine-bench", cores, partitions=int(cores) if cores.isdigit() else 8)
    registered, _ = catalog.load()
    seconds = {}
    for name in QUERIES:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if times[-1] > 15:  # slow ones: one run is the measure
                break
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        clear_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf_dir.rsplit("sf", 1)[-1]),
            }
        )
    )


if __name__ == "__main__":
    main()
