"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftlake.plans import registry  # noqa: E402
from siftlake.session import build_session  # noqa: E402

HEADLINE = (
    "overview", "topic_metrics", "hourly_activity", "minute_activity", "resource_by_search", "run_fold", "final_run_summary", "dls_outcome_summary", "timeline_seed", "timeline_overview",
    "score_deltas", "verified_best", "feed_page", "feed_count", "run_compare", "launch_runs", "launch_progress", "seed_lifecycle", "research_summary", "payload_extraction", "info_gain",
    "symmetrical_uncertainty", "confusion_metrics", "adaptive_resource_series", "downsample_min_max", "catalog_pairs", "relieff_rank", "vnd_search",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(app="siftlake-bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["overview"](spark, sf_dir).collect()  # starts the JVM's compilers and the reader
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
