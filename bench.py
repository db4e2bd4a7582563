"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from feedloom.plans.queries import QUERIES  # noqa: E402
from feedloom.session import configure  # noqa: E402

HEADLINE = (
    "feed_items", "item_keys", "fetch_strategy", "page_extract", "merge_articles", "rejected_items", "new_articles",
    "collect_summary", "list_articles", "status_totals", "first_by_slug", "lookup_ids", "patch_articles",
    "delete_articles", "lifecycle_step", "lifecycle_replay", "source_quality", "coverage_report", "collection_report",
    "fetch_report", "queue_process", "approved_events", "url_refetch_24h", "duplicate_texts", "tag_counts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("feedloom-bench")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "sum of best-of-two query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
