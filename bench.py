"""Time the registered queries: one JSON line on stdout.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_QUERIES (optional, comma-separated) a selection.
A query's time covers building its plan and writing all of its rows to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from presslake.session import local_session  # noqa: E402
from presslake.workloads import QUERIES  # noqa: E402

HEADLINE = [
    "article_pipeline", "extract_articles", "main_text_density", "main_text_paragraphs", "selector_cascade",
    "image_collect", "html_blocks", "strip_html_tags", "clean_text", "page_metadata", "scan_feed_entries", "scan_opml",
    "published_coalesce", "parse_timestamp", "is_newer_than_last_id", "take_until_stale", "limit_successes",
    "incremental_high_water", "history_update", "entries_checked", "blacklist_build", "blacklist_match",
    "dedup_url_timestamp", "page_join", "nest_output", "run_summary",
]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, "bench", driver_memory="12g")
    run(spark, sf_dir, "strip_html_tags")  # start-up of the JVM and the first scan is not a query's cost
    seconds = {name: run(spark, sf_dir, name) for name in names}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total query time", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
