"""Plans keep the shape the data size needs."""

import re

import pytest
from pyspark.sql import functions as F

from presslake.operators import incremental as inc
from presslake.plans.lineage import shared_folder
from presslake.workloads import QUERIES
from presslake.workloads import fixtures as fx


def plan_of(df, mode="formatted"):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", ["main_text_density", "body_text", "image_collect", "selector_cascade", "strategy_cascade", "html_blocks"])
def test_page_work_never_shuffles(spark, sf_dir, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, sf_dir))


# Queries that write and read again: their last plan is a scan.
WRITING = {
    "save_history", "write_results", "blacklist_persist", "incremental_stream", "stream_incremental_state", "progress_metrics",
    "marks_log", "scan_feed_files", "stream_initial_state", "dedup_stream",
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_cross_joins(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir), "simple")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_first_k_is_cut_before_the_shuffle(spark, sf_dir):
    plan = plan_of(inc.limit_successes(fx.settled(spark, sf_dir)), "simple")
    assert re.search(r"WindowGroupLimit .*Partial", plan) and re.search(r"WindowGroupLimit .*Final", plan)


def test_scan_reads_only_needed_columns(spark, sf_dir):
    rows = fx.entries(spark, sf_dir).select("feed_url", "pos", "link", "published")
    plan = plan_of(inc.take_until_stale(rows, fx.history(spark, sf_dir)))
    schemas = set(re.findall(r"ReadSchema: (struct<[^\n]*>)", plan))
    assert schemas and all("text" not in s for s in schemas)


def test_hot_feed_is_split(spark):
    """One feed holds most rows; its join partition is split although the plan above groups by the same key."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        n = 60_000
        rows = spark.range(n, numPartitions=16).select(
            F.when(F.col("id") % 10 < 6, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 500)).alias("feed_url"),
            F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("link"),
            F.lit("2026-01-01T00:00:00").alias("published"),
        )
        marks = spark.range(500).select(F.concat(F.lit("f"), F.col("id")).alias("feed_url"), F.lit("2025-01-01T00:00:00").alias("last_id"))
        joined = inc.history_lookup(rows, marks.union(spark.createDataFrame([("hot", "2025-01-01T00:00:00")], marks.schema)))
        counts = joined.groupBy("feed_url").agg(F.count("last_id").alias("n"), F.max("link"))
        assert counts.where("feed_url = 'hot'").first().n == n * 6 // 10
        counts.collect()
        assert "skew=true" in plan_of(counts, "simple")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (named or spark.sparkContext.getCheckpointDir())


def test_only_pages_that_are_asked_for_are_shuffled(spark):
    from presslake.sources.pages import candidate_pages, page_join

    pages = spark.range(20000, numPartitions=4).select(
        F.concat(F.lit("https://e.org/"), "id").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 9).alias("html"), F.lit(None).cast("string").alias("error_kind")
    )
    asked = spark.range(0, 40000, 400).select(F.concat(F.lit("https://e.org/"), "id").alias("link")).union(spark.sql("select cast(null as string)"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = candidate_pages(pages, asked)
        assert 50 <= near.count() < 100
        plain, reduced = page_join(asked, pages), page_join(asked, pages, reduce=True)
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, reduced.collect()))
        plan = plan_of(reduced, "simple")
        # The HTML side's exchange lies above the broadcast filter.
        wide = plan[plan.index("html#"):]
        assert "SortMergeJoin" in plan and wide.index("Exchange hashpartitioning(_url") < wide.index("BroadcastHashJoin [_at")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_run_blocking_moves_no_html(spark, sf_dir):
    from presslake.operators import blacklist as bl
    from presslake.plans import pipeline

    candidates = pipeline.new_candidates(fx.page_feeds(spark, sf_dir), fx.page_feed_documents(spark, sf_dir).select("feed_url", "doc"), fx.page_history(spark, sf_dir), 5)
    out = pipeline.extract_candidates(candidates, fx.crawl_with_images(spark, sf_dir), bl.permanent_domains(spark), block_within_run=True)
    plan = plan_of(out, "simple")
    for exchange in re.findall(r"Exchange hashpartitioning\(_domain[^\n]*", plan):
        assert "html" not in exchange
    assert out.count() == candidates.count()
