"""Whole runs: the batch pipeline, two runs in a row, and their streaming forms."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from presslake.functions.urls import domain_of_url
from presslake.operators import incremental as inc
from presslake.plans import pipeline
from presslake.plans.lineage import landed, scratch_path
from presslake.sources.marks import append_marks, load_marks
from presslake.streaming import dedup, progress
from presslake.streaming import incremental as stream
from presslake.workloads import fixtures as fx
from presslake.workloads import sql
from presslake.workloads.registry import query


def pipeline_run(spark, sf_dir, materialize=None, keep_settled=True) -> pipeline.RunOutput:
    blocked = fx.table(spark, sf_dir, "pages").where("page_id % 50 = 7").select(domain_of_url(F.col("url")).alias("domain")).distinct()
    docs = fx.page_feed_documents(spark, sf_dir).select("feed_url", "doc")
    return pipeline.run(
        feeds=fx.page_feeds(spark, sf_dir),
        docs=docs,
        history=fx.page_history(spark, sf_dir),
        pages=fx.crawl_with_images(spark, sf_dir),
        blacklist=blocked,
        materialize=materialize,
        keep_settled=keep_settled,
        at=F.lit("2026-04-14 12:00:00").cast("timestamp_ntz"),
    )


_PIPELINE = (
    sql.EXTRACTED
    + f""",
  v_block AS (SELECT DISTINCT {sql.domain("url")} AS dom FROM pages WHERE page_id % 50 = 7),
  marked AS (
    SELECT s.* EXCLUDE (method, content), s.method AS m, s.content AS c, f.feed_ord, published <= h.last_id AS stale,
           took AND {sql.domain("link")} IN (SELECT dom FROM v_block) AS closed
    FROM settled s JOIN v_page_feeds f USING (feed_url) LEFT JOIN v_page_history h USING (feed_url)),
  shut AS (
    SELECT * EXCLUDE (m, c, images), CASE WHEN closed THEN '' ELSE images END AS images,
           CASE WHEN closed THEN CASE WHEN {sql.valid("description")} THEN 'description-fallback' ELSE 'failed' END ELSE m END AS method,
           CASE WHEN closed THEN CASE WHEN {sql.valid("description")} THEN {sql.strip_tags("description")} ELSE '' END ELSE c END AS content
    FROM marked),
  open AS (SELECT *, max(CAST(coalesce(stale, false) AS INT)) OVER (PARTITION BY feed_url ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM shut),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY pos) AS rn FROM open WHERE stop = 0 AND method <> 'failed' AND content <> ''),
  v_out AS (SELECT * FROM ranked WHERE rn <= 5)"""
)


@query(
    "article_pipeline",
    f"""WITH {_PIPELINE}
SELECT feed_ord, feed_url, 'Feed ' || feed_ord AS feed_title, 'RSS' AS feed_type, CAST(count(*) AS INTEGER) AS n_articles,
  string_agg(json_object('title', title, 'url', link, 'published', published, 'author', coalesce(author, 'Unknown'))::VARCHAR, chr(10) ORDER BY published DESC, pos) AS articles,
  string_agg(content, chr(10) ORDER BY published DESC, pos) AS contents, string_agg(images, chr(10) ORDER BY published DESC, pos) AS images
FROM v_out GROUP BY feed_ord, feed_url""",
)
def article_pipeline(spark, sf_dir):
    nested = pipeline_run(spark, sf_dir, landed, keep_settled=False).nested
    line = F.transform(
        "articles",
        lambda a: F.to_json(F.struct(*[a[n].alias(n) for n in ("title", "url", "published", "author")])),
    )
    return nested.select(
        "feed_ord", "feed_url", "feed_title", "feed_type", F.size("articles").alias("n_articles"),
        F.array_join(line, "\n").alias("articles"),
        F.array_join(F.transform("articles", lambda a: a["content"]), "\n").alias("contents"),
        F.array_join(F.transform("articles", lambda a: F.array_join(a["images"], " ")), "\n").alias("images"),
    )


@query(
    "article_pipeline_history",
    f"""WITH {_PIPELINE}, n AS (SELECT feed_url, max(published) AS new_id FROM v_out GROUP BY feed_url)
SELECT feed_url, coalesce(new_id, last_id) AS last_id FROM v_page_history FULL JOIN n USING (feed_url)""",
)
def article_pipeline_history(spark, sf_dir):
    return pipeline_run(spark, sf_dir, landed, keep_settled=False).history


@query(
    "blacklist_after_run",
    f"""WITH {_PIPELINE}, b AS (SELECT dom AS domain FROM v_block UNION SELECT 'weixin.sogou.com'),
  reached AS (SELECT *, coalesce(sum(CAST(method <> 'failed' AND content <> '' AS INT)) OVER (
                PARTITION BY feed_url ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM open WHERE stop = 0),
  n AS (SELECT {sql.domain("link")} AS domain FROM reached WHERE before < 5 AND error_kind = 'network' AND NOT closed)
SELECT domain, TIMESTAMP '2026-04-14 12:00:00' AS added_at, TIMESTAMP '2026-04-14 12:00:00' AS last_failed, count(*) AS fail_count,
       coalesce(any_value('网络错误'), '') AS reason FROM n WHERE domain NOT IN (SELECT domain FROM b) GROUP BY domain
UNION ALL SELECT domain, NULL, NULL, NULL, NULL FROM b""",
)
def blacklist_after_run(spark, sf_dir):
    return pipeline_run(spark, sf_dir, landed).blacklist


def _run_sql(name: str, source: str, marks: str) -> str:
    """CTEs of one run over a table of settled entries: {name}_kept and the next marks {name}_marks."""
    return f"""
  {name}_dated AS (SELECT e.*, m.last_id IS NOT NULL AND e.published <= m.last_id AS stale
                   FROM {source} e LEFT JOIN {marks} m USING (feed_url) WHERE link <> '' AND published IS NOT NULL),
  {name}_stop AS (SELECT *, max(CAST(stale AS INT)) OVER (PARTITION BY feed_url ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM {name}_dated),
  {name}_rank AS (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY pos) AS rn FROM {name}_stop WHERE stop = 0 AND success AND content <> ''),
  {name}_kept AS (SELECT feed_url, pos, link, published FROM {name}_rank WHERE rn <= 5),
  {name}_marks AS (SELECT feed_url, coalesce(n.new_id, m.last_id) AS last_id FROM {marks} m
                   FULL JOIN (SELECT feed_url, max(published) AS new_id FROM {name}_kept GROUP BY feed_url) n USING (feed_url))"""


# The first run sees the older part of each range of ids, the second everything.
_OLDER = "pos % 400 >= 200"
_TWO_RUNS = (
    sql.SETTLED
    + f""",
  none AS (SELECT feed_url, last_id FROM v_history WHERE false),
  older AS (SELECT * FROM v_settled WHERE {_OLDER}),"""
    + _run_sql("one", "older", "none")
    + ","
    + _run_sql("two", "v_settled", "one_marks")
)


@query("incremental_high_water", f"WITH {_TWO_RUNS} SELECT * FROM two_kept")
def incremental_high_water(spark, sf_dir):
    entries = fx.settled(spark, sf_dir)
    none = inc.history_clear(fx.history(spark, sf_dir))
    first = inc.limit_successes(inc.take_until_stale(entries.where(_OLDER), none))
    marks = inc.history_update(none, first)
    second = inc.limit_successes(inc.take_until_stale(entries, marks))
    return second.select("feed_url", "pos", "link", "published")


@query("incremental_stream", f"WITH {_TWO_RUNS} SELECT 0 AS batch, * FROM one_kept UNION ALL SELECT 1, * FROM two_kept")
def incremental_stream(spark, sf_dir):
    entries = fx.settled(spark, sf_dir)
    root = scratch_path(spark, "stream")
    landed, kept = f"{root}/landed", f"{root}/results"
    for part in (entries.where(_OLDER), entries):
        part.write.mode("append").parquet(landed)
        source = stream.read_entry_stream(spark, landed, entries.schema)
        run = stream.run_stream(source, f"{root}/history", kept, f"{root}/checkpoint", extract=lambda df: df)
        run.awaitTermination()
    return spark.read.parquet(kept).select("batch", "feed_url", "pos", "link", "published")


@query(
    "stream_incremental_state",
    f"WITH {_TWO_RUNS} SELECT feed_url, pos, link, published FROM one_kept UNION ALL SELECT feed_url, pos, link, published FROM two_kept",
)
def stream_incremental_state(spark, sf_dir):
    entries = fx.settled(spark, sf_dir)
    root = scratch_path(spark, "state")
    landed, kept = f"{root}/landed", f"{root}/kept"
    with _rocksdb(spark):
        for part in (entries.where(_OLDER), entries):
            part.write.mode("append").parquet(landed)
            marked = stream.keyed_marks(stream.read_entry_stream(spark, landed, entries.schema))
            run = marked.writeStream.format("parquet").option("path", kept).option("checkpointLocation", f"{root}/checkpoint")
            run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(entries.schema).parquet(kept).select("feed_url", "pos", "link", "published")


@query(
    "stream_initial_state",
    f"""WITH {sql.SETTLED.lstrip()},{_run_sql("one", "v_settled", "v_history")}
SELECT feed_url, pos, link, published FROM one_kept""",
)
def stream_initial_state(spark, sf_dir):
    """Keyed state that starts from the marks of earlier batch runs."""
    entries = fx.settled(spark, sf_dir)
    root = scratch_path(spark, "state")
    entries.write.parquet(f"{root}/landed")
    append_marks(fx.history(spark, sf_dir), f"{root}/marks", 0)
    with _rocksdb(spark):
        source = stream.read_entry_stream(spark, f"{root}/landed", entries.schema)
        marked = stream.keyed_marks(source, marks=load_marks(spark, f"{root}/marks"))
        run = marked.writeStream.format("parquet").option("path", f"{root}/kept").option("checkpointLocation", f"{root}/checkpoint")
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(entries.schema).parquet(f"{root}/kept").select("feed_url", "pos", "link", "published")


@contextmanager
def _rocksdb(spark):
    """The state store that keyed state needs."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


# Copies of an article land in the same micro-batch, in a later one, and after a restart.
_EARLIER = "event_id % 4 < 2"


@query(
    "dedup_stream",
    f"""WITH d AS (SELECT 'https://x.example.com/' || user_id AS url_key, strftime(ts, '%Y-%m-%d') AS published,
                    'f' || (event_id % 3) AS feed_url, event_id AS pos, CASE WHEN {_EARLIER} THEN 0 ELSE 1 END AS batch FROM events)
SELECT batch, url_key, published, feed_url, pos FROM d
QUALIFY row_number() OVER (PARTITION BY url_key, published ORDER BY batch, feed_url, pos) = 1""",
)
def dedup_stream(spark, sf_dir):
    e = F.col("event_id")
    tail = F.when(e % 3 == 0, "?utm_source=a").when(e % 3 == 1, "#top").otherwise("")
    rows = fx.table(spark, sf_dir, "events").select(
        fx.text_of("f", e % 3).alias("feed_url"), e.alias("pos"), fx.text_of("https://x.example.com/", F.col("user_id"), tail).alias("link"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("published"), "event_id",
    )
    root = scratch_path(spark, "dedup")
    for part in (rows.where(_EARLIER), rows.where(f"NOT ({_EARLIER})")):
        part.drop("event_id").write.mode("append").parquet(f"{root}/landed")
        source = stream.read_entry_stream(spark, f"{root}/landed", part.drop("event_id").schema)
        dedup.run_dedup_stream(source, f"{root}/seen", f"{root}/kept", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/kept").select("batch", "url_key", "published", "feed_url", "pos")


@query(
    "progress_metrics",
    f"WITH {sql.RESULTS} SELECT count(*) AS feeds_done, count(*) FILTER (WHERE success) AS feeds_ok FROM v_results",
)
def progress_metrics(spark, sf_dir):
    """Results that land while feeds are worked off, passed on by a stream; its progress table, summed up."""
    root = scratch_path(spark, "progress")
    landed = fx.feed_results(spark, sf_dir)
    landed.repartition(4).write.parquet(f"{root}/landed")
    results = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/landed")
    seen = progress.watched(results, feeds_done=F.count(F.lit(1)), feeds_ok=F.count_if("success"))
    log = progress.ProgressLog(spark, f"{root}/progress")
    spark.streams.addListener(log)
    try:
        run = seen.writeStream.format("parquet").option("path", f"{root}/results").option("checkpointLocation", f"{root}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
        if not log.finished() or log.errors:
            raise RuntimeError(f"progress was not recorded: {log.errors}")
    finally:
        spark.streams.removeListener(log)
    done = spark.read.parquet(f"{root}/progress")
    return done.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("feeds_done", "feeds_ok")])
