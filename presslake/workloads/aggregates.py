"""Aggregations, orderings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslake.operators import blacklist as bl
from presslake.operators import dedup, results
from presslake.operators import incremental as inc
from presslake.plans.lineage import scratch_path
from presslake.schemas import BLACKLIST
from presslake.workloads import fixtures as fx
from presslake.workloads import sql
from presslake.workloads.registry import query


@query(
    "history_update",
    f"""WITH {sql.LIMITED}, n AS (SELECT feed_url, max(published) AS new_id FROM limited GROUP BY feed_url)
SELECT feed_url, coalesce(new_id, last_id) AS last_id FROM v_history FULL JOIN n USING (feed_url)""",
)
def history_update(spark, sf_dir):
    history = fx.history(spark, sf_dir)
    return inc.history_update(history, _limited(spark, sf_dir, history))


def _limited(spark, sf_dir, history):
    return inc.limit_successes(inc.take_until_stale(fx.settled(spark, sf_dir), history))


@query("blacklist_build", f"WITH {sql.FAILURES} SELECT * FROM v_listed")
def blacklist_build(spark, sf_dir):
    return bl.blacklist_build(fx.failures(spark, sf_dir), fx.seeds(spark, sf_dir))


@query(
    "blacklist_added_flag",
    f"""WITH {sql.FAILURES}
SELECT pos, domain, domain IS NOT NULL AND domain NOT IN (SELECT domain FROM v_seeds)
       AND row_number() OVER (PARTITION BY domain ORDER BY ts, pos) = 1 AS added FROM filed""",
)
def blacklist_added_flag(spark, sf_dir):
    return bl.blacklist_added_flag(fx.failures(spark, sf_dir), fx.seeds(spark, sf_dir)).select("pos", "domain", "added")


@query("blacklist_size", f"WITH {sql.FAILURES} SELECT count(DISTINCT domain) AS n_domains FROM v_listed")
def blacklist_size(spark, sf_dir):
    return bl.blacklist_size(blacklist_build(spark, sf_dir))


@query("blacklist_list", f"WITH {sql.FAILURES} SELECT DISTINCT domain FROM v_listed")
def blacklist_list(spark, sf_dir):
    return bl.blacklist_list(blacklist_build(spark, sf_dir))


@query("blacklist_metadata", f"WITH {sql.FAILURES} SELECT * FROM v_listed WHERE fail_count IS NOT NULL")
def blacklist_metadata(spark, sf_dir):
    return bl.blacklist_metadata(blacklist_build(spark, sf_dir))


@query(
    "blacklist_union_seed",
    f"""WITH {sql.FAILURES} SELECT domain FROM filed WHERE domain IS NOT NULL UNION SELECT domain FROM v_seeds""",
)
def blacklist_union_seed(spark, sf_dir):
    return bl.union_seed(blacklist_build(spark, sf_dir), fx.seeds(spark, sf_dir))


@query("blacklist_persist", f"WITH {sql.FAILURES} SELECT * FROM v_listed")
def blacklist_persist(spark, sf_dir):
    path = scratch_path(spark, "blacklist")
    blacklist_build(spark, sf_dir).write.parquet(path)
    return spark.read.schema(BLACKLIST).parquet(path)


@query("feed_count", f"WITH {sql.HISTORY} SELECT count(*) AS feed_count FROM v_history")
def feed_count(spark, sf_dir):
    return inc.feed_count(fx.history(spark, sf_dir))


@query(
    "run_summary",
    f"""WITH {sql.RESULTS} SELECT count(*) AS total_feeds, count(*) FILTER (WHERE success) AS successful_feeds,
  count(*) FILTER (WHERE NOT success) AS failed_feeds,
  (SELECT count(*) FROM v_articles JOIN v_results USING (feed_url) WHERE success) AS total_articles FROM v_results""",
)
def run_summary(spark, sf_dir):
    return results.run_summary(fx.feed_results(spark, sf_dir), fx.articles(spark, sf_dir))


@query("run_summary_failed_feeds", f"WITH {sql.RESULTS} SELECT feed_ord, feed_url FROM v_results WHERE NOT success ORDER BY feed_ord")
def run_summary_failed_feeds(spark, sf_dir):
    return results.failed_feed_list(fx.feed_results(spark, sf_dir))


@query(
    "feed_success_stats",
    f"WITH {sql.RESULTS} SELECT count(*) FILTER (WHERE success) AS success_count, count(*) AS total FROM v_results",
)
def feed_success_stats(spark, sf_dir):
    return results.feed_success_stats(fx.feed_results(spark, sf_dir))


@query(
    "entries_checked",
    f"""WITH {sql.LIMITED}, bound AS (
  SELECT feed_url, min(p) AS last_pos FROM (
    SELECT feed_url, min(pos) AS p FROM stopped WHERE stale GROUP BY feed_url
    UNION ALL SELECT feed_url, pos FROM ranked WHERE rn = 5) GROUP BY feed_url)
SELECT feed_url, count(*) FILTER (WHERE last_pos IS NULL OR pos <= last_pos) AS entries_checked
FROM v_entries LEFT JOIN bound USING (feed_url) GROUP BY feed_url""",
)
def entries_checked(spark, sf_dir):
    history, entries = fx.history(spark, sf_dir), fx.entries(spark, sf_dir)
    good = inc.require_content(inc.take_until_stale(fx.settled(spark, sf_dir), history))
    return inc.entries_checked(entries, history, good)


@query(
    "all_articles",
    f"WITH {sql.RESULTS} SELECT feed_url, pos, title, url, published, author FROM v_articles JOIN (SELECT feed_url FROM v_results WHERE success) USING (feed_url)",
)
def all_articles(spark, sf_dir):
    rows = fx.articles(spark, sf_dir).select("feed_url", "pos", "title", "url", "published", "author")
    return results.all_articles(fx.feed_results(spark, sf_dir), rows)


_NESTED = """SELECT r.feed_ord, r.feed_url, r.feed_title, r.feed_type,
  string_agg(json_object('title', title, 'url', url, 'published', published, 'author', author, 'content', content,
             'images', CASE WHEN has_image THEN ['https://i.example.com/' || pos || '.png'] ELSE [] END)::VARCHAR, chr(10)
             ORDER BY coalesce(published, '') DESC, pos) AS articles
FROM v_results r JOIN v_articles a USING (feed_url) WHERE r.success GROUP BY ALL"""


@query("nest_output", f"WITH {sql.RESULTS} {_NESTED}")
def nest_output(spark, sf_dir):
    nested = results.nest_output(fx.feed_results(spark, sf_dir), fx.articles(spark, sf_dir))
    line = F.transform(
        "articles",
        lambda a: F.to_json(
            F.struct(a["title"].alias("title"), a["url"].alias("url"), a["published"].alias("published"), a["author"].alias("author"),
                     a["content"].alias("content"), a["images"].alias("images")),
            {"ignoreNullFields": "false"},
        ),
    )
    return nested.withColumn("articles", F.array_join(line, "\n"))


@query(
    "to_result_json",
    f"WITH {sql.RESULTS}, {sql.RESULT_LINES} SELECT feed_ord, json FROM v_lines",
)
def to_result_json(spark, sf_dir):
    return results.to_result_json(results.nest_output(fx.feed_results(spark, sf_dir), fx.articles(spark, sf_dir)))


@query("take_until_stale", f"WITH {sql.STALE} SELECT feed_url, pos, link, published FROM alive")
def take_until_stale(spark, sf_dir):
    rows = fx.entries(spark, sf_dir).select("feed_url", "pos", "link", "published")
    return inc.take_until_stale(rows, fx.history(spark, sf_dir))


@query("limit_successes", f"WITH {sql.LIMITED} SELECT feed_url, pos, title, link, published, content FROM limited")
def limit_successes(spark, sf_dir):
    return _limited(spark, sf_dir, fx.history(spark, sf_dir)).drop("success")


@query(
    "sort_published_desc",
    f"WITH {sql.ENTRIES} SELECT feed_url, pos, published FROM v_entries ORDER BY feed_url, published DESC NULLS LAST, pos",
)
def sort_published_desc(spark, sf_dir):
    return inc.sort_published_desc(fx.entries(spark, sf_dir).select("feed_url", "pos", "published"), "feed_url")


@query(
    "latest_per_feed",
    f"""WITH {sql.LIMITED} SELECT feed_url, published, pos, title FROM (
  SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY published DESC, pos) AS r FROM limited) WHERE r = 1""",
)
def latest_per_feed(spark, sf_dir):
    return inc.latest_per_feed(_limited(spark, sf_dir, fx.history(spark, sf_dir)), "title")


@query(
    "newest_k",
    f"""WITH {sql.ENTRIES} SELECT feed_url, pos, published FROM (
  SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY published DESC NULLS LAST, pos) AS r FROM v_entries) WHERE r <= 5""",
)
def newest_k(spark, sf_dir):
    return inc.newest_k(fx.entries(spark, sf_dir).select("feed_url", "pos", "published"))


@query(
    "history_remove_feed",
    f"WITH {sql.HISTORY} SELECT * FROM v_history WHERE feed_url NOT IN (SELECT feed_url FROM v_entries WHERE pos % 20 IN (3, 10, 14))",
)
def history_remove_feed(spark, sf_dir):
    gone = fx.entries(spark, sf_dir).where("pos % 20 IN (3, 10, 14)").select("feed_url").distinct()
    return inc.history_remove(fx.history(spark, sf_dir), gone)


@query("history_clear", f"WITH {sql.HISTORY} SELECT * FROM v_history WHERE false")
def history_clear(spark, sf_dir):
    return inc.history_clear(fx.history(spark, sf_dir))


@query(
    "history_set_marks",
    f"""WITH {sql.HISTORY} SELECT * FROM v_history WHERE length(feed_url) % 2 = 1 AND feed_url NOT LIKE '%7.example%'
UNION ALL SELECT DISTINCT feed_url, '2030-01-01T00:00:00' FROM v_entries WHERE feed_url LIKE '%7.example%'""",
)
def history_set_marks(spark, sf_dir):
    marks = fx.entries(spark, sf_dir).where("feed_url LIKE '%7.example%'").select("feed_url").distinct()
    return inc.set_marks(fx.history(spark, sf_dir), marks.withColumn("last_id", F.lit("2030-01-01T00:00:00")))


_DUPES = r"""v_dupes AS (
  SELECT 'f' || (event_id % 3) AS feed_url, event_id AS pos, 'https://x.example.com/' || user_id || CASE event_id % 3 WHEN 0 THEN '?utm_source=a'
         WHEN 1 THEN '#top' ELSE '' END AS link, strftime(date_trunc('day', ts), '%Y-%m-%d') AS published, user_id FROM events)"""


@query(
    "dedup_url_timestamp",
    f"""WITH {_DUPES} SELECT feed_url, pos, link, published FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, published ORDER BY feed_url, pos) AS r FROM v_dupes) WHERE r = 1 AND user_id % 10 <> 3""",
)
def dedup_url_timestamp(spark, sf_dir):
    e, user = F.col("event_id"), F.col("user_id")
    tail = F.when(e % 3 == 0, "?utm_source=a").when(e % 3 == 1, "#top").otherwise("")
    rows = fx.table(spark, sf_dir, "events").select(
        fx.text_of("f", e % 3).alias("feed_url"), e.alias("pos"), fx.text_of("https://x.example.com/", user, tail).alias("link"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("published"), "user_id",
    )
    seen = rows.where("user_id % 10 = 3").select(fx.text_of("https://x.example.com/", user).alias("url_key"), "published").distinct()
    return dedup.dedup_url_timestamp(rows, seen).select("feed_url", "pos", "link", "published")
