"""Filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslake.operators import blacklist as bl
from presslake.operators import incremental as inc
from presslake.operators import results
from presslake.sources import pages
from presslake.workloads import fixtures as fx
from presslake.workloads import sql
from presslake.workloads.registry import query


@query("history_lookup", f"WITH {sql.HISTORY} SELECT pos, feed_url, last_id FROM v_entries LEFT JOIN v_history USING (feed_url)")
def history_lookup(spark, sf_dir):
    rows = fx.entries(spark, sf_dir).select("feed_url", "pos")
    return inc.history_lookup(rows, fx.history(spark, sf_dir))


# Marks and stamps in every combination of zoned, zone-less and unreadable.
_MIXED = (
    sql.HISTORY
    + """,
  v_marks AS (SELECT feed_url, last_id || CASE WHEN length(feed_url) % 3 = 0 THEN 'Z' ELSE '' END AS last_id FROM v_history),
  v_stamps AS (SELECT feed_url, pos, published AS p, pos % 5 AS form,
                      CASE pos % 5 WHEN 0 THEN published || 'Z' WHEN 1 THEN published WHEN 2 THEN published || '+00:00'
                      WHEN 3 THEN 'issue ' || (pos % 2) ELSE replace(published, 'T', ' ') END AS published FROM v_entries),
  v_mixed AS (SELECT s.*, m.last_id, h.last_id AS mark, m.last_id LIKE '%Z' AS mark_zoned, form IN (0, 2) AS zoned
              FROM v_stamps s LEFT JOIN v_marks m USING (feed_url) LEFT JOIN v_history h USING (feed_url))"""
)
_NEWER = """CASE WHEN last_id IS NULL THEN true WHEN form <> 3 AND p IS NOT NULL AND zoned = mark_zoned THEN p > mark ELSE {else_} END"""


def _mixed(spark, sf_dir):
    at, pos = F.col("published"), F.col("pos") % 5
    form = (
        F.when(pos == 0, fx.text_of(at, "Z")).when(pos == 1, at).when(pos == 2, fx.text_of(at, "+00:00"))
        .when(pos == 3, fx.text_of("issue ", F.col("pos") % 2)).otherwise(F.replace(at, F.lit("T"), F.lit(" ")))
    )
    rows = fx.entries(spark, sf_dir).select("feed_url", "pos", form.alias("published"))
    zone = F.when(F.length("feed_url") % 3 == 0, "Z").otherwise("")
    marks = fx.history(spark, sf_dir).withColumn("last_id", fx.text_of(F.col("last_id"), zone))
    return rows, marks


@query("is_newer_than_last", f"WITH {_MIXED} SELECT pos, {_NEWER.format(else_='true')} AS is_new FROM v_mixed")
def is_newer_than_last(spark, sf_dir):
    return inc.with_is_new(*_mixed(spark, sf_dir)).select("pos", "is_new")


@query(
    "is_newer_than_last_id",
    f"WITH {_MIXED} SELECT pos, {_NEWER.format(else_='published IS DISTINCT FROM last_id')} AS is_new FROM v_mixed",
)
def is_newer_than_last_id(spark, sf_dir):
    return inc.with_is_new(*_mixed(spark, sf_dir), by_id=True).select("pos", "is_new")


@query(
    "is_new_article",
    f"WITH {sql.HISTORY} SELECT pos, link, last_id IS NULL OR published IS NULL OR published > last_id AS is_new FROM v_entries LEFT JOIN v_history USING (feed_url)",
)
def is_new_article(spark, sf_dir):
    return inc.with_is_new(fx.entries(spark, sf_dir), fx.history(spark, sf_dir)).select("pos", "link", "is_new")


@query(
    "should_skip_article",
    f"WITH {sql.HISTORY} SELECT pos, coalesce(published <= last_id, false) AS should_skip FROM v_entries LEFT JOIN v_history USING (feed_url)",
)
def should_skip_article(spark, sf_dir):
    return inc.should_skip(fx.entries(spark, sf_dir), fx.history(spark, sf_dir)).select("pos", "should_skip")


@query(
    "filter_articles",
    f"WITH {sql.HISTORY} SELECT feed_url, pos, published FROM v_entries LEFT JOIN v_history USING (feed_url) WHERE NOT coalesce(published <= last_id, false)",
)
def filter_articles(spark, sf_dir):
    return inc.filter_articles(fx.entries(spark, sf_dir), fx.history(spark, sf_dir)).select("feed_url", "pos", "published")


@query("require_link", f"WITH {sql.ENTRIES} SELECT pos, link FROM v_entries WHERE link <> ''")
def require_link(spark, sf_dir):
    return inc.require_link(fx.entries(spark, sf_dir)).select("pos", "link")


@query("require_content", f"WITH {sql.SETTLED} SELECT pos, content FROM v_settled WHERE success AND content <> ''")
def require_content(spark, sf_dir):
    return inc.require_content(fx.settled(spark, sf_dir)).select("pos", "content")


_LISTED = f"(link IN (SELECT domain FROM v_blacklist) OR coalesce({sql.domain('link')} IN (SELECT domain FROM v_blacklist), false))"


@query("blacklist_match", f"WITH {sql.PROBES} SELECT event_id, link FROM v_probes WHERE {_LISTED}")
def blacklist_match(spark, sf_dir):
    return bl.blacklist_match(fx.probes(spark, sf_dir), fx.blacklist(spark, sf_dir))


@query("blacklist_exclude", f"WITH {sql.PROBES} SELECT event_id, link FROM v_probes WHERE NOT {_LISTED}")
def blacklist_exclude(spark, sf_dir):
    return bl.blacklist_exclude(fx.probes(spark, sf_dir), fx.blacklist(spark, sf_dir))


@query(
    "page_join",
    f"""WITH {sql.PAGE_ENTRIES} SELECT pos, link, html, error_kind FROM v_page_entries e JOIN v_crawl c ON e.link = c.url""",
)
def page_join(spark, sf_dir):
    return pages.page_join(fx.page_entries(spark, sf_dir).select("pos", "link"), fx.crawl(spark, sf_dir).drop("page_id"), reduce=True)


@query(
    "result_reorder",
    f"""WITH {sql.RESULTS}
SELECT feed_ord, feed_url, feed_title, feed_type, success, error FROM v_results WHERE feed_ord % 4 <> 1
UNION ALL SELECT feed_ord, feed_url, feed_title, feed_type, NOT success, 'later' FROM v_results WHERE feed_ord % 4 = 1
UNION ALL SELECT feed_ord + 1000000000, feed_url, feed_title, feed_type, success, error FROM v_results WHERE feed_ord % 12 = 0""",
)
def result_reorder(spark, sf_dir):
    done = fx.feed_results(spark, sf_dir)
    listed = done.select("feed_ord", "feed_url", "feed_title", "feed_type")
    again = listed.where("feed_ord % 12 = 0").withColumn("feed_ord", F.col("feed_ord") + F.lit(1000000000))
    first = done.select("feed_url", F.col("feed_ord").alias("finished_ord"), "success", "error")
    later = done.where("feed_ord % 4 = 1").select(
        "feed_url", (F.col("feed_ord") + F.lit(5)).alias("finished_ord"), (~F.col("success")).alias("success"), F.lit("later").alias("error")
    )
    return results.result_reorder(listed.union(again), first.union(later))


@query("successful_results", f"WITH {sql.RESULTS} SELECT * FROM v_results WHERE success")
def successful_results(spark, sf_dir):
    return results.successful_results(fx.feed_results(spark, sf_dir))


@query("failed_results", f"WITH {sql.RESULTS} SELECT * FROM v_results WHERE NOT success")
def failed_results(spark, sf_dir):
    return results.failed_results(fx.feed_results(spark, sf_dir))
