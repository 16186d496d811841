"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslake.operators import results
from presslake.plans.lineage import scratch_path
from presslake.sources import feeds, marks, opml, pages, sinks, split_feeds, state
from presslake.workloads import fixtures as fx
from presslake.workloads import sql
from presslake.workloads.registry import query

_OUTLINE_URL = """'https://' || source || '.example.com/' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.atom' ELSE '.xml?a=1&b=2' END"""


@query(
    "scan_opml",
    f"""SELECT doc_id // 50 AS list_id, {_OUTLINE_URL} AS feed_url,
       CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id || ' > 0' WHEN doc_id % 4 <> 1 THEN 'Text ' || doc_id || ' & "more"'
            ELSE {_OUTLINE_URL} END AS feed_title,
       CASE doc_id % 5 WHEN 0 THEN 'RSS' WHEN 1 THEN 'ATOM' ELSE CASE WHEN doc_id % 7 = 0 THEN 'ATOM' ELSE 'RSS' END END AS feed_type
FROM documents WHERE doc_id % 9 <> 4""",
)
def scan_opml(spark, sf_dir):
    return opml.scan_opml(fx.opml_documents(spark, sf_dir)).drop("outline_pos")


_FLAT = """v_outlines AS (
  SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 9 = 5 THEN ''
                 ELSE 'https://' || source || CASE WHEN doc_id % 7 = 0 THEN '/ATOM/' ELSE '/feed/' END || doc_id END AS xml_url,
         CASE doc_id % 3 WHEN 0 THEN 'Title ' || doc_id WHEN 1 THEN '' END AS title,
         CASE WHEN doc_id % 4 <> 1 THEN 'Text ' || doc_id END AS text,
         CASE doc_id % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'Atom' WHEN 2 THEN '' END AS type FROM documents)"""
_TYPE = """CASE WHEN type <> '' THEN upper(type) WHEN lower(xml_url) LIKE '%atom%' THEN 'ATOM' ELSE 'RSS' END"""


@query(
    "outline_to_feed",
    f"""WITH {_FLAT} SELECT doc_id, xml_url AS feed_url, coalesce(nullif(title, ''), nullif(text, ''), xml_url) AS feed_title,
       {_TYPE} AS feed_type FROM v_outlines WHERE xml_url <> ''""",
)
def outline_to_feed(spark, sf_dir):
    return opml.outline_to_feed(fx.outlines(spark, sf_dir))


@query("detect_feed_type", f"WITH {_FLAT} SELECT doc_id, {_TYPE} AS feed_type FROM v_outlines")
def detect_feed_type(spark, sf_dir):
    kind = opml.detect_feed_type(F.col("xml_url"), F.col("type"))
    return fx.outlines(spark, sf_dir).select("doc_id", kind.alias("feed_type"))


@query(
    "scan_feed_entries",
    f"""SELECT 'https://' || source || '.example.com/' || (doc_id // 200) || '.xml' AS feed_url,
       row_number() OVER (PARTITION BY source, doc_id // 200 ORDER BY doc_id) - 1 AS pos,
       CASE WHEN doc_id % 11 <> 7 THEN 'Doc ' || doc_id || ' <&>' END AS title,
       CASE WHEN doc_id % 17 <> 3 THEN 'https://www.' || source || '.example.com/a/' || doc_id END AS link,
       CASE WHEN doc_id % 23 <> 5 THEN {sql.iso(sql.stamp("doc_id"))} END AS published,
       CASE WHEN doc_id % 5 > 1 THEN 'Author ' || (doc_id % 7) END AS author,
       CASE WHEN (doc_id // 200) % 3 = 0 THEN text END AS description,
       CASE WHEN (doc_id // 200) % 3 <> 1 THEN text END AS summary,
       CASE WHEN (doc_id // 200) % 3 = 1 THEN text END AS content
FROM documents""",
)
def scan_feed_entries(spark, sf_dir):
    return feeds.scan_feed_entries(fx.feed_documents(spark, sf_dir)).drop("first_id")


@query(
    "scan_feed_files",
    f"""SELECT source || '-' || (doc_id // 200) AS feed_key,
       row_number() OVER (PARTITION BY source, doc_id // 200 ORDER BY doc_id) - 1 AS pos,
       CASE WHEN doc_id % 11 <> 7 THEN 'Doc ' || doc_id || ' <&>' END AS title,
       CASE WHEN doc_id % 17 <> 3 THEN 'https://www.' || source || '.example.com/a/' || doc_id END AS link,
       CASE WHEN doc_id % 23 <> 5 THEN {sql.iso(sql.stamp("doc_id"))} END AS published,
       CASE WHEN (doc_id // 200) % 3 = 0 THEN text END AS description,
       CASE WHEN (doc_id // 200) % 3 = 1 THEN text END AS content
FROM documents""",
)
def scan_feed_files(spark, sf_dir):
    """The feed documents landed as files and read item by item, whatever the size of a file."""
    root = scratch_path(spark, "feeds")
    key = F.regexp_replace("feed_url", r"^https://(.*)\.example\.com/(.*)\.xml$", "$1-$2")
    fx.feed_documents(spark, sf_dir).select(key.alias("feed"), "doc").write.partitionBy("feed").text(root)
    entries = split_feeds.read_feed_entries(spark, root)
    named = F.regexp_extract("path", "/feed=([^/]+)/", 1).alias("feed_key")
    return entries.select(named, "pos", "title", "link", "published", "description", "content")


@query(
    "feed_parse_status",
    """WITH d AS (SELECT 'https://' || source || '.example.com/' || (doc_id // 200) || '.xml' AS feed_url, min(doc_id) AS first_id
           FROM documents GROUP BY source, doc_id // 200)
SELECT feed_url, first_id % 7 <> 3 AS success, first_id % 7 = 5 AS malformed,
       CASE WHEN first_id % 7 = 3 THEN '无法获取 feed 数据' END AS error FROM d""",
)
def feed_parse_status(spark, sf_dir):
    first = F.col("first_id") % 7
    doc = F.when(first == 5, F.expr("substring(doc, 1, length(doc) - 20)")).when(first != 3, F.col("doc"))
    docs = fx.feed_documents(spark, sf_dir).withColumn("doc", doc)
    return feeds.feed_parse_status(docs).drop("first_id")


@query(
    "scan_history",
    f"""SELECT doc_id // 50 AS list_id, 'https://f' || doc_id || '.example.com/' AS feed_url, {sql.iso(sql.stamp("doc_id"))} AS last_id
FROM documents WHERE (doc_id // 50) % 5 <> 4""",
)
def scan_history(spark, sf_dir):
    config = state.parse_config_json(fx.config_documents(spark, sf_dir)).where("_corrupt_record IS NULL")
    return config.select("list_id", F.explode("his").alias("feed_url", "last_id"))


@query(
    "parse_config_json",
    """SELECT list_id, CASE WHEN k IN (2, 4) THEN NULL WHEN k = 1 THEN '' ELSE 'https://c.example.com/' || list_id END AS url,
       CASE WHEN k <> 4 THEN '5' END AS threads, CASE WHEN k <> 4 THEN 3 END AS log_days,
       CASE WHEN k <> 4 THEN n END AS n_feeds, k = 4 AS unreadable
FROM (SELECT doc_id // 50 AS list_id, (doc_id // 50) % 5 AS k, CAST(count(*) AS INTEGER) AS n FROM documents GROUP BY doc_id // 50)""",
)
def parse_config_json(spark, sf_dir):
    config = state.parse_config_json(fx.config_documents(spark, sf_dir))
    return config.select(
        "list_id", "url", "threads", "log_days",
        F.when(F.col("his").isNotNull(), F.size("his")).alias("n_feeds"),
        F.col("_corrupt_record").isNotNull().alias("unreadable"),
    )


@query(
    "scan_config_url_check",
    "SELECT DISTINCT doc_id // 50 AS list_id, (doc_id // 50) % 5 IN (0, 3) AS valid FROM documents",
)
def scan_config_url_check(spark, sf_dir):
    config = state.parse_config_json(fx.config_documents(spark, sf_dir))
    return state.config_valid(config).select("list_id", "valid")


@query("save_history", f"WITH {sql.HISTORY} SELECT feed_url, last_id FROM v_history")
def save_history(spark, sf_dir):
    root = scratch_path(spark, "history")
    state.save_history(fx.history(spark, sf_dir), root, 1)
    return state.load_history(spark, root)


@query(
    "marks_log",
    f"""WITH {sql.HISTORY.lstrip()}
SELECT feed_url, CASE WHEN length(last_id) > 0 AND doc % 3 = 1 THEN '2027-01-0' || doc % 9 ELSE last_id END AS last_id
FROM (SELECT feed_url, last_id, CAST(regexp_extract(feed_url, 'src([0-9]+)', 1) AS INTEGER) AS doc FROM v_history) WHERE doc % 5 <> 2""",
)
def marks_log(spark, sf_dir):
    """Marks published whole, then moved for some feeds, then forgotten for others; what a later run reads."""
    root = scratch_path(spark, "marks")
    history = fx.history(spark, sf_dir)
    source = F.regexp_extract("feed_url", "src([0-9]+)", 1).cast("int")
    marks.replace_marks(history, root, 0)
    moved = history.where((F.length("last_id") > 0) & (source % 3 == 1))
    marks.append_marks(moved.select("feed_url", F.concat(F.lit("2027-01-0"), source % 9).alias("last_id")), root, 1)
    marks.append_marks(history.where(F.lit(False)), root, 2, removed=history.where(source % 5 == 2))
    return marks.load_marks(spark, root)


@query(
    "write_results",
    f"WITH {sql.RESULTS}, {sql.RESULT_LINES} SELECT json FROM v_lines",
)
def write_results(spark, sf_dir):
    path = scratch_path(spark, "results")
    sinks.write_results(results.nest_output(fx.feed_results(spark, sf_dir), fx.articles(spark, sf_dir)), path)
    return spark.read.text(path).withColumnRenamed("value", "json")


@query(
    "scan_pages",
    """SELECT url, CASE WHEN page_id % 19 IN (4, 9) THEN NULL ELSE html END AS html,
       CASE page_id % 19 WHEN 4 THEN 'network' WHEN 9 THEN 'http' END AS error_kind FROM pages""",
)
def scan_pages(spark, sf_dir):
    p = F.col("page_id")
    crawl = fx.table(spark, sf_dir, "pages").select(
        "url",
        F.when(p % 19 == 9, 404).when(p % 19 != 4, 200).alias("status"),
        F.when(p % 19 != 4, F.when(p % 5 == 3, F.encode("html", "UTF-16BE")).otherwise(F.encode("html", "UTF-8"))).alias("body"),
        F.when(p % 5 == 3, "utf-16-be").when(p % 5 == 1, "ISO-8859-1").when(p % 5 == 2, "utf-8").alias("charset"),
        F.when(p % 19 == 4, "network").alias("error_kind"),
    )
    return pages.page_outcomes(crawl)
