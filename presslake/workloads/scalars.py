"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslake.functions import dates, images, text, urls
from presslake.operators import dedup, extraction, incremental, results
from presslake.sources import feeds
from presslake.workloads import fixtures as fx
from presslake.workloads import sql
from presslake.workloads.registry import query

_PADDED = "chr(9) || replace(text, ' th', ' ' || chr(160) || chr(10) || chr(10) || ' th') || '  '"


@query("clean_text", f"SELECT doc_id, {sql.clean(_PADDED)} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    padded = fx.text_of("\t", F.replace(F.col("text"), F.lit(" th"), F.lit(" \xa0\n\n th")), "  ")
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.clean_text(padded).alias("cleaned"))


@query("strip_html_tags", f"SELECT page_id, {sql.strip_tags('html')} AS stripped FROM pages")
def strip_html_tags(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", text.strip_html_tags(F.col("html")).alias("stripped"))


@query("html_unescape", f"SELECT page_id, {sql.decoded('html')} AS unescaped FROM pages")
def html_unescape(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", text.html_unescape(F.col("html")).alias("unescaped"))


# Whole texts, every fourth behind so many control characters that some pass the allowed share.
_MANGLED = """CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN repeat(chr(1), CAST(length(text) // (7 + doc_id % 5) AS INTEGER)) || text
                  WHEN 2 THEN chr(10) || text ELSE chr(9) || text || chr(31) END"""


@query("content_valid", f"SELECT doc_id, {sql.valid('t')} AS valid FROM (SELECT doc_id, {_MANGLED} AS t FROM documents)")
def content_valid(spark, sf_dir):
    return _mangled(spark, sf_dir).select("doc_id", text.content_valid(F.col("t")).alias("valid"))


def _mangled(spark, sf_dir):
    d = F.col("doc_id")
    t = (
        F.when(d % 4 == 0, F.col("text"))
        .when(d % 4 == 1, fx.text_of(F.repeat(F.lit("\x01"), F.floor(F.length("text") / (7 + d % 5)).cast("int")), F.col("text")))
        .when(d % 4 == 2, fx.text_of("\n", F.col("text")))
        .otherwise(fx.text_of("\t", F.col("text"), "\x1f"))
    )
    return fx.table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))


@query("low_quality_flag", f"SELECT doc_id, NOT {sql.valid('t')} AS low_quality FROM (SELECT doc_id, {_MANGLED} AS t FROM documents)")
def low_quality_flag(spark, sf_dir):
    return dedup.low_quality_flag(_mangled(spark, sf_dir), "t").select("doc_id", "low_quality")


_FORMS = """CASE event_id % 8 WHEN 0 THEN strftime(s, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(s, '%a, %d %b %Y %H:%M:%S +0800')
  WHEN 2 THEN strftime(s, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN strftime(s, '%Y-%m-%dT%H:%M:%S-03:30')
  WHEN 4 THEN strftime(s, '%d %b %Y %H:%M GMT') WHEN 5 THEN strftime(s, '%Y-%m-%d') WHEN 6 THEN 'no date' END"""


def _dates(spark, sf_dir):
    """Event times written in several formats."""
    s = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").cast("string")
    day, clock = F.substring(s, 1, 10), F.substring(s, 12, 8)
    month = F.element_at(F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]), F.month("ts"))
    weekday = F.element_at(F.array(*[F.lit(n) for n in "Sun Mon Tue Wed Thu Fri Sat".split()]), F.dayofweek("ts"))
    mail = fx.text_of(F.substring(s, 9, 2), " ", month, " ", F.substring(s, 1, 4), " ")
    e = F.col("event_id") % 8
    form = (
        F.when(e == 0, fx.text_of(day, "T", clock, "Z"))
        .when(e == 1, fx.text_of(weekday, ", ", mail, clock, " +0800"))
        .when(e == 2, fx.text_of(day, " ", clock))
        .when(e == 3, fx.text_of(day, "T", clock, "-03:30"))
        .when(e == 4, fx.text_of(mail, F.substring(clock, 1, 5), " GMT"))
        .when(e == 5, day)
        .when(e == 6, "no date")
    )
    return fx.table(spark, sf_dir, "events").select("event_id", form.alias("written"), s.alias("s"))


def _free_form(s):
    """The same times, each in one of several forms that are neither ISO nor mail dates; every seventh is no time."""
    e = F.floor(F.col("event_id") / 8) % 7
    year, mm, dd, hh, mi, ss = (F.substring(s, at, n) for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2)))
    long_names = "January February March April May June July August September October November December".split()
    month = F.element_at(F.array(*[F.lit(m) for m in long_names]), mm.cast("int"))
    day, hour = dd.cast("int").cast("string"), hh.cast("int")
    half = ((hour + 11) % 12 + 1).cast("string")
    return (
        F.when(e == 0, fx.text_of(month, " ", day, ", ", year, " at ", hh, ":", mi, ":", ss))
        .when(e == 1, fx.text_of(mm, "/", dd, "/", year, " ", half, ":", mi, F.when(hour < 12, " a.m.").otherwise(" PM")))
        .when(e == 2, fx.text_of(year, mm, dd, "T", hh, mi, ss, "Z"))
        .when(e == 3, fx.text_of(day, "-", F.substring(month, 1, 3), "-", F.substring(year, 3, 2)))
        .when(e == 4, fx.text_of(F.substring(month, 1, 3), " ", dd, " ", hh, ":", mi, ":", ss, " UTC ", year))
        .when(e == 5, fx.text_of(hh, "h", mi, "m +0530, ", day, "th of ", F.upper(month), " ", year))
        .otherwise(fx.text_of("30 February ", year, " ", hh, ":", mi))
    )


@query(
    "parse_timestamp",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00')
  WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S-03:30')
  WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:00+00:00') WHEN 5 THEN strftime(ts, '%Y-%m-%dT00:00:00')
  WHEN 7 THEN CASE event_id // 8 % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:00')
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 3 THEN strftime(ts, '%Y-%m-%dT00:00:00')
    WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') WHEN 5 THEN strftime(ts, '%Y-%m-%dT%H:%M:00+05:30') END END AS parsed FROM events""",
)
def parse_timestamp(spark, sf_dir):
    written = F.when(F.col("event_id") % 8 == 7, _free_form(F.col("s"))).otherwise(F.col("written"))
    return _dates(spark, sf_dir).select("event_id", dates.parse_timestamp(written).alias("parsed"))


@query(
    "published_coalesce",
    """SELECT event_id, strftime(CASE event_id % 8 WHEN 1 THEN ts - INTERVAL 8 HOUR WHEN 3 THEN ts + INTERVAL 210 MINUTE
  WHEN 4 THEN date_trunc('minute', ts) WHEN 5 THEN date_trunc('day', ts) WHEN 7 THEN TIMESTAMP '2020-01-02 03:04:05'
  WHEN 6 THEN CASE WHEN event_id % 3 = 0 THEN NULL ELSE TIMESTAMP '2020-01-02 03:04:05' END ELSE ts END, '%Y-%m-%dT%H:%M:%S') AS published
FROM events""",
)
def published_coalesce(spark, sf_dir):
    updated = F.when(F.col("event_id") % 3 == 0, "soon").otherwise("2020-01-02T03:04:05Z")
    created = F.when(F.col("event_id") % 8 == 7, "Thu, 02 Jan 2020 03:04:05 UT")
    return _dates(spark, sf_dir).select(
        "event_id", dates.published_coalesce(F.col("written"), updated, created).alias("published")
    )


@query(
    "article_id",
    f"WITH {sql.ENTRIES} SELECT pos, published AS _id, 'published' AS _id_type FROM v_entries WHERE published IS NOT NULL",
)
def article_id(spark, sf_dir):
    return feeds.article_ids(fx.entries(spark, sf_dir)).select("pos", "_id", "_id_type")


@query("article_id_rejected", f"WITH {sql.ENTRIES} SELECT pos, title, link FROM v_entries WHERE published IS NULL")
def article_id_rejected(spark, sf_dir):
    return feeds.entries_without_id(fx.entries(spark, sf_dir)).select("pos", "title", "link")


@query(
    "description_coalesce",
    f"""WITH {sql.ENTRIES} SELECT pos, CASE WHEN description <> '' THEN description WHEN summary <> '' THEN summary
    WHEN content <> '' THEN content END AS description FROM v_entries""",
)
def description_coalesce(spark, sf_dir):
    value = feeds.description_coalesce(F.col("description"), F.col("summary"), F.col("content"))
    return fx.entries(spark, sf_dir).select("pos", value.alias("description"))


@query(
    "author_coalesce",
    f"WITH {sql.ENTRIES} SELECT pos, CASE WHEN author <> '' THEN author WHEN author_name <> '' THEN author_name ELSE 'Unknown' END AS author FROM v_entries",
)
def author_coalesce(spark, sf_dir):
    value = feeds.author_coalesce(F.col("author"), F.col("author_name"))
    return fx.entries(spark, sf_dir).select("pos", value.alias("author"))


@query(
    "title_default", f"WITH {sql.ENTRIES} SELECT pos, CASE WHEN title <> '' THEN title ELSE 'Unknown' END AS title FROM v_entries"
)
def title_default(spark, sf_dir):
    return fx.entries(spark, sf_dir).select("pos", feeds.title_default(F.col("title")).alias("title"))


@query(
    "rewrite_aggregator_url",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://' || source || '/a/' || doc_id
  WHEN doc_id % 6 = 4 THEN 'https://weixin.sogou.com/link?u=' || doc_id
  ELSE 'https://mp.weixin.qq.com/s?id=' || doc_id || '&v=2' END AS link FROM documents""",
)
def rewrite_aggregator_url(spark, sf_dir):
    d = F.col("doc_id")
    plain = fx.text_of("https://", F.col("source"), "/a/", d)
    search = fx.text_of("https://weixin.sogou.com/link?u=", d)
    # Encoded once or twice, behind an unrelated link; every sixth entry names no original.
    anchor = F.when(d % 2 == 0, fx.text_of("<a class='x' href=\"https://mp.weixin.qq.com/s?id=", d, '&amp;amp;v=2">o</a>')).otherwise(
        fx.text_of("&lt;a href=&quot;https://mp.weixin.qq.com/s?id=", d, "&amp;v=2&quot;&gt;o&lt;/a&gt;")
    )
    body = fx.text_of('<p><a href="https://other.example.com/">x</a>', F.when(d % 6 == 4, "").otherwise(anchor), F.col("text"), "</p>")
    rows = fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 3 == 0, plain).otherwise(search).alias("link"),
        F.when(d % 5 == 0, "").when(d % 5 != 1, body).alias("summary"),
        body.alias("content"),
    )
    return feeds.rewrite_entry_links(rows).select("doc_id", "link")


@query(
    "domain_of_url",
    f"WITH {sql.PROBES}, u AS (SELECT link FROM v_probes UNION ALL SELECT url FROM pages) SELECT link, {sql.domain('link')} AS domain FROM u",
)
def domain_of_url(spark, sf_dir):
    links = fx.probes(spark, sf_dir).select("link").union(fx.table(spark, sf_dir, "pages").select("url"))
    return links.select("link", urls.domain_of_url(F.col("link")).alias("domain"))


@query(
    "normalize_url",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(utm_source|ref)=[^&]*', '\1', 'g'),
    '&+', '&', 'g'), '[?&]+$', '') AS normalized FROM pages""",
)
def normalize_url(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))


_IMAGES = """v_images AS (
  SELECT page_id, url, i, (page_id + i) % 9 AS kind, 'https://i.example.com/' || page_id || '/' || (i // 2) || '.png' AS name
  FROM (SELECT page_id, url, unnest(range(page_id % 13)) AS i FROM pages)),
v_srcs AS (SELECT *, CASE kind WHEN 4 THEN '/rel/' || i || '.png' WHEN 5 THEN 'https://i.example.com/LOGO/' || i || '.png' ELSE name END AS src
           FROM v_images)"""


def _attrs():
    return {n: F.col(f"`{n}`") for n in images.IMAGE_ATTRIBUTES}


@query("image_src", f"WITH {_IMAGES} SELECT page_id, CAST(i AS INTEGER) AS i, src FROM v_srcs")
def image_src(spark, sf_dir):
    return fx.image_attributes(spark, sf_dir).select("page_id", "i", images.image_src(_attrs()).alias("src"))


@query("image_valid", f"WITH {_IMAGES} SELECT page_id, CAST(i AS INTEGER) AS i, kind NOT IN (4, 5, 6) AS valid FROM v_srcs")
def image_valid(spark, sf_dir):
    valid = images.image_valid(images.image_src(_attrs()), F.col("width"), F.col("height"))
    return fx.image_attributes(spark, sf_dir).select("page_id", "i", valid.alias("valid"))


@query("image_dedup", f"WITH {_IMAGES} SELECT DISTINCT page_id, src FROM v_srcs WHERE kind NOT IN (4, 5, 6)")
def image_dedup(spark, sf_dir):
    src = images.image_src(_attrs())
    rows = fx.image_attributes(spark, sf_dir).where(images.image_valid(src, F.col("width"), F.col("height")))
    return rows.select("page_id", src.alias("src")).distinct()


@query(
    "absolute_url",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://o.example.com/x.png' WHEN 1 THEN origin || '/rel/x.png'
   WHEN 2 THEN origin || folder || 'x.png?s=1' ELSE regexp_extract(url, '^([a-z]+:)', 1) || '//cdn.example.com/x.png' END AS resolved
FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS origin,
             regexp_extract(url, '^[a-z]+://[^/]*(/(?:[^/?#]*/)*)', 1) AS folder FROM pages)""",
)
def absolute_url(spark, sf_dir):
    p = F.col("page_id") % 4
    ref = F.when(p == 0, "https://o.example.com/x.png").when(p == 1, "/rel/y/../x.png").when(p == 2, "./x.png?s=1").otherwise("//cdn.example.com/x.png")
    return fx.table(spark, sf_dir, "pages").select("page_id", urls.absolute_url(F.col("url"), ref).alias("resolved"))


@query("encoding_repair", "SELECT doc_id, text AS repaired FROM documents")
def encoding_repair(spark, sf_dir):
    mixed_up = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    broken = F.when(F.col("doc_id") % 2 == 0, mixed_up).otherwise(F.col("text"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.repair_mojibake(broken).alias("repaired"))


@query(
    "content_by_method",
    f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {sql.strip_tags('html')} ELSE html END AS content FROM pages",
)
def content_by_method(spark, sf_dir):
    method = F.when(F.col("page_id") % 2 == 0, extraction.FALLBACK_METHOD).otherwise("css-selectors")
    return fx.table(spark, sf_dir, "pages").select("page_id", extraction.content_by_method(F.col("html"), method).alias("content"))


@query("method_name", "SELECT doc_id, replace(lower(source || '+' || lang), '+', '-') AS method FROM documents")
def method_name(spark, sf_dir):
    name = F.upper(fx.text_of(F.col("source"), "+", F.col("lang")))
    return fx.table(spark, sf_dir, "documents").select("doc_id", extraction.method_name_column(name).alias("method"))


@query(
    "drop_internal_columns",
    f"WITH {sql.RESULTS} SELECT feed_url, pos, title, url, published, author, content FROM v_articles",
)
def drop_internal_columns(spark, sf_dir):
    return results.drop_internal_columns(fx.articles(spark, sf_dir)).drop("images")


@query(
    "missing_date_default",
    f"WITH {sql.ENTRIES} SELECT pos, coalesce(published, '2026-04-14T12:00:00') AS published FROM v_entries",
)
def missing_date_default(spark, sf_dir):
    filled = incremental.missing_date_default(fx.entries(spark, sf_dir), F.lit("2026-04-14T12:00:00"))
    return filled.select("pos", "published")
