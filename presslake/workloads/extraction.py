"""Text, image and metadata extraction from pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslake.functions import dom
from presslake.functions import html as html_fn
from presslake.functions.dates import parse_timestamp
from presslake.functions.images import collect_images
from presslake.operators import blacklist as bl
from presslake.operators import extraction as ex
from presslake.operators import results
from presslake.sources.pages import page_join
from presslake.workloads import fixtures as fx
from presslake.workloads import sql
from presslake.workloads.registry import query


def _pages(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", "html")


@query(
    "html_blocks",
    f"""WITH {sql.blocks("pages")}
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS block_pos, tag, text, words, link_words FROM sql_blocks""",
)
def html_blocks(spark, sf_dir):
    blocks = _pages(spark, sf_dir).select("page_id", F.posexplode(html_fn.html_blocks(F.col("html"))).alias("block_pos", "b"))
    return blocks.select("page_id", "block_pos", "b.*")


@query("main_text_density", f"WITH {sql.density('pages')} SELECT page_id, d.text AS main_text FROM pages LEFT JOIN sql_density d USING (page_id)")
def main_text_density(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html_fn.main_text_density(F.col("html")).alias("main_text"))


@query(
    "main_text_paragraphs",
    f"SELECT page_id, CASE WHEN length(t) >= 100 THEN t END AS main_text FROM (SELECT page_id, {sql.paragraphs('html')} AS t FROM pages)",
)
def main_text_paragraphs(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html_fn.main_text_paragraphs(F.col("html")).alias("main_text"))


@query("body_text", f"SELECT page_id, {sql.visible(sql.body(sql.drop_nontext('html')))} AS body FROM pages")
def body_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", html_fn.body_text(F.col("html")).alias("body"))


@query(
    "page_metadata",
    f"""SELECT page_id, CASE WHEN page_id % 11 = 5 THEN 'Unknown' ELSE
  {sql.clean(sql.decoded("regexp_extract(html, '<title>(.*?)</title>', 1)"))} END AS title,
  CASE page_id % 4 WHEN 1 THEN '2026-03-01T10:00:00+00:00' WHEN 2 THEN '2026-03-02T00:00:00' END AS published,
  CASE WHEN page_id % 3 = 0 THEN 'A & B ' || page_id WHEN page_id % 3 = 1 THEN 'Single ' || page_id END AS author FROM pages""",
)
def page_metadata(spark, sf_dir):
    p = F.col("page_id")
    meta = fx.text_of(
        F.when(p % 3 == 0, fx.text_of('<meta name="author" content="A &amp; B ', p, '">'))
        .when(p % 3 == 1, fx.text_of("<META content='Single ", p, "' name='author' />"))
        .otherwise('<meta name="author-note" content="no">'),
        F.when(p % 4 == 1, '<meta property="article:published_time" content="2026-03-01T10:00:00Z">')
        .when(p % 4 == 2, '<time class="x" datetime="2026-03-02">then</time>').otherwise(""),
    )
    html = F.replace(F.col("html"), F.lit("<head>"), fx.text_of("<head>", meta))
    html = F.when(p % 11 == 5, F.regexp_replace(html, "<title>.*?</title>", "")).otherwise(html)
    found = _pages(spark, sf_dir).select("page_id", html_fn.page_metadata(html).alias("m"))
    return found.select(
        "page_id", "m.title", parse_timestamp(F.col("m.published_text")).alias("published"), "m.author"
    )


@query(
    "best_element",
    """SELECT page_id, arg_max(t, n * 10 - i) AS best FROM (
  SELECT page_id, i, (page_id * 7 + i * 13) % 50 AS n, repeat('x ', (page_id * 7 + i * 13) % 50) || 'n' || i AS t
  FROM (SELECT page_id, unnest(range(4)) AS i FROM pages)) GROUP BY page_id""",
)
def best_element(spark, sf_dir):
    p = F.col("page_id")
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: fx.text_of('<div class="a content">', F.repeat(F.lit("x "), ((p * 7 + i * 13) % 50).cast("int")), "n", i, "</div>"),
    )
    html = F.replace(F.col("html"), F.lit("</article>"), fx.text_of("<div>", F.array_join(parts, "<p>between"), "</div></article>"))
    rows = _pages(spark, sf_dir).select("page_id", dom.page_elements(html).alias("dom"))
    best = rows.withColumn("e", dom.best_element(F.col("dom.elements"), ("class", "", "content")))
    return best.select("page_id", dom.element_text(F.col("dom"), F.col("e")).alias("best"))


def _container_sql() -> str:
    h = sql.drop_nontext("html")
    kinds = [
        (r"<article>", r"</article>"), (r'<div class="wide post-content">', r"</div>"), (r'<div id="main-content">', r"</div>"),
        (r'<section data-content="article">', r"</section>"),
    ]
    inner = " ".join(f"WHEN {i} THEN {sql.visible(f'coalesce({sql.between(h, o, c)}, chr(32))')}" for i, (o, c) in enumerate(kinds))
    opening = """CASE page_id % 5 WHEN 1 THEN '<div class="wide post-content">' WHEN 2 THEN '<div id="main-content">'
      WHEN 3 THEN '<section data-content="article">' WHEN 4 THEN '<div>' ELSE '<article>' END"""
    closing = "CASE page_id % 5 WHEN 3 THEN '</section>' WHEN 0 THEN '</article>' ELSE '</div>' END"
    return f"""WITH c AS (SELECT page_id, replace(replace(html, '<article>', {opening}), '</article>', {closing}) AS html FROM pages),
t AS (SELECT page_id, CASE page_id % 5 {inner} ELSE '' END AS inside, {sql.visible(sql.body(h))} AS body FROM c)
SELECT page_id, CASE WHEN length(inside) >= 100 THEN inside ELSE body END AS main_text FROM t"""


@query("selector_cascade", _container_sql())
def selector_cascade(spark, sf_dir):
    pages = fx.pages_in_containers(spark, sf_dir)
    return pages.select("page_id", ex.main_text_selectors(F.col("html")).alias("main_text"))


@query(
    "main_text_selectors",
    f"""WITH t AS (SELECT page_id, {sql.visible(sql.article(sql.drop_nontext('html')))} AS inside, {sql.visible(sql.body(sql.drop_nontext('html')))} AS body FROM pages)
SELECT page_id, CASE WHEN length(inside) >= 100 THEN inside ELSE body END AS main_text FROM t""",
)
def main_text_selectors(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", ex.main_text_selectors(F.col("html")).alias("main_text"))


@query(
    "strategy_cascade",
    f"""WITH {sql.density("pages")},
  t AS (SELECT page_id, d.text AS t1, {sql.paragraphs("html")} AS t2, {sql.visible(f"coalesce({sql.article(sql.drop_nontext('html'))}, '')")} AS t3,
               {sql.visible(sql.body(sql.drop_nontext("html")))} AS t4 FROM pages LEFT JOIN sql_density d USING (page_id)),
  s AS (SELECT *, CASE WHEN length(t3) >= 100 THEN t3 ELSE t4 END AS t34 FROM t),
  m AS (SELECT *, CASE WHEN {sql.valid("t1")} THEN 'readability' WHEN length(t2) >= 100 AND {sql.valid("t2")} THEN 'newspaper3k'
        WHEN length(t34) >= 100 THEN 'css-selectors' END AS method FROM s)
SELECT page_id, method AS extraction_method,
  CASE method WHEN 'readability' THEN t1 WHEN 'newspaper3k' THEN t2 WHEN 'css-selectors' THEN t34 END AS extracted_text
FROM m""",
)
def strategy_cascade(spark, sf_dir):
    return ex.strategy_cascade(_pages(spark, sf_dir)).select("page_id", "extraction_method", "extracted_text")


@query(
    "extractor_registry",
    f"""WITH t AS (SELECT page_id, {sql.visible("coalesce(" + sql.between("html", "<h1>", "</h1>") + ", '')")} AS h, {sql.visible(sql.body(sql.drop_nontext("html")))} AS b FROM pages)
SELECT page_id, CASE WHEN length(h) >= 100 THEN 'heading-first' ELSE 'whole-body' END AS extraction_method, CASE WHEN length(h) >= 100 THEN h ELSE b END AS extracted_text FROM t""",
)
def extractor_registry(spark, sf_dir):
    def heading(html):
        return html_fn.visible_text(F.regexp_extract(html, r"(?is)<h1>(.*?)(?:</h1>|\z)", 1))

    own = [ex.Strategy("Heading+First", heading), ex.Strategy("Whole-Body", html_fn.body_text)]
    return ex.strategy_cascade(_pages(spark, sf_dir), strategies=own).select("page_id", "extraction_method", "extracted_text")


_DESCRIBED = """v_described AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<p>' || text || '</p>' WHEN 1 THEN text
                  WHEN 2 THEN '<div>' || replace(text, ' ', ' &amp; ') || '</div>' ELSE text || repeat('<br/>', 12) END AS description FROM documents)"""


@query(
    "description_fallback",
    f"""WITH {_DESCRIBED} SELECT doc_id, {sql.valid("description")} AS success,
  CASE WHEN {sql.valid("description")} THEN 'description-fallback' ELSE 'failed' END AS extraction_method,
  CASE WHEN {sql.valid("description")} THEN {sql.strip_tags("description")} ELSE '' END AS content FROM v_described""",
)
def description_fallback(spark, sf_dir):
    d = F.col("doc_id")
    described = fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 4 == 0, fx.text_of("<p>", F.col("text"), "</p>")).when(d % 4 == 1, F.col("text"))
        .when(d % 4 == 2, fx.text_of("<div>", F.replace(F.col("text"), F.lit(" "), F.lit(" &amp; ")), "</div>"))
        .otherwise(fx.text_of(F.col("text"), "<br/>" * 12)).alias("description"),
        F.lit(None).cast("string").alias("extracted_text"), F.lit(None).cast("string").alias("extraction_method"),
    )
    return ex.with_fallback(described).select("doc_id", "success", "extraction_method", "content")


@query(
    "image_collect",
    f"SELECT page_id, array_to_string({sql.page_images('page_id')}, ' ') AS images FROM pages",
)
def image_collect(spark, sf_dir):
    found = collect_images(fx.pages_with_images(spark, sf_dir), "url", "html")
    return found.select("page_id", F.array_join("images", " ").alias("images"))


def _extracted(spark, sf_dir):
    rows = bl.with_blocked(fx.page_entries(spark, sf_dir), fx.blacklist(spark, sf_dir))
    return ex.extract_articles(rows, pages=fx.crawl_with_images(spark, sf_dir))


@query("extraction_method_stats", f"WITH {sql.EXTRACTED} SELECT method AS extraction_method, count(*) AS n FROM settled GROUP BY method")
def extraction_method_stats(spark, sf_dir):
    return results.extraction_method_stats(_extracted(spark, sf_dir))


@query(
    "extract_articles",
    f"""WITH {sql.EXTRACTED} SELECT pos, link, title, coalesce(author, 'Unknown') AS author, images, method AS extraction_method, method <> 'failed' AS success, content,
  CASE WHEN took THEN NULL WHEN error_kind = 'network' THEN '网络错误' ELSE '所有提取方法失败' END AS failure_reason FROM settled""",
)
def extract_articles(spark, sf_dir):
    rows = _extracted(spark, sf_dir).withColumn("images", F.array_join("images", " "))
    return rows.select("pos", "link", "title", "author", "images", "extraction_method", "success", "content", "failure_reason")


@query(
    "blacklist_run_order",
    f"""WITH {sql.PAGE_ENTRIES},
  j AS (SELECT e.pos, f.feed_ord, c.error_kind, {sql.domain("e.link")} AS dom FROM v_page_entries e JOIN v_page_feeds f USING (feed_url) JOIN v_crawl c ON c.url = e.link)
SELECT pos, coalesce(max(CAST(error_kind = 'network' AS INT)) OVER (PARTITION BY dom ORDER BY feed_ord, pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS blocked FROM j""",
)
def blacklist_run_order(spark, sf_dir):
    feeds = fx.page_feeds(spark, sf_dir).select("feed_url", "feed_ord")
    rows = fx.page_entries(spark, sf_dir).select("feed_url", "pos", "link").join(feeds, "feed_url")
    joined = page_join(rows.withColumn("blocked", F.lit(False)), fx.crawl(spark, sf_dir))
    return bl.with_run_blocked(joined).select("pos", "blocked")
