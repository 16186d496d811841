"""Feeds, entries, pages and events in the engine's shapes, derived by Spark from the given tables.

Every derived row follows from one given row by a formula, so the reference results can be stated over the same
tables. Grouped documents hold a fixed range of ids, which bounds them whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.functions.dates import ntz_to_iso
from presslake.functions.dom import page_elements
from presslake.functions.images import IMAGE_ATTRIBUTES
from presslake.functions.urls import domain_of_url

IDS_PER_DOCUMENT = 200
IDS_PER_OPML = 50
IDS_PER_FEED = 60
IDS_PER_ENTRY_FEED = 400
ENTRIES_PER_FEED = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def stamp(number: Column) -> Column:
    """Newest first, with every 13th pushed three days ahead."""
    base = F.expr("TIMESTAMP_NTZ '2026-04-14 00:00:00'") - F.make_dt_interval(secs=number)
    ahead = F.expr("INTERVAL '3' DAY")
    return F.when(number % 13 == 1, base + ahead).otherwise(base)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per source and 400 document ids, one entry per document: some without title, link, date, author or description."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        text_of("https://", F.col("source"), ".example.com/", F.floor(d / IDS_PER_ENTRY_FEED), "/feed.xml").alias("feed_url"),
        d.alias("pos"),
        F.when(d % 11 == 7, None).when(d % 11 == 8, "").otherwise(text_of("Doc ", d)).alias("title"),
        F.when(d % 17 == 3, None)
        .when(d % 34 == 5, "")
        .otherwise(text_of("https://www.", F.col("source"), ".example.com/a/", d))
        .alias("link"),
        F.when(d % 23 != 5, ntz_to_iso(stamp(d))).alias("published"),
        F.when(d % 5 == 0, None).when(d % 5 == 1, "").otherwise(text_of("Author ", d % 7)).alias("author"),
        F.when(d % 3 != 0, text_of("Name ", d % 4)).alias("author_name"),
        F.when(d % 6 == 0, None).when(d % 6 == 1, "").otherwise(F.col("text")).alias("description"),
        F.when(d % 4 == 0, None).when(d % 4 == 1, "").otherwise(text_of("<p>", F.col("text"), "</p>")).alias("summary"),
        F.col("text").alias("content"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks for the feeds whose URL has an odd length."""
    marked = (F.col("pos") % 29 == 0) & (F.col("pos") % 13 != 1) & (F.length("feed_url") % 2 == 1)
    return entries(spark, sf_dir).where(marked).groupBy("feed_url").agg(F.max("published").alias("last_id"))


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with an extraction outcome: every 10th failed, every 11th came out empty."""
    pos = F.col("pos")
    return entries(spark, sf_dir).select(
        "feed_url", "pos", "title", "link", "published",
        (pos % 10 != 0).alias("success"),
        F.when(pos % 11 == 0, "").otherwise(F.col("content")).alias("content"),
    )


def xml_escape(text: Column) -> Column:
    out = text
    for char, ref in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        out = F.replace(out, F.lit(char), F.lit(ref))
    return out


def _ordered(rows: DataFrame, keys: list[Column], order: str, text: Column, doc: Column) -> DataFrame:
    """Join the texts of each bounded group in order into one document; doc sees them as column body."""
    grouped = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order), text.alias("t")))).alias("parts"), F.min(order).alias("first_id")
    )
    body = F.array_join(F.transform("parts", lambda p: p["t"]), "")
    return grouped.withColumn("body", body).withColumn("doc", doc).drop("parts", "body")


def _tag(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), text_of(f"<{name}>", value, f"</{name}>")).otherwise("")


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS 2.0, RSS 1.0 and Atom documents in turn: feed_url, doc, first_id."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.floor(d / IDS_PER_DOCUMENT) % 3).alias("kind"),
        text_of("https://", F.col("source"), ".example.com/", F.floor(d / IDS_PER_DOCUMENT), ".xml").alias("feed_url"),
        _tag("title", F.when(d % 11 != 7, text_of("Doc ", d, " &lt;&amp;&gt;"))).alias("title"),
        F.when(d % 17 != 3, text_of("https://www.", F.col("source"), ".example.com/a/", d)).alias("url"),
        F.when(d % 23 != 5, ntz_to_iso(stamp(d))).alias("at"),
        F.when(d % 5 > 1, text_of("Author ", d % 7)).alias("by"),
        xml_escape(F.col("text")).alias("x"),
    )
    rss = text_of(
        "<item>", F.col("title"), _tag("link", F.col("url")), _tag("pubDate", text_of(F.col("at"), "Z")),
        _tag("dc:creator", F.col("by")), "<description>", F.col("x"), "</description></item>",
    )
    rdf = text_of(
        "<item>", F.col("title"), _tag("link", F.col("url")), _tag("dc:date", F.col("at")),
        _tag("dc:creator", F.col("by")), "<content:encoded>", F.col("x"), "</content:encoded></item>",
    )
    href = F.when(
        F.col("url").isNotNull(),
        text_of('<link rel="self" href="https://other/"/><link rel="alternate" href="', F.col("url"), '"/>'),
    ).otherwise("")
    atom = text_of(
        "<entry>", F.col("title"), href, _tag("updated", text_of(F.col("at"), "+00:00")),
        F.when(F.col("by").isNotNull(), text_of("<author><name>", F.col("by"), "</name></author>")).otherwise(""),
        "<summary>", F.col("x"), "</summary></entry>",
    )
    item = F.when(F.col("kind") == 0, rss).when(F.col("kind") == 1, rdf).otherwise(atom)
    names = 'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"'
    body = F.col("body")
    doc = (
        F.when(F.col("kind") == 0, text_of(f'<rss version="2.0" {names}><channel><title>t</title>', body, "</channel></rss>"))
        .when(
            F.col("kind") == 1,
            text_of(
                f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" {names}>'
                "<channel><title>t</title></channel>", body, "</rdf:RDF>",
            ),
        )
        .otherwise(text_of('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>', body, "</feed>"))
    )
    return _ordered(rows, ["feed_url", "kind"], "doc_id", item, doc).drop("kind")


def opml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription lists of 50 ids, every third outline inside a folder: list_id, doc."""
    d = F.col("doc_id")
    outline = text_of(
        "<outline",
        F.when(d % 4 != 1, text_of(' text="Text ', d, ' &amp; &quot;more&quot;"')).otherwise(""),
        F.when(d % 3 == 0, text_of(" title='Title ", d, " &gt; 0'")).otherwise(""),
        F.when(d % 5 == 0, ' type="rss"').when(d % 5 == 1, ' type="Atom"').when(d % 5 == 2, ' type=""').otherwise(""),
        F.when(d % 9 != 4, text_of(' xmlUrl="', _outline_url(), '"')).otherwise(""),
        "/>",
    )
    foldered = F.when(d % 3 == 1, text_of('<outline text="Folder"><outline text="Inner">', outline, "</outline></outline>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(d / IDS_PER_OPML).alias("list_id"))
    doc = text_of(
        '<?xml version="1.0"?><opml version="2.0"><head><title>Feeds</title></head><body><!-- <outline xmlUrl="no"/> -->',
        F.col("body"), "</body></opml>",
    )
    return _ordered(rows, ["list_id"], "doc_id", F.coalesce(foldered, outline), doc).drop("first_id")


def _outline_url() -> Column:
    ending = F.when(F.col("doc_id") % 7 == 0, ".atom").otherwise(".xml?a=1&amp;b=2")
    return text_of("https://", F.col("source"), ".example.com/", F.col("doc_id"), ending)


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat outline rows with absent and empty attributes."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(d % 9 == 4, None)
        .when(d % 9 == 5, "")
        .otherwise(text_of("https://", F.col("source"), F.when(d % 7 == 0, "/ATOM/").otherwise("/feed/"), d))
        .alias("xml_url"),
        F.when(d % 3 == 0, text_of("Title ", d)).when(d % 3 == 1, "").alias("title"),
        F.when(d % 4 != 1, text_of("Text ", d)).alias("text"),
        F.when(d % 5 == 0, "rss").when(d % 5 == 1, "Atom").when(d % 5 == 2, "").alias("type"),
    )


def config_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON configuration per 50 ids; some lack the url, some are cut off: list_id, value."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(d / IDS_PER_OPML).alias("list_id"), ntz_to_iso(stamp(d)).alias("at"))
    grouped = rows.groupBy("list_id").agg(F.collect_list(F.struct(text_of("https://f", d, ".example.com/").alias("k"), "at")).alias("m"))
    url = F.when(F.col("list_id") % 5 == 1, "").when(F.col("list_id") % 5 != 2, text_of("https://c.example.com/", F.col("list_id")))
    body = F.to_json(
        F.struct(url.alias("url"), F.lit(5).alias("threads"), F.lit(3).alias("log_days"), F.map_from_entries("m").alias("his"))
    )
    cut = F.when(F.col("list_id") % 5 == 4, F.substring(body, 1, 20)).otherwise(body)
    return grouped.select("list_id", cut.alias("value"))


def feed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finished feed per (source, 60 ids); every 7th failed."""
    d = F.col("doc_id")
    feeds = (
        table(spark, sf_dir, "documents")
        .groupBy("source", F.floor(d / IDS_PER_FEED).alias("part"))
        .agg(F.min("doc_id").alias("feed_ord"))
    )
    ok = F.col("feed_ord") % 7 != 3
    return feeds.select(
        "feed_ord",
        _part_url(F.col("part")).alias("feed_url"),
        text_of("Feed ", F.col("feed_ord")).alias("feed_title"),
        F.when(F.col("feed_ord") % 2 == 0, "RSS").otherwise("ATOM").alias("feed_type"),
        ok.alias("success"),
        F.when(~ok, text_of("Error ", F.col("feed_ord"))).alias("error"),
    )


def _part_url(part: Column) -> Column:
    return text_of("https://", F.col("source"), ".example.com/", part, ".xml")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted articles of those feeds, one from every document."""
    d = F.col("doc_id")
    part = F.floor(d / IDS_PER_FEED)
    return (
        table(spark, sf_dir, "documents")
        .select(
            _part_url(part).alias("feed_url"),
            d.alias("pos"),
            text_of("Doc ", d).alias("title"),
            text_of("https://www.", F.col("source"), ".example.com/a/", d).alias("url"),
            F.when(d % 23 != 5, ntz_to_iso(stamp(d))).alias("published"),
            text_of("Author ", d % 7).alias("author"),
            F.col("text").alias("content"),
            F.when(d % 2 == 0, F.array(text_of("https://i.example.com/", d, ".png"))).otherwise(F.array().cast("array<string>")).alias("images"),
            ntz_to_iso(stamp(d)).alias("_id"),
            F.lit("published").alias("_id_type"),
        )
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network failures: the error events, one host per user, as URLs, bare domains and rejected text."""
    event = F.col("event_id")
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'error'")
        .select(
            _probe_url().alias("url_or_domain"),
            F.when(event % 3 == 0, None).when(event % 7 == 0, "").otherwise(F.col("props")).alias("reason"),
            "ts",
            event.alias("pos"),
        )
    )


def _probe_url() -> Column:
    user = F.col("user_id")
    return (
        F.when(user % 4 == 0, text_of("https://www.h", user, ".example.com/p/", F.col("event_id")))
        .when(user % 4 == 1, text_of("http://u@h", user, ".example.com:8080?x=", F.col("event_id")))
        .when(user % 4 == 2, text_of("h", user, ".example.com"))
        .otherwise(text_of("httpbin", user))
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as URLs to test against a blacklist."""
    return table(spark, sf_dir, "events").select("event_id", _probe_url().alias("link"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permanent domains: the hosts of every 24th user."""
    users = table(spark, sf_dir, "events").where("user_id % 24 = 0").select("user_id").distinct()
    return users.select(text_of("h", F.col("user_id"), ".example.com").alias("domain"))


def blacklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of every third user, plus bare 'www.' and plain entries that only match as text."""
    users = table(spark, sf_dir, "events").where("user_id % 3 = 0").select("user_id").distinct()
    user = F.col("user_id")
    domain = (
        F.when(user % 4 == 1, text_of("u@h", user, ".example.com:8080"))
        .when(user % 4 == 3, text_of("httpbin", user))
        .otherwise(text_of("h", user, ".example.com"))
    )
    return users.select(domain.alias("domain"))


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages; every 19th timed out and every 19th got an error status."""
    p = F.col("page_id")
    kind = F.when(p % 19 == 4, "network").when(p % 19 == 9, "http")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.when(kind.isNull(), F.col("html")).alias("html"), kind.alias("error_kind"))


def crawl_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages with images in them: url, html, error_kind. Images add no text."""
    fetched = crawl(spark, sf_dir).select("page_id", "error_kind")
    rows = pages_with_images(spark, sf_dir).join(fetched, "page_id")
    return rows.select("url", F.when(F.col("error_kind").isNull(), F.col("html")).alias("html"), "error_kind")


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per document, several of them linking to one page; one feed per domain and 40 document ids."""
    p = F.col("doc_id")
    pages = table(spark, sf_dir, "pages")
    text = table(spark, sf_dir, "documents").select("doc_id", "text", (p % F.lit(max(1, pages.count()))).alias("linked"))
    body = F.when(p % 2 == 0, text_of("<p>", F.col("text"), "</p>")).otherwise(F.col("text"))
    return (
        text.join(pages.select("page_id", "url"), F.col("page_id") == F.col("linked"))
        .select(
            text_of("https://", domain_of_url(F.col("url")), "/", F.floor(p / ENTRIES_PER_FEED), ".xml").alias("feed_url"),
            p.alias("pos"),
            text_of("Page ", p).alias("title"),
            F.col("url").alias("link"),
            ntz_to_iso(stamp(p)).alias("published"),
            F.when(p % 3 != 0, text_of("Author ", p % 7)).alias("author"),
            body.alias("description"),
        )
    )


def page_feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS documents of those entries: feed_url, first_id, doc."""
    item = text_of(
        "<item>", _tag("title", F.col("title")), _tag("link", xml_escape(F.col("link"))),
        _tag("pubDate", text_of(F.col("published"), "Z")), _tag("dc:creator", F.col("author")),
        _tag("description", xml_escape(F.col("description"))), "</item>",
    )
    doc = text_of(
        '<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title>', F.col("body"),
        "</channel></rss>",
    )
    return _ordered(page_entries(spark, sf_dir), ["feed_url"], "pos", item, doc)


def page_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions to those feeds."""
    return page_entries(spark, sf_dir).groupBy("feed_url").agg(F.min("pos").alias("feed_ord")).select(
        "feed_ord", "feed_url", text_of("Feed ", F.col("feed_ord")).alias("feed_title"), F.lit("RSS").alias("feed_type")
    )


def page_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of every second feed: the date of its highest id divisible by 5."""
    marked = page_entries(spark, sf_dir).where((F.col("pos") % 5 == 0) & (F.col("pos") % 13 != 1) & (F.length("feed_url") % 2 == 0))
    return marked.groupBy("feed_url").agg(F.max_by("published", "pos").alias("last_id"))


def image_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image elements of pages with 0 to 12 images: lazy, inline, small, tracking, decorative and repeated ones."""
    p = F.col("page_id")

    def attribute(name: str, value: Column) -> Column:
        return F.coalesce(text_of(f' {name}="', value, '"'), F.lit(""))

    def image(i: Column) -> Column:
        kind = (p + i) % 9
        name = text_of("https://i.example.com/", p, "/", F.floor(i / 2), ".png")
        return text_of(
            "<img",
            attribute("data-src", F.when(kind == 0, name)),
            attribute("data-lazy-src", F.when(kind == 1, name).when(kind == 2, "")),
            attribute("data-original", F.when(kind == 2, name)),
            attribute(
                "src",
                F.when(kind == 3, "data:image/gif;base64,R0").when(kind == 4, text_of("/rel/", i, ".png"))
                .when(kind == 5, text_of("https://i.example.com/LOGO/", i, ".png")).when(kind != 8, name),
            ),
            attribute("srcset", F.when((kind == 3) | (kind == 8), text_of(name, " 1x, https://i.example.com/big.png 2x"))),
            attribute("width", F.when(kind == 6, "50").when(kind == 7, "auto")),
            attribute("height", F.when(kind == 6, "500").when(kind == 7, "20")),
            ">",
        )

    run = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.when(i < p % 13, image(i)).otherwise("")), "")
    html = F.replace(F.col("html"), F.lit("</article>"), text_of(run, "</article>"))
    found = table(spark, sf_dir, "pages").select("page_id", "url", page_elements(html).alias("dom"))
    images = found.select("page_id", "url", F.posexplode(F.filter("dom.elements", lambda e: e["tag"] == "img")).alias("i", "e"))
    return images.select("page_id", "url", "i", *[F.try_element_at("e.attrs", F.lit(n)).alias(n) for n in IMAGE_ATTRIBUTES])


def pages_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with images written into the article (even ids) or into other containers (odd ids)."""
    p = F.col("page_id")
    one = "<img class='x' data-src=\"https://i.example.com/"

    def run_of(label: str, n: Column) -> Column:
        return F.array_join(
            F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.when(i < n, text_of(one, label, F.floor(i / 2), "-", p, '.png">')).otherwise("")), ""
        )

    in_article = F.replace(F.col("html"), F.lit("<article>"), text_of("<article>", run_of("a", p % 8)))
    elsewhere = text_of('<div id="readability-content">', run_of("r", p % 3), '</div><figure><img src="https://i.example.com/icon.png">',
                        run_of("f", p % 5), '</figure><div class="post-content big">', run_of("c", F.lit(30) * (p % 2)), "</div><footer>")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.replace(in_article, F.lit("<footer>"), elsewhere).alias("html"))


def pages_in_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose article sits in one of four kinds of container, or in none."""
    p = F.col("page_id") % 5
    opening = (
        F.when(p == 1, '<div class="wide post-content">').when(p == 2, '<div id="main-content">')
        .when(p == 3, '<section data-content="article">').when(p == 4, "<div>").otherwise("<article>")
    )
    closing = F.when(p == 3, "</section>").when(p == 0, "</article>").otherwise("</div>")
    html = F.replace(F.replace(F.col("html"), F.lit("<article>"), opening), F.lit("</article>"), closing)
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))
