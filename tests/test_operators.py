"""Operators on small tables, and against slower formulations."""

import random

import pytest
from pyspark.sql import functions as F

from presslake.functions.images import collect_images
from presslake.operators import blacklist as bl
from presslake.operators import extraction as ex
from presslake.operators import incremental as inc
from presslake.operators import results
from presslake.plans import pipeline
from presslake.plans.lineage import cut_lineage
from presslake.schemas import FAILURES, HISTORY, RESULTS
from presslake.sources import feeds, opml, state

FEED1, FEED2 = "https://example.com/feed1.xml", "https://example.com/feed2.xml"


@pytest.fixture()
def history(spark):
    return spark.createDataFrame([(FEED1, "2025-02-09T10:00:00Z"), (FEED2, "2025-02-09T09:00:00Z")], HISTORY)


def test_filter_articles(spark, history):
    rows = [(FEED1, u, p) for u, p in [("new", "2025-02-09T11:00:00Z"), ("old", "2025-02-09T09:00:00Z"), ("none", None), ("same", "2025-02-09T10:00:00Z")]]
    kept = inc.filter_articles(spark.createDataFrame(rows, "feed_url STRING, url STRING, published STRING"), history)
    assert {r.url for r in kept.collect()} == {"new", "none"}


def test_newer_rules(spark, history):
    stamps = ["2025-02-09T11:00:00Z", "2025-02-09T09:00:00Z", "2025-02-09T10:00:00Z", "invalid-timestamp", "2025-02-09T18:30:00+08:00", "2025-02-09T11:00:00"]
    rows = [(FEED1, s) for s in stamps] + [("https://not-exist.com", "2025-02-09T10:00:00Z")]
    df = spark.createDataFrame(rows, "feed_url STRING, published STRING")
    got = {(r.feed_url, r.published): r.is_new for r in inc.with_is_new(df, history).collect()}
    assert [got[r] for r in rows] == [True, False, False, True, True, True, True]


def test_history_edits(spark, history):
    new = spark.createDataFrame([("https://new.com", "2025-02-10T12:00:00Z"), (FEED2, "x")], HISTORY)
    merged = {r.feed_url: r.last_id for r in inc.set_marks(history, new).collect()}
    assert merged == {FEED1: "2025-02-09T10:00:00Z", FEED2: "x", "https://new.com": "2025-02-10T12:00:00Z"}
    gone = spark.createDataFrame([(FEED1,), ("unknown",)], "feed_url STRING")
    assert [r.feed_url for r in inc.history_remove(history, gone).collect()] == [FEED2]
    assert inc.history_clear(history).count() == 0
    assert inc.feed_count(history).first().feed_count == 2


def feed_loop(entries, marks, k):
    """The per-feed loop, one entry at a time."""
    kept = []
    for feed in sorted({e["feed_url"] for e in entries}):
        taken = 0
        for e in sorted((e for e in entries if e["feed_url"] == feed), key=lambda e: e["pos"]):
            if taken >= k:
                break
            if not e["link"] or not e["published"]:
                continue
            if feed in marks and e["published"] <= marks[feed]:
                break
            if e["ok"]:
                taken += 1
                kept.append((feed, e["pos"]))
    return sorted(kept)


@pytest.mark.parametrize("seed", range(3))
def test_stop_and_limit_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    entries = [
        {
            "feed_url": f"f{min(rng.randrange(8), rng.randrange(8))}",
            "pos": pos,
            "link": rng.choice(["", None, "u", "u", "u"]),
            "published": rng.choice([None] + [f"2026-01-{d:02d}T00:00:00" for d in range(1, 29)]),
            "ok": rng.random() < 0.6,
        }
        for pos in range(400)
    ]
    marks = {f"f{i}": f"2026-01-0{i + 1}T00:00:00" for i in range(0, 8, 2)}
    df = spark.createDataFrame(entries, "feed_url STRING, pos BIGINT, link STRING, published STRING, ok BOOLEAN")
    past = spark.createDataFrame(list(marks.items()), HISTORY)
    alive = inc.take_until_stale(df, past).withColumn("success", F.col("ok")).withColumn("content", F.lit("x"))
    got = sorted((r.feed_url, r.pos) for r in inc.limit_successes(alive, 3).collect())
    assert got == feed_loop(entries, marks, 3)


def test_blacklist(spark):
    rows = [(f"https://www.example.com/{i}", "Test" if i == 4 else None, None, i) for i in range(10)]
    rows += [("httpbin.org", None, None, 10), ("weixin.sogou.com", "x", None, 11)]
    failures = spark.createDataFrame(rows, FAILURES).withColumn("ts", F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00' + make_dt_interval(0, 0, 0, pos)"))
    seed = bl.permanent_domains(spark)
    built = {r.domain: (r.fail_count, r.reason) for r in bl.blacklist_build(failures, seed).collect()}
    assert built == {"example.com": (10, "Test"), "weixin.sogou.com": (None, None)}
    added = [r.pos for r in bl.blacklist_added_flag(failures, seed).where("added").collect()]
    assert added == [0]


def test_run_order_blocking_on_a_hot_domain(spark):
    rows = [(0, i, f"https://hot.com/{i}", "network" if i in (5, 9) else None, i == 1) for i in range(50)]
    df = spark.createDataFrame(rows, "feed_ord BIGINT, pos BIGINT, link STRING, error_kind STRING, blocked BOOLEAN")
    blocked = {r.pos for r in bl.with_run_blocked(df).where("blocked").collect()}
    assert blocked == {1} | set(range(6, 50))


def test_nest_output(spark):
    status = spark.createDataFrame(
        [(1, "a", "Feed 1", "RSS", True, None), (2, "b", "Feed 2", "RSS", False, "e"), (3, "c", "Feed 3", "ATOM", True, None), (4, "d", "Feed 4", "RSS", True, None)],
        RESULTS,
    )
    schema = "feed_url STRING, pos BIGINT, title STRING, url STRING, published STRING, author STRING, content STRING, images ARRAY<STRING>, _id STRING"
    arts = spark.createDataFrame(
        [("a", i, f"t{i}", "u", p, "A", "c", [], "x") for i, p in enumerate(["2025-01-01", None, "2025-01-03", "2025-01-03"])]
        + [("b", 9, "no", "u", None, "A", "c", [], "x"), ("c", 8, "t", "u", None, "A", "c", [], "x")],
        schema,
    )
    got = results.nest_output(status, arts).orderBy("feed_ord").collect()
    assert [r.feed_title for r in got] == ["Feed 1", "Feed 3"]
    assert [a.title for a in got[0].articles] == ["t2", "t3", "t0", "t1"]
    summary = results.run_summary(status, arts).first()
    assert tuple(summary) == (4, 3, 1, 5)
    line = results.to_result_json(results.nest_output(status, arts)).where("feed_ord = 3").first().json
    assert '"published":null' in line and "_id" not in line


def test_description_fallback(spark):
    html = "<p>这是一段带有 <strong>HTML</strong> 标签的测试内容，用于验证标签清理功能是否正常工作。</p>"
    df = spark.createDataFrame([(html,), (None,), ("<br/>" * 12,)], "description STRING")
    for name in ("extracted_text", "extraction_method"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    got = ex.with_fallback(df).collect()
    assert (got[0].extraction_method, got[0].success) == ("description-fallback", True)
    assert got[0].content == "这是一段带有 HTML 标签的测试内容，用于验证标签清理功能是否正常工作。"
    assert (got[1].extraction_method, got[1].success, got[1].content) == ("failed", False, "")
    assert (got[2].success, got[2].content) == (True, "")


def test_selectors(spark):
    long = "text " * 30
    pages = [
        f"<div class='post-content wide'>short</div><main>{long}main</main>",
        f"<div class='content'>{long}</div><div class='content'>{long}longer<script>{'x' * 5}</script></div>",
        f"<div class='my-post-content-x'><p>{long}<p>second</div>",
        "<body>only body",
        f"<article>tiny</article><section><div id='main-content'>{long}id</div></section>",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i INT, html STRING")
    got = [r.t for r in df.select("i", ex.main_text_selectors(F.col("html")).alias("t")).orderBy("i").collect()]
    text = long.strip()
    assert got == [f"{text} main", f"{text} longer", f"{text}\nsecond", "only body", f"{text} id"]


def test_images(spark):
    nested = "<article><article><img src='http://x/in.png'></article><img src='http://x/a.png'></article>"
    pages = [
        nested + "<figure><img src='http://x/f.png' width=50 height=500><img src='http://x/g&amp;h.png'></figure>",
        "<article>" + "".join(f"<img data-src='http://x/{i % 12}.png'>" for i in range(24)) + "</article>",
        "<!-- <img src='http://x/no.png'> --><main><img src='/rel.png'><img srcset='http://x/s.png 1x, http://x/t.png 2x'></main>",
        "<p>none</p>",
        None,
    ]
    df = spark.createDataFrame([(i, "http://x/p", p) for i, p in enumerate(pages)], "i INT, url STRING, html STRING")
    got = [r.images for r in collect_images(df, "url", "html").orderBy("i").collect()]
    assert got[0] == ["http://x/in.png", "http://x/a.png", "http://x/g&h.png"]
    assert got[1] == [f"http://x/{i}.png" for i in range(10)]
    assert got[2:] == [["http://x/s.png"], [], []]


def test_opml(spark):
    good = """<?xml version="1.0" encoding="UTF-8"?><opml version="2.0"><head><title>t</title></head><body>
    <outline text="Tech News" title="Tech News" type="rss" xmlUrl="https://example.com/tech.xml"/>
    <outline text="Science" title="Science" type="atom" xmlUrl="https://example.com/science.atom"/>
    <outline text="Group"><outline text="a &gt; b > c" xmlUrl='https://example.com/politics.xml?a=1&amp;b=2'/></outline>
    <outline xmlUrl="https://example.com/feed.atom"/></body></opml>"""
    empty = "<opml><head/><body></body></opml>"
    df = spark.createDataFrame([("good", good), ("empty", empty), ("bad", "invalid xml")], "name STRING, doc STRING")
    got = [tuple(r) for r in opml.scan_opml(df).orderBy("outline_pos").select("feed_url", "feed_title", "feed_type").collect()]
    assert got == [
        ("https://example.com/tech.xml", "Tech News", "RSS"),
        ("https://example.com/science.atom", "Science", "ATOM"),
        ("https://example.com/politics.xml?a=1&b=2", "a > b > c", "RSS"),
        ("https://example.com/feed.atom", "https://example.com/feed.atom", "ATOM"),
    ]
    assert [r.name for r in opml.opml_errors(df).collect()] == ["bad"]


def test_feed_with_cdata_and_html_entities(spark):
    doc = (
        "<rss version='2.0'><channel><item><title>A &nbsp;&mdash; B</title><link>http://x/1</link>"
        "<description><![CDATA[<p>x &nbsp; y</p>]]></description><pubDate>Tue, 14 Apr 2026 08:30:00 +0800</pubDate></item></channel></rss>"
    )
    df = spark.createDataFrame([("f", doc), ("cut", doc[:-30]), ("gone", None)], "feed_url STRING, doc STRING")
    row = feeds.scan_feed_entries(df).collect()
    assert len(row) == 1
    assert (row[0].title, row[0].description, row[0].published) == ("A \xa0— B", "<p>x &nbsp; y</p>", "2026-04-14T00:30:00")
    status = {r.feed_url: (r.success, r.malformed) for r in feeds.feed_parse_status(df).collect()}
    assert status == {"f": (True, False), "cut": (True, True), "gone": (False, False)}


def test_config(spark):
    texts = ['{"url": "https://t/opml", "threads": 5, "his": {"f": "2025"}}', "{}", '{"url": ""}', "malformed"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, value STRING")
    config = state.parse_config_json(df)
    assert [r.valid for r in state.config_valid(config).orderBy("i").collect()] == [True, False, False, False]
    assert [tuple(r) for r in state.scan_history(config).collect()] == [("f", "2025")]
    assert [r.i for r in config.where("_corrupt_record IS NOT NULL").collect()] == [3]


def test_snapshots(spark, history, tmp_path):
    root = str(tmp_path / "marks")
    assert state.load_history(spark, root).count() == 0
    state.save_history(history, root, 3)
    state.save_history(inc.history_clear(history), root, 4)
    assert state.load_history(spark, root).count() == 0
    assert state.load_history(spark, root, before=4).count() == 2
    state.save_history(history, root, 4)
    assert state.load_history(spark, root).count() == 2


def test_second_run_finds_nothing_new(spark, sf_dir):
    from presslake.workloads import fixtures as fx
    from presslake.workloads.runs import pipeline_run

    first = pipeline_run(spark, sf_dir, materialize=cut_lineage)
    assert first.articles.count() > 0
    newest_first = first.articles.groupBy("feed_url").agg(F.max("published").alias("last_id"))
    docs = fx.page_feed_documents(spark, sf_dir).select("feed_url", "doc")
    again = pipeline.new_candidates(fx.page_feeds(spark, sf_dir), docs, newest_first)
    stale = again.join(newest_first, "feed_url").where("published <= last_id")
    assert stale.count() == 0


RSS = '<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title>{}</channel></rss>'


def item(title, n, day="2026-01-01", tail=""):
    return f"<item><title>{title}</title><link>https://e.com/{n}</link><pubDate>{day}T00:00:00Z</pubDate><dc:creator>Z</dc:creator>{tail}</item>"


def test_careless_feed_documents(spark):
    docs = [
        RSS.format(item("A & B", 1) + item("C&nbsp;D &amp; E", 2)),
        "\n ﻿" + '<?xml version="1.0"?>' + RSS.format(item("x\x01y", 3)),
        RSS.format(item("ok", 4) + item("bad <b>", 5) + item("fine", 6)),
        RSS.format(item("ok", 7) + item("cut", 8))[:-60],
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>q & r</title><link href="https://e.com/9"/></entry><entry><title>u</titl',
        RSS.format("<item><title>g</title><guid>https://e.com/10</guid></item><item><title>h</title><guid isPermaLink='false'>https://e.com/no</guid></item>"),
        "no feed", "", None,
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "i INT, doc STRING")
    got = [(r.i, r.title, r.link) for r in feeds.scan_feed_entries(df).orderBy("i", "pos").collect()]
    e = "https://e.com/"
    assert got == [
        (0, "A & B", e + "1"), (0, "C\xa0D & E", e + "2"), (1, "xy", e + "3"), (2, "ok", e + "4"), (2, "fine", e + "6"),
        (3, "ok", e + "7"), (4, "q & r", e + "9"), (5, "g", e + "10"), (5, "h", None),
    ]
    status = [(r.success, r.malformed) for r in feeds.feed_parse_status(df).orderBy("i").collect()]
    assert status == [(True, i in (2, 3, 4, 6, 7)) for i in range(8)] + [(False, False)]


def test_run_with_duplicates_and_failures(spark):
    long = " ".join(f"word{i}" for i in range(40))
    entries = "".join(item(f"t{n}", n, f"2026-01-{20 - n:02}", f"<description>{long} {n}</description>") for n in range(8))
    relative = RSS.format(f"<item><title>r</title><link>/rel</link><pubDate>2026-01-01T00:00:00Z</pubDate><description>{long}</description></item>")
    rows = [(0, "https://a.com/f", "A", "RSS"), (1, "https://b.com/f", "B", "RSS"), (2, "https://a.com/f", "A again", "RSS"), (3, "https://c.com/f", "C", "RSS")]
    listed = spark.createDataFrame(rows, "feed_ord BIGINT, feed_url STRING, feed_title STRING, feed_type STRING")
    docs = spark.createDataFrame(
        [("https://a.com/f", RSS.format("old"), 1), ("https://a.com/f", RSS.format(entries), 2), ("https://b.com/f", relative, 1), ("https://c.com/f", None, 1)],
        "feed_url STRING, doc STRING, fetched_at INT",
    )
    page = f"<body><article><p>{long} page</p></article></body>"
    pages = spark.createDataFrame(
        [("https://e.com/0", "<p>old</p>", None, 1), ("https://e.com/0", page, None, 2), ("https://e.com/1", None, "network", 1), ("https://b.com/rel", page, None, 1)],
        "url STRING, html STRING, error_kind STRING, fetched_at INT",
    )
    none = spark.createDataFrame([], "domain STRING")
    out = pipeline.run(listed, docs, spark.createDataFrame([], HISTORY), pages, none)
    nested = {r.feed_title: [a.title for a in r.articles] for r in out.nested.collect()}
    assert nested == {"A": ["t0", "t1", "t2", "t3", "t4"], "A again": ["t0", "t1", "t2", "t3", "t4"], "B": ["r"]}
    content = {a.title: a.content for r in out.nested.collect() for a in r.articles}
    assert content["t0"].endswith("page") and content["r"].endswith("page")
    assert sorted((r.feed_ord, r.success) for r in out.results.collect()) == [(0, True), (1, True), (2, True), (3, False)]
    black = {r.domain: r.fail_count for r in out.blacklist.collect()}
    assert black == {"e.com": 1, "weixin.sogou.com": None}
    assert {f.name for f in pipeline.failures_of(out.extracted, F.current_timestamp()).schema} == {f.split()[0] for f in FAILURES.split(", ")}


def test_strategies_in_turn(spark):
    short = "<article>" + "".join(f"<p>w {i}</p>" for i in range(30)) + "</article>"
    items = '<div class="entry-content">' + "".join(f"<li>v {i}</li>" for i in range(40)) + "</div>"
    rows = [(0, short, False), (1, items, False), (2, "<body>tiny</body>", False), (3, short, True), (4, None, False)]
    df = spark.createDataFrame(rows, "i INT, html STRING, closed BOOLEAN")
    got = {r.i: r.extraction_method for r in ex.strategy_cascade(df, blocked=F.col("closed")).collect()}
    assert got == {0: "newspaper3k", 1: "css-selectors", 2: None, 3: None, 4: None}


def test_page_never_fetched(spark):
    from presslake.sources.pages import page_join

    pages = spark.createDataFrame([("u", "<p>", None)], "url STRING, html STRING, error_kind STRING")
    rows = spark.createDataFrame([("u",), ("v",)], "link STRING")
    assert {r.link: (r.html, r.error_kind) for r in page_join(rows, pages).collect()} == {"u": ("<p>", None), "v": (None, "http")}
