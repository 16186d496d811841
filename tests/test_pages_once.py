"""A page that several articles link to is read once."""

from pyspark.sql import functions as F

from presslake.operators.extraction import Strategy, extract_articles
from presslake.plans import pipeline
from presslake.plans.lineage import cut_lineage, landed
from presslake.sources.pages import page_join
from presslake.workloads import runs


def test_pages_are_read_once_with_the_same_result(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def body(html):
        if html is not None:
            reads.add(1)
        return html

    body = body.asNondeterministic()
    text = "a long enough text " * 10
    pages = spark.createDataFrame(
        [("u", f"<article><img src='https://i.example.com/a.png'>{text}</article>", None), ("v", text, "http"), ("w", text, None), ("x", "short", None), ("y", None, "network"), ("z", text, None)],
        "url STRING, html STRING, error_kind STRING",
    )
    rows = [(i, link, "t", None, text, False) for i, link in enumerate(["u"] * 6 + ["v", "x", "y", "none", None])]
    rows += [(20, "w", "t", "a", text, True), (21, "w", "t", "a", "short", True), (22, "u", "t", "a", "short", True)]
    candidates = spark.createDataFrame(rows, "pos INT, link STRING, title STRING, author STRING, description STRING, blocked BOOLEAN")
    own = [Strategy("Own", lambda html: body(html))]
    names = ["pos", "link", "title", "author", "images", "extraction_method", "success", "content", "failure_reason", "error_kind"]
    plain = extract_articles(page_join(candidates, pages), own).select(*names).orderBy("pos").collect()
    reads.value = 0
    once = extract_articles(candidates, own, pages=pages).select(*names).orderBy("pos").collect()
    assert once == plain
    assert plain[0].extraction_method == "own" and plain[0].images == ["https://i.example.com/a.png"]
    assert reads.value == 2  # u and x: v and y failed, w is blocked, nothing asks for z


def test_a_run_makes_its_documents_once_and_tells_every_feeds_status(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def make(doc):
        made.add(1)
        return doc

    long = "a long enough description " * 10
    item = f"<item><title>t</title><link>https://p.example.com/1</link><pubDate>2026-04-01T00:00:00Z</pubDate><description>{long}</description></item>"
    doc = "<rss version='2.0'><channel><title>f</title>{}</channel></rss>"
    feeds = spark.createDataFrame([(i, u, u, "RSS") for i, u in enumerate(["some", "empty", "absent", "never", "some"])], "feed_ord LONG, feed_url STRING, feed_title STRING, feed_type STRING")
    docs = spark.createDataFrame([("some", doc.format(item * 3)), ("empty", doc.format("")), ("absent", None), ("unlisted", doc.format(item))], "feed_url STRING, doc STRING")
    docs = docs.withColumn("doc", F.when(F.col("doc").isNotNull(), make.asNondeterministic()(F.col("doc"))))
    history = spark.createDataFrame([], "feed_url STRING, last_id STRING")
    pages = spark.createDataFrame([("https://p.example.com/1", f"<article>{long}</article>", None)], "url STRING, html STRING, error_kind STRING")
    listed = spark.createDataFrame([], "domain STRING")

    def outcome(**more):
        out = pipeline.run(feeds, docs, history, pages, listed, **more)
        nested = sorted((r.feed_ord, len(r.articles), r.articles[0].content) for r in out.nested.collect())
        return sorted(map(tuple, out.results.collect())), nested

    plain = outcome()
    assert [r[4] for r in plain[0]] == [True, True, False, False, True] and [r[:2] for r in plain[1]] == [(0, 3), (4, 3)]
    made.value = 0
    assert outcome(materialize=cut_lineage) == plain
    assert made.value == 4  # each row of docs once
    for keep in (True, False):
        assert outcome(materialize=landed, keep_settled=keep) == plain


def test_article_pipeline_parses_and_asks_for_pages_ahead(spark, sf_dir):
    plan = runs.article_pipeline(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_xml" not in plan and "_flatten_batch" in plan
    # HTML is read before it meets the articles, once a page.
    assert "_link" in plan
