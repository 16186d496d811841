"""Split reading of feed files equals the one-row form; declared encodings are read."""

import pytest
from pyspark.sql import functions as F

from presslake.sources import feeds, opml
from presslake.sources.split_feeds import item_tags, pieces, read_feed_entries

FIELDS = ["pos", "title", "link", "published", "author", "description", "summary", "content"]


@pytest.fixture
def small_blocks(spark):
    """Files are cut every few hundred bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rss(n, encoding="utf-8", extra="", word="café"):
    items = "".join(
        f"<item><title>T{i} {word} &amp; &mdash;</title><link>https://e.org/{i}</link><pubDate>Mon, {1 + i % 28:02d} Jan 2024 10:00:00 GMT</pubDate>"
        f"<dc:creator>A{i}</dc:creator><description><![CDATA[<p>{'x' * (i % 90)}</p>]]></description></item>\n{extra}"
        for i in range(n)
    )
    return f"<?xml version='1.0' encoding='{encoding}'?>\n<rss xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>F</title>{items}</channel></rss>"


def atom(n, prefix=""):
    p = f"{prefix}:" if prefix else ""
    xmlns = f"xmlns:{prefix}" if prefix else "xmlns"
    items = "".join(
        f"<{p}entry>\n<{p}title>E{i}</{p}title><{p}link href='https://e.org/{i}'/><{p}updated>2024-02-{1 + i % 28:02d}T00:00:00Z</{p}updated>"
        f"<{p}author><{p}name>N</{p}name></{p}author><{p}summary>s{i}</{p}summary></{p}entry>" for i in range(n)
    )
    return f"<{p}feed {xmlns}='http://www.w3.org/2005/Atom'><{p}title>F</{p}title>{items}</{p}feed>"


def rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], *[r[c] for c in FIELDS]) for r in df.collect())


def test_equals_the_one_row_form(spark, tmp_path, small_blocks):
    files = {
        "rss.xml": rss(120), "latin.xml": rss(40, "ISO-8859-1"), "gb.xml": rss(30, "gb18030", word="新闻报道"), "atom.xml": atom(60), "prefixed.xml": atom(30, "a"),
        "odd.xml": rss(25, extra="<item><title>odd</title><link>https://e.org/o</link><description><![CDATA[a </item> b <item> c]]></description></item>"),
        "empty.xml": "<rss><channel><title>none</title></channel></rss>", "bom.xml": "﻿" + rss(7), "one.xml": rss(1), "nothing.xml": "",
    }
    encodings = {"latin.xml": "iso-8859-1", "gb.xml": "gb18030"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode(encodings.get(name, "utf-8")))
    whole = feeds.scan_feed_entries(feeds.read_feed_documents(spark, str(tmp_path)))
    split = read_feed_entries(spark, str(tmp_path))
    want = rows(whole)
    assert len(want) == 120 + 40 + 30 + 60 + 30 + 50 + 7 + 1
    assert rows(split) == want
    assert item_tags(spark, str(tmp_path)).keys() == {"item", "entry", "a:entry"}


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.xml").write_text(rss(3000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        entries = read_feed_entries(spark, str(tmp_path))
        tasks = entries.select(F.spark_partition_id().alias("p")).distinct().count()
        assert [r.pos for r in entries.select("pos").orderBy("pos").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 4


def test_cut_off_and_damaged_files(spark, tmp_path, small_blocks):
    text = rss(40)
    (tmp_path / "cut.xml").write_text(text[: text.rindex("<dc:creator>")])
    (tmp_path / "open.xml").write_text(text[: text.rindex("</item>") + len("</item>")])
    (tmp_path / "bad.xml").write_text(text.replace("<title>T7 ", "<title><b>T7 "))
    got = {}
    for r in read_feed_entries(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.pos)
    assert sorted(got["cut.xml"]) == list(range(39))
    assert sorted(got["open.xml"]) == list(range(40))
    assert sorted(got["bad.xml"]) == [i for i in range(40) if i != 7]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "iso-8859-1", "windows-1251", "shift_jis"])
def test_declared_encodings_of_lists(spark, tmp_path, encoding):
    title = {"windows-1251": "Новости", "shift_jis": "ニュース"}.get(encoding, "café")
    text = f"<?xml version='1.0' encoding='{encoding}'?><opml><body><outline text='{title}' xmlUrl='https://e.org/f'/></body></opml>"
    (tmp_path / "list.opml").write_bytes(text.encode(encoding))
    assert [r.feed_title for r in opml.scan_opml(opml.read_opml(spark, str(tmp_path))).collect()] == [title]


def test_no_files_with_items(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss/>")
    assert read_feed_entries(spark, str(tmp_path)).count() == 0


def test_small_files_share_tasks(spark, tmp_path):
    # A split of 16 MB held four files of any size, as opening one counted 4 MB.
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    root = str(tmp_path / "feeds")
    doc = F.format_string("<rss><channel><item><title>t%d</title></item></channel></rss>", "id")
    spark.range(120).select(F.col("id").alias("feed"), doc.alias("doc")).repartition(1).write.partitionBy("feed").text(root)
    spark.conf.set(key, "16m")
    try:
        files = [f for paths in item_tags(spark, root).values() for f in paths]
        assert len(files) == 120
        assert pieces(spark, files, "item").rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
        assert read_feed_entries(spark, root).count() == 120
    finally:
        spark.conf.set(key, before)
