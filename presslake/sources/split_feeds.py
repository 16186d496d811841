"""Large feed files read by many tasks: a file is cut at the end tags of its items, wherever its blocks lie.

The text source takes an end tag as its line separator and so splits a file of any size; a row is one item. What an item
needs of its document, namespaces and encoding, is taken from the first row of the file. Positions are those of the file:
a block's first position is the number of items in the blocks before it, and rows of a block follow one another.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslake.functions.binding import with_computed
from presslake.functions.text import decode_body, xml_encoding
from presslake.plans.lineage import scratch_path
from presslake.sources.feeds import scan_feed_entries

_ITEM = r"<((?:[\w.-]+:)?(?:item|entry))(?=[\s>])"
_NAMESPACES = r"xmlns(?::[\w.-]+)?\s*=\s*(?:\x22[^\x22<]*\x22|\x27[^\x27<]*\x27)"


def item_tags(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Item tag as written (item, entry, atom:entry, ...) -> files that use it, by the first one in each file.

    One pass over rows no longer than a tag and the text before it. The driver gets a name per file, as many as Spark
    itself lists to read them.
    """
    rows = spark.read.option("lineSep", ">").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"),
        F.regexp_extract(F.concat("value", F.lit(">")), _ITEM, 1).alias("tag"),
    )
    found = rows.where("tag <> ''").groupBy("path").agg(F.min_by("tag", "at").alias("tag"))
    out: dict[str, list[str]] = {}
    for r in found.groupBy("tag").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect():
        out[r.tag] = list(r.paths)
    return out


def pieces(spark: SparkSession, paths: Iterable[str], tag: str) -> DataFrame:
    """(path, size, block, row, body): what lies between end tags, in document order by (block, row)."""
    return spark.read.option("lineSep", f"</{tag}>").text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        F.col("value").cast("binary").alias("body"),
    )


def _sections(body: Column) -> Column:
    """CDATA sections opened less those closed."""
    text = body.cast("string")
    return F.regexp_count(text, F.lit(r"<!\[CDATA\[")) - F.regexp_count(text, F.lit(r"\]\]>"))


def _blocks(rows: DataFrame, tag: str) -> DataFrame:
    """One row per block of a file: start (rows of the file before it), first_row, and what its file says.

    last_row is set in a file's last block if the file does not end in an end tag: that row is no item. A file is odd if
    an end tag stands inside CDATA somewhere: there a row is not an item. Sums run over blocks, never over rows.
    """
    end = len(f"</{tag}>")
    each = rows.groupBy("path", "block").agg(
        F.min_by(F.when(F.col("block") == 0, F.col("body")), "row").alias("head"), F.min("row").alias("first_row"), F.max("row").alias("last"),
        F.first("size").alias("size"), F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"),
        F.max(F.abs(_sections(F.col("body"))) > 0).alias("odd"),
    )
    head = F.substring_index(F.decode("head", "ISO-8859-1"), f"<{tag}", 1)
    names = F.array_join(F.array_distinct(F.regexp_extract_all(head, F.lit(_NAMESPACES), F.lit(0))), " ")
    file = Window.partitionBy("path")
    before = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("size") - F.sum("bytes").over(file) - (F.sum("n").over(file) - 1) * end
    open_end = (F.col("block") == F.max("block").over(file)) & (left < end)
    return each.select(
        "path", "block", "first_row", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.when(open_end, F.col("last")).alias("last_row"),
        F.coalesce(F.max("odd").over(file), F.lit(False)).alias("odd"), F.coalesce(F.max(names).over(file), F.lit("")).alias("namespaces"),
        F.coalesce(F.max(xml_encoding(F.col("head"))).over(file), F.lit("utf-8")).alias("encoding"),
    )


def _mended(rows: DataFrame, tag: str) -> DataFrame:
    """Rows of odd files put together up to the end of their CDATA sections; a file's sections are summed in order."""
    upto = Window.partitionBy("path").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    balance = rows.withColumn("inside", F.coalesce(F.sum(_sections(F.col("body"))).over(upto), F.lit(0)) > 0)
    group = F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(Window.partitionBy("path").orderBy("block", "row"))
    parts = balance.withColumn("group", group).groupBy("path", "group", "namespaces", "encoding")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", "row", F.hex("body").alias("h")))), lambda x: x["h"])
    whole = F.unhex(F.array_join(ordered, f"</{tag}>".encode().hex()))
    return parts.agg(whole.alias("body")).select("path", (F.col("group") - 1).alias("pos"), "body", "namespaces", "encoding")


def _one_item(tag: str) -> Column:
    """A row's item as a document of its own; null if no item begins in it."""
    text = decode_body(F.col("body"), F.col("encoding"))
    item = F.regexp_extract(text, rf"(?s)<{tag}[\s>].*$", 0)
    return F.when(item != "", F.concat(F.lit("<rdf "), "namespaces", F.lit(">"), item, F.lit(f"</{tag}></rdf>")))


def read_feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, title, link, ...): the entries of all feed files below path, as scan_feed_entries gives them.

    A file may be larger than a task can hold; an item may not. pos counts the file's items from 0, damaged ones
    included, which are left out. An item that the file's end cuts off is left out, as is a file without items. The
    encoding is that of the XML declaration, UTF-8 without one; UTF-16 files are for read_feed_documents.
    """
    docs = spark.createDataFrame([], "path STRING, at BIGINT, doc STRING")
    for tag, paths in sorted(item_tags(spark, path).items()):
        rows = pieces(spark, paths, tag)
        # Written, so that Spark knows its size: broadcast if small, else a hot file's rows are split at run time.
        facts = scratch_path(spark, "feed-blocks")
        _blocks(rows, tag).write.parquet(facts)
        blocks = spark.read.parquet(facts)
        known = rows.join(blocks, ["path", "block"]).where(F.col("last_row").isNull() | (F.col("row") != F.col("last_row")))
        place = (F.col("start") + F.col("row") - F.col("first_row")).alias("pos")
        items = known.where(~F.col("odd")).select("path", place, "body", "namespaces", "encoding")
        if not blocks.where("odd").isEmpty():
            items = items.unionByName(_mended(known.where("odd"), tag))
        one = with_computed(items, "doc", _one_item(tag)).where("doc is not null")
        docs = docs.unionByName(one.select("path", F.col("pos").alias("at"), "doc"))
    # An end tag written with blanks does not cut: then a row holds several items, of which the first has its place.
    return scan_feed_entries(docs).withColumn("pos", F.col("at") + F.col("pos")).drop("at")
