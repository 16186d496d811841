"""Subscription lists: OPML documents -> feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.functions.text import blank_to_null, decode_entities, decode_xml

# An outline start tag at any depth; quoted values may hold '>'.
_OUTLINE = r"""<outline\b((?:[^>"']+|"[^"]*"|'[^']*')*)>"""


def detect_feed_type(url: Column, type_attr: Column) -> Column:
    """The type attribute upper-cased, else ATOM when the URL mentions it, else RSS."""
    return (
        F.when(blank_to_null(type_attr).isNotNull(), F.upper(type_attr))
        .when(F.lower(url).contains("atom"), F.lit("ATOM"))
        .otherwise(F.lit("RSS"))
    )


def feed_title(title: Column, text: Column, url: Column) -> Column:
    return F.coalesce(blank_to_null(title), blank_to_null(text), url)


def _attribute(attrs: Column, name: str) -> Column:
    double = F.regexp_extract(attrs, rf'(?:^|\s){name}\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(attrs, rf"(?:^|\s){name}\s*=\s*'([^']*)'", 1)
    return decode_entities(F.coalesce(blank_to_null(double), blank_to_null(single)))


def is_well_formed(doc: Column) -> Column:
    """Can the text be parsed as XML?"""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_xml(doc, "head STRING, _corrupt_record STRING", options)
    return parsed.isNotNull() & parsed["_corrupt_record"].isNull() & doc.contains("<")


def scan_outlines(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Every outline at any depth in document order: other columns plus outline_pos, xml_url, title, text, type.

    Outlines need no nesting to be read, so start tags are taken natively; comments are dropped first.
    """
    plain = F.regexp_replace(F.col(doc), r"(?s)<!--.*?-->", "")
    tags = F.regexp_extract_all(plain, F.lit(_OUTLINE), F.lit(1))
    keep = [c for c in docs.columns if c != doc]
    rows = docs.select(*keep, F.posexplode(tags).alias("outline_pos", "_attrs"))
    attrs = {"xml_url": "xmlUrl", "title": "title", "text": "text", "type": "type"}
    return rows.select(*keep, "outline_pos", *[_attribute(F.col("_attrs"), a).alias(c) for c, a in attrs.items()])


def outline_to_feed(outlines: DataFrame) -> DataFrame:
    """Outlines with a feed URL -> feed_url, feed_title, feed_type (other columns kept)."""
    keep = [c for c in outlines.columns if c not in ("xml_url", "title", "text", "type")]
    url = F.col("xml_url")
    return outlines.where(blank_to_null(url).isNotNull()).select(
        *keep,
        url.alias("feed_url"),
        feed_title(F.col("title"), F.col("text"), url).alias("feed_title"),
        detect_feed_type(url, F.col("type")).alias("feed_type"),
    )


def scan_opml(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Feeds of the well-formed documents."""
    return outline_to_feed(scan_outlines(docs.where(is_well_formed(F.col(doc))), doc))


def opml_errors(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Documents that cannot be parsed."""
    return docs.where(~F.coalesce(is_well_formed(F.col(doc)), F.lit(False)))


def read_opml(spark, path: str) -> DataFrame:
    """One row per file: path, doc, in the encoding its bytes declare."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_xml(F.col("content")).alias("doc"))
