"""Feed documents: RSS 0.9x/1.0/2.0 and Atom text -> entries."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.functions.binding import row_sql, sql_let, with_computed
from presslake.functions.dates import sql_published
from presslake.functions.text import blank_to_null, decode_xml, sql_text_map
from presslake.functions.urls import rewrite_aggregator_url
from presslake.schemas import FEED_DOCUMENT, FEED_NOT_FETCHED

_XML_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
# XML itself defines these five; the other HTML names must be spelled as numbers before parsing.
_XML_NAMES = ["amp", "lt", "gt", "quot", "apos"]


# A reference that XML itself knows, after its '&'.
_XML_REFERENCE = r"(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);"


def well_formed(doc: Column) -> Column:
    """What an XML parser can take of a careless document.

    Blanks ahead of the declaration and characters XML forbids go. Outside CDATA, HTML-only entity names become numeric
    references, and an '&' that begins no reference is spelled out.
    """
    table = {name: f"&#{code};" for name, code in name2codepoint.items() if name not in _XML_NAMES}
    name = r"regexp_extract(p, r'^([A-Za-z][0-9A-Za-z]*);', 1)"
    known = f"try_element_at({sql_text_map(table)}, n) || substring(p, length(n) + 2)"
    bare = f"CASE WHEN rlike(p, r'^{_XML_REFERENCE}') THEN '&' || p ELSE '&amp;' || p END"
    spelled = sql_let(name, "n", f"coalesce({known}, {bare})")
    piece = f"(p, i) -> CASE WHEN i = 0 THEN p ELSE {spelled} END"
    section = (
        f"s -> CASE WHEN startswith(s, '<![CDATA[') THEN s ELSE array_join(transform(split(s, '&', -1), {piece}), '') END"
    )
    # Text inside CDATA is not markup; documents without such names outside it stay as they are.
    outside = r"regexp_replace(d, r'(?s)<!\[CDATA\[.*?\]\]>', '')"
    needs = rf"rlike({outside}, r'&(?!{_XML_REFERENCE})')"
    sections = r"split(d, r'(?s)(?=<!\[CDATA\[)|(?<=\]\]>)', -1)"
    allowed = r"regexp_replace(v.d, r'^[\s\x{FEFF}]+(?=<)|[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]', '')"
    return row_sql(sql_let(allowed, "d", f"CASE WHEN {needs} THEN array_join(transform({sections}, {section}), '') ELSE d END"), d=doc)


def salvaged(doc: Column) -> Column:
    """Entries of a document that is no XML as a whole: each complete item is parsed alone, under the document's namespaces.

    ARRAY of item structs; a damaged item, and what follows the last complete one, is lost.
    """
    items = r"regexp_extract_all(v.d, r'(?s)<(item|entry)\b(?:[^>\x22\x27]++|\x22[^\x22]*+\x22|\x27[^\x27]*+\x27)*+>.*?</\1\s*>', 0)"
    names = r"array_join(array_distinct(regexp_extract_all(v.d, r'xmlns:\w+\s*=\s*(?:\x22[^\x22<]*\x22|\x27[^\x27<]*\x27)', 0)), ' ')"
    options = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in _XML_OPTIONS.items()) + ")"
    one = f"from_xml(concat('<rdf ', ns, '>', i, '</rdf>'), '{FEED_DOCUMENT}', {options})"
    good = sql_let(one, "f", "CASE WHEN f._corrupt_record IS NULL THEN coalesce(f.item, f.entry) END")
    parsed = sql_let(names, "ns", f"transform({items}, i -> {good})")
    return row_sql(f"flatten(filter({parsed}, x -> x IS NOT NULL))", d=doc)


def parse_feed(doc: Column) -> Column:
    """A well_formed() feed document as one fixed struct; a malformed one has _corrupt_record set."""
    return F.from_xml(doc, FEED_DOCUMENT, _XML_OPTIONS)


def _sql_link() -> str:
    """Element text, else the href of a link without rel or with rel=alternate, else a guid that is a permalink."""
    texts = "filter(transform(r.link, x -> nullif(trim(x._VALUE), '')), x -> x IS NOT NULL)"
    hrefs = "filter(r.link, x -> x._href IS NOT NULL AND (x._rel IS NULL OR x._rel = 'alternate'))"
    guid = r"CASE WHEN coalesce(lower(r.guid._isPermaLink), 'true') = 'true' AND rlike(r.guid._VALUE, r'(?i)^\s*https?://') THEN trim(r.guid._VALUE) END"
    return f"coalesce(try_element_at({texts}, 1), try_element_at({hrefs}, 1)._href, {guid})"


def _sql_first(field: str) -> str:
    return f"try_element_at(filter({field}, x -> x <> ''), 1)"


def entries_array(items: Column) -> Column:
    """Parsed items as ARRAY<STRUCT<pos, title, link, published, author, description, summary, content>> in document order.

    Fields follow the usual roles: pubDate or published, then updated or dc:date, then created; dc:creator or author;
    description or summary; content:encoded or content.
    """
    dates = ["coalesce(r.pubDate, r.published, r.issued)", "coalesce(r.updated, r.modified, r.date)", "r.created"]
    author = "coalesce(nullif(r.creator, ''), nullif(trim(r.author._VALUE), ''), nullif(r.author.name, ''))"
    entry = f"""(r, i) -> named_struct('pos', CAST(i AS BIGINT), 'title', r.title, 'link', {_sql_link()},
        'published', {sql_published(dates)}, 'author', {author}, 'description', nullif(r.description, ''),
        'summary', coalesce(nullif(r.description, ''), nullif(r.summary, '')),
        'content', coalesce({_sql_first("r.encoded")}, {_sql_first("r.content")}))"""
    return row_sql(f"transform(v.r, {entry})", r=items)


def parse_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Add entries, success, malformed and error; drop the document text.

    A NULL document was not fetched: the feed failed. A malformed one is a success with a warning and the entries
    that can be read one by one.
    """
    cleaned = with_computed(docs, "_doc", well_formed(F.col(doc)))
    parsed = with_computed(cleaned, "_feed", parse_feed(F.col("_doc")))
    fetched = F.col(doc).isNotNull()
    bad = fetched & (F.col("_feed").isNull() | F.col("_feed._corrupt_record").isNotNull())
    flagged = (
        parsed.withColumn("success", fetched)
        .withColumn("malformed", F.coalesce(bad, F.lit(False)))
        .withColumn("error", F.when(~fetched, F.lit(FEED_NOT_FETCHED)))
    )
    whole = F.coalesce("_feed.channel.item", "_feed.item", "_feed.entry")
    items = F.when(F.col("malformed"), salvaged(F.when(F.col("malformed"), F.col("_doc")))).otherwise(whole)
    read = with_computed(flagged, "_items", items)
    return with_computed(read, "entries", entries_array(F.col("_items"))).drop("_feed", "_doc", "_items", doc)


def feed_parse_status(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per document: success, malformed, error."""
    return parse_documents(docs, doc).drop("entries")


def scan_feed_entries(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per entry of every fetched document."""
    parsed = parse_documents(docs, doc).where("success")
    keep = [c for c in docs.columns if c != doc]
    return parsed.select(*keep, F.inline("entries"))


def description_coalesce(description: Column, summary: Column, content: Column) -> Column:
    return F.coalesce(blank_to_null(description), blank_to_null(summary), blank_to_null(content))


def author_coalesce(author: Column, author_name: Column) -> Column:
    return F.coalesce(blank_to_null(author), blank_to_null(author_name), F.lit("Unknown"))


def title_default(title: Column) -> Column:
    return F.coalesce(blank_to_null(title), F.lit("Unknown"))


def rewrite_entry_links(entries: DataFrame, rules=None) -> DataFrame:
    link = rewrite_aggregator_url(F.col("link"), F.col("summary"), F.col("content"), rules)
    return with_computed(entries, "link", link).select(*entries.columns)


def article_ids(entries: DataFrame) -> DataFrame:
    """Entries with their id: the published date, which is also its kind."""
    dated = entries.where(blank_to_null(F.col("published")).isNotNull())
    return dated.withColumn("_id", F.col("published")).withColumn("_id_type", F.lit("published"))


def entries_without_id(entries: DataFrame) -> DataFrame:
    """The rejected side of article_ids."""
    return entries.where(blank_to_null(F.col("published")).isNull())


def read_feed_documents(spark, path: str) -> DataFrame:
    """One row per landed file: path, doc, in the encoding its bytes declare."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode_xml(F.col("content")).alias("doc"))
