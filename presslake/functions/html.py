"""HTML text extraction over one page per row: no explode, no shuffle, no DOM.

The sql_ functions give SQL text over an SQL operand; the functions of the same name take and give columns.
"""

from __future__ import annotations

from pyspark.sql import Column

from presslake.functions.binding import row_sql, sql_let
from presslake.functions.text import sql_clean_text, sql_decode_entities

# A strategy's text must reach this length.
MIN_CONTENT_CHARS = 100

# Tags that start a new text block.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol",
    "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
]

# Thresholds of the word-count and link-density classifier (Kohlschuetter et al., WSDM 2010).
MAX_LINK_DENSITY = 0.333333
MAX_PREV_LINK_DENSITY = 0.555556


def sql_drop_nontext(x: str) -> str:
    """Remove comments, scripts and styles; each leaves a text boundary."""
    x = rf"regexp_replace({x}, r'(?s)<!--.*?(?:-->|\z)', '\n')"
    x = rf"regexp_replace({x}, r'(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)', '\n')"
    return rf"regexp_replace({x}, r'(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)', '\n')"


def sql_visible_text(x: str) -> str:
    """Text nodes of script-free HTML, one per line, stripped, blanks dropped."""
    return sql_clean_text(sql_decode_entities(rf"regexp_replace({x}, '<[^>]+>', '\n')", loose=True))


def sql_body_fragment(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, r'(?is)\A.*?<body\b[^>]*>', ''), r'(?is)</body\s*>.*\z', '')"


def sql_article_fragment(x: str) -> str:
    """Inner HTML of the first article element, '' when there is none."""
    return rf"regexp_extract({x}, r'(?is)<article\b[^>]*>(.*?)(?:</article\s*>|\z)', 1)"


def drop_nontext(html: Column) -> Column:
    return row_sql(sql_drop_nontext("v.h"), h=html)


def visible_text(html: Column) -> Column:
    return row_sql(sql_visible_text("v.h"), h=html)


def body_text(html: Column) -> Column:
    """Whole visible body; a page without a body tag is all body."""
    return row_sql(sql_visible_text(sql_body_fragment(sql_drop_nontext("v.h"))), h=html)


def _sql_pieces(x: str) -> str:
    """Pieces of script-free HTML cut at block tags: the tag name, a marker, what follows (the first has no name)."""
    lines = rf"regexp_replace({x}, r'(?i)<br\b[^>]*>', '\n')"
    tags = "|".join(BLOCK_TAGS)
    marked = rf"regexp_replace({lines}, r'(?i)<(/?(?:{tags}))\b[^>]*>', '\u0001$1\u0002')"
    return rf"split({marked}, '\u0001', -1)"


_PIECE_TAG = r"CASE WHEN contains(p, '\u0002') THEN lower(substring_index(p, '\u0002', 1)) ELSE '' END"
_PIECE_HTML = r"substring_index(p, '\u0002', -1)"


def _sql_word_count(x: str) -> str:
    """Space-separated words, plus one per two ideographs for scripts written without spaces."""
    ideographs = rf"regexp_count({x}, r'[\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}]') div 2"
    return (
        f"CASE WHEN {x} = '' THEN 0 ELSE size(split({x}, r'[ \\n]+')) END "
        f"+ CASE WHEN octet_length({x}) = length({x}) THEN 0 ELSE CAST({ideographs} AS INT) END"
    )


def sql_html_blocks(x: str) -> str:
    links = rf"array_join(regexp_extract_all({_PIECE_HTML}, r'(?is)<a\b[^>]*>(.*?)(?:</a\s*>|\z)', 1), ' ')"
    cut = (
        f"p -> named_struct('tag', {_PIECE_TAG}, 'text', {sql_visible_text(_PIECE_HTML)}, "
        f"'link_text', {sql_visible_text(links)})"
    )
    count = (
        f"b -> named_struct('tag', b.tag, 'text', b.text, 'words', {_sql_word_count('b.text')}, "
        f"'link_words', {_sql_word_count('b.link_text')})"
    )
    return f"transform(filter(transform({_sql_pieces(sql_drop_nontext(x))}, {cut}), b -> b.text <> ''), {count})"


def html_blocks(html: Column) -> Column:
    """ARRAY<STRUCT<tag, text, words, link_words>> of the non-empty text blocks in document order."""
    return row_sql(sql_html_blocks("v.h"), h=html)


def _sql_long_enough(x: str) -> str:
    return sql_let(x, "t", f"CASE WHEN length(t) >= {MIN_CONTENT_CHARS} THEN t END")


def _sql_content_blocks(blocks: str) -> str:
    """Blocks the decision tree over a block and its neighbours keeps; a missing neighbour has no words, no links."""

    def words(i: str) -> str:
        return f"coalesce(get({blocks}, {i}).words, 0)"

    def density(i: str) -> str:
        return f"CASE WHEN {words(i)} > 0 THEN get({blocks}, {i}).link_words / {words(i)} ELSE 0 END"

    return (
        f"filter({blocks}, (b, i) -> {density('i')} <= {MAX_LINK_DENSITY} AND CASE "
        f"WHEN {density('i - 1')} <= {MAX_PREV_LINK_DENSITY} "
        f"THEN b.words > 16 OR {words('i + 1')} > 15 OR {words('i - 1')} > 4 "
        f"ELSE b.words > 40 OR {words('i + 1')} > 17 END)"
    )


def main_text_density(html: Column) -> Column:
    """Text of the content blocks, NULL when under 100 characters."""
    joined = f"array_join(transform({_sql_content_blocks('bs')}, b -> b.text), '\\n')"
    return row_sql(_sql_long_enough(sql_let(sql_html_blocks("v.h"), "bs", joined)), h=html)


def main_text_paragraphs(html: Column) -> Column:
    """Paragraphs of the article element (else the body), one per line, NULL when under 100 characters."""
    fragment = f"coalesce(nullif({sql_article_fragment('h')}, ''), {sql_body_fragment('h')})"
    inline = sql_clean_text(sql_decode_entities(f"regexp_replace({_PIECE_HTML}, '<[^>]+>', '')", loose=True))
    texts = f"transform(filter({_sql_pieces(fragment)}, p -> {_PIECE_TAG} = 'p'), p -> {inline})"
    joined = f"array_join(filter({texts}, t -> t <> ''), '\\n')"
    return row_sql(_sql_long_enough(sql_let(sql_drop_nontext("v.h"), "h", joined)), h=html)


def sql_attribute(tag: str, name: str) -> str:
    """Raw value of an attribute inside one tag's text; NULL when absent or empty."""
    return sql_attribute_of(sql_attributes(tag), name)


def sql_tags(name: str) -> str:
    """Pattern of a start tag; a '>' inside a quoted value does not end it."""
    return rf"(?is)<{name}\b(?:[^>\x22\x27]++|\x22[^\x22]*+\x22|\x27[^\x27]*+\x27)*+>"


def sql_attributes(tag: str) -> str:
    """The attributes of a tag as 'name=value' texts; what looks like one inside a quoted value is none."""
    value = r"(?:\x22[^\x22]*+\x22|\x27[^\x27]*+\x27|[^\s\x22\x27>]++)"
    return rf"regexp_extract_all({tag}, r'(?s)[^\s\x22\x27<>/=]++\s*+=\s*+{value}', 0)"


def sql_attribute_of(attributes: str, name: str) -> str:
    """Value of the first attribute of that name in a list of sql_attributes; NULL when absent or empty."""
    first = rf"try_element_at(filter({attributes}, a -> rlike(a, r'(?i)^{name}\s*=')), 1)"
    # Only one group takes part in a match, so their concatenation is the value.
    pattern = r"(?s)^[^=]*=\s*(?:\x22(.*)\x22|\x27(.*)\x27|([^\x22\x27].*))$"
    return f"nullif(regexp_replace({first}, r'{pattern}', '$1$2$3'), '')"


def page_metadata(html: Column) -> Column:
    """STRUCT<title, published_text, author>: title defaults to 'Unknown', the others to NULL."""

    def meta(pattern: str) -> str:
        return sql_attribute(f"try_element_at(filter(ms, m -> rlike(m, r'{pattern}')), 1)", "content")

    title = sql_clean_text(sql_decode_entities(r"regexp_extract(v.h, r'(?is)<title\b[^>]*>(.*?)</title\s*>', 1)", loose=True))
    published = meta(r"(?i)property\s*=\s*[\x22\x27]?article:published_time")
    time = sql_attribute(r"regexp_extract(v.h, r'(?is)<time\b[^>]*>', 0)", "datetime")
    author = meta(r"(?i)[\s\x22\x27]name\s*=\s*[\x22\x27]?author[\x22\x27\s/>]")
    found = (
        f"named_struct('title', coalesce(nullif({title}, ''), 'Unknown'), "
        f"'published_text', {sql_decode_entities(f'coalesce({published}, {time})')}, "
        f"'author', {sql_decode_entities(author)})"
    )
    return row_sql(sql_let(r"regexp_extract_all(v.h, r'" + sql_tags("meta") + "', 0)", "ms", found), h=html)
