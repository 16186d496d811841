"""Element table of a page for selector matching, where nesting matters and regular expressions cannot follow it.

The helper only flattens one page into token and element arrays; matching, scoring and choosing are column
expressions over those arrays. Callers pass NULL for pages that do not need it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType

from presslake.functions.binding import row_sql, sql_let

# Content selectors in order of preference, as (kind, attribute, value).
CONTENT_SELECTORS = [
    ("tag", "", "article"),
    ("tag", "", "main"),
    ("attr", "role", "main"),
    ("attr", "itemprop", "articleBody"),
    ("attr", "itemprop", "text"),
    ("class", "", "article-content"),
    ("class", "", "article-body"),
    ("class", "", "article__body"),
    ("class", "", "article-text"),
    ("class", "", "post-content"),
    ("class", "", "post-body"),
    ("class", "", "post-text"),
    ("class", "", "entry-content"),
    ("class", "", "entry-body"),
    ("class", "", "story-body"),
    ("class", "", "story-content"),
    ("class", "", "blog-post-content"),
    ("class", "", "single-content"),
    ("class", "", "single-post"),
    ("class", "", "content-body"),
    ("class", "", "content"),
    ("attr", "id", "article-body"),
    ("attr", "id", "post-body"),
    ("attr", "id", "content-body"),
    ("attr", "id", "main-content"),
    ("attr", "data-component", "article-body"),
    ("attr", "data-content", "article"),
    ("attr", "data-testid", "article-body"),
    ("class", "", "wp-block-post-content"),
    ("class", "", "elementor-theme-builder-content"),
    ("contains", "class", "article-body"),
    ("contains", "class", "post-content"),
]

# Containers whose images count, in order of preference.
IMAGE_SELECTORS = [
    ("tag", "", "article"),
    ("tag", "", "main"),
    ("class", "", "article-content"),
    ("class", "", "article-body"),
    ("class", "", "article__body"),
    ("class", "", "post-content"),
    ("class", "", "post-body"),
    ("class", "", "entry-content"),
    ("class", "", "story-body"),
    ("class", "", "blog-post"),
    ("class", "", "single-content"),
    ("attr", "itemprop", "image"),
    ("contains", "class", "article"),
    ("contains", "class", "post"),
    ("tag", "", "figure"),
    ("class", "", "featured-image"),
    ("class", "", "cover-image"),
]

# Elements without an end tag, and start tags that end an open element of the same family.
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}

_TOKEN = StructType([StructField("text", StringType()), StructField("hidden", BooleanType())])
_ELEMENT = StructType(
    [
        StructField("tag", StringType()),
        StructField("attrs", MapType(StringType(), StringType())),
        StructField("classes", ArrayType(StringType())),
        *[StructField(n, IntegerType()) for n in ("start", "stop", "first_token", "n_tokens", "raw_len")],
    ]
)
PAGE_ELEMENTS = StructType([StructField("tokens", ArrayType(_TOKEN)), StructField("elements", ArrayType(_ELEMENT))])
_ARROW_ELEMENTS = to_arrow_type(PAGE_ELEMENTS)


class _Flattener(HTMLParser):
    """Collects text tokens and, for each element, its tag span, token span and raw text length."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tokens, self.elements, self.open = [], [], []
        self.clock = self.raw = 0

    def _close_from(self, depth):
        for element in self.open[depth:]:
            element["stop"] = self.clock
            element["n_tokens"] = len(self.tokens) - element["first_token"]
            element["raw_len"] = self.raw - element["raw_len"]
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        self.clock += 1
        if tag in ENDS_PARAGRAPH and self.open and self.open[-1]["tag"] == "p":
            self._close_from(len(self.open) - 1)
        if tag == "li" and self.open and self.open[-1]["tag"] == "li":
            self._close_from(len(self.open) - 1)
        values = {name: value or "" for name, value in attrs}
        element = {
            "tag": tag,
            "attrs": values,
            "classes": values.get("class", "").split(),
            "start": self.clock,
            "stop": self.clock,
            "first_token": len(self.tokens),
            "n_tokens": 0,
            "raw_len": 0,
        }
        if tag in _SELECTABLE_TAGS or not _SELECTABLE_ATTRIBUTES.isdisjoint(values):
            self.elements.append(element)
        if tag not in VOID_TAGS:
            element["raw_len"] = self.raw
            self.open.append(element)

    def handle_endtag(self, tag):
        self.clock += 1
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] == tag:
                self._close_from(depth)
                break

    def handle_data(self, data):
        self.raw += len(data)
        text = data.strip()
        if text:
            hidden = bool(self.open) and self.open[-1]["tag"] in ("script", "style")
            self.tokens.append({"text": text, "hidden": hidden})

    def parse_marked_section(self, i, report=1):
        """A section HTML does not know is a comment up to the next '>'."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def finish(self):
        self.close()
        self.clock += 1
        self._close_from(0)
        return {"tokens": self.tokens, "elements": self.elements}


_SELECTABLE_TAGS = {"img"} | {value for kind, _, value in CONTENT_SELECTORS + IMAGE_SELECTORS if kind == "tag"}
_SELECTABLE_ATTRIBUTES = {"class", "id"} | {name for _, name, _ in CONTENT_SELECTORS + IMAGE_SELECTORS if name}


# Characters of HTML whose elements a worker holds at a time; a longer page is a slice of its own.
SLICE_CHARS = 1 << 20


def _flat(page: str | None) -> dict:
    if page is None:
        return {"tokens": None, "elements": None}
    parser = _Flattener()
    try:
        parser.feed(page)
        return parser.finish()
    except Exception:  # one page the parser cannot take must not end the job; see unreadable()
        return {"tokens": None, "elements": None}


def flatten_slices(batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """The pages of Arrow batches as element tables, handed on slice by slice whatever the length of a batch."""
    for pages in batches:
        rows, chars = [], 0
        for page in pages:
            html = page.as_py()
            rows.append(_flat(html))
            chars += 64 + len(html or "")
            if chars >= SLICE_CHARS:
                yield pa.array(rows, _ARROW_ELEMENTS)
                rows, chars = [], 0
        if rows:
            yield pa.array(rows, _ARROW_ELEMENTS)


@F.arrow_udf(PAGE_ELEMENTS)
def _flatten_batch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from flatten_slices(batches)


def page_elements(html: Column) -> Column:
    """Tokens and selectable elements of a page in document order; both NULL if the parser cannot take the page."""
    return _flatten_batch(html)


def unreadable(html: Column, dom: Column) -> Column:
    """The page was there but could not be parsed; such pages count as having no elements."""
    return html.isNotNull() & dom["elements"].isNull()


def sql_rules(rules: list[tuple[str, str, str]]) -> str:
    """A selector list as one SQL array."""
    return "array(" + ", ".join(f"named_struct('kind', '{k}', 'name', '{n}', 'value', '{v}')" for k, n, v in rules) + ")"


def sql_matches(e: str, r: str) -> str:
    """Does element e satisfy selector rule r?"""
    attribute = f"try_element_at({e}.attrs, {r}.name)"
    return (
        f"coalesce(CASE {r}.kind WHEN 'tag' THEN {e}.tag = {r}.value "
        f"WHEN 'class' THEN array_contains({e}.classes, {r}.value) "
        f"WHEN 'attr' THEN {attribute} = {r}.value ELSE contains({attribute}, {r}.value) END, false)"
    )


def sql_element_text(dom: str, e: str) -> str:
    """Visible text nodes of an element, one per line."""
    span = f"slice({dom}.tokens, {e}.first_token + 1, {e}.n_tokens)"
    return f"array_join(transform(filter({span}, k -> NOT k.hidden), k -> k.text), '\\n')"


def sql_best_element(elements: str, rule: str) -> str:
    """Matching element with the longest raw text, the first one on a tie; NULL when none matches."""
    key = "struct({0}.raw_len, -{0}.start)".format
    top = f"array_max(transform(es, e -> {key('e')}))"
    pick = sql_let(top, "top", f"try_element_at(filter(es, e -> {key('e')} = top), 1)")
    return sql_let(f"filter({elements}, e -> {sql_matches('e', rule)})", "es", pick)


def element_text(dom: Column, element: Column) -> Column:
    return row_sql(sql_element_text("v.dom", "v.e"), dom=dom, e=element)


def best_element(elements: Column, rule: tuple[str, str, str]) -> Column:
    return row_sql(sql_let(sql_rules([rule]) + "[0]", "r", sql_best_element("v.es", "r")), es=elements)
