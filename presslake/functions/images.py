"""Image choice over a page's image attributes, one page per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslake.functions.binding import row_sql, sql_let, with_computed
from presslake.functions.dom import IMAGE_SELECTORS, page_elements, sql_matches, sql_rules
from presslake.functions.html import sql_article_fragment, sql_attribute_of, sql_attributes, sql_drop_nontext, sql_tags
from presslake.functions.text import sql_decode_entities
from presslake.functions.urls import sql_absolute_url

# Lazy-loading attributes in order of preference.
LAZY_ATTRIBUTES = ["data-src", "data-lazy-src", "data-original"]
# Words of trackers and of decorative images, and size and count limits.
TRACKER_WORDS = [
    "googletagmanager", "google-analytics", "facebook.net", "analytics", "tracking", "pixel", "beacon", "adsystem",
]
SKIP_WORDS = ["icon", "logo", "avatar", "user-pic", "profile", "button", "btn"]
MIN_SIDE = 100
MAX_IMAGES = 10
ENOUGH_IMAGES = 3

IMAGE_ATTRIBUTES = [*LAZY_ATTRIBUTES, "src", "srcset", "width", "height"]
_WORDS = "|".join(w.replace(".", r"\.") for w in TRACKER_WORDS + SKIP_WORDS)
_HAS_IMAGE = r"(?i)<img\b"


def sql_image_src(attribute: Callable[[str], str]) -> str:
    """Lazy-load source, else a src that is no data URI, else the first srcset candidate."""
    lazy = ", ".join(f"nullif({attribute(name)}, '')" for name in LAZY_ATTRIBUTES)
    src = sql_let(f"nullif({attribute('src')}, '')", "s", "CASE WHEN NOT startswith(s, 'data:') THEN s END")
    first = rf"nullif(regexp_extract({attribute('srcset')}, r'^\s*([^\s,]*)', 1), '')"
    return f"coalesce({lazy}, {src}, {first})"


def sql_image_valid(src: str, width: str, height: str) -> str:
    """Absolute http source, no tracker or decoration word, not small; sizes count only when both are numbers."""
    w, h = f"try_cast(trim({width}) AS INT)", f"try_cast(trim({height}) AS INT)"
    small = f"coalesce({w} <> 0 AND {h} <> 0 AND ({w} < {MIN_SIDE} OR {h} < {MIN_SIDE}), false)"
    return f"coalesce(startswith({src}, 'http') AND NOT rlike(lower({src}), r'{_WORDS}') AND NOT {small}, false)"


def image_src(attrs: dict[str, Column]) -> Column:
    packed = F.struct(*[attrs[name].alias(name) for name in IMAGE_ATTRIBUTES])
    return row_sql(sql_image_src(lambda name: f"v.a.`{name}`"), a=packed)


def image_valid(src: Column, width: Column, height: Column) -> Column:
    return row_sql(sql_image_valid("v.src", "v.w", "v.h"), src=src, w=width, h=height)


def _sql_accepted(url: str, attribute: Callable[[str], str]) -> str:
    """Absolute URL of one image when it is valid, else NULL."""
    resolved = sql_let(sql_decode_entities("s"), "d", sql_absolute_url(url, "d"))
    valid = sql_image_valid("s", attribute("width"), attribute("height"))
    return sql_let(sql_image_src(attribute), "s", f"CASE WHEN {valid} THEN {resolved} END")


def quick_images(url: Column, html: Column) -> Column:
    """First-article images of a page that has exactly one article element, read without a DOM."""
    tags = f"regexp_extract_all(f, r'{sql_tags('img')}', 0)"
    accepted = _sql_accepted("v.url", lambda name: sql_attribute_of("g", name))
    urls = f"transform(ts, t -> {sql_let(sql_attributes('t'), 'g', accepted)})"
    found = f"array_distinct(filter({urls}, u -> u IS NOT NULL))"
    # An image that is no complete tag leaves the page to the parser.
    whole = rf"CASE WHEN size(ts) = regexp_count(f, r'{_HAS_IMAGE}') THEN {found} END"
    first = sql_let(sql_article_fragment("h"), "f", sql_let(tags, "ts", whole))
    single = rf"CASE WHEN regexp_count(h, r'(?i)<article\b') = 1 THEN {first} END"
    return row_sql(sql_let(sql_drop_nontext("v.html"), "h", single), url=url, html=F.when(html.rlike(_HAS_IMAGE), html))


def needs_elements(html: Column, quick: Column) -> Column:
    """The page has images and the quick path did not settle the matter."""
    known = F.size(F.coalesce(quick, F.array()))
    return F.coalesce(html.rlike(_HAS_IMAGE) & (known < ENOUGH_IMAGES), F.lit(False))


def staged_images(url: Column, dom: Column) -> Column:
    """Three stages over the element table; a later stage runs only while fewer than 3 distinct images are known."""

    def inside(containers: str) -> str:
        hit = f"exists(cs, c -> c.start < i.start AND i.start < c.stop)"
        picked = f"transform(filter(imgs, i -> {hit}), i -> i.url)"
        return sql_let(containers, "cs", f"CASE WHEN size(cs) > 0 THEN {picked} ELSE array() END")

    def add(known: str, more: str) -> str:
        return sql_let(
            known, "k", f"CASE WHEN size(k) < {ENOUGH_IMAGES} THEN array_distinct(concat(k, {more})) ELSE k END"
        )

    article = inside("slice(filter(boxes, e -> e.tag = 'article'), 1, 1)")
    readable = inside("slice(filter(boxes, e -> e.tag = 'div' AND try_element_at(e.attrs, 'id') = 'readability-content'), 1, 1)")
    selected = f"flatten(transform({sql_rules(IMAGE_SELECTORS)}, r -> {inside('filter(boxes, e -> ' + sql_matches('e', 'r') + ')')}))"
    stages = add(add(f"array_distinct({article})", readable), selected)

    accepted = _sql_accepted("v.url", lambda name: f"try_element_at(e.attrs, '{name}')")
    images = f"transform(filter(v.elements, e -> e.tag = 'img'), e -> named_struct('start', e.start, 'url', {accepted}))"
    usable = f"filter({images}, i -> i.url IS NOT NULL)"
    return row_sql(
        sql_let(usable, "imgs", sql_let("filter(v.elements, e -> e.tag <> 'img')", "boxes", stages)),
        url=url,
        elements=dom["elements"],
    )


def collect_images(df, url: str, html: str, out: str = "images", limit: int = MAX_IMAGES):
    """Add up to limit distinct images per page. Pages the quick path settles reach the DOM helper as NULL."""
    step = with_computed(df, "_quick", quick_images(F.col(url), F.col(html)))
    needed = F.when(needs_elements(F.col(html), F.col("_quick")), F.col(html))
    step = step.withColumn("_dom", page_elements(needed))
    staged = F.when(F.col("_dom.elements").isNotNull(), staged_images(F.col(url), F.col("_dom")))
    images = F.coalesce(staged, F.col("_quick"), F.array().cast("array<string>"))
    return with_computed(step, out, F.slice(images, 1, limit)).drop("_quick", "_dom")
