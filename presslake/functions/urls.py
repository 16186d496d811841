"""URL handling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslake.functions.binding import row_sql, sql_let
from presslake.functions.text import blank_to_null, html_unescape

# Query parameters that only track the visitor.
TRACKING_PARAMS = ["utm_[^=&]*", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid", "spm", "ref"]

# Aggregator link pattern -> pattern of the original article's link inside the entry.
AGGREGATOR_RULES = [("weixin.sogou.com", "mp.weixin.qq.com")]


# Optional scheme, '//', one optional 'www.', then a network location whose brackets match.
_NETLOC = (
    r"(?s)^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:www\.)?+"
    r"((?:[^/?#\[\]]++|\[[^/?#\[\]]*\])++)(?:[/?#].*)?$"
)


def domain_of_url(url: Column) -> Column:
    """Network location (port, user and case kept) without one leading 'www.'; NULL when there is none."""
    text = F.translate(url, "\t\r\n", "")
    return F.try_element_at(F.regexp_extract_all(text, F.lit(_NETLOC), F.lit(1)), F.lit(1))


def blacklist_key(url_or_domain: Column) -> Column:
    """Domain under which a failure is filed: text starting with 'http' is a URL, other text is kept."""
    return F.when(url_or_domain.startswith("http"), domain_of_url(url_or_domain)).otherwise(
        blank_to_null(url_or_domain)
    )


def normalize_url(url: Column) -> Column:
    """Drop the fragment and tracking parameters."""
    bare = F.regexp_replace(url, "#.*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    wrapped = F.concat(F.lit("&"), F.replace(query, F.lit("&"), F.lit("&&")), F.lit("&"))
    kept = F.regexp_replace(wrapped, rf"(?i)&(?:{'|'.join(TRACKING_PARAMS)})(?:=[^&]*)?&", "")
    kept = F.regexp_replace(F.regexp_replace(kept, "&+", "&"), "^&|&$", "")
    path = F.regexp_replace(bare, r"\?.*$", "")
    return F.when(kept == "", path).otherwise(F.concat(path, F.lit("?"), kept))


def _sql_remove_dots(path: str) -> str:
    """Resolve '.' and '..' segments of an absolute path."""
    step = (
        "(acc, seg) -> CASE WHEN seg = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 1)) "
        "WHEN seg = '.' THEN acc ELSE concat(acc, array(seg)) END"
    )
    body = f"aggregate(slice(split({path}, '/', -1), 2, length({path})), array(''), {step})"
    tail = rf"CASE WHEN rlike({path}, r'/\.\.?$') THEN '/' ELSE '' END"
    return f"coalesce(nullif(concat(array_join({body}, '/'), {tail}), ''), '/')"


def sql_absolute_url(base: str, ref: str) -> str:
    """Resolve a reference against the URL of its page."""
    scheme = f"regexp_extract({base}, r'^([A-Za-z][A-Za-z0-9+.-]*:)', 1)"
    origin = f"regexp_extract({base}, r'^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
    folder = f"regexp_extract({base}, r'^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/(?:[^/?#]*/)*)', 1)"
    ref_path = f"regexp_extract({ref}, '^([^?#]*)', 1)"
    ref_tail = f"regexp_extract({ref}, '^[^?#]*(.*)$', 1)"
    rooted = (
        f"CASE WHEN startswith({ref}, '/') THEN {ref_path} ELSE coalesce(nullif({folder}, ''), '/') || {ref_path} END"
    )
    resolved = sql_let(rooted, "rp", rf"CASE WHEN rlike(rp, r'/\.\.?(/|$)') THEN {_sql_remove_dots('rp')} ELSE rp END")
    return (
        f"CASE WHEN {ref} = '' THEN {base} WHEN rlike({ref}, r'^[A-Za-z][A-Za-z0-9+.-]*:') THEN {ref} "
        f"WHEN startswith({ref}, '//') THEN {scheme} || {ref} "
        f"WHEN startswith({ref}, '?') THEN regexp_replace({base}, '[?#].*$', '') || {ref} "
        f"WHEN startswith({ref}, '#') THEN regexp_replace({base}, '#.*$', '') || {ref} "
        f"ELSE {origin} || {resolved} || {ref_tail} END"
    )


def absolute_url(base: Column, ref: Column) -> Column:
    return row_sql(sql_absolute_url("v.base", "v.ref"), base=base, ref=ref)


def _first_containing(values: Column, part: str) -> Column:
    return F.try_element_at(F.filter(values, lambda v: v.contains(part)), F.lit(1))


def rewrite_aggregator_url(
    link: Column, summary: Column, content: Column, rules: list[tuple[str, str]] | None = None
) -> Column:
    """Replace a search-page link by the first original-article link found in the entry's own HTML.

    Both unescape helpers see NULL unless the link belongs to an aggregator, so ordinary rows cost nothing there.
    """
    rules = AGGREGATOR_RULES if rules is None else rules
    body = F.coalesce(blank_to_null(summary), blank_to_null(content))
    applies = F.lit(False)
    for source, _ in rules:
        applies = applies | link.contains(source)
    hrefs = F.regexp_extract_all(
        html_unescape(F.when(applies, body)),
        F.lit(r"""(?is)<a\s(?:[^>]*?[\s"'])?href\s*=\s*["']?([^"'\s>]+)"""),
        F.lit(1),
    )
    found = F.lit(None).cast("string")
    for source, target in reversed(rules):
        found = F.when(link.contains(source), _first_containing(hrefs, target)).otherwise(found)
    return F.coalesce(html_unescape(found), link)
