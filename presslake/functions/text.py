"""Text cleaning, validity and decoding as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5, name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from presslake.functions.binding import row_sql, sql_let
from presslake.functions.charsets import CharsetModel, default_model

# The characters str.strip() removes.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Entities decoded after tag removal, one pass each, in this order.
STRIP_ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "…"),
    ("&copy;", "©"),
    ("&reg;", "®"),
    ("&trade;", "™"),
]

# Content thresholds.
MIN_VALID_CHARS = 50
MAX_CONTROL_RATIO = 0.1


def blank_to_null(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(text != "", text)


def sql_trim_space(x: str) -> str:
    """Strip Unicode whitespace from both ends. Works inward from the ends, so long inner runs cost nothing."""
    spelled = "".join(f"\\u{ord(c):04x}" for c in SPACE_CHARS)
    return f"btrim({x}, '{spelled}')"


def sql_clean_text(x: str) -> str:
    lines = f"filter(transform(split({x}, '\\n', -1), s -> {sql_trim_space('s')}), s -> s <> '')"
    return f"coalesce(array_join({lines}, '\\n'), '')"


def clean_text(text: Column) -> Column:
    """Strip every line and drop the blank ones; NULL gives ''."""
    return row_sql(sql_clean_text("v.t"), t=text)


def strip_html_tags(text: Column) -> Column:
    """Drop tags, then decode the fixed entity list in order, then clean."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for entity, char in STRIP_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return clean_text(out)


def content_valid(text: Column) -> Column:
    """At least 50 characters, at most 10 % control characters, no NUL, valid UTF-8."""
    controls = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return F.coalesce(
        (F.length(text) >= MIN_VALID_CHARS)
        & (controls <= F.length(text) * MAX_CONTROL_RATIO)
        & ~text.contains("\x00")
        & F.is_valid_utf8(text),
        F.lit(False),
    )


# What numbers 128 to 159 mean in HTML: the characters that Windows-1252 has there, if it has one.
_WINDOWS_1252 = [ord(bytes([n]).decode("cp1252", "ignore") or chr(n)) for n in range(128, 160)]


def _sql_code_point(n: str, loose: bool) -> str:
    """Character of a Unicode code point, NULL outside the valid range; loose reads 128 to 159 as HTML does."""
    plain = (
        f"CASE WHEN {n} = 65279 THEN '\\uFEFF' "  # decoding takes it for a byte order mark
        f"WHEN {n} BETWEEN 1 AND 55295 OR {n} BETWEEN 57344 AND 1114111 "
        f"THEN decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32') END"
    )
    if not loose:
        return plain
    listed = ", ".join(map(str, _WINDOWS_1252))
    return (
        f"CASE WHEN {n} BETWEEN 128 AND 159 "
        f"THEN decode(unhex(lpad(hex(element_at(array({listed}), CAST({n} - 127 AS INT))), 8, '0')), 'UTF-32') ELSE {plain} END"
    )


def sql_text_map(pairs: dict[str, str]) -> str:
    """A map literal of short texts, written with escapes only."""

    def spell(text: str) -> str:
        return "".join(f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}" for c in text)

    listing = "\\u0002".join(f"{spell(k)}\\u0001{spell(v)}" for k, v in pairs.items())
    return f"str_to_map('{listing}', '\\u0002', '\\u0001')"


def _sql_decode(x: str, loose: bool) -> str:
    """Decode references in one pass over the pieces between '&' signs.

    loose also takes what HTML text allows without ';': numbers, and the names the HTML standard lists so.
    """
    bare = {name: char for name, char in html5.items() if not name.endswith(";")}
    table = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"} | bare
    char = f"""CASE WHEN startswith(n, '#x') OR startswith(n, '#X')
          THEN {sql_let("try_cast(conv(substring(n, 3), 16, 10) AS BIGINT)", "c", _sql_code_point("c", loose))}
        WHEN startswith(n, '#') THEN {sql_let("try_cast(substring(n, 2) AS BIGINT)", "c", _sql_code_point("c", loose))}
        WHEN n <> '' THEN try_element_at(w.names, n) END"""

    def attempt(pattern: str, skip: str) -> str:
        return sql_let(f"regexp_extract(p, r'{pattern}', 1)", "n", f"{char} || regexp_replace(substring(p, length(n) + 1), '^{skip}', '')")

    attempts = [attempt(r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][0-9A-Za-z]*);", ";")]
    if loose:
        longest_first = "|".join(sorted(bare, key=len, reverse=True))
        attempts.append(attempt(rf"^(#[0-9]+|#[xX][0-9a-fA-F]+|{longest_first})", ""))
    spelled = f"coalesce({', '.join(attempts)}, '&' || p)"
    pieces = f"transform(split(w.t, '&', -1), (p, i) -> CASE WHEN i = 0 THEN p ELSE {spelled} END)"
    bound = f"named_struct('t', {x}, 'names', {sql_text_map(table)})"
    return sql_let(bound, "w", f"CASE WHEN contains(w.t, '&') THEN array_join({pieces}, '') ELSE w.t END")


_DECODE = {loose: _sql_decode("@text@", loose) for loose in (False, True)}


def sql_decode_entities(x: str, loose: bool = False) -> str:
    return _DECODE[loose].replace("@text@", x)


def decode_entities(text: Column, loose: bool = False) -> Column:
    """One pass over named (HTML 4) and numeric references; unknown ones stay as they are.

    They end in ';'. loose, meant for page text, also reads those that may do without it.
    """
    return row_sql(sql_decode_entities("v.t", loose), t=text)


def _names_by_letter() -> Column:
    """HTML5 names that end in ';': for each first letter a text of name and character pairs, in which a name is searched."""
    letters: dict[str, str] = {}
    for name, char in html5.items():
        if name.endswith(";"):
            letters[name[0]] = letters.get(name[0], "\x02") + f"{name[:-1]}\x01{char}\x02"
    return F.str_to_map(F.lit("\x04".join(f"{k}\x03{v}" for k, v in letters.items())), F.lit("\x04"), F.lit("\x03"))


def _sql_numbered(n: str) -> str:
    """The character that HTML text means by a number (a BIGINT, NULL if too large)."""
    gone = f"{n} BETWEEN 1 AND 8 OR {n} = 11 OR {n} BETWEEN 14 AND 31 OR {n} = 127 OR {n} BETWEEN 64976 AND 65007 OR {n} % 65536 >= 65534"
    none = f"{n} IS NULL OR {n} = 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343"
    return f"CASE WHEN {none} THEN '\\uFFFD' WHEN {gone} THEN '' ELSE {_sql_code_point(n, loose=True)} END"


def _sql_unescape() -> str:
    """Every reference of HTML5, decoded in one pass over the pieces between '&' signs.

    Numbers may lack their ';'. A name is looked up with its ';', else the longest name that may lack it is taken from
    its front.
    """
    longest_first = "|".join(sorted(_BARE, key=len, reverse=True))
    rest = "substring(p, length(n) + 1)"
    # Beyond seven digits there is no character.
    hexadecimal = sql_let("regexp_replace(substring(n, 3), '^0+', '')", "h", "CASE WHEN h = '' THEN 0L WHEN length(h) <= 7 THEN CAST(conv(h, 16, 10) AS BIGINT) END")
    value = f"CASE WHEN startswith(lower(n), '#x') THEN {hexadecimal} ELSE try_cast(substring(n, 2) AS BIGINT) END"
    number = f"{sql_let(value, 'c', _sql_numbered('c'))} || regexp_replace({rest}, '^;', '')"
    known = "substring_index(substring_index(names, concat('\\u0002', n, '\\u0001'), -1), '\\u0002', 1)"
    found = f"CASE WHEN contains(names, concat('\\u0002', n, '\\u0001')) THEN {known} || substring({rest}, 2) END"
    named = sql_let("try_element_at(v.names, substring(n, 1, 1))", "names", found)
    short = f"try_element_at(v.bare, n) || {rest}"
    tries = [
        sql_let("regexp_extract(p, '^(#[0-9]+|#[xX][0-9a-fA-F]+)', 1)", "n", f"CASE WHEN n <> '' THEN {number} END"),
        sql_let("regexp_extract(p, '^([A-Za-z][0-9A-Za-z]*);', 1)", "n", f"CASE WHEN n <> '' THEN {named} END"),
        sql_let(f"regexp_extract(p, '^({longest_first})', 1)", "n", f"CASE WHEN n <> '' THEN {short} END"),
    ]
    pieces = f"transform(split(v.t, '&', -1), (p, i) -> CASE WHEN i = 0 THEN p ELSE coalesce({', '.join(tries)}, '&' || p) END)"
    return f"CASE WHEN contains(v.t, '&') THEN array_join({pieces}, '') ELSE v.t END"


# Names that may lack their ';'.
_BARE = {name: char for name, char in html5.items() if not name.endswith(";")}
_UNESCAPE = _sql_unescape()


def html_unescape(text: Column) -> Column:
    """Every named and numeric reference of HTML5, with and without ';'; unknown ones stay as they are."""
    bare = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in _BARE.items())), F.lit("\x02"), F.lit("\x01"))
    return row_sql(_UNESCAPE, t=text, names=_names_by_letter(), bare=bare)


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 bytes read as ISO-8859-1; text that is not such a mix-up is returned unchanged."""
    latin = F.when(~text.rlike(r"[^\x00-\xFF]"), text)
    return F.coalesce(F.try_validate_utf8(F.encode(latin, "ISO-8859-1").cast("string")), text)


def _decoder(model: CharsetModel) -> Callable:
    """Bytes to text by a charset's name; a NULL name is guessed from the bytes."""

    def decode(body, charset):
        if body is None:
            return None
        body = bytes(body)
        try:
            return body.decode(charset or model.guess(body) or "utf-8", errors="replace")
        except LookupError:
            return body.decode("utf-8", errors="replace")

    @F.pandas_udf(StringType())
    def decode_batch(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
        return pd.Series([decode(b, c) for b, c in zip(bodies, charsets)], dtype=object)

    return decode_batch


def decode_body(body: Column, charset: Column, model: CharsetModel | None = None) -> Column:
    """Bytes to text. An absent or ISO-8859-1 declaration is not trusted: valid UTF-8 wins, then what the bytes
    themselves say (a byte order mark, or a charset in a meta tag), then the charset whose byte pairs they resemble.

    Other charsets than UTF-8 and ISO-8859-1, and bytes to be guessed, go through an Arrow helper, other rows as NULL.
    """
    declared = F.lower(F.coalesce(charset, F.lit("iso-8859-1")))
    trusted = F.when(declared != "iso-8859-1", declared)
    utf8 = F.try_validate_utf8(body.cast("string"))
    mark = F.hex(F.substring(body, 1, 2))
    bytes_as_text = F.decode(F.when(trusted.isNull() & utf8.isNull(), body), "ISO-8859-1")
    meta = F.regexp_extract(bytes_as_text, r"(?is)<meta\b[^>]*?charset\s*=\s*[\x22\x27]?\s*([\w.:-]+)", 1)
    own = F.when(mark.isin("FEFF", "FFFE"), F.lit("utf-16")).otherwise(blank_to_null(F.lower(meta)))
    name = F.coalesce(trusted, own)
    unicode = F.coalesce(name.isin("utf-8", "utf8"), F.lit(False))
    plain = name.isNull() & utf8.isNotNull()
    foreign = F.when(~unicode & ~plain & ~F.coalesce(name == "iso-8859-1", F.lit(False)), body)
    return F.coalesce(
        F.when(plain | unicode, utf8),
        F.when(name == "iso-8859-1", F.decode(body, "ISO-8859-1")),
        F.when(unicode, F.make_valid_utf8(body.cast("string"))),
        _decoder(model or default_model())(foreign, name),
    )


def xml_encoding(body: Column) -> Column:
    """The encoding an XML document's bytes declare: by a byte order mark, else by the declaration, else NULL."""
    mark = F.hex(F.substring(body, 1, 3))
    head = F.decode(F.substring(body, 1, 200), "ISO-8859-1")
    declared = F.lower(F.regexp_extract(head, r"^\s*<\?xml\b[^>]*?\bencoding\s*=\s*[\x22\x27]([\w.:-]+)", 1))
    return (
        F.when(mark == "EFBBBF", F.lit("utf-8"))
        .when(mark.startswith("FEFF") | mark.startswith("FFFE"), F.lit("utf-16"))
        .otherwise(blank_to_null(declared))
    )


def decode_xml(body: Column) -> Column:
    """Bytes of an XML document to text, without its byte order mark; UTF-8 where nothing is declared."""
    text = decode_body(body, F.coalesce(xml_encoding(body), F.lit("utf-8")))
    return F.regexp_replace(text, "^\\x{FEFF}", "")
