"""Date text to ISO text and comparable instants, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslake.functions.binding import row_sql, sql_let

# Month abbreviations of the mail date format, in order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(:\d{2})?(?:[.,](\d{1,9}))?)?\s*(Z|z|[+-]\d{2}:?\d{2})?$"
_MAIL = (
    r"(?i)^(?:[a-z]{3,9},?\s+)?(\d{1,2})[\s-]+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s-]+(\d{4})"
    r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(gmt|utc|ut|z|[ecmp][sd]t|[+-]\d{2}:?\d{2})?$"
)
ISO_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}.*(?:Z|z|[+-]\d{2}:?\d{2})$"

# Zone names of the mail date format.
ZONE_OFFSETS = {
    "GMT": "+00:00", "UTC": "+00:00", "UT": "+00:00", "Z": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
_US_ZONE = r"(?i)[ecmp][sd]t$"

# Names of months and weekdays in free-form dates.
_MONTH = (
    "(?i:(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?))"
)
_WEEKDAY = r"(?i)\b(?:mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b[.,]?"

# Free-form text is first rewritten, in this order, so that a clock always reads h:mm or h:mm:ss.
_REWRITES = (
    (r"[\x00-\x1f]+", " "),
    (_WEEKDAY, " "),
    (r"(?i)(?<=\d)(?:st|nd|rd|th)\b", ""),
    (r"^(\d{8})(\d{2})(\d{2})(\d{2})$", "$1 $2:$3:$4"),
    (r"^(\d{8})(\d{2})(\d{2})$", "$1 $2:$3"),
    (r"(?<=\d{8}|-\d{2})[Tt ](\d{2})(\d{2})(\d{2})(?!\d)", " $1:$2:$3"),
    (r"(?<=\d{8}|-\d{2})[Tt ](\d{2})(\d{2})(?![\d:])", " $1:$2"),
    (r"(?<=-\d{2})[Tt](\d{2})(?![\d:])", " $1:00"),
    (r"(?<=\d)[Tt](?=\d)", " "),
    (r"(?i)(?<![\d:.])(\d{1,2})h\s?(\d{2})m\b", "$1:$2"),
    (r"(?i)(?<![\d:.])(\d{1,2})\s*([ap])\.?m\b\.?", "$1:00 $2m"),
    (r"(:\d{2})\s+(\d{4})\s+([+-]\d{4})$", "$1 $3 $2"),
    (r"\x27(?=\d{2}\b)", ""),
)
# Before the clock, hour, minute, second, fraction, a or p, name of the zone, gap, offset, after the zone.
_CLOCK = (
    r"^(.*?)(?<![\d:/.+-])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?![\d:])(?:\s*([AaPp])\.?[Mm]\b\.?)?"
    rf"\s*((?!{_MONTH}\b)(?:[A-Z]{{2,5}}|[Zz])(?![A-Za-z]))?(?:(\s*)([+-](?:(?:[01]\d|2[0-3]):?[0-5]\d|\d{{1,2}}))(?![\d:]))?"
    r"(?:\s*\([A-Z]{3,5}\))?(.*)$"
)
_CLOCK_FIELDS = "$1\x1f$2\x1f$3\x1f$4\x1f$5\x1f$6\x1f$7\x1f$9\x1f$10\x1f$11"
# What is left is a date in one of these forms: the pattern and where its year, month and day stand. 'any' is three
# numbers of which the first is a year if it is above 31, a day if it is above 12, and else a month.
_DATE_FORMS = (
    (r"^(\d{4})([-/. ])(\d{1,2})\2(\d{1,2})$", "$1,$3,$4"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1,$2,$3"),
    (rf"^{_MONTH}[-/. ]*(\d{{1,2}})[-/. ]+(\d{{4}}|\d{{2}})$", "$3,$1,$2"),
    (rf"^(\d{{1,2}})[-/. ]*{_MONTH}[-/. ]*(\d{{4}}|\d{{2}})$", "$3,$2,$1"),
    (rf"^(\d{{4}})[-/. ]*{_MONTH}[-/. ]*(\d{{1,2}})$", "$1,$2,$3"),
    (r"^(\d{1,2})([-/. ])(\d{1,2})\2(\d{4}|\d{2})$", "any,$1,$3,$4"),
    (r"^(\d{2})(\d{2})(\d{2})$", "any,$1,$2,$3"),
)


def _sql_offset(z: str) -> str:
    """'+hh:mm' of a zone text, '' for none."""
    names = ", ".join(f"'{name}', '{offset}'" for name, offset in ZONE_OFFSETS.items())
    numeric = f"left({z}, 3) || ':' || right({z}, 2)"
    return f"CASE WHEN {z} = '' THEN '' ELSE coalesce(try_element_at(map({names}), upper({z})), {numeric}) END"


def _sql_iso(t: str) -> str:
    """STRUCT<local TIMESTAMP_NTZ, offset> of text already known to be ISO."""
    zone = rf"regexp_extract({t}, r'(?:Z|z|[+-]\d{{2}}:?\d{{2}})$', 0)"
    local = f"try_cast(replace(rtrim(left({t}, length({t}) - length(z))), ',', '.') AS TIMESTAMP_NTZ)"
    return sql_let(zone, "z", f"named_struct('local', {local}, 'offset', {_sql_offset('z')})")


def _sql_mail(t: str) -> str:
    """The same for 'Tue, 14 Apr 2026 08:30:00 +0800' style text."""
    fields = rf"split(regexp_replace({t}, r'{_MAIL}', '$1,$2,$3,$4,$5,$6,$7'), ',', -1)"
    month = f"lpad((instr('{MONTHS}', lower(m[1])) + 2) div 3, 2, '0')"
    day = f"m[2] || '-' || {month} || '-' || lpad(m[0], 2, '0')"
    clock = "lpad(m[3], 2, '0') || ':' || m[4] || ':' || coalesce(nullif(m[5], ''), '00')"
    local = f"try_cast({day} || ' ' || {clock} AS TIMESTAMP_NTZ)"
    return sql_let(fields, "m", f"named_struct('local', {local}, 'offset', {_sql_offset('m[6]')})")


def _sql_parts(t: str) -> str:
    """STRUCT<local, offset>, NULL for text in neither format; local is NULL for impossible dates."""
    return f"CASE WHEN rlike({t}, r'{ISO}') THEN {_sql_iso(t)} WHEN rlike({t}, r'{_MAIL}') THEN {_sql_mail(t)} END"


def _sql_iso_text(ntz: str) -> str:
    text = f"replace(CAST({ntz} AS STRING), ' ', 'T')"
    return sql_let(text, "s", "CASE WHEN contains(s, '.') THEN rpad(s, 26, '0') ELSE s END")


def sql_iso_to_utc(t: str) -> str:
    """TIMESTAMP_NTZ in UTC of date text; text without a zone is taken as UTC."""
    sign = "CASE WHEN startswith(d.offset, '-') THEN -1 ELSE 1 END"
    hours, minutes = (f"{sign} * CAST(substring(d.offset, {at}, 2) AS INT)" for at in (2, 5))
    shifted = f"CASE WHEN d.offset = '' THEN d.local ELSE d.local - make_dt_interval(0, {hours}, {minutes}) END"
    return sql_let(_sql_parts(t), "d", shifted)


def _sql_replaced(t: str, rewrites) -> str:
    for pattern, by in rewrites:
        t = f"regexp_replace({t}, r'{pattern}', '{by}')"
    return t


def _sql_day(t: str) -> str:
    """'y-m-d' of date text without a clock, NULL if it leaves a part open."""
    forms = " ".join(f"WHEN rlike({t}, r'{p}') THEN split(regexp_replace({t}, r'{p}', '{order}'), ',')" for p, order in _DATE_FORMS)
    order = (
        "CASE WHEN f[0] <> 'any' THEN f WHEN CAST(f[1] AS INT) > 31 THEN array(f[1], f[2], f[3])"
        " WHEN CAST(f[1] AS INT) > 12 THEN array(f[3], f[2], f[1]) ELSE array(f[3], f[1], f[2]) END"
    )
    month = f"CASE WHEN rlike(d[1], '^[0-9]') THEN d[1] ELSE CAST((instr('{MONTHS}', lower(left(d[1], 3))) + 2) div 3 AS STRING) END"
    # Two digits are a year from 1969 to 2068, whatever the day on which they are read.
    year = "CASE WHEN length(d[0]) > 2 THEN d[0] WHEN CAST(d[0] AS INT) < 69 THEN '20' || lpad(d[0], 2, '0') ELSE '19' || d[0] END"
    day = f"{year} || '-' || lpad({month}, 2, '0') || '-' || lpad(d[2], 2, '0')"
    return sql_let(f"CASE {forms} END", "f", sql_let(order, "d", day))


def _sql_bare(t: str) -> str:
    """Date text without the words and signs that may stand around its numbers and month."""
    return _sql_replaced(t, ((r"(?i)\b(?:at|on|of|and)\b|[,;]", " "), (r"\s+", " "), ("^[- ]+|[- ]+$", "")))


def _sql_at(day: str, clock: str) -> str:
    """ISO text of date text and a clock; NULL if there is no such time."""
    local = f"try_cast({sql_let(day, 'b', _sql_day('b'))} || ' ' || {clock} AS TIMESTAMP_NTZ)"
    return sql_let(local, "l", _sql_iso_text("l"))


def _sql_free_form(t: str) -> str:
    """ISO text of a date in any of the known orders, with or without a clock; NULL for other text."""
    fields = rf"split(regexp_replace(r, r'{_CLOCK}', '{_CLOCK_FIELDS}'), r'\x1f', -1)"
    hour = (
        "CASE WHEN c[5] = '' THEN c[1] WHEN CAST(c[1] AS INT) > 12 THEN NULL"
        " ELSE CAST(CAST(c[1] AS INT) % 12 + IF(lower(c[5]) = 'p', 12, 0) AS STRING) END"
    )
    clock = f"lpad({hour}, 2, '0') || ':' || c[2] || ':' || coalesce(nullif(c[3], ''), '00') || IF(c[4] = '', '', '.' || left(c[4], 6))"
    # 'UTC+3' is the zone in which three hours are added to get UTC.
    sign = "IF(o = '0000' OR startswith(c[8], '+') <> (c[6] <> '' AND c[7] = ''), '+', '-')"
    digits = "rpad(if(length(c[8]) < 3, '0', '') || replace(substring(c[8], 2), ':', ''), 4, '0')"
    given = sql_let(digits, "o", f"{sign} || left(o, 2) || ':' || right(o, 2)")
    offset = f"CASE WHEN c[8] <> '' THEN {given} WHEN upper(c[6]) IN ('Z', 'UT', 'UTC', 'GMT') THEN '+00:00' ELSE '' END"
    day = _sql_bare("concat(c[0], ' ', c[9])")
    clocked = sql_let(fields, "c", f"{_sql_at(day, clock)} || {offset}")
    unclocked = _sql_at(_sql_bare("r"), "'00:00:00'")
    return sql_let(_sql_replaced(f"trim({t})", _REWRITES), "r", f"IF(rlike(r, r'{_CLOCK}'), {clocked}, {unclocked})")


def parse_timestamp(text: Column, free_form: bool = True) -> Column:
    """Date text to ISO 8601, keeping a given offset; NULL when it is no date or leaves a part of the date open.

    ISO and mail dates are read by their own patterns. With free_form, other text is read by a grammar: an optional
    clock (h:mm, am and pm, compact digits), an optional zone behind it, and a date in one of the orders of _DATE_FORMS.
    Zone names other than UTC's are dropped. Of 03/04/2021 the first number is the month. All of it is expressions.
    """
    # Zone names other than UTC are left to the free-form reader, which drops them.
    known = f"CASE WHEN NOT rlike(v.t, r'{_US_ZONE}') THEN {sql_let('trim(v.t)', 't', _sql_parts('t'))} END"
    native = sql_let(known, "d", f"{_sql_iso_text('d.local')} || d.offset")
    if not free_form:
        return row_sql(native, t=text)
    return row_sql(f"coalesce({native}, CASE WHEN rlike(v.t, '[0-9]') THEN {_sql_free_form('v.t')} END)", t=text)


def ntz_to_iso(ts: Column) -> Column:
    """ISO text of a zone-less timestamp."""
    return F.replace(ts.cast("string"), F.lit(" "), F.lit("T"))


def published_coalesce(*fields: Column) -> Column:
    """First field that is a date, as zone-less UTC ISO text cut to seconds."""
    names = {f"f{i}": field for i, field in enumerate(fields)}
    return row_sql(sql_published([f"v.{name}" for name in names]), **names)


def sql_published(fields: list[str]) -> str:
    dates = ", ".join(sql_let(f"trim({field})", "t", sql_iso_to_utc("t")) for field in fields)
    return f"left(replace(CAST(coalesce({dates}) AS STRING), ' ', 'T'), 19)"


def _newer(ts: Column, last: Column, undecided: Column) -> Column:
    both_iso = ts.rlike(ISO) & last.rlike(ISO)
    ts_zoned, last_zoned = ts.rlike(ISO_ZONED), last.rlike(ISO_ZONED)
    instant = ts.try_cast("timestamp") > last.try_cast("timestamp")
    local = ts.try_cast("timestamp_ntz") > last.try_cast("timestamp_ntz")
    later = F.when(both_iso & ts_zoned & last_zoned, instant).when(both_iso & ~ts_zoned & ~last_zoned, local)
    return F.when(last.isNull() | (last == ""), F.lit(True)).otherwise(F.coalesce(later, undecided))


def is_newer_than_last(ts: Column, last: Column) -> Column:
    """Strictly later than the feed's mark; unknown mark, unreadable text or mixed zones count as newer."""
    return _newer(ts, last, F.lit(True))


def is_newer_than_last_id(ts: Column, last: Column) -> Column:
    """The same, but what cannot be compared as time is newer when the texts differ."""
    return _newer(ts, last, ~ts.eqNullSafe(last))
