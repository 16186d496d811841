"""SQL pieces the stated results are made of (DuckDB dialect)."""

from __future__ import annotations

from presslake.functions.html import BLOCK_TAGS
from presslake.functions.text import STRIP_ENTITIES

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Entities found in the given pages, '&amp;' last so that one pass is enough.
PAGE_ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = f"replace({x}, {quote(old)}, {quote(new)})"
    return x


def decoded(x: str) -> str:
    """Page entities with or without ';', '&amp' last."""
    for entity, char in PAGE_ENTITIES:
        x = f"regexp_replace({x}, '{entity}?', {quote(char)}, 'g')"
    return x


def clean(x: str) -> str:
    strip = f"lambda s: regexp_replace(s, '^{SPACE}+|{SPACE}+$', '', 'g')"
    return (
        f"array_to_string(list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), {strip}), "
        "lambda s: s <> ''), chr(10))"
    )


def strip_tags(x: str) -> str:
    return clean(replaced(f"regexp_replace(coalesce({x}, ''), '<[^>]+>', '', 'g')", STRIP_ENTITIES))


def drop_nontext(x: str) -> str:
    x = rf"regexp_replace({x}, '(?s)<!--.*?(?:-->|\z)', chr(10), 'g')"
    x = rf"regexp_replace({x}, '(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)', chr(10), 'g')"
    return rf"regexp_replace({x}, '(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)', chr(10), 'g')"


def visible(x: str) -> str:
    return clean(decoded(f"regexp_replace({x}, '<[^>]+>', chr(10), 'g')"))


def body(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?is)\A.*?<body\b[^>]*>', ''), '(?is)</body\s*>.*\z', '')"


def between(x: str, opening: str, closing: str) -> str:
    return rf"nullif(regexp_extract({x}, '(?is){opening}(.*?)(?:{closing}|\z)', 1), '')"


def article(x: str) -> str:
    return between(x, r"<article\b[^>]*>", r"</article\s*>")


def pieces(x: str) -> str:
    lines = rf"regexp_replace({x}, '(?i)<br\b[^>]*>', chr(10), 'g')"
    tags = "|".join(BLOCK_TAGS)
    marked = rf"regexp_replace({lines}, '(?i)<(/?(?:{tags}))\b[^>]*>', chr(1) || '\1' || chr(2), 'g')"
    return f"string_split({marked}, chr(1))"


def piece_tag(p: str) -> str:
    return f"CASE WHEN contains({p}, chr(2)) THEN lower(split_part({p}, chr(2), 1)) ELSE '' END"


def piece_html(p: str) -> str:
    return f"CASE WHEN contains({p}, chr(2)) THEN split_part({p}, chr(2), 2) ELSE {p} END"


def words(x: str) -> str:
    ideographs = rf"length({x}) - length(regexp_replace({x}, '[\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}]', '', 'g'))"
    return (
        f"CAST(CASE WHEN {x} = '' THEN 0 ELSE len(string_split_regex({x}, '[ \\n]+')) END + ({ideographs}) // 2 AS INTEGER)"
    )


def blocks(pages: str) -> str:
    """CTEs ending in sql_blocks(page_id, url, i, tag, text, words, link_words) of pages(page_id, url, html)."""
    links = r"array_to_string(regexp_extract_all(body, '(?is)<a\b[^>]*>(.*?)(?:</a\s*>|\z)', 1), ' ')"
    return f"""
  cut AS (SELECT page_id, {pieces(drop_nontext("html"))} AS parts FROM {pages} WHERE html IS NOT NULL),
  piece AS (SELECT page_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM cut),
  named AS (SELECT page_id, i, {piece_tag("p")} AS tag, {piece_html("p")} AS body FROM piece),
  texts AS (SELECT page_id, i, tag, {visible("body")} AS text, {visible(links)} AS link_text FROM named),
  sql_blocks AS (SELECT page_id, i, tag, text, {words("text")} AS words, {words("link_text")} AS link_words
                 FROM texts WHERE text <> '')"""


def density(pages: str) -> str:
    """CTEs ending in sql_density(page_id, text): pages without a row have no main text."""
    return (
        blocks(pages)
        + """,
  around AS (
    SELECT page_id, i, text, words, link_words / words AS ld,
           coalesce(lag(words) OVER w, 0) AS prev_words, coalesce(lag(link_words / words) OVER w, 0) AS prev_ld,
           coalesce(lead(words) OVER w, 0) AS next_words
    FROM sql_blocks WINDOW w AS (PARTITION BY page_id ORDER BY i)),
  good AS (
    SELECT page_id, i, text FROM around
    WHERE ld <= 0.333333 AND CASE WHEN prev_ld <= 0.555556 THEN words > 16 OR next_words > 15 OR prev_words > 4
                                  ELSE words > 40 OR next_words > 17 END),
  sql_density AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS text FROM good GROUP BY page_id
                  HAVING length(string_agg(text, chr(10) ORDER BY i)) >= 100)"""
    )


def paragraphs(x: str) -> str:
    """Paragraph text of an html value; NULL under 100 characters is left to the caller."""
    fragment = f"coalesce({article(drop_nontext(x))}, {body(drop_nontext(x))})"
    inline = clean(decoded(f"regexp_replace({piece_html('p')}, '<[^>]+>', '', 'g')"))
    chosen = f"list_filter({pieces(fragment)}, lambda p: {piece_tag('p')} = 'p')"
    return f"array_to_string(list_filter(list_transform({chosen}, lambda p: {inline}), lambda t: t <> ''), chr(10))"


def control_chars(x: str) -> str:
    return rf"length({x}) - length(regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))"


def valid(x: str) -> str:
    return f"coalesce(length({x}) >= 50 AND {control_chars(x)} <= 0.1 * length({x}) AND NOT contains({x}, chr(0)), false)"


def domain(x: str) -> str:
    netloc = rf"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
    return rf"nullif(regexp_replace({netloc}, '^www\.', ''), '')"


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"


def stamp(n: str) -> str:
    return (
        f"(TIMESTAMP '2026-04-14 00:00:00' - to_seconds({n}) + CASE WHEN {n} % 13 = 1 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END)"
    )


ENTRIES = f"""
  v_entries AS (
    SELECT 'https://' || source || '.example.com/' || (doc_id // 400) || '/feed.xml' AS feed_url, doc_id AS pos,
           CASE WHEN doc_id % 11 = 7 THEN NULL WHEN doc_id % 11 = 8 THEN '' ELSE 'Doc ' || doc_id END AS title,
           CASE WHEN doc_id % 17 = 3 THEN NULL WHEN doc_id % 34 = 5 THEN ''
                ELSE 'https://www.' || source || '.example.com/a/' || doc_id END AS link,
           CASE WHEN doc_id % 23 <> 5 THEN {iso(stamp("doc_id"))} END AS published,
           CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE 'Author ' || (doc_id % 7) END AS author,
           CASE WHEN doc_id % 3 <> 0 THEN 'Name ' || (doc_id % 4) END AS author_name,
           CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN '' ELSE text END AS description,
           CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '' ELSE '<p>' || text || '</p>' END AS summary,
           text AS content
    FROM documents)"""

HISTORY = (
    ENTRIES
    + """,
  v_history AS (
    SELECT feed_url, max(published) AS last_id FROM v_entries
    WHERE pos % 29 = 0 AND pos % 13 <> 1 AND length(feed_url) % 2 = 1 GROUP BY feed_url)"""
)

# Running maximum of the stale flag: the other way to say 'before the first stale entry'.
STALE = (
    HISTORY
    + """,
  dated AS (SELECT e.*, h.last_id IS NOT NULL AND e.published <= h.last_id AS stale
            FROM v_entries e LEFT JOIN v_history h USING (feed_url) WHERE link <> '' AND published IS NOT NULL),
  stopped AS (SELECT *, max(CAST(stale AS INT)) OVER (PARTITION BY feed_url ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM dated),
  alive AS (SELECT * EXCLUDE (stale, stop) FROM stopped WHERE stop = 0)"""
)

SETTLED = (
    HISTORY
    + """,
  v_settled AS (SELECT feed_url, pos, title, link, published, pos % 10 <> 0 AS success,
                       CASE WHEN pos % 11 = 0 THEN '' ELSE content END AS content FROM v_entries)"""
)

LIMITED = (
    STALE
    + """,
  v_settled AS (SELECT feed_url, pos, title, link, published, pos % 10 <> 0 AS success,
                       CASE WHEN pos % 11 = 0 THEN '' ELSE content END AS content FROM alive),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY feed_url ORDER BY pos) AS rn FROM v_settled
             WHERE success AND content <> ''),
  limited AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn <= 5)"""
)

RESULTS = f"""
  v_results AS (
    SELECT min(doc_id) AS feed_ord, 'https://' || source || '.example.com/' || (doc_id // 60) || '.xml' AS feed_url,
           'Feed ' || min(doc_id) AS feed_title, CASE WHEN min(doc_id) % 2 = 0 THEN 'RSS' ELSE 'ATOM' END AS feed_type,
           min(doc_id) % 7 <> 3 AS success, CASE WHEN min(doc_id) % 7 = 3 THEN 'Error ' || min(doc_id) END AS error
    FROM documents GROUP BY source, doc_id // 60),
  v_articles AS (
    SELECT 'https://' || source || '.example.com/' || (doc_id // 60) || '.xml' AS feed_url, doc_id AS pos,
           'Doc ' || doc_id AS title, 'https://www.' || source || '.example.com/a/' || doc_id AS url,
           CASE WHEN doc_id % 23 <> 5 THEN {iso(stamp("doc_id"))} END AS published, 'Author ' || (doc_id % 7) AS author,
           text AS content, doc_id % 2 = 0 AS has_image
    FROM documents)"""

_PROBE = """CASE user_id % 4 WHEN 0 THEN 'https://www.h' || user_id || '.example.com/p/' || event_id
                WHEN 1 THEN 'http://u@h' || user_id || '.example.com:8080?x=' || event_id
                WHEN 2 THEN 'h' || user_id || '.example.com' ELSE 'httpbin' || user_id END"""

FAILURES = f"""
  v_failures AS (
    SELECT {_PROBE} AS url_or_domain,
           CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 7 = 0 THEN '' ELSE props END AS reason, ts, event_id AS pos
    FROM events WHERE event_type = 'error'),
  v_seeds AS (SELECT DISTINCT 'h' || user_id || '.example.com' AS domain FROM events WHERE user_id % 24 = 0),
  filed AS (SELECT *, CASE WHEN starts_with(url_or_domain, 'http') THEN {domain("url_or_domain")} ELSE url_or_domain END AS domain
            FROM v_failures),
  v_listed AS (
    SELECT domain, min(ts) AS added_at, max(ts) AS last_failed, count(*) AS fail_count,
           coalesce(arg_max(nullif(reason, ''), pos) FILTER (WHERE reason <> ''), 'Unknown') AS reason
    FROM filed WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM v_seeds) GROUP BY domain
    UNION ALL SELECT domain, NULL, NULL, NULL, NULL FROM v_seeds)"""

PROBES = f"""
  v_probes AS (SELECT event_id, {_PROBE} AS link FROM events),
  v_blacklist AS (
    SELECT DISTINCT CASE user_id % 4 WHEN 1 THEN 'u@h' || user_id || '.example.com:8080' WHEN 3 THEN 'httpbin' || user_id
                    ELSE 'h' || user_id || '.example.com' END AS domain FROM events WHERE user_id % 3 = 0)"""



def page_images(p: str) -> str:
    """Images of the page with id p as fixtures.pages_with_images writes them: the article's, then other containers'."""

    def run(label: str, n: str) -> str:
        return f"list_transform(range({n}), lambda k: 'https://i.example.com/{label}' || k || '-' || {p} || '.png')"

    a, r = run("a", f"({p} % 8 + 1) // 2"), run("r", f"({p} % 3 + 1) // 2")
    c, f = run("c", f"15 * ({p} % 2)"), run("f", f"({p} % 5 + 1) // 2")
    return f"list_slice(CASE WHEN len({a}) >= 3 THEN {a} WHEN len({a}) + len({r}) >= 3 THEN {a} || {r} ELSE {a} || {r} || {c} || {f} END, 1, 10)"


CRAWL = """
  v_crawl AS (
    SELECT page_id, url, CASE WHEN page_id % 19 = 4 THEN 'network' WHEN page_id % 19 = 9 THEN 'http' END AS error_kind,
           CASE WHEN page_id % 19 NOT IN (4, 9) THEN html END AS html FROM pages)"""

PAGE_ENTRIES = (
    CRAWL
    + f""",
  v_page_entries AS (
    SELECT 'https://' || {domain("url")} || '/' || (doc_id // 40) || '.xml' AS feed_url, doc_id AS pos,
           'Page ' || doc_id AS title, url AS link, {iso(stamp("doc_id"))} AS published,
           CASE WHEN doc_id % 3 <> 0 THEN 'Author ' || (doc_id % 7) END AS author,
           CASE WHEN doc_id % 2 = 0 THEN '<p>' || text || '</p>' ELSE text END AS description
    FROM documents JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)),
  v_page_feeds AS (SELECT feed_url, min(pos) AS feed_ord FROM v_page_entries GROUP BY feed_url),
  v_page_history AS (
    SELECT feed_url, arg_max(published, pos) AS last_id FROM v_page_entries
    WHERE pos % 5 = 0 AND pos % 13 <> 1 AND length(feed_url) % 2 = 0 GROUP BY feed_url)"""
)

# One settled row per page entry: density text, else paragraphs, else body, else description.
EXTRACTED = (
    PAGE_ENTRIES
    + ","
    + density("v_crawl")
    + f""",
  tried AS (
    SELECT c.page_id, c.url, c.error_kind, d.text AS t1, {paragraphs("c.html")} AS t2,
           {visible(body(drop_nontext("c.html")))} AS t4,
           {visible(f"coalesce({article(drop_nontext('c.html'))}, '')")} AS t3
    FROM v_crawl c LEFT JOIN sql_density d ON c.page_id = d.page_id),
  picked AS (
    SELECT page_id, url, error_kind,
           CASE WHEN error_kind IS NOT NULL THEN NULL WHEN {valid("t1")} THEN 'readability'
                WHEN length(t2) >= 100 AND {valid("t2")} THEN 'newspaper3k'
                WHEN length(CASE WHEN length(t3) >= 100 THEN t3 ELSE t4 END) >= 100 THEN 'css-selectors' END AS method,
           t1, t2, CASE WHEN length(t3) >= 100 THEN t3 ELSE t4 END AS t34 FROM tried),
  settled AS (
    SELECT e.*, p.page_id, p.error_kind, p.method IS NOT NULL AS took,
           array_to_string(CASE WHEN p.method IS NOT NULL THEN {page_images("p.page_id")} ELSE [] END, ' ') AS images,
           coalesce(p.method, CASE WHEN {valid("e.description")} THEN 'description-fallback' ELSE 'failed' END) AS method,
           CASE p.method WHEN 'readability' THEN t1 WHEN 'newspaper3k' THEN t2 WHEN 'css-selectors' THEN t34
                ELSE CASE WHEN {valid("e.description")} THEN {strip_tags("e.description")} ELSE '' END END AS content
    FROM v_page_entries e JOIN picked p ON e.link = p.url)"""
)


# The output lines: one JSON document for each successful feed with articles.
RESULT_LINES = """
  v_lines AS (
    SELECT feed_ord, json_object('feed_url', feed_url, 'feed_title', r.feed_title, 'feed_type', r.feed_type, 'articles',
             list(struct_pack(title := title, url := url, published := published, author := author, content := content,
                  images := CASE WHEN has_image THEN ['https://i.example.com/' || pos || '.png'] ELSE [] END)
                  ORDER BY coalesce(published, '') DESC, pos))::VARCHAR AS json
    FROM v_results r JOIN v_articles a USING (feed_url) WHERE r.success GROUP BY feed_ord, feed_url, r.feed_title, r.feed_type)"""
