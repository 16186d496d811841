"""Table contracts. Schemas are fixed; nothing is inferred from data."""

FEEDS = "feed_ord BIGINT, feed_url STRING, feed_title STRING, feed_type STRING"

ENTRIES = (
    "feed_url STRING, pos BIGINT, title STRING, link STRING, published STRING, author STRING, "
    "description STRING, summary STRING, content STRING"
)

HISTORY = "feed_url STRING, last_id STRING"

BLACKLIST = "domain STRING, added_at TIMESTAMP_NTZ, last_failed TIMESTAMP_NTZ, fail_count BIGINT, reason STRING"

FAILURES = "url_or_domain STRING, reason STRING, ts TIMESTAMP_NTZ, pos BIGINT"

# One row per fetched URL. error_kind: NULL = fetched, 'http' = error status, 'network' = timeout or no connection.
PAGES = "url STRING, html STRING, error_kind STRING"

# Fixed value: the error of a feed that could not be fetched.
FEED_NOT_FETCHED = "无法获取 feed 数据"

RESULTS = "feed_ord BIGINT, feed_url STRING, feed_title STRING, feed_type STRING, success BOOLEAN, error STRING"

ARTICLE = (
    "STRUCT<title: STRING, url: STRING, published: STRING, author: STRING, content: STRING, images: ARRAY<STRING>>"
)

CONFIG = (
    "url STRING, threads STRING, log_days INT, log_dir STRING, result_file STRING, "
    "his MAP<STRING, STRING>, _corrupt_record STRING"
)

# One schema covers RSS 0.9x/2.0 (channel.item), RSS 1.0 (item beside channel) and Atom (entry).
_ENTRY = """ARRAY<STRUCT<
  title: STRING, link: ARRAY<STRUCT<_VALUE: STRING, _href: STRING, _rel: STRING>>,
  pubDate: STRING, published: STRING, issued: STRING, date: STRING, updated: STRING, modified: STRING, created: STRING,
  description: STRING, summary: STRING, encoded: ARRAY<STRING>, content: ARRAY<STRING>,
  creator: STRING, author: STRUCT<_VALUE: STRING, name: STRING>,
  guid: STRUCT<_VALUE: STRING, _isPermaLink: STRING>>>"""

FEED_DOCUMENT = (
    f"title STRING, channel STRUCT<title: STRING, item: {_ENTRY}>, item {_ENTRY}, entry {_ENTRY}, "
    "_corrupt_record STRING"
)
