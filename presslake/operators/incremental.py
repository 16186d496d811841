"""Per-feed high-water marks: what is new, where a feed stops, what is kept, and the next marks.

No window runs over a whole feed. A feed's stop position is a partial-aggregated minimum joined back, and
first-k is a top-k that each partition cuts to k rows per feed before any shuffle, so one feed holding a third
of all entries costs no more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.functions.dates import is_newer_than_last, is_newer_than_last_id
from presslake.functions.text import blank_to_null

# Articles kept per feed.
MAX_ARTICLES = 5


def history_lookup(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Add last_id, NULL for unknown feeds."""
    return rows.join(history.select("feed_url", "last_id"), "feed_url", "left")


def with_is_new(rows: DataFrame, history: DataFrame, ts: str = "published", by_id: bool = False) -> DataFrame:
    """Add last_id and is_new. by_id compares unreadable stamps as text instead of passing them."""
    rule = is_newer_than_last_id if by_id else is_newer_than_last
    return history_lookup(rows, history).withColumn("is_new", rule(F.col(ts), F.col("last_id")))


def filter_articles(articles: DataFrame, history: DataFrame) -> DataFrame:
    """Keep new or undated articles."""
    undated = F.col("published").isNull() | (F.col("published") == "")
    return with_is_new(articles, history).where(undated | F.col("is_new")).drop("last_id", "is_new")


def should_skip(rows: DataFrame, history: DataFrame) -> DataFrame:
    return with_is_new(rows, history).withColumn("should_skip", ~F.col("is_new")).drop("is_new")


def require_link(entries: DataFrame) -> DataFrame:
    return entries.where(blank_to_null(F.col("link")).isNotNull())


def datable(entries: DataFrame) -> DataFrame:
    """Entries the feed loop gets as far as comparing: they have a link and a date."""
    return require_link(entries).where(blank_to_null(F.col("published")).isNotNull())


def stop_positions(entries: DataFrame, history: DataFrame, document: tuple[str, ...] = ("feed_url",)) -> DataFrame:
    """(*document, stop_pos): first datable entry of each document that is not newer than its feed's mark."""
    marks = history.where(blank_to_null(F.col("last_id")).isNotNull()).select("feed_url", "last_id")
    dated = datable(entries).select(*document, "pos", "published")
    stale = dated.join(marks, "feed_url").where(~is_newer_than_last_id(F.col("published"), F.col("last_id")))
    return stale.groupBy(*document).agg(F.min("pos").alias("stop_pos"))


def take_until_stale(entries: DataFrame, history: DataFrame, document: tuple[str, ...] = ("feed_url",)) -> DataFrame:
    """Datable entries before their document's stop position; later newer ones are given up with the rest.

    document tells several fetches of one feed apart, e.g. ("feed_url", "fetch_id").
    """
    stops = stop_positions(entries, history, document)
    joined = datable(entries).join(stops, list(document), "left")
    return joined.where(F.col("stop_pos").isNull() | (F.col("pos") < F.col("stop_pos"))).drop("stop_pos")


def first_k_per_feed(rows: DataFrame, k: int = MAX_ARTICLES, order: list[Column] | None = None) -> DataFrame:
    """First k rows of each feed, with their 1-based rank in column rn."""
    window = Window.partitionBy("feed_url").orderBy(*(order or [F.col("pos")]))
    return rows.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= k)


def limit_successes(extracted: DataFrame, k: int = MAX_ARTICLES, order: list[Column] | None = None) -> DataFrame:
    """First k successful entries with content, in document order unless order is given."""
    return first_k_per_feed(require_content(extracted), k, order).drop("rn")


def newest_fetch_of_each(entries: DataFrame) -> DataFrame:
    """Of the copies of an entry (link, published) in several fetches of its feed (fetch_id), the newest fetch's first."""
    copies = Window.partitionBy("feed_url", "link", "published").orderBy(F.col("fetch_id").desc(), "pos")
    return entries.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1").drop("_copy")


def require_content(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("success") & (F.col("content") != ""))


def newest_k(rows: DataFrame, k: int = MAX_ARTICLES) -> DataFrame:
    """The k newest rows of each feed by date."""
    return first_k_per_feed(rows, k, [F.col("published").desc_nulls_last(), F.col("pos")]).drop("rn")


def sort_published_desc(articles: DataFrame, *feed_keys: str) -> DataFrame:
    """Order articles by date within their feed, undated last, document order on ties. A range sort, so a large
    feed is spread over several partitions."""
    return articles.orderBy(*feed_keys, F.col("published").desc_nulls_last(), "pos")


def entries_checked(entries: DataFrame, history: DataFrame, successes: DataFrame, k: int = MAX_ARTICLES) -> DataFrame:
    """Entries inspected per feed: up to the stale one or up to the k-th success, whichever comes first.

    successes holds (feed_url, pos) of the successful entries.
    """
    kth = first_k_per_feed(successes.select("feed_url", "pos"), k).where(F.col("rn") == k)
    bounds = (
        stop_positions(entries, history)
        .withColumnRenamed("stop_pos", "last_pos")
        .unionByName(kth.select("feed_url", F.col("pos").alias("last_pos")))
        .groupBy("feed_url")
        .agg(F.min("last_pos").alias("last_pos"))
    )
    seen = F.col("last_pos").isNull() | (F.col("pos") <= F.col("last_pos"))
    return (
        entries.select("feed_url", "pos")
        .join(bounds, "feed_url", "left")
        .groupBy("feed_url")
        .agg(F.count_if(seen).alias("entries_checked"))
    )


def latest_per_feed(articles: DataFrame, *columns: str) -> DataFrame:
    """Newest accepted article of each feed, first in document order on ties."""
    picked = F.max_by(F.struct("published", "pos", *columns), F.struct(F.col("published"), -F.col("pos")))
    return articles.groupBy("feed_url").agg(picked.alias("a")).select("feed_url", "a.*")


def new_marks(articles: DataFrame) -> DataFrame:
    return articles.groupBy("feed_url").agg(F.max("published").alias("new_id"))


def history_update(history: DataFrame, articles: DataFrame) -> DataFrame:
    """Next marks: the newest accepted date where a feed accepted anything, the old mark elsewhere."""
    return (
        history.join(new_marks(articles), "feed_url", "full")
        .select("feed_url", F.coalesce("new_id", "last_id").alias("last_id"))
        .where(F.col("feed_url").isNotNull())
    )


def set_marks(history: DataFrame, marks: DataFrame) -> DataFrame:
    """Overwrite or add single marks (feed_url, last_id)."""
    fresh = marks.select("feed_url", F.col("last_id").alias("new_id"), F.lit(True).alias("_set"))
    return history.join(fresh, "feed_url", "full").select(
        "feed_url", F.when(F.col("_set"), F.col("new_id")).otherwise(F.col("last_id")).alias("last_id")
    )


def history_remove(history: DataFrame, feeds: DataFrame) -> DataFrame:
    """Forget some feeds; unknown ones change nothing."""
    return history.join(feeds.select("feed_url"), "feed_url", "left_anti")


def history_clear(history: DataFrame) -> DataFrame:
    return history.where(F.lit(False))


def feed_count(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("feed_count"))


def missing_date_default(entries: DataFrame, default: Column) -> DataFrame:
    """Give undated entries a date instead of dropping them."""
    return entries.withColumn("published", F.coalesce(blank_to_null(F.col("published")), default))
