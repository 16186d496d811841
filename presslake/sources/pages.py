"""Fetched article pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.functions.text import decode_body

# Bits of the table of asked URLs: 16 MB of rows at most, one page in 16 passes for nothing at a million URLs.
KEY_BITS = 1 << 24


def page_outcomes(crawl: DataFrame) -> DataFrame:
    """Crawl rows (url, status, body, charset, error_kind) -> url, html, error_kind.

    An error status is an 'http' error; a timeout or refused connection arrives as 'network'. Only fetched pages
    have html.
    """
    kind = F.coalesce(F.col("error_kind"), F.when(F.col("status") >= 400, F.lit("http")))
    html = F.when(kind.isNull(), decode_body(F.col("body"), F.col("charset")))
    return crawl.select("url", html.alias("html"), kind.alias("error_kind"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def candidate_pages(pages: DataFrame, articles: DataFrame, url: str = "link", bits: int = KEY_BITS) -> DataFrame:
    """Pages that articles may ask for: a filter ahead of any shuffle, so that HTML of other pages does not move.

    The articles' URLs set bits of a table of fixed size, which meets the pages as a broadcast of at most bits / 64 rows,
    however many articles there are. A collision lets a page pass for nothing; the join drops it.
    """

    def slot(key: Column) -> tuple[Column, Column]:
        place = F.pmod(F.xxhash64(key), F.lit(bits))
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
        return F.shiftright(place, 6), bit

    at, bit = slot(F.col(url))
    asked = articles.where(F.col(url).isNotNull()).select(at.alias("_at"), bit.alias("_bit")).groupBy("_at").agg(F.bit_or("_bit").alias("_mask"))
    at, bit = slot(F.col("url"))
    marked = pages.withColumn("_at", at).join(F.broadcast(asked), "_at")
    return marked.where(F.col("_mask").bitwiseAND(bit) != 0).select(*pages.columns)


def asked_pages(pages: DataFrame, articles: DataFrame, url: str = "link") -> DataFrame:
    """The pages, html only of fetched ones that some article which is not blocked asks for; each page is one row."""
    open_to = ~F.coalesce(F.col("blocked"), F.lit(False))
    asked = articles.where(open_to & F.col(url).isNotNull()).select(F.col(url).alias("_link")).distinct()
    marked = pages.join(asked, F.col("url") == F.col("_link"), "left")
    read = F.col("_link").isNotNull() & F.col("error_kind").isNull()
    return marked.select("url", F.when(read, F.col("html")).alias("html"), "error_kind")


def page_join(
    articles: DataFrame, pages: DataFrame, url: str = "link", reduce: bool = False, values: tuple[str, ...] = ("html",)
) -> DataFrame:
    """Attach the fetched page of each article URL, its html or other values; a URL never fetched counts as an 'http' error.

    pages holds one row per URL (see latest_pages). reduce passes them through candidate_pages first, which reads the
    articles' URLs once more: leave it out where articles are dear to compute and not materialised.
    """
    near = candidate_pages(pages, articles, url) if reduce else pages
    crawled = near.select(F.col("url").alias("_url"), *values, "error_kind", F.lit(True).alias("_crawled"))
    joined = articles.join(crawled, F.col(url) == F.col("_url"), "left")
    kind = F.when(F.col("_crawled"), F.col("error_kind")).otherwise(F.lit("http"))
    return joined.withColumn("error_kind", kind).drop("_url", "_crawled")


def latest_pages(crawl: DataFrame, order: str = "fetched_at") -> DataFrame:
    """One row per URL, the newest fetch; order is a column whose values are distinct within a URL.

    Keys are reduced first and HTML is joined back only for the winners.
    """
    newest = crawl.groupBy("url").agg(F.max(order).alias(order))
    return crawl.join(newest, ["url", order], "left_semi")

