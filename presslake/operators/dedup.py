"""Optional deduplication and quality marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.functions.text import content_valid
from presslake.functions.urls import normalize_url


def dedup_url_timestamp(articles: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One row per (normalised URL, published), the lowest (feed_url, pos); pairs in seen are dropped.

    The winner is a map-side combined minimum of the row keys, so copies of one article never meet in one task;
    the wide row is fetched by key afterwards.
    """
    keyed = articles.withColumn("url_key", normalize_url(F.col("link")))
    first = F.min(F.struct("feed_url", "pos"))
    winners = keyed.groupBy("url_key", "published").agg(first.alias("w"))
    if seen is not None:
        old = seen.select(F.col("url_key").alias("_k"), F.col("published").alias("_p"))
        match = (F.col("url_key") == F.col("_k")) & F.col("published").eqNullSafe(F.col("_p"))
        winners = winners.join(old, match, "left_anti")
    return keyed.join(winners.select("w.feed_url", "w.pos"), ["feed_url", "pos"], "left_semi")


def low_quality_flag(articles: DataFrame, text: str = "content") -> DataFrame:
    """Mark text that fails the validity test instead of dropping it."""
    return articles.withColumn("low_quality", ~content_valid(F.col(text)))
