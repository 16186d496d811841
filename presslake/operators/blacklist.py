"""Failing domains as aggregates. Per-domain state is always a partial aggregate joined back, never a window over
all rows of a domain, so one domain holding a third of all failures is combined map-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.functions.text import blank_to_null
from presslake.functions.urls import blacklist_key, domain_of_url

# Domains that are never worth fetching.
PERMANENT_DOMAINS = ["weixin.sogou.com"]


def permanent_domains(spark) -> DataFrame:
    return spark.createDataFrame([(d,) for d in PERMANENT_DOMAINS], "domain STRING")


def union_seed(domains: DataFrame, seed: DataFrame) -> DataFrame:
    """Runtime and permanent domains, once each."""
    return domains.select("domain").unionByName(seed.select("domain")).distinct()


def _filed(failures: DataFrame) -> DataFrame:
    return failures.withColumn("domain", blacklist_key(F.col("url_or_domain"))).where(F.col("domain").isNotNull())


def blacklist_build(failures: DataFrame, seed: DataFrame) -> DataFrame:
    """Failure events -> one row per listed domain.

    Seeded domains are listed without metadata and their failures are not counted. The last given reason stays.
    """
    order = F.struct("ts", "pos")
    given = blank_to_null(F.col("reason"))
    counted = (
        _filed(failures)
        .groupBy("domain")
        .agg(
            F.min("ts").alias("added_at"),
            F.max("ts").alias("last_failed"),
            F.count(F.lit(1)).alias("fail_count"),
            F.coalesce(F.max_by(given, F.when(given.isNotNull(), order)), F.lit("Unknown")).alias("reason"),
        )
        .join(seed.select("domain"), "domain", "left_anti")
    )
    seeded = seed.select("domain").distinct()
    return counted.unionByName(seeded, allowMissingColumns=True)


def blacklist_added_flag(failures: DataFrame, seed: DataFrame) -> DataFrame:
    """Add domain and added: true for the event that put its domain on the list."""
    filed = failures.withColumn("domain", blacklist_key(F.col("url_or_domain")))
    firsts = (
        _filed(failures)
        .groupBy("domain")
        .agg(F.min(F.struct("ts", "pos")).alias("_first"))
        .join(seed.select("domain"), "domain", "left_anti")
    )
    is_first = F.struct("ts", "pos") == F.col("_first")
    return filed.join(firsts, "domain", "left").withColumn("added", F.coalesce(is_first, F.lit(False))).drop("_first")


def with_blocked(rows: DataFrame, blacklist: DataFrame, url: str = "link") -> DataFrame:
    """Add blocked: the raw text or its domain is listed."""
    listed = blacklist.select(F.col("domain").alias("_listed")).distinct()
    by_domain = rows.withColumn("_domain", domain_of_url(F.col(url))).join(
        listed.withColumn("_hit_domain", F.lit(True)), F.col("_domain") == F.col("_listed"), "left"
    )
    by_text = by_domain.drop("_listed").join(
        listed.withColumn("_hit_text", F.lit(True)), F.col(url) == F.col("_listed"), "left"
    )
    hit = F.coalesce(F.col("_hit_domain"), F.col("_hit_text"), F.lit(False))
    return by_text.withColumn("blocked", hit).drop("_listed", "_domain", "_hit_domain", "_hit_text")


def blacklist_match(rows: DataFrame, blacklist: DataFrame, url: str = "link") -> DataFrame:
    return with_blocked(rows, blacklist, url).where("blocked").drop("blocked")


def blacklist_exclude(rows: DataFrame, blacklist: DataFrame, url: str = "link") -> DataFrame:
    return with_blocked(rows, blacklist, url).where("NOT blocked").drop("blocked")


def with_run_blocked(rows: DataFrame, url: str = "link") -> DataFrame:
    """Also block rows whose domain already had a network error earlier in the run, in (feed_ord, pos) order.

    Expects blocked and error_kind, no page. Rows blocked beforehand are never fetched, so they raise no error themselves.
    """
    at = F.struct("feed_ord", "pos")
    keyed = rows.withColumn("_domain", domain_of_url(F.col(url)))
    errors = keyed.where((F.col("error_kind") == "network") & ~F.col("blocked") & F.col("_domain").isNotNull())
    firsts = errors.groupBy("_domain").agg(F.min(at).alias("_first_error"))
    later = F.coalesce(at > F.col("_first_error"), F.lit(False))
    return (
        keyed.join(firsts, "_domain", "left")
        .withColumn("blocked", F.col("blocked") | later)
        .drop("_domain", "_first_error")
    )


def blacklist_size(blacklist: DataFrame) -> DataFrame:
    return blacklist.agg(F.count_distinct("domain").alias("n_domains"))


def blacklist_list(blacklist: DataFrame) -> DataFrame:
    return blacklist.select("domain").distinct()


def blacklist_metadata(blacklist: DataFrame) -> DataFrame:
    """Listed domains that carry metadata; seeded ones do not."""
    return blacklist.where(F.col("fail_count").isNotNull())
