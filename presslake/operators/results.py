"""Feed results, run summary and nested output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARTICLE_FIELDS = ["title", "url", "published", "author", "content", "images"]


def successful_results(results: DataFrame) -> DataFrame:
    return results.where("success")


def failed_results(results: DataFrame) -> DataFrame:
    return results.where("NOT success")


def result_reorder(feeds: DataFrame, finished: DataFrame) -> DataFrame:
    """One result per subscription position; of several results of a feed URL the last finished one counts.

    finished holds (feed_url, finished_ord, success, error).
    """
    last = F.max_by(F.struct("success", "error"), "finished_ord")
    latest = finished.groupBy("feed_url").agg(last.alias("r")).select("feed_url", "r.*")
    return feeds.join(latest, "feed_url").orderBy("feed_ord")


def all_articles(results: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles of the successful feeds."""
    good = successful_results(results).select("feed_url").distinct()
    return articles.join(good, "feed_url", "left_semi")


def articles_per_feed(articles: DataFrame) -> DataFrame:
    return articles.groupBy("feed_url").agg(F.count(F.lit(1)).alias("n_articles"))


def run_summary(results: DataFrame, articles: DataFrame) -> DataFrame:
    """Run totals in one row. The failed feeds are the rows of failed_feed_list, which may be many."""
    counted = results.join(articles_per_feed(articles), "feed_url", "left")
    kept = F.when(F.col("success"), F.coalesce("n_articles", F.lit(0)))
    return counted.agg(
        F.count(F.lit(1)).alias("total_feeds"),
        F.count_if("success").alias("successful_feeds"),
        F.count_if(~F.col("success")).alias("failed_feeds"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("total_articles"),
    )


def failed_feed_list(results: DataFrame) -> DataFrame:
    """URLs of the failed feeds in subscription order."""
    return failed_results(results).select("feed_ord", "feed_url").orderBy("feed_ord")


def feed_success_stats(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("success").alias("success_count"), F.count(F.lit(1)).alias("total"))


def extraction_method_stats(extracted: DataFrame) -> DataFrame:
    return extracted.groupBy("extraction_method").agg(F.count(F.lit(1)).alias("n"))


def drop_internal_columns(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def nest_output(results: DataFrame, articles: DataFrame) -> DataFrame:
    """One row per successful feed with its articles, newest first; feeds without articles drop out.

    Articles are already limited per feed, so a group is at most that many rows.
    """
    # Undated articles sort as '' and so come last in descending order.
    sort_key = F.struct(F.coalesce("published", F.lit("")).alias("day"), (-F.col("pos")).alias("order"))
    row = F.struct(sort_key.alias("k"), F.struct(*ARTICLE_FIELDS).alias("a"))
    grouped = articles.groupBy("feed_url").agg(F.collect_list(row).alias("rows"))
    # The key is unique per feed, so the article struct is never compared.
    newest_first = F.transform(F.sort_array("rows", asc=False), lambda r: r["a"])
    nested = grouped.select("feed_url", newest_first.alias("articles"))
    feeds = successful_results(results).select("feed_ord", "feed_url", "feed_title", "feed_type")
    return feeds.join(nested, "feed_url").select("feed_ord", "feed_url", "feed_title", "feed_type", "articles")


def to_result_json(nested: DataFrame) -> DataFrame:
    """One JSON document per feed."""
    body = F.struct("feed_url", "feed_title", "feed_type", "articles")
    return nested.select("feed_ord", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
