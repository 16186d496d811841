"""Deduplication of an article stream by (normalised URL, published): within a time by keyed state, for good by a table.

The table of seen keys is partitioned by the day of `published` and by micro-batch, and a micro-batch reads only the days
that occur in it: copies of an article carry the same date. A replayed micro-batch sees the keys of the ones before it
and replaces its own partitions, so results do not depend on restarts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from presslake.functions.urls import normalize_url
from presslake.operators.dedup import dedup_url_timestamp

SEEN = "url_key STRING, published STRING, day STRING, batch BIGINT"
# The day of what carries no date.
NO_DAY = "none"


def published_day(published: Column) -> Column:
    return F.when(published.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(published, 1, 10)).otherwise(F.lit(NO_DAY))


def drop_recent_copies(articles: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream without the copies that arrive within delay of the first one; which of them stays is not defined.

    The watermark is on the time of arrival, so no row is late, however old its article.
    """
    arrived = articles.withColumn("url_key", normalize_url(F.col("link"))).withColumn("_arrived", F.current_timestamp())
    kept = arrived.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["url_key", "published"])
    return kept.drop("_arrived", "url_key")


def load_seen(spark: SparkSession, root: str, days: list[str], before: int) -> DataFrame:
    """(url_key, published) of earlier micro-batches on some days."""
    none = spark.createDataFrame([], SEEN)
    if not days:
        return none
    try:
        rows = spark.read.schema(SEEN).option("basePath", root).parquet(f"{root}/day={{{','.join(days)}}}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return none
        raise
    return rows.where(F.col("batch") < before)


def dedup_batch(articles: DataFrame, batch_id: int, seen_root: str, results_root: str) -> None:
    """One micro-batch: of its copies the lowest (feed_url, pos) stays, if no earlier micro-batch had the article.

    Results are written before the keys, both under the batch number.
    """
    spark = articles.sparkSession
    days = [r.day for r in articles.select(published_day(F.col("published")).alias("day")).distinct().collect()]
    kept = dedup_url_timestamp(articles, load_seen(spark, seen_root, sorted(days), batch_id))
    target = f"{results_root}/batch={batch_id}"
    kept.write.mode("overwrite").parquet(target)
    keys = spark.read.schema(kept.schema).parquet(target).select("url_key", "published").distinct()
    placed = keys.withColumns({"day": published_day(F.col("published")), "batch": F.lit(batch_id).cast("bigint")})
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(seen_root)


def run_dedup_stream(
    articles: DataFrame, seen_root: str, results_root: str, checkpoint: str, delay: str | None = None
) -> StreamingQuery:
    """Start the stream; it ends when the landed files are used up. delay also drops recent copies by keyed state,
    which saves their way to the table, but leaves open which of a micro-batch's copies stays."""
    rows = articles if delay is None else drop_recent_copies(articles, delay)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        dedup_batch(batch, batch_id, seen_root, results_root)

    writer = rows.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
