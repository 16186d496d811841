"""Job configuration and high-water marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.functions.text import blank_to_null
from presslake.schemas import CONFIG
from presslake.sources.marks import load_marks, replace_marks


def parse_config_json(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON text -> configuration fields; unreadable text has _corrupt_record set."""
    parsed = F.from_json(F.col(value), CONFIG, {"columnNameOfCorruptRecord": "_corrupt_record"})
    keep = [c for c in raw.columns if c != value]
    return raw.select(*keep, parsed.alias("c")).select(*keep, "c.*")


def config_valid(config: DataFrame) -> DataFrame:
    """Add valid: the required url is present and not empty."""
    return config.withColumn("valid", blank_to_null(F.col("url")).isNotNull())


def scan_history(config: DataFrame) -> DataFrame:
    """Marks of the his map; a missing map gives none."""
    return config.select(F.explode("his").alias("feed_url", "last_id"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return parse_config_json(spark.read.text(path, wholetext=True))


def history_to_config(history: DataFrame) -> DataFrame:
    """Marks as (feed_url, last_id) JSON lines; a map of all feeds in one row would not scale."""
    return history.select(F.to_json(F.struct("feed_url", "last_id")).alias("value"))


def save_history(history: DataFrame, root: str, version: int) -> None:
    """Publish all marks under a version. A rerun of the same version replaces it (see marks for the log's layout)."""
    replace_marks(history, root, version)


def load_history(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Newest published marks, or the newest older than a version; none published gives no marks."""
    return load_marks(spark, root, before)
