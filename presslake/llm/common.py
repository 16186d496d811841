"""What the operators share: settings, written intermediate tables, texts inside Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1024
CHUNK_BYTES = 4 << 20
# A null key is ordered after every other one.
NULL_KEY = (1 << 63) - 1


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, as texts may be long, and adaptive execution."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a single-process session may choose its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"/tmp/presslake-shared-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read again: later uses neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def never_broadcast(df: DataFrame) -> DataFrame:
    """df as a side of a join that is done by sorting, whatever size either side seems to have.

    Spark takes the output of a Python step or of an explode for about as large as its input, and a written table for as
    large as its compressed files. A broadcast chosen by such a size stays, even if the rows turn out to be too many for the driver.
    """
    return df.hint("merge")


def own_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under fixed names, so that other columns of df cannot clash."""
    return df.select(*[F.col(f"`{have}`").alias(want) for want, have in columns.items()])


def bounded(df: DataFrame, limit: int, *keys: Column | str) -> DataFrame:
    """At most limit rows, those with the least hashes of their keys: the same ones on every run.

    Most other rows are left out by their hash first, so that no task hands limit rows to the driver, whatever the
    number of tasks.
    """
    by = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    total = df.count()
    if total > 4 * limit:
        df = df.where(by < F.lit((1 << 40) * 2 * limit // total))
    return df.orderBy(by, *keys).limit(limit)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column) -> list[bytes]:
    """The texts of an Arrow column as bytes; a null is an empty text."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about limit bytes in each; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
