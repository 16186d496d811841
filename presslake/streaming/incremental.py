"""The same job on landed files as Structured Streaming.

run_stream is the form to use at scale: each micro-batch is the batch plan, with its skew handling, between two
published states of the marks, and writes only the marks it moves. keyed_marks accepts the same rows with the marks as keyed state; all new rows of a feed
then pass through one task per micro-batch, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from presslake.functions.dates import ISO, ISO_ZONED
from presslake.functions.text import blank_to_null
from presslake.operators.incremental import (
    MAX_ARTICLES,
    datable,
    limit_successes,
    new_marks,
    newest_fetch_of_each,
    take_until_stale,
)
from presslake.sources.feeds import rewrite_entry_links, scan_feed_entries
from presslake.schemas import ENTRIES
from presslake.sources.marks import append_marks, load_marks


def read_entry_stream(spark: SparkSession, path: str, schema: str = ENTRIES, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def read_document_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed feed documents (feed_url, fetch_id, doc) as a stream of entries with links rewritten, one parse per row."""
    schema = "feed_url STRING, fetch_id BIGINT, doc STRING"
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rewrite_entry_links(scan_feed_entries(docs))


def process_batch(
    entries: DataFrame,
    batch_id: int,
    history_root: str,
    results_root: str,
    extract: Callable[[DataFrame], DataFrame],
    k: int = MAX_ARTICLES,
) -> None:
    """One run over a micro-batch. Results are written before the marks move; both paths carry the batch number,
    so a replayed batch starts from the same marks and replaces its own output.

    Where entries have fetch_id, a micro-batch may hold several fetches of a feed: each stops at its own first stale
    entry, an entry found in several counts once, and newer fetches come first.
    """
    spark = entries.sparkSession
    history = load_marks(spark, history_root, before=batch_id, feeds=entries.select("feed_url").distinct())
    if "fetch_id" in entries.columns:
        fresh = newest_fetch_of_each(take_until_stale(entries, history, ("feed_url", "fetch_id")))
        accepted = limit_successes(extract(fresh), k, [F.col("fetch_id").desc(), F.col("pos")])
    else:
        accepted = limit_successes(extract(take_until_stale(entries, history)), k)
    target = f"{results_root}/batch={batch_id}"
    accepted.write.mode("overwrite").parquet(target)
    written = spark.read.schema(accepted.schema).parquet(target)
    append_marks(new_marks(written).select("feed_url", F.col("new_id").alias("last_id")), history_root, batch_id)


def run_stream(
    entries: DataFrame,
    history_root: str,
    results_root: str,
    checkpoint: str,
    extract: Callable[[DataFrame], DataFrame],
    k: int = MAX_ARTICLES,
) -> StreamingQuery:
    """Start the stream; it ends when the landed files are used up."""

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, history_root, results_root, extract, k)

    return (
        entries.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class _MarkKeeper(StatefulProcessor):
    """A feed's run over its rows of one micro-batch: stop at the first stale one, keep the first k successes, move the mark.

    Rows come in any order and are seen once: the k first successes among the newer rows are held, with the least
    position of a stale row, so memory does not grow with the feed. State is one value per feed.
    """

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField("last_id", StringType()), StructField("kind", IntegerType()), StructField("at", LongType())]
        self.mark = handle.getValueState("mark", StructType(fields))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self.mark.update((first["last_id"], int(first["mark_kind"]), int(first["mark_at"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, kind, at = self.mark.get() if self.mark.exists() else (None, 0, 0)
        held, stop = None, None
        for chunk in rows:
            newer = chunk["published"] != last
            if last is not None and kind:
                alike = chunk["mark_kind"] == kind
                newer = (alike & (chunk["mark_at"] > at)) | (~alike & newer)
            stale = chunk.loc[~newer, "pos"]
            if len(stale):
                stop = stale.min() if stop is None else min(stop, stale.min())
            good = chunk[newer & chunk["success"].fillna(False).astype(bool) & (chunk["content"].fillna("") != "")]
            held = (good if held is None else pd.concat([held, good])).nsmallest(self.k, "pos")
        if held is None:
            return
        kept = held if stop is None else held[held["pos"] < stop]
        if len(kept):
            newest = kept.sort_values("published").iloc[-1]
            self.mark.update((newest["published"], int(newest["mark_kind"]), int(newest["mark_at"])))
            yield kept.drop(columns=["mark_kind", "mark_at"])

    def close(self) -> None:
        pass


def _with_time(rows: DataFrame, stamp: str) -> DataFrame:
    """Add mark_kind (2: a time with a zone, 1: one without, 0: none) and mark_at, its microseconds."""
    at = F.col(stamp)
    zoned = F.unix_micros(at.try_cast("timestamp"))
    local = F.unix_micros(at.try_cast("timestamp_ntz").cast("timestamp"))
    kind = F.when(at.rlike(ISO_ZONED) & zoned.isNotNull(), 2).when(at.rlike(ISO) & ~at.rlike(ISO_ZONED) & local.isNotNull(), 1).otherwise(0)
    return rows.withColumn("mark_kind", kind).withColumn("mark_at", F.coalesce(F.when(kind == 2, zoned).when(kind == 1, local), F.lit(0)))


def keyed_marks(entries: DataFrame, k: int = MAX_ARTICLES, marks: DataFrame | None = None) -> DataFrame:
    """What a run accepts of settled entries (as limit_successes of take_until_stale), the marks being keyed state.

    Entries have published, link, pos, success and content. Every micro-batch is one run. marks (feed_url, last_id), one
    row a feed, e.g. load_marks of a batch run, are the state before the first micro-batch; blank ones count as none.
    """
    dated = datable(entries)
    start = None
    if marks is not None:
        known = marks.where(blank_to_null(F.col("last_id")).isNotNull()).select("feed_url", "last_id")
        start = _with_time(known, "last_id").groupBy("feed_url")
    return _with_time(dated, "published").groupBy("feed_url").transformWithStateInPandas(
        statefulProcessor=_MarkKeeper(k), outputStructType=dated.schema, outputMode="Append", timeMode="None", initialState=start
    )
