"""High-water marks as a log: small deltas over a base, a manifest for each published state, a ring of slots.

A run writes the marks it changed and a manifest that names a base and the deltas to lay over it; nothing else is
rewritten. Marks are merged when read, the newest delta of a feed winning. After COMPACT_EVERY deltas the merged marks
become the next base. Deltas, bases and manifests rotate through numbered slots, so a log never holds more than RING
deltas and manifests and BASES bases. A manifest counts for COMPACT_EVERY versions and BASES - 2 newer bases; until then
nothing that it names is overwritten.

A manifest appears as one file, by a commit of Spark's writer, after all it names is complete. A run that is repeated
starts from the newest manifest before its own version, and replaces what it left behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.schemas import HISTORY

COMPACT_EVERY = 16
RING = 2 * COMPACT_EVERY + 2
BASES = 4
_DELTA = f"{HISTORY}, removed BOOLEAN"
_MANIFEST = "version BIGINT, seq BIGINT, generation BIGINT, base STRING, deltas ARRAY<STRING>"


@dataclass(frozen=True)
class Manifest:
    """A published state. version: the run's number; seq and generation count manifests and bases."""

    version: int = -1
    seq: int = -1
    generation: int = -1
    base: str | None = None
    deltas: tuple[str, ...] = ()


def newest_manifest(spark: SparkSession, root: str, before: int | None = None) -> Manifest:
    """The newest published state, or the newest older than a version; an empty one if none was ever published.

    Reads the ring's few one-line files in one job. States whose slots may have been taken since are not given: asking
    for one raises ValueError.
    """
    ring = _ring(spark, root)
    if not ring:
        return Manifest()
    last = ring[-1]
    asked = [m for m in ring if before is None or m.version < before]
    kept = [m for m in asked if m.seq > last.seq - COMPACT_EVERY and m.generation > last.generation - BASES + 1]
    if not kept and (asked or ring[0].seq > 0):
        raise ValueError(f"the marks before version {before} have expired")
    return kept[-1] if kept else Manifest()


def _ring(spark: SparkSession, root: str) -> list[Manifest]:
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{root}/manifest").drop("slot").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    found = [Manifest(r.version, r.seq, r.generation, r.base, tuple(r.deltas or ())) for r in rows]
    return sorted(found, key=lambda m: m.seq)


def _prior(spark: SparkSession, root: str, version: int) -> Manifest:
    ring = _ring(spark, root)
    if ring and ring[-1].version > version:
        raise ValueError(f"version {ring[-1].version} was published, {version} comes too late")
    return newest_manifest(spark, root, version)


def _publish(spark: SparkSession, root: str, state: Manifest) -> None:
    row = (state.version, state.seq, state.generation, state.base, list(state.deltas))
    one = spark.createDataFrame([row], _MANIFEST).coalesce(1)
    one.write.mode("overwrite").json(f"{root}/manifest/slot={state.seq % RING}")


def _merged(spark: SparkSession, root: str, state: Manifest, feeds: DataFrame | None = None) -> DataFrame:
    """The marks of a state: of each feed its newest delta's, else the base's. Removed feeds have none."""

    def of(path: str, age: int) -> DataFrame:
        rows = spark.read.schema(_DELTA).parquet(f"{root}/{path}").withColumn("age", F.lit(age))
        return rows if feeds is None else rows.join(feeds.select("feed_url"), "feed_url", "left_semi")

    if state.base is None and not state.deltas:
        return spark.createDataFrame([], HISTORY)
    rows = of(state.base, 0) if state.base is not None else None
    for age, path in enumerate(state.deltas, 1):
        rows = of(path, age) if rows is None else rows.unionByName(of(path, age))
    newest = rows.groupBy("feed_url").agg(F.max_by(F.struct("last_id", "removed"), "age").alias("m"))
    return newest.where(~F.col("m.removed")).select("feed_url", "m.last_id")


def load_marks(spark: SparkSession, root: str, before: int | None = None, feeds: DataFrame | None = None) -> DataFrame:
    """(feed_url, last_id) of the newest published state, or of the newest older than a version.

    feeds (feed_url) keeps only theirs, ahead of the merge: then a run's cost follows its own feeds, not all marks.
    """
    return _merged(spark, root, newest_manifest(spark, root, before), feeds)


def append_marks(changed: DataFrame, root: str, version: int, removed: DataFrame | None = None) -> Manifest:
    """Publish a version: the marks (feed_url, last_id) it changed, one row a feed, and the feeds it forgot."""
    spark = changed.sparkSession
    prior = _prior(spark, root, version)
    seq = prior.seq + 1
    delta = changed.select("feed_url", "last_id", F.lit(False).alias("removed"))
    if removed is not None:
        gone = removed.select("feed_url", F.lit(None).cast("string").alias("last_id"), F.lit(True).alias("removed"))
        delta = delta.unionByName(gone)
    path = f"delta/slot={seq % RING}"
    delta.write.mode("overwrite").parquet(f"{root}/{path}")
    state = Manifest(version, seq, prior.generation, prior.base, (*prior.deltas, path))
    if len(state.deltas) >= COMPACT_EVERY:
        state = _rebased(_merged(spark, root, state), root, state)
    _publish(spark, root, state)
    return state


def replace_marks(marks: DataFrame, root: str, version: int) -> Manifest:
    """Publish a version that holds exactly these marks (feed_url, last_id)."""
    spark = marks.sparkSession
    prior = _prior(spark, root, version)
    state = _rebased(marks, root, Manifest(version, prior.seq + 1, prior.generation))
    _publish(spark, root, state)
    return state


def _rebased(marks: DataFrame, root: str, state: Manifest) -> Manifest:
    generation = state.generation + 1
    path = f"base/slot={generation % BASES}"
    marks.select("feed_url", "last_id", F.lit(False).alias("removed")).write.mode("overwrite").parquet(f"{root}/{path}")
    return Manifest(state.version, state.seq, generation, path)
