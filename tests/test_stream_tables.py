"""Stream deduplication, progress rows and keyed state that starts from marks."""

import pytest
from pyspark.sql import functions as F

from presslake.operators import incremental as inc
from presslake.operators.dedup import dedup_url_timestamp
from presslake.streaming import dedup, progress
from presslake.streaming import incremental as stream

SCHEMA = "feed_url string, pos bigint, link string, published string"
OLD, NEW = "2020-01-01T00:00:00", "2026-05-01T10:00:00"
FIRST = [("f", 3, "https://e.org/a?utm_source=x", NEW), ("f", 1, "https://e.org/a", NEW), ("g", 0, "https://e.org/a", OLD), ("g", 1, "https://e.org/b", None)]
SECOND = [("a", 0, "https://e.org/a#top", NEW), ("a", 1, "https://e.org/b", None), ("a", 2, "https://e.org/c", "no date"), ("a", 3, None, NEW)]
# Long after the others: an article of an old day that is new, and copies of old and odd ones.
LATE = [("z", 0, "https://e.org/late", OLD), ("z", 1, "https://e.org/a", OLD), ("z", 2, "https://e.org/c", "no date"), ("z", 3, "https://e.org/d", "2026-05-01")]


def land(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_copies_go_across_batches_and_restarts(spark, tmp_path, delay):
    landed, kept, seen = (str(tmp_path / x) for x in ("landed", "kept", "seen"))
    for part in (FIRST, SECOND, LATE):  # each start is a restart
        land(spark, landed, part)
        dedup.run_dedup_stream(stream.read_entry_stream(spark, landed, SCHEMA), seen, kept, str(tmp_path / "checkpoint"), delay).awaitTermination()
    got = spark.read.parquet(kept)
    keys = sorted((r.batch, r.url_key or "", r.published or "") for r in got.collect())
    batch_of = {}
    for n, part in enumerate((FIRST, SECOND, LATE)):
        known = dedup_url_timestamp(spark.createDataFrame(part, SCHEMA)).collect()
        for r in known:
            batch_of.setdefault((r.url_key or "", r.published or ""), n)
    assert sorted(batch_of) == sorted(k[1:] for k in keys)
    if delay is None:  # a watermark adds batches without rows
        assert sorted((n, *k) for k, n in batch_of.items()) == keys
        assert (got.where("batch = 0").select("feed_url", "pos").orderBy("feed_url", "pos").collect()) == [("f", 1), ("g", 0), ("g", 1)]


def test_a_replayed_batch_replaces_itself_and_reads_only_its_days(spark, tmp_path):
    kept, seen = str(tmp_path / "kept"), str(tmp_path / "seen")
    first, second = (spark.createDataFrame(x, SCHEMA) for x in (FIRST, SECOND))
    dedup.dedup_batch(first, 0, seen, kept)
    for _ in range(2):
        dedup.dedup_batch(second, 1, seen, kept)
    assert sorted(r.link or "" for r in spark.read.parquet(f"{kept}/batch=1").collect()) == ["", "https://e.org/c"]
    days = dedup.load_seen(spark, seen, ["2026-05-01", "1999-01-01"], 9)
    assert {r.day for r in days.collect()} == {"2026-05-01"}
    assert all("day=2026-05-01" in f for f in days.inputFiles())
    assert dedup.load_seen(spark, seen, ["1999-01-01"], 9).count() == 0
    dedup.dedup_batch(first.where("false"), 2, seen, kept)
    assert spark.read.parquet(f"{kept}/batch=2").count() == 0


def test_progress_rows(spark, tmp_path):
    landed, rows = str(tmp_path / "landed"), spark.range(100).withColumn("ok", F.col("id") % 4 == 0)
    rows.repartition(5).write.parquet(landed)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(landed)
    log = progress.ProgressLog(spark, str(tmp_path / "progress"))
    spark.streams.addListener(log)
    try:
        watched = progress.watched(source, done=F.count(F.lit(1)), ok=F.count_if("ok"))
        run = watched.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        run.trigger(availableNow=True).start().awaitTermination()
        assert log.finished() and not log.errors
    finally:
        spark.streams.removeListener(log)
    got = spark.read.parquet(str(tmp_path / "progress")).orderBy("batch").collect()
    assert [r.batch for r in got] == [0, 1, 2]
    assert (sum(r.input_rows for r in got), sum(r.done for r in got), sum(r.ok for r in got)) == (100, 100, 25)


def test_state_starts_from_marks(spark, tmp_path):
    rows = [(f, p, f"https://e.org/{f}{p}", f"2026-01-{20 - p:02d}T00:00:00Z", True, "c") for f in "abcd" for p in range(8)]
    entries = spark.createDataFrame(rows, SCHEMA + ", success boolean, content string")
    marks = spark.createDataFrame([("a", "2026-01-18T00:00:00Z"), ("b", "2030-01-01T00:00:00Z"), ("c", ""), ("e", "x")], "feed_url string, last_id string")
    entries.repartition(3).write.parquet(str(tmp_path / "landed"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        kept = stream.keyed_marks(stream.read_entry_stream(spark, str(tmp_path / "landed"), entries.schema), 5, marks)
        run = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    got = sorted((r.feed_url, r.pos) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = inc.limit_successes(inc.take_until_stale(entries, marks)).collect()
    assert got == sorted((r.feed_url, r.pos) for r in want)
    assert [p for f, p in got if f == "a"] == [0, 1] and not [p for f, p in got if f == "b"]
