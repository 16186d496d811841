"""Streaming forms equal the batch form and survive a replay."""

from pyspark.sql import functions as F

from presslake.operators import incremental as inc
from presslake.sources.state import load_history
from presslake.streaming import incremental as stream
from presslake.workloads import fixtures as fx


def keys(df):
    return sorted((r.feed_url, r.pos) for r in df.select("feed_url", "pos").collect())


def test_replayed_batch_replaces_its_own_output(spark, sf_dir, tmp_path):
    marks, kept = str(tmp_path / "marks"), str(tmp_path / "kept")
    entries = fx.settled(spark, sf_dir)
    older = entries.where("pos % 2 = 1")
    stream.process_batch(older, 0, marks, kept, lambda df: df)
    stream.process_batch(entries, 1, marks, kept, lambda df: df)
    once = keys(spark.read.parquet(kept)), sorted(map(tuple, load_history(spark, marks).collect()))
    stream.process_batch(entries, 1, marks, kept, lambda df: df)
    again = keys(spark.read.parquet(kept)), sorted(map(tuple, load_history(spark, marks).collect()))
    assert once == again

    first = inc.limit_successes(inc.take_until_stale(older, load_history(spark, str(tmp_path / "none"))))
    assert keys(spark.read.parquet(f"{kept}/batch=0")) == keys(first)
    past = inc.history_update(load_history(spark, str(tmp_path / "none")), first)
    second = inc.limit_successes(inc.take_until_stale(entries, past))
    assert keys(spark.read.parquet(f"{kept}/batch=1")) == keys(second)


def test_helpers_travel_by_value(spark):
    """Workers need no copy of the package."""
    from pyspark import cloudpickle

    from presslake.functions import dom, text
    from presslake.functions.charsets import default_model

    for helper in (text._decoder(default_model()), dom._flatten_batch):
        assert b"_make_function" in cloudpickle.dumps(helper.func)
    assert b"_make_skeleton_class" in cloudpickle.dumps(stream._MarkKeeper)
    df = spark.createDataFrame([(bytearray("я".encode("cp1251")),)], "t BINARY").select(text.decode_body(F.col("t"), F.lit("cp1251")).alias("t"))
    assert df.first().t == "я"


def test_two_fetches_in_one_batch(spark, tmp_path):
    rows = [
        ("f", 1, 0, "a", "2026-01-05T00:00:00"), ("f", 1, 1, "old", "2026-01-01T00:00:00"), ("f", 1, 2, "given up", "2026-01-09T00:00:00"),
        ("f", 2, 0, "b", "2026-01-06T00:00:00"), ("f", 2, 1, "a", "2026-01-05T00:00:00"), ("f", 2, 2, "old", "2026-01-01T00:00:00"),
    ]
    entries = spark.createDataFrame(rows, "feed_url STRING, fetch_id BIGINT, pos BIGINT, link STRING, published STRING")
    settled = entries.withColumn("success", F.lit(True)).withColumn("content", F.lit("c"))
    marks, kept = str(tmp_path / "marks"), str(tmp_path / "kept")
    from presslake.sources.state import save_history

    save_history(spark.createDataFrame([("f", "2026-01-02T00:00:00")], "feed_url STRING, last_id STRING"), marks, 0)
    stream.process_batch(settled, 1, marks, kept, lambda df: df)
    got = spark.read.parquet(f"{kept}/batch=1").orderBy("published").collect()
    assert [(r.fetch_id, r.pos, r.link) for r in got] == [(2, 1, "a"), (2, 0, "b")]
    assert load_history(spark, marks).first().last_id == "2026-01-06T00:00:00"


def test_stream_of_documents_equals_the_batch(spark, sf_dir, tmp_path):
    from presslake.sources.feeds import rewrite_entry_links, scan_feed_entries

    docs = fx.feed_documents(spark, sf_dir).select("feed_url", F.lit(1).cast("bigint").alias("fetch_id"), "doc")
    landed = str(tmp_path / "landed")
    docs.repartition(3).write.parquet(landed)

    def settle(df):
        return df.withColumn("success", F.lit(True)).withColumn("content", F.lit("c"))

    kept = str(tmp_path / "kept")
    source = stream.read_document_stream(spark, landed)
    stream.run_stream(source, str(tmp_path / "marks"), kept, str(tmp_path / "checkpoint"), settle).awaitTermination()
    none = inc.history_clear(fx.history(spark, sf_dir))
    batch = inc.limit_successes(settle(inc.take_until_stale(rewrite_entry_links(scan_feed_entries(docs)), none)))
    assert keys(spark.read.parquet(kept)) == keys(batch)
