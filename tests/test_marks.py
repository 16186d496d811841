"""The log of marks against a plain dictionary, with replays, removals and expiry."""

import os
import random

import pytest

from presslake.sources import marks

SCHEMA = "feed_url string, last_id string"


def state(df):
    rows = df.collect()
    assert len({r.feed_url for r in rows}) == len(rows)
    return {r.feed_url: r.last_id for r in rows}


@pytest.fixture
def short_ring(monkeypatch):
    monkeypatch.setattr(marks, "COMPACT_EVERY", 3)
    monkeypatch.setattr(marks, "RING", 8)


def test_log_equals_a_dictionary(spark, tmp_path, short_ring):
    rng, root, want, history = random.Random(2), str(tmp_path), {}, []
    for version in range(0, 30, 2):
        changed = {f"f{rng.randrange(12)}": f"t{version}-{i}" for i in range(4)}
        gone = {f"f{rng.randrange(12)}" for _ in range(version % 3)} - changed.keys()
        table = spark.createDataFrame(list(changed.items()), SCHEMA)
        removed = spark.createDataFrame([(g,) for g in gone], "feed_url string") if gone else None
        if version % 6 == 2:  # a run that fails half way and is repeated
            marks.append_marks(spark.createDataFrame([("f0", "lost"), ("new", "lost")], SCHEMA), root, version)
        now = marks.append_marks(table, root, version, removed)
        want = {k: v for k, v in {**want, **changed}.items() if k not in gone}
        history.append((version, want))
        assert len(now.deltas) < 3
        if now.deltas:
            assert spark.read.parquet(f"{root}/{now.deltas[-1]}").count() == len(changed) + len(gone)
    assert state(marks.load_marks(spark, root)) == want
    assert state(marks.load_marks(spark, root, before=28)) == history[-2][1]
    some = spark.createDataFrame([("f1",), ("f2",), ("unknown",)], "feed_url string")
    assert state(marks.load_marks(spark, root, feeds=some)) == {k: v for k, v in want.items() if k in ("f1", "f2")}
    slots = {kind: len(os.listdir(tmp_path / kind)) for kind in ("delta", "manifest", "base")}
    assert slots["delta"] <= 8 and slots["manifest"] <= 8 and slots["base"] <= marks.BASES


def test_expired_and_late_versions_are_refused(spark, tmp_path, short_ring):
    root = str(tmp_path)
    assert marks.load_marks(spark, root).count() == 0
    one = spark.createDataFrame([("f", "1")], SCHEMA)
    for version in range(6):
        marks.replace_marks(one, root, version)
    with pytest.raises(ValueError, match="expired"):
        marks.load_marks(spark, root, before=1)
    with pytest.raises(ValueError, match="too late"):
        marks.append_marks(one, root, 3)
    assert state(marks.load_marks(spark, root, before=5)) == {"f": "1"}


def test_nothing_changed(spark, tmp_path):
    root = str(tmp_path)
    marks.replace_marks(spark.createDataFrame([("f", "1")], SCHEMA), root, 0)
    marks.append_marks(spark.createDataFrame([], SCHEMA), root, 1)
    assert state(marks.load_marks(spark, root)) == {"f": "1"}
    assert marks.newest_manifest(spark, root).version == 1
