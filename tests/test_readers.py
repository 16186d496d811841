"""Readers of landed files and marks as lines."""

import json

from presslake.sources import pages, state


def test_configuration_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"url": "https://e.org/opml", "threads": 5, "his": {"f": "1", "g": "2"}}))
    (tmp_path / "bad.json").write_text("{")
    rows = {r.url: r for r in state.config_valid(state.read_config(spark, str(tmp_path))).collect()}
    assert rows["https://e.org/opml"].valid and rows["https://e.org/opml"].his == {"f": "1", "g": "2"}
    assert not rows[None].valid and rows[None]._corrupt_record is not None


def test_marks_as_lines(spark, tmp_path):
    marks = [("f", "2026-01-01T00:00:00Z"), ("g", "x \"y\"")]
    lines = state.history_to_config(spark.createDataFrame(marks, "feed_url string, last_id string"))
    assert sorted(tuple(json.loads(r.value).values()) for r in lines.collect()) == marks


def test_pages_are_read_back(spark, tmp_path):
    rows = [("u", "<p>", None), ("v", None, "http")]
    spark.createDataFrame(rows, "url string, html string, error_kind string").write.parquet(str(tmp_path / "pages"))
    assert sorted(map(tuple, pages.read_pages(spark, str(tmp_path / "pages")).collect())) == rows
