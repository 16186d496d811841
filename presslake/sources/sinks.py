"""Result files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from presslake.operators.results import to_result_json


def write_results(nested: DataFrame, path: str) -> None:
    """One JSON line per feed, UTF-8, NULL fields kept."""
    to_result_json(nested).select("json").write.mode("overwrite").text(path)
