"""Quality by compression: one zstandard dictionary of good and one of bad text; the text is like the one that helps more.

The difference of the two compressed sizes, divided by the larger, is calibrated by logistic regression. Dictionaries and
calibration are fitted on two bounded, disjoint samples of labelled rows, chosen by a hash of the id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from presslake.llm import compression as c

WIDTH = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    raw: bool
    level: int
    calibration: dict


def features(good: bytes, bad: bytes, raw: bool, level: int):
    import math

    by_good, by_bad = c.compressor(good, level, raw), c.compressor(bad, level, raw)

    def of(text: bytes) -> tuple[float, ...]:
        a, b = len(by_good.compress(text)), len(by_bad.compress(text))
        gain = (b - a) / max(a, b)
        # The gain of a short text is dominated by the frame, so length decides how far it is trusted.
        return gain, gain * math.log1p(len(text)), a / (len(text) + 20)

    return of


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train: Column | None = None, per_class: int = 4000,
        piece_chars: int = 2000, calibration_rows: int = 10000, dictionary_bytes: int = 112640, level: int = 3,
        id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model from labels (doc_id, label 0 or 1; 1 is good) of docs.

    Bounds: per_class rows of each label with piece_chars characters of each for the dictionaries, calibration_rows
    whole texts, of which only WIDTH numbers leave the workers. Too few rows to train a dictionary: their plain content
    serves as one. Only one label, or none: the score is that share for every text.
    """
    import zstandard

    rows = c.labelled(labels, label, id_col, train)
    few = c.sample_ids(rows, 0, per_class, "label = 1").union(c.sample_ids(rows, 0, per_class, "label = 0"))
    sample = c.pieces(docs, few, piece_chars, id_col, text_col)
    parts = {k: [t for x, t in sample if x == k and t] for k in (0, 1)}
    try:
        good, bad = (zstandard.train_dictionary(dictionary_bytes, parts[k], level=level).as_bytes() for k in (1, 0))
        raw = False
    except zstandard.ZstdError:
        good, bad = (b"\n".join(parts[k])[:dictionary_bytes] for k in (1, 0))
        raw = True
    model = c.calibrated(
        docs, c.sample_ids(rows, 1, calibration_rows), lambda: features(good, bad, raw, level), WIDTH, id_col, text_col
    )
    return QualityModel(good, bad, raw, level, model)


def score(docs: DataFrame, model: QualityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The keep columns of docs with _score, the chance of label 1. Whole texts, row by row; a null text is empty."""
    good, bad, raw, level = model.good, model.bad, model.raw, model.level
    return c.scored(docs, text_col, lambda: features(good, bad, raw, level), WIDTH, model.calibration, keep)
