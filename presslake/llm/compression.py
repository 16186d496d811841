"""What the two compression classifiers share: bounded labelled samples, dictionaries, calibration, row-local scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from presslake.llm.common import bounded, own_columns, utf8


def labelled(labels: DataFrame, label: str, id_col: str, train: Column | None) -> DataFrame:
    """(doc_id, label): one row for each labelled id of the training part; of several labels of an id the least."""
    rows = labels if train is None else labels.where(train)
    rows = rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    return rows.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))


def sample_ids(rows: DataFrame, part: int, limit: int, where: str = "true") -> DataFrame:
    """At most limit rows of one half of the labelled ids, by a hash of the id: the same ones on every run."""
    half = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == part).where(where)
    return bounded(half, limit, "doc_id")


def pieces(docs: DataFrame, ids: DataFrame, chars: int, id_col: str, text_col: str) -> list[tuple[int, bytes]]:
    """(label, text) of sampled ids, in order of id; of a longer text, chars characters from a place set by its id.

    The ids are few by sample_ids' limit, which bounds both what is broadcast and what comes to the driver.
    """
    rows = own_columns(docs, doc_id=id_col, text=text_col).join(F.broadcast(ids), "doc_id")
    room = F.greatest(F.length("text") - F.lit(chars), F.lit(0)) + 1
    start = F.pmod(F.xxhash64("doc_id", F.lit("place")), room).cast("int") + 1
    cut = rows.select("doc_id", "label", F.substring("text", start, F.lit(chars)).alias("text"))
    return [(r.label, (r.text or "").encode()) for r in sorted(cut.collect(), key=lambda r: (str(r.doc_id), r.text or ""))]


def logistic(features, labels, penalty: float = 1e-3) -> dict:
    """Logistic regression by Newton's method on standardised features."""
    import numpy as np

    x, y = np.asarray(features, float), np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        # One class or none: the share seen, drawn a little towards one half.
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return {"mean": 0.0, "scale": 1.0, "weights": None, "bias": float(np.log(share / (1 - share)))}
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty * len(y))
    ridge[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), slope)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return {"mean": mean, "scale": scale, "weights": w[:-1], "bias": float(w[-1])}


def probability(model: dict, features):
    import numpy as np

    x = np.asarray(features, float)
    if model["weights"] is None:
        return np.full(len(x), 1 / (1 + np.exp(-model["bias"])))
    line = ((x - model["mean"]) / model["scale"]) @ model["weights"] + model["bias"]
    return 1 / (1 + np.exp(-np.clip(line, -30, 30)))


def compressor(content: bytes, level: int, raw: bool):
    """A compressor primed with a dictionary, or with plain content, or with nothing."""
    import zstandard

    options = {"level": level, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
    if not content:
        return zstandard.ZstdCompressor(**options)
    kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
    primed = zstandard.ZstdCompressionDict(content, dict_type=kind)
    primed.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=primed, **options)


def with_features(docs: DataFrame, text_col: str, width: int, prepare: Callable, keep: list[str]) -> DataFrame:
    """The keep columns of docs and features: prepare() makes, once per task, the function from a text to width numbers."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features_of = prepare()
        for batch in batches:
            found = [features_of(x) for x in utf8(batch.column(len(keep)))]
            out = pa.array(found, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], out], [*keep, "features"])

    return rows.mapInArrow(run, rows.select(*[f"`{c}`" for c in keep]).schema.add("features", ArrayType(DoubleType())))


def calibrated(docs: DataFrame, ids: DataFrame, prepare: Callable, width: int, id_col: str, text_col: str) -> dict:
    """The calibration fitted on whole texts of sampled ids; only their numbers come to the driver."""
    rows = own_columns(docs, doc_id=id_col, text=text_col).join(F.broadcast(ids), "doc_id")
    seen = with_features(rows, "text", width, prepare, ["doc_id", "label"]).orderBy("doc_id").collect()
    return logistic([r.features for r in seen] or [[0.0] * width], [r.label for r in seen])


def scored(docs: DataFrame, text_col: str, prepare: Callable, width: int, model: dict, keep: list[str]) -> DataFrame:
    """The keep columns of docs, and score."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        features_of = prepare()
        for batch in batches:
            found = np.array([features_of(x) for x in utf8(batch.column(len(keep)))], float).reshape(-1, width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(probability(model, found))], [*keep, "_score"]
            )

    return rows.mapInArrow(run, rows.select(*[f"`{c}`" for c in keep]).schema.add("_score", "double"))
