"""Whitening of embeddings with components found by contour integration (see feast).

Entries become whole numbers, so sums and deviations are exact. Sums and covariance are gathered in Spark: a task adds up
its own rows, centred before they are multiplied, and the parts meet by matrix entry. Only a dimensions x dimensions
matrix comes to the driver, which finds the components; projecting is row-local.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm import feast
from presslake.llm.common import written
from presslake.llm.vectors import matrix

MOST_DIMENSIONS = 4096
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
LOW32 = (1 << 32) - 1
LARGEST = (1 << 63) - 1


def whole_numbers(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x array<long>, size) of the rows that take part; others have a null vector or a null or non-finite entry."""
    rows = table.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("v is not null")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"), F.size("v").alias("size"))


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension) of the fit list."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(0))
            if not len(x):
                continue
            # Halves of 32 bits, whose sums over a batch cannot pass 64 bits.
            high, low = (x >> 32).sum(0), (x & LOW32).sum(0)
            at = np.arange(size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(size, len(x))), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

    parts = fit.select("x").mapInArrow(run, "at long, n long, high long, low long")
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = {r.at: r for r in parts.groupBy("at").agg(big("n"), big("high"), big("low")).collect()}
    if not found:
        return 0, []
    return int(found[0].n), [(int(found[i].high) << 32) + int(found[i].low) for i in range(size)]


def second_moments(rows: DataFrame, prepare, width: int):
    """The width x width matrix of summed products of what prepare makes of each batch of x vectors."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros((width, width))
        for batch in batches:
            y = prepare(matrix(batch.column(0)))
            total += y.T @ y
        at = np.arange(width * width)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1))], ["at", "value"])

    import numpy as np

    parts = rows.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width * width)
    out[parts.column("at").to_numpy()] = parts.column("value").to_numpy()
    return out.reshape(width, width)


def centred(n: int, total: list[int]):
    """The function from x vectors to x - S / n, whose rounding does not grow with S."""
    import numpy as np

    whole = np.array([s // n for s in total], np.float64)
    rest = np.array([(s % n) / n for s in total])

    def run(x):
        return (x - whole) - rest

    return run


def deviations(x, n: int, total: list[int]) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2, exact; null beyond 64 bits."""
    import numpy as np

    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if reach * reach * max(1, len(total)) <= LARGEST:
        away = n * x - np.array(total, np.int64)
        return (away * away).sum(1).tolist()
    out = []
    for row in x.tolist():
        value = sum((n * a - s) ** 2 for a, s in zip(row, total))
        out.append(value if value <= LARGEST else None)
    return out


def whiten(table: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Rows with a null vector or with null or non-finite entries are left out. Each entry c becomes floor(scale * c). The
    fit list is each different vector once, however often it is repeated. Vectors of another length are a set of their
    own, with their own fit list and components; an empty vector has no component. There are as many components as
    dimensions, `components` at most, numbered from 1 by falling eigenvalue of the covariance; of equal eigenvalues any
    orthogonal choice. A component without variance has whitened null and explained 0 (null if nothing varies). deviation
    is null where it passes 64 bits. A null id is kept. An empty table gives no rows. Other columns are not looked at.
    At most MOST_DIMENSIONS dimensions.
    """
    rows = whole_numbers(table, id_col, vector_col, scale).where("size > 0")
    distinct = written(rows.select("x", "size").distinct(), "whitening-fit")
    sizes = sorted(r.size for r in distinct.select("size").distinct().collect())
    if sizes and sizes[-1] > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {sizes[-1]} dimensions; at most {MOST_DIMENSIONS}")
    out = table.sparkSession.createDataFrame([], _OUT)
    for i, size in enumerate(sizes):
        part = _whitened(rows.where(F.col("size") == size), distinct.where(F.col("size") == size), size, components)
        out = part if i == 0 else out.unionByName(part)
    return out


def _whitened(rows: DataFrame, fit: DataFrame, size: int, components: int) -> DataFrame:
    import numpy as np

    n, total = sums(fit, size)
    away = centred(n, total)
    covariance = second_moments(fit, away, size) / n
    values, vectors = feast.largest(covariance, components)
    trace = float(np.trace(covariance))
    varies = values > size * np.finfo(float).eps * max(trace, 0.0)
    turn = vectors[:, varies] / np.sqrt(values[varies])
    explained = (np.where(varies, values, 0.0) / trace).tolist() if trace > 0 else [None] * len(values)
    width = int(varies.sum())
    error = None
    if width:
        error = float(np.abs(second_moments(fit, lambda x: away(x) @ turn, width) / n - np.eye(width)).max())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            made = away(x) @ turn
            far = pa.array(deviations(x, n, total), pa.int64())
            for i in range(len(values)):
                whitened = pa.array(made[:, i]) if i < width else pa.nulls(len(x), pa.float64())
                columns = [batch.column(0), pa.array([i + 1] * len(x), pa.int32()), pa.array([n] * len(x)), far, whitened,
                           pa.array([explained[i]] * len(x), pa.float64()), pa.array([error] * len(x), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(run, _OUT.replace("vec_id long", f"vec_id {kind}"))
