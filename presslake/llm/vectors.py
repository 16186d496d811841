"""What the two vector operators share: which vectors take part, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import bounded


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part.

    A row takes no part if its id or vector is null, or if the vector is empty, all zero, or holds a null or non-finite
    component. Vectors of different lengths are never compared: by_length gives the sets that are.
    """
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def by_length(rows: DataFrame) -> list[tuple[DataFrame, int]]:
    """The rows of each length of vector, with their number. The driver holds one number for each length."""
    found = sorted((r.n, r["count"]) for r in rows.groupBy(F.size("v").alias("n")).count().collect())
    return [(rows if len(found) == 1 else rows.where(F.size("v") == n), total) for n, total in found]


def sample(rows: DataFrame, limit: int, salt: str):
    """(ids, matrix) of at most limit rows, by a hash of their ids: the same ones on every run."""
    import numpy as np

    few = bounded(rows, limit, "vec_id", F.lit(salt)).toArrow()
    return few.column("vec_id").to_numpy(), matrix(few.column("v")) if few.num_rows else np.zeros((0, 1))


def matrix(column):
    """The rows of an Arrow list column of equal lengths."""
    import numpy as np
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))
