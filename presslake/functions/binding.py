"""Evaluate an expression once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row.

    Spark does not share repeated sub-expressions inside array lambdas, so a value used several times there, or
    fed to one, is bound through a one-element array. It also lets a Python helper's result enter a lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_let(value: str, name: str, body: str) -> str:
    """The same in SQL text: body over name, bound to value."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def row_sql(body: str, **values: Column) -> Column:
    """SQL text over named columns, each computed once; the text sees them as v.name.

    Long expressions are written this way because Spark parses one text much faster than Python can build the same
    tree call by call.
    """
    packed = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.get(F.call_function("transform", F.array(packed), F.expr(f"v -> {body}")), F.lit(0))


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column whose value is computed once per row, however often later steps use it.

    Predicates and projections are otherwise rewritten in terms of the expression itself, and a costly one would run
    again in each of them. Exploding a one-element array is a row-local step that they cannot be pushed through.
    """
    keep = [c for c in df.columns if c != name]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.explode(F.array(value)).alias(name))
