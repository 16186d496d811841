"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source's documents stand in a shuffled line (by the md5 of their ids), which is gone through max_repeats times. A place in
the line finishes at a virtual time: the source's words up to and including it, divided by the source's target. Sorted by
finish time over all sources, the places are taken until the total budget is used up; with these weights every source
comes to its own target at virtual time 1.

No running sum goes over a source or over the corpus in one task. Keys are cut into LEVELS nested groups of FAN parts:
sums of groups are aggregated partially, running sums are formed over at most FAN groups at each level, and only within
a group of the last level over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.llm.common import never_broadcast, written

FAN, LEVELS = 128, 3
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, group: Sequence[str], place: Column, order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows of its group up to its own, by `place`, then `order`.

    place is a number from 0 to below FAN ** LEVELS that never falls along the order; the better it spreads the rows, the
    smaller the groups within which rows are sorted. No hash or range of the physical rows is involved, so a task that
    runs again gives the same sums.
    """
    cuts = [f"_g{k}" for k in range(1, LEVELS + 1)]
    whole = F.floor(place)
    spread = df.withColumns({c: F.floor(whole / F.lit(FAN ** (LEVELS - k))).cast("int") for k, c in enumerate(cuts, 1)})
    inner = Window.partitionBy(*group, cuts[-1]).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = spread.withColumn(name, F.sum(value).over(inner))
    sums = spread.groupBy(*group, *cuts).agg(F.sum(value).alias("_sum"))
    before = None
    for k in range(1, LEVELS + 1):
        level = sums if k == LEVELS else sums.groupBy(*group, *cuts[:k]).agg(F.sum("_sum").alias("_sum"))
        over = Window.partitionBy(*group, *cuts[: k - 1]).orderBy(cuts[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("_b", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
        if before is not None:
            level = level.join(never_broadcast(before), [*group, *cuts[: k - 1]])
            level = level.withColumn("_b", F.col("_b") + F.col("_before")).drop("_before")
        before = level.withColumnRenamed("_b", "_before")
    before = before.select(*group, cuts[-1], "_before")
    out = out.join(never_broadcast(before), [*group, cuts[-1]])
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_before", *cuts)


def targets(sizes: DataFrame, cycle: Sequence[int] = (1, 2, 3), max_repeats: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, target double) from (source, source_size): one row per source.

    Sources by code point, null last, have the weights of cycle, repeating. The budget is share of all sizes. A target
    stops at max_repeats times its source's size, and the excess is shared again by weight until none is above: sources
    stop in the order of size over weight, so the number of stopped ones is found from running sums in that order.
    There is one row per source here, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = (F.row_number().over(by_name) - 1) % len(cycle)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in cycle]), (rank + 1).cast("int"))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    upto = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    df = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    df = df.withColumn("budget", F.round(F.sum("source_size").over(everything) * F.lit(share)).cast("long"))
    df = df.withColumns(
        {
            "rest": F.col("budget") - F.coalesce(F.sum("cap").over(upto), F.lit(0)),
            "weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
        }
    )
    # A source stops if, with all before it stopped, its share of the rest reaches its cap.
    df = df.withColumn("stops", F.col("rest") * F.col("weight") >= F.col("cap") * F.col("weights"))
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "rest", "weights")))
    df = df.withColumn("free", first.over(everything))
    shared = F.col("free.rest") * F.col("weight") / F.col("free.weights")
    target = F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(shared)
    return df.select(*sizes.columns, target.cast("double").alias("target"), "budget")


def plan(docs: DataFrame, cycle: Sequence[int] = (1, 2, 3), max_repeats: int = 3, share: float = 1.0,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, mark, times, size, source_size, target, copies): how often the mix takes each document.

    Rows with the same id, source and text are one document with their number in times; it is taken as a whole, each of
    the rows equally often. mark is xxhash64 of the text. A null text has size 0, and a document without words is never
    taken. A null source is a source of its own, the last one; a null id stands in line as an empty one. Without words
    the mix is empty.
    """
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), F.xxhash64(text).alias("mark"), words_in(text).alias("size"))
    rows = rows.groupBy("id", "source", "mark", "size").agg(F.count("*").alias("times"))
    # A null source as a key that no other source has.
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = written(rows.withColumn("words", F.col("size") * F.col("times")), "sizes")
    per_source = rows.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    goals = written(targets(per_source, cycle, max_repeats, share), "targets")

    line = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    waiting = rows.where("size > 0").withColumn("line", line)
    first = F.conv(F.substring("line", 1, 7), 16, 10).cast("long")
    queue = running_sum(waiting, ["key"], first * F.lit(FAN**LEVELS) / F.lit(16**7), ["line", "mark"], "words", "upto")
    queue = queue.join(goals.drop("source"), "key").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    finish = (F.col("upto") + F.col("turn") * F.col("source_size")) / F.col("target")
    queue = queue.withColumn("finish", finish).withColumn("all", F.lit(0))
    time = F.col("finish") / (F.col("finish") + 1) * F.lit(FAN**LEVELS - 1)
    order = ["finish", "line", "mark", "key"]
    taken = running_sum(queue, ["all"], time, order, "words", "used").where("used <= budget")
    copies = taken.groupBy("key", "line", "mark").agg(F.count("*").alias("copies"))
    named = never_broadcast(rows.withColumn("line", line)).join(copies, ["key", "line", "mark"], "left")
    named = named.join(goals.drop("source"), "key")
    return named.select(
        "id", "source", "mark", "times", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("copies")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: docs' rows, each as often as plan() takes it; the columns are those of docs."""
    chosen = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
    chosen = chosen.select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark"), F.col("copies").alias("_copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = rows.withColumn("_text_mark", F.xxhash64(F.col(f"_row.`{text_col}`")))
    same = (
        F.col(f"_row.`{id_col}`").eqNullSafe(F.col("_id"))
        & F.col(f"_row.`{source_col}`").cast("string").eqNullSafe(F.col("_source"))
        & (F.col("_text_mark") == F.col("_mark"))
    )
    joined = never_broadcast(rows).join(chosen, same)
    return joined.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_row.*")
