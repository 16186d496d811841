"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on a bounded sample: each node splits its vectors at the median of their projection on a random
direction, the difference of two random vectors drawn towards the two halves they attract. Every row of the table is
indexed: it lies in one leaf of each tree. A query walks all trees through one priority queue, ordered by how far it
lies beyond the splits on the way, and so visits a number of leaves; the rows in them are ranked exactly.

How many leaves are visited is not guessed: a bounded set of audit queries is answered by brute force, and the smallest
number that reaches the target recall on them is taken. The first of them are searched ahead of the rest; the k-th
distance found there bounds what the other leaves have to report.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslake.llm.common import written
from presslake.llm.vectors import by_length, matrix, sample, usable

TREES, LEAF_ROWS, SAMPLE_ROWS, GROUP_ROWS = 8, 200, 20000, 50000
AUDIT_QUERIES, TARGET = 100, 0.96


@dataclass
class Tree:
    """A node k below 2 ** depth - 1 has the children 2k + 1 and 2k + 2; leaves are numbered from 0."""

    depth: int
    normals: object
    cuts: object


def grow(points, depth: int, rng) -> Tree:
    import numpy as np

    nodes = (1 << depth) - 1
    normals, cuts = np.zeros((nodes, points.shape[1])), np.zeros(nodes)
    held = {0: np.arange(len(points))}
    for node in range(nodes):
        here = held.pop(node)
        if len(here) > 1:
            near = points[rng.choice(here, min(len(here), 400), replace=False)]
            a, b = near[0], near[1]
            for _ in range(4):
                first = ((near - a) ** 2).sum(1) < ((near - b) ** 2).sum(1)
                if first.all() or not first.any():
                    break
                a, b = near[first].mean(0), near[~first].mean(0)
            normal = a - b if (a != b).any() else rng.normal(size=points.shape[1])
            normals[node] = normal / (np.linalg.norm(normal) or 1.0)
            cuts[node] = np.median(points[here] @ normals[node])
        right = points[here] @ normals[node] > cuts[node]
        held[2 * node + 1], held[2 * node + 2] = here[~right], here[right]
    return Tree(depth, normals, cuts)


def leaves_of(tree: Tree, points):
    """The leaf of each point."""
    import numpy as np

    node = np.zeros(len(points), np.int64)
    for _ in range(tree.depth):
        side = np.einsum("ij,ij->i", points, tree.normals[node]) > tree.cuts[node]
        node = 2 * node + 1 + side
    return node - ((1 << tree.depth) - 1)


def visit(trees: list[Tree], query, visits: int) -> list[tuple[int, int]]:
    """The first (tree, leaf) pairs on the way of a query through all trees, by one queue."""
    import heapq

    margins = [tree.normals @ query - tree.cuts for tree in trees]
    queue = [(0.0, t, 0) for t in range(len(trees))]
    found: list[tuple[int, int]] = []
    while queue and len(found) < visits:
        beyond, t, node = heapq.heappop(queue)
        inner = (1 << trees[t].depth) - 1
        while node < inner:
            margin = float(margins[t][node])
            near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(beyond, abs(margin)), t, far))
            node = near
        found.append((t, node - inner))
    return found


def distances(query, points):
    import numpy as np

    return np.sqrt(((points - query) ** 2).sum(1))


def nearest(query_id: int, query, ids, points, k: int):
    """(ids, distances) of the k nearest rows but the query's own, ties to the smaller id."""
    import numpy as np

    far = distances(query, points)
    order = np.lexsort((ids, far))
    order = order[ids[order] != query_id][:k]
    return ids[order], far[order]


RESULT = "query_id long, vec_id long, score double"


def _result(rows: list):
    import numpy as np
    import pyarrow as pa

    none = np.zeros(0)
    q = np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in rows] or [none.astype(np.int64)])
    i = np.concatenate([i for _, i, _ in rows] or [none.astype(np.int64)])
    s = np.concatenate([s for _, _, s in rows] or [none])
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; a row found in several places counts once. At most k a query and task are shuffled."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(rows: DataFrame, query_ids, queries, k: int) -> DataFrame:
    """Brute force for a few queries: every block of rows gives its own k nearest."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, points = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            yield from _result([(int(q), *nearest(q, x, ids, points, k)) for q, x in zip(query_ids, queries)]).to_batches()

    return best(rows.select("vec_id", "v").mapInArrow(run, RESULT), k)


def visits_for(trees: list[Tree], queries, neighbours, target: float) -> int:
    """The fewest leaves with which the share target of the queries' true neighbours (one matrix each) is met."""
    import numpy as np

    leaves = len(trees) << trees[0].depth
    needed = []
    for query, true in zip(queries, neighbours):
        rank = {leaf: n for n, leaf in enumerate(visit(trees, query, leaves), 1)}
        where = np.stack([leaves_of(tree, true) for tree in trees])
        needed += [min(rank[t, int(leaf)] for t, leaf in enumerate(column)) for column in where.T]
    return int(np.quantile(needed, target, method="higher")) if needed else 1


def search(table: DataFrame, queries: Column, k: int = 10, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
           sample_rows: int = SAMPLE_ROWS, target: float = TARGET, audit_queries: int = AUDIT_QUERIES, seed: int = 6,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of table where queries (over vec_id) holds.

    Nearness is Euclidean distance in double precision, ties to the smaller id; a query's own id is no candidate.
    vectors.usable says which rows take part; a query that takes no part has no result, an empty table no rows.
    Candidates are the rows whose vectors have the query's length. Fewer than k candidates give fewer rows. Of rows that
    repeat an id, each is indexed, and the nearest counts; asked is the one with the shortest, then least vector. Of equal
    vectors only the k + 1 smallest ids can be among k nearest, so only those are indexed. Other columns of table,
    whatever their names, are not read.

    Bounds: sample_rows vectors grow the trees, so that there are at most sample_rows / 8 leaves in a tree, and
    audit_queries queries are answered by brute force; leaves with more than GROUP_ROWS rows are dealt into parts.
    """
    rows = written(usable(table, id_col, vector_col), "vectors")
    least = F.min(F.struct(F.size("v").alias("n"), "v")).alias("least")
    asked = rows.where(queries).groupBy("vec_id").agg(least).select("vec_id", "least.v")
    parts = [
        _search(part, asked.where(F.size("v") == F.lit(part.select(F.size("v")).first()[0])), k, trees, leaf_rows, sample_rows, target, audit_queries, seed)
        for part, _ in by_length(rows)
    ]
    return reduce(DataFrame.union, parts) if parts else best(rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("score")), k)


def _search(rows: DataFrame, asked: DataFrame, k: int, trees: int, leaf_rows: int, sample_rows: int, target: float,
            audit_queries: int, seed: int) -> DataFrame:
    """search over rows (vec_id, v), whose vectors have one length, for the rows asked."""
    import numpy as np

    equal = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    indexed = written(rows.withColumn("n", equal).where(F.col("n") <= k + 1).drop("n"), "indexed")
    total = indexed.count()
    _, points = sample(indexed, sample_rows, "trees")
    depth = max(0, min(int(np.log2(max(1, total / leaf_rows))), int(np.log2(max(1, len(points) / 8)))))
    forest = [grow(points, depth, np.random.default_rng([seed, t])) for t in range(trees)]
    audit_ids, audit = sample(asked, audit_queries, "audit")
    visits = 1
    if depth and len(audit):
        true = exact(indexed, audit_ids, audit, k).join(indexed, "vec_id").select("query_id", "v").toArrow()
        owner, near = true.column("query_id").to_numpy(), matrix(true.column("v"))
        visits = visits_for(forest, audit, [near[owner == q] for q in audit_ids], target)
    first = min(visits, max(trees, visits // 8))
    parts = max(1, -(-total // ((1 << depth) * GROUP_ROWS)))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            points = matrix(batch.column(1))
            for t, tree in enumerate(forest):
                leaf = leaves_of(tree, points).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf), *batch.columns], ["tree", "leaf", "vec_id", "v"]
                )

    def ask(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            points, radius = matrix(batch.column(1)), batch.column(2)
            later = radius.null_count == 0
            found = [visit(forest, x, visits)[first:] if later else visit(forest, x, first) for x in points]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            flat = np.array([x for f in found for x in f], np.int32).reshape(-1, 2)
            columns = [pa.array(flat[:, 0]), pa.array(flat[:, 1]), *(c.take(owner) for c in batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "vec_id", "v", "radius"])

    def rank(left, right):
        rows = []
        if left.num_rows:
            ids, points = left.column("vec_id").to_numpy(), matrix(left.column("v"))
            asked_ids, asked = right.column("vec_id").to_numpy(), matrix(right.column("v"))
            for q, x, radius in zip(asked_ids, asked, right.column("radius").to_pylist()):
                near, far = nearest(q, x, ids, points, k)
                inside = slice(None) if radius is None else far <= radius
                rows.append((int(q), near[inside], far[inside]))
        return _result(rows)

    schema = "tree int, leaf int, vec_id long, v array<double>"
    key = ["tree", "leaf", "part"]
    placed = indexed.select("vec_id", "v").mapInArrow(place, schema)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))

    def searched(queries: DataFrame) -> DataFrame:
        asking = queries.mapInArrow(ask, schema + ", radius double")
        asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return placed.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(rank, RESULT)

    early = best(searched(asked.select("vec_id", "v", F.lit(None).cast("double").alias("radius"))), k)
    if first >= visits:
        return early
    early = written(early, "early")
    kth = early.groupBy("query_id").agg(F.max("score").alias("far"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    bounded_ = asked.join(kth, asked.vec_id == kth.query_id, "left").select("vec_id", "v", F.coalesce(bound, F.lit(float("inf"))).alias("radius"))
    return best(early.select("query_id", "vec_id", "score").union(searched(bounded_)), k)
