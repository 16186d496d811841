"""Nearest neighbours: exact scores and order, recall against brute force, odd vectors."""

import math

import numpy as np
from pyspark.sql import functions as F

from presslake.llm import forest
from presslake.llm.common import tune
from presslake.llm.queries import QUERIES


def brute(rows, wanted, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in ok:
        if wanted(q):
            near = sorted((math.sqrt(((x - y) ** 2).sum()), i) for i, y in ok if i != q and len(x) == len(y))[:k]
            if near:
                out[q] = near
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_table_is_exact(spark):
    tune(spark)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    rows += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [1.0, float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (205, [1.0, 2.0]), (206, []), (-1, [1.0, 2.5]), (210, [0.5, 2.5]), (215, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = found(forest.search(df, F.col("vec_id") % 5 == 0, k=10))
    want = brute(rows, lambda q: q % 5 == 0, 10)
    assert got.keys() == want.keys() and len(got[205]) == 2 and 215 not in got
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)
    few = forest.search(df.where("vec_id in (0, 1, 2, 200)"), F.lit(True), k=10)
    assert {q: len(x) for q, x in found(few).items()} == {0: 2, 1: 2, 2: 2}
    assert forest.search(df.where("false"), F.lit(True)).count() == 0


def test_recall_over_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    got = found(QUERIES["op6_approximate_nearest_neighbours"](spark, sf))
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, lambda q: q % 100 == 0, 10)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_trees_are_searched(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(500, 8))
    trees = [forest.grow(points, 4, np.random.default_rng(t)) for t in range(3)]
    for tree in trees:
        sizes = np.bincount(forest.leaves_of(tree, points), minlength=16)
        assert sizes.sum() == 500 and sizes.max() < 80
    order = forest.visit(trees, points[7], 48)
    assert len(set(order)) == 48
    assert {(t, int(forest.leaves_of(tree, points[7:8])[0])) for t, tree in enumerate(trees)} == set(order[:3])
    assert forest.visits_for(trees, points[:5], [points[i : i + 1] for i in range(5)], 1.0) <= 3
