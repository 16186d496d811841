"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest

from presslake.llm import graph
from presslake.llm.common import tune
from presslake.llm.queries import QUERIES


def brute(rows, threshold):
    ok = {k: np.array(v, float) / np.linalg.norm(v) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    keys = list(ok)
    close = np.zeros((len(keys), len(keys)), bool)
    for n in {len(v) for v in ok.values()}:
        at = np.flatnonzero([len(ok[k]) == n for k in keys])
        x = np.array([ok[keys[k]] for k in at])
        close[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(close, False)
    label = {k: rows[k][0] for k in keys}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(close)):
            low = min(label[keys[a]], label[keys[b]])
            for c in (keys[a], keys[b]):
                if label[c] != low:
                    label[c], changed = low, True
    links = dict(zip(keys, close.sum(1).tolist()))
    return sorted([(i, links.get(k, 0), label.get(k, i), i is not None and label.get(k, i) == i) for k, (i, _) in enumerate(rows)], key=repr)


@pytest.mark.parametrize("sizes", [{}, {"cluster_rows": 60, "shard_rows": 50, "sample_rows": 400, "overlap": 3}])
def test_agrees_with_brute_force(spark, sizes):
    tune(spark)
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v)
    rows, n = [], 0
    for size in [1] * 200 + [2] * 20 + [5] * 6 + [90]:
        center = unit(rng.normal(size=32))
        for _ in range(size):
            rows.append((n, (unit(center + 0.02 * rng.normal(size=32)) * rng.uniform(0.5, 2)).tolist()))
            n += 1
    chain = [unit(rng.normal(size=32))]
    for _ in range(12):
        step = rng.normal(size=32)
        step -= (step @ chain[-1]) * chain[-1]
        chain.append(unit(chain[-1] * 0.97 + unit(step) * np.sqrt(1 - 0.97**2)))
    rows += [(n + 5 + i, v.tolist()) for i, v in enumerate(chain)]
    rows += [(2000 + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1])]
    rows += [(3000, None), (3001, [0.0] * 32), (3002, [None] + [1.0] * 31), (3003, [float("nan")] * 32), (None, rows[3][1]), (None, None), (3004, []), (-1, [1.0, 2.0]), (3005, [2.0, 4.1]), (3006, [-1.0, 2.0]), (3007, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int").repartition(4)
    got = sorted([tuple(r) for r in graph.near_duplicates(df, **sizes).collect()], key=repr)
    assert got == brute(rows, 0.95)
    assert graph.near_duplicates(df.where("false")).count() == 0


def test_given_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted([tuple(r) for r in QUERIES["op1_embedding_near_dedup"](spark, sf).collect()], key=repr)
    assert got == brute(rows, 0.95)


def test_prune_keeps_the_nearest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = np.tile(np.arange(80), (80, 1))
    out = graph.robust_prune(x, lists, 8)
    close = x @ x.T - 2 * np.eye(80)
    assert (out[:, 0] == close.argmax(1)).all()
    assert (out != np.arange(80)[:, None]).all()
    for row in out:
        kept = row[row >= 0]
        assert len(set(kept.tolist())) == len(kept)


def mixed(rng, hot):
    unit = lambda v: v / np.linalg.norm(v)
    points = [unit(c + 0.02 * rng.normal(size=32)) for n in [1] * 100 + [2] * 60 + [hot] for c in [unit(rng.normal(size=32))] for _ in range(n)]
    return [(i, v.tolist()) for i, v in enumerate(points)]


def test_a_lossy_search_is_noticed_and_settled(spark, monkeypatch):
    # All links of small groups are lost; those of a large group outnumber them by far.
    tune(spark)
    rows = mixed(np.random.default_rng(6), 1200)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    whole = graph._links
    monkeypatch.setattr(graph, "_links", lambda *a: whole(*a).where("(a is null and linked > 2) or a >= 220"))
    got = sorted([tuple(r) for r in graph.near_duplicates(df, shard_rows=500).collect()], key=repr)
    assert got == brute(rows, 0.95)


def test_links_across_shards_need_no_walk(spark, monkeypatch):
    # Pairs near one another, too close for centroids of their own: one cluster, and half of the pairs in different shards.
    tune(spark)
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v)
    middle = unit(rng.normal(size=128))
    points = [unit(c + 0.01 * rng.normal(size=128)) for _ in range(150) for c in [unit(middle + 0.043 * rng.normal(size=128))] for _ in range(2)]
    rows = [(i, v.tolist()) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(graph, "TRIES", 1)
    monkeypatch.setattr(graph, "_settled", None, raising=False)
    # A walk that gets stuck where it starts.
    monkeypatch.setattr(graph, "greedy", lambda points, edges, queries, starts, beam: starts)
    got = sorted([tuple(r) for r in graph.near_duplicates(df, shard_rows=160).collect()], key=repr)
    assert got == brute(rows, 0.95)
