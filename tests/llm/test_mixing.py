"""Mixing against a plain version of the same queue, and its promises."""

import hashlib
import re
from collections import defaultdict

from presslake.llm import mixing
from presslake.llm.common import tune


def plain(rows, max_repeats=3):
    """rows: (id, text, source) without repeats."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = defaultdict(int)
    for i, _, s in rows:
        total[s] += size[i]
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, free, budget = {}, set(sources), sum(size.values())
    while free:
        rest = budget - sum(target.values())
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= max_repeats * total[s]}
        if not full:
            target.update({s: level * weight[s] for s in free})
            break
        target.update({s: max_repeats * total[s] for s in full})
        free -= full
    line = []
    for s in sources:
        upto = 0
        for name, i in sorted((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i) for i, _, x in rows if x == s):
            upto += size[i]
            if size[i]:
                line += [((upto + k * total[s]) / target[s], name, i) for k in range(max_repeats)]
    taken, used = defaultdict(int), 0
    for _, _, i in sorted(line, key=lambda x: x[:2]):
        used += size[i]
        if used > budget:
            break
        taken[i] += 1
    return {i: (size[i], total[s], target[s], taken[i]) for i, _, s in rows}


def rows_of(n=300):
    sources = ["b", "a", None, "é", "\U0001f600", "z", ""]
    out = [(i, " ".join(["w"] * (1 + i * 7 % 90)), sources[0] if i % 3 else sources[i % 7]) for i in range(n)]
    return out + [(n + 1, None, "b"), (n + 2, " \t\n", "a"), (n + 3, "w " * 20000, "b"), (n + 4, "x", "only"), (n + 5, "", "none")]


def test_agrees_with_plain_queue(spark):
    tune(spark)
    rows = rows_of()
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, source string, key string")
    got = {r.id: (r.size, r.source_size, r.target, r.copies) for r in mixing.plan(df).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    assert all(abs(got[i][2] - want[i][2]) < 1e-6 * max(1, want[i][2]) for i in want)
    assert {i: (*x[:2], x[3]) for i, x in got.items()} == {i: (*x[:2], x[3]) for i, x in want.items()}
    by_source = defaultdict(int)
    for i, _, s in rows:
        by_source[s] += got[i][0] * got[i][3]
    assert sum(by_source.values()) <= sum(x[0] for x in got.values())


def test_mix_repeats_rows(spark):
    tune(spark)
    rows = rows_of(120)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = {r.id: r.copies for r in mixing.plan(df).collect()}
    out = mixing.mix(df)
    assert out.columns == df.columns
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    assert dict(seen) == {i: n for i, n in copies.items() if n}


def test_odd_tables(spark):
    tune(spark)
    schema = "doc_id long, text string, source string"
    assert mixing.plan(spark.createDataFrame([], schema)).count() == 0
    assert [r.copies for r in mixing.plan(spark.createDataFrame([(1, None, None)], schema)).collect()] == [0]
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (None, "d e f", "s")], schema)
    got = {(r.id, r.source, r.mark): r.times for r in mixing.plan(twice).collect()}
    assert sorted(got.values()) == [1, 1, 2]
    assert mixing.mix(twice).where("doc_id = 1").count() % 2 == 0
