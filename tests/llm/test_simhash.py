"""SimHash near-duplicates against a brute-force comparison."""

import itertools
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from presslake.llm import simhash
from presslake.llm.common import tune


def plain_fingerprint(text, k=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def test_agrees_with_brute_force(spark):
    tune(spark)
    base = [f"w{i % 17} Word{i % 5} x{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 20 + i % 30])) for i in range(40)]
    rows += [(100 + i, " ".join(base) + " tail" * i) for i in range(6)]
    rows += [(3, rows[3][1]), (None, "a b"), (None, None), (200, ""), (201, " \t"), (202, None), (203, "one"), (204, "É É é"), (205, "x " * 30000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted([tuple(r) for r in simhash.near_duplicates(df).collect()], key=repr)
    assert got == plain(rows)


def test_anchors_meet_every_close_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 32, 400, dtype=np.uint64).astype(np.uint32)
    home, _ = simhash.anchors_of(x)
    assert all(int(a ^ b).bit_count() <= 1 for a, b in zip(x, home))
    for bit in range(32):
        _, near = simhash.anchors_of(x ^ np.uint32(1 << bit))
        assert (near == home[:, None]).any(1).all()


def test_links_are_found_once(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 1, base ^ 3, base ^ (1 << 40), base ^ 1 ^ (1 << 63), base ^ (3 << 33), base ^ 7]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = sorted(tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect())
    want = sorted(tuple(sorted(p)) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & ((1 << 64) - 1)).bit_count() <= 2)
    assert got == want


def test_empty_and_dropping(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(2, "a b c d"), (1, "A b c d"), (None, "a b c d"), (5, "other words stand here now")], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {1, None, 5}


def test_no_fingerprints_are_broadcast(spark):
    # A fingerprint visits some 66 anchors, but Spark takes the visits for as large as the fingerprints: 0.5 GB of documents gave
    # a broadcast of 7.8 million rows.
    tune(spark)
    texts = [(i, " ".join(f"w{i} x{i // 2} {k}" for k in range(30))) for i in range(200)]
    df = spark.createDataFrame(texts + [(1000 + i, t + " tail") for i, t in texts], "doc_id long, text string")
    visits = simhash.links(spark.range(500).select(F.xxhash64("id").alias("fp")))
    assert "Broadcast" not in visits._jdf.queryExecution().toString()
    for out in (simhash.near_duplicates(df), simhash.drop_near_duplicates(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [fp#" in plan
        assert not re.search(r"BroadcastHashJoin [^\n]*(fp|key)#", plan)
