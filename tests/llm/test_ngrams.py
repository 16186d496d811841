"""The n-gram model against a plain version, its normalisation, and what it gains on held-out texts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from presslake.llm import ngrams
from presslake.llm.common import tune
from presslake.llm.queries import QUERIES


def tokens_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


class Plain:
    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            w = tokens_of(t)
            self.c.update(w)
            self.pairs.update(zip(["<s>", *w], w))
        self.N, self.V = sum(self.c.values()), len(self.c)
        self.before, self.after = Counter(b for _, b in self.pairs), defaultdict(Counter)
        for (a, b), n in self.pairs.items():
            self.after[a][b] = n
        self.d2 = ngrams.discounts(*(sum(n == k for n in self.pairs.values()) for k in (1, 2, 3, 4)))
        self.d1 = ngrams.discounts(*(sum(n == k for n in self.before.values()) for k in (1, 2, 3, 4)))

    def lower(self, b):
        types = len(self.pairs)
        off = lambda n: 0 if n == 0 else self.d1[min(n, 3) - 1]
        rest = sum(off(n) for n in self.before.values()) / types
        return (self.before[b] - off(self.before[b])) / types + rest / (self.V + 1)

    def p(self, a, b):
        seen = self.after.get(a)
        if not seen:
            return self.lower(b)
        off = lambda n: 0 if n == 0 else self.d2[min(n, 3) - 1]
        left = sum(off(n) for n in seen.values())
        n = seen[b] if b in seen else 0
        return (n - off(n) + left * self.lower(b)) / sum(seen.values())

    def score(self, text):
        w = tokens_of(text)
        base = sum(math.log10((self.c[x] + 1) / (self.N + self.V + 1)) for x in w)
        return len(w), sum(self.c[x] > 0 for x in w), base, sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *w], w))


def sample():
    rnd = random.Random(2)
    words = [f"W{int(rnd.paretovariate(0.7))}é" for _ in range(4000)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    return rows + [(500, None), (501, " \n"), (None, "w1é w2é"), (7, rows[7][1]), (502, "the " * 5000), (503, "new Words only")]


def test_agrees_with_plain_model(spark):
    tune(spark)
    rows = sample()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int").repartition(5)
    train = F.coalesce(F.col("doc_id") % 5, F.lit(1)) != 0
    model = ngrams.fit(df, train=train, buckets=7)
    plain = Plain([t for i, t in rows if i is None or i % 5])
    assert (model.tokens, model.words) == (plain.N, plain.V)
    got = sorted([tuple(r) for r in ngrams.score(df, model, ["doc_id", "text"]).collect()], key=repr)
    for _, text, n, known, base, score in got:
        want = plain.score(text)
        assert (n, known) == want[:2]
        assert math.isclose(base, want[2], rel_tol=1e-9)
        assert math.isclose(score, want[3], rel_tol=1e-9, abs_tol=1e-9)
    assert len(got) == len(rows)


def test_probabilities_sum_to_one():
    plain = Plain([t for _, t in sample()])
    for a in ["<s>", "w1é", "nothing"]:
        assert abs(sum(plain.p(a, b) for b in [*plain.c, "unknown"]) - 1) < 1e-9


def test_empty_model(spark):
    tune(spark)
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = ngrams.fit(df, train=F.lit(False))
    assert [tuple(r)[1:] for r in ngrams.score(df, model, ["doc_id"]).orderBy("doc_id").collect()] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    assert ngrams.score(df.where("false"), model, ["doc_id"]).count() == 0


def test_packed_pairs_round_trip():
    first = np.array([1, 1, 5, 5, 5, 9], np.uint64)
    second, count = np.arange(6, dtype=np.uint64) * 7, np.array([1, 2, 300, 4, 5, 70000])
    got = ngrams.pairs_of(ngrams.pair_block(first, second, count))
    assert all((a == b).all() for a, b in zip(got, (first, second, count)))


def test_beats_the_base_on_held_out_texts(spark):
    rows = QUERIES["op10_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert len(rows) > 50 and rows["score"].sum() > rows["base_score"].sum()
