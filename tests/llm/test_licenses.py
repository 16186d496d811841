"""License scan against a plain search of every text."""

import random
import re

from pyspark.sql import functions as F

from presslake.llm import licenses
from presslake.llm.common import tune
from presslake.llm.licenses import NOTICES, PHRASES, Template

SCHEMA = "doc_id long, text string, k1 long, spans string, n_words string, labels string, low string"


def edit_distance_anywhere(template, words):
    """The least edits from template to a part of words, word by word."""
    row = [0] * (len(words) + 1)
    for i, t in enumerate(template):
        new = [i + 1]
        for j, w in enumerate(words):
            new.append(min(row[j] + (t != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def grams(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain(text, k=3, similarity=0.8):
    """(n_words, n_base, first, last, base labels, labels that must be there, score)"""
    w = words(text)
    places, best = [], {}
    for t in PHRASES:
        p = words(t.text)
        places += [(i, t.label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    for t in NOTICES:
        p = words(t.text)
        if grams(p, k) & grams(w, k):
            edits = edit_distance_anywhere(p, w)
            if edits <= int((1 - similarity) * len(p) + 1e-9):
                best[t.label] = max(best.get(t.label, 0), 1 - edits / len(p))
    places.sort()
    base = sorted({x for _, x in places})
    score = 1.0 if places else max(best.values(), default=0.0)
    return len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(base), best, score


def texts():
    rng = random.Random(6)
    filler = [w for t in NOTICES for w in words(t.text)] + "alpha beta gamma delta é ﬁ 42 \U0001f600".split()
    out = [None, "", " .;", "MIT License", "the mit-license; Apache  LICENSE general public license", "mit licenses", "xmit license", "mit license " * 300]
    out += ["Permission is hereby granted " * 50, "of the software " * 400, "İmit license MİT license"]
    for t in NOTICES:
        for edits in range(4):
            w = words(t.text)
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(filler)], [w[at], rng.choice(filler)]])
            around = [rng.choice(filler) for _ in range(rng.randrange(60))]
            at = rng.randrange(len(around) + 1)
            out.append(rng.choice([" ", "\n", "-"]).join(around[:at] + w + around[at:]).title())
    out += [" ".join(rng.choice(filler) for _ in range(rng.randrange(200))) for _ in range(60)]
    out.append(" ".join(rng.choice(filler[-8:]) for _ in range(200000)) + " released under the mit license")
    return out


def test_agrees_with_plain_search(spark):
    tune(spark)
    rows = list(enumerate(texts()))
    rows += [rows[3], rows[4], (None, "apache license"), (4, "apache license")]
    df = spark.createDataFrame([(i, t, 1, "a", "b", "c", "d") for i, t in rows], SCHEMA).repartition(6)
    got = licenses.scan(df).collect()
    assert len(got) == len(rows)
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words), r) for r in got)
    want = sorted(((i is None, i or 0, len(words(t))), t or "") for i, t in rows)
    for (_, r), (_, t) in zip(found, want):
        n, n_base, first, last, base, best, score = plain(t) if len(t) < 100000 else (200005, 1, 200003, 200003, "mit", {"mit": 1.0}, 1.0)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, base)
        labels = set(filter(None, r.labels.split(",")))
        assert set(filter(None, base.split(","))) <= labels <= set(filter(None, base.split(","))) | set(best)
        top = max(best.values(), default=0)
        # The nearest notices are never the ones left out.
        assert {x for x, s in best.items() if s == top} <= labels
        assert abs(r.score - score) < 1e-12


def test_more_templates_than_are_broadcast(spark, monkeypatch):
    tune(spark)
    monkeypatch.setattr(licenses, "BROADCAST_GRAMS", 0)
    df = spark.createDataFrame([(1, "a mit license"), (2, "b")], "doc_id long, text string")
    got = licenses.scan(df, notices=[Template("own", "b")]).orderBy("doc_id").collect()
    assert [(r.labels, r.n_base, r.score) for r in got] == [("mit", 1, 1.0), ("own", 0, 1.0)]


def test_nearer_notice_counts(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0."), (2, "licensed under cc by 4.0")], "doc_id long, text string")
    assert [r.labels for r in licenses.scan(df).orderBy("doc_id").collect()] == ["cc-by-nc", "cc-by"]


def test_words_are_split_without_a_pattern(spark):
    # Patterns over every text took most of the time.
    tune(spark)
    texts = ["".join(chr(c) + ("x" if c % 3 else "") for c in range(400)), "\x00", "a\x00B", "MIT\x00License\x7f", "é\x85\xa0\u2028\U0001f600 K", "", " a", "a "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = df.select("text", licenses._words(F.col("text")).alias("w"), F.encode("text", "UTF-8").alias("b")).collect()
    assert [r.w for r in found] == [words(r.text) for r in found] == [[w.decode() for w in licenses.words_of(bytes(r.b))] for r in found]
    scanned = licenses.scan(df)
    assert sorted((r.doc_id, r.n_words, r.n_base) for r in scanned.collect()) == [(i, len(words(t)), int(i == 3)) for i, t in enumerate(texts)]
    assert "regexp" not in scanned._jdf.queryExecution().optimizedPlan().toString()


def test_no_rows(spark):
    tune(spark)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
