"""Collocations against a plain count of all windows."""

import random
import re
from collections import Counter

import pytest

from presslake.llm import phrases
from presslake.llm.common import tune

SCHEMA = "doc_id long, text string, lang string, prefix string, n long, next string, phrase string, _ string"


def plain(rows, max_words, min_count, scale, best):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, max_words + 1):
                for i in range(len(words) - size + 1):
                    count[lang, tuple(words[i : i + size])] += 1
    often = {k: v for k, v in count.items() if v >= min_count}
    inside = Counter()
    for (lang, p), f in often.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                key = lang, p[i : i + size]
                inside[key] = max(inside[key], f)
    found = []
    for (lang, p), a in often.items():
        if len(p) < 2 or inside[lang, p] >= a:
            continue
        n = total[lang]
        cuts = [(scale * a * n // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        found.append((lang, -score, -a, " ".join(p).encode(), left, right, n))
    out, ranks = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(found):
        ranks[lang] += 1
        if ranks[lang] <= best:
            out.append((lang, ranks[lang], phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "York", "city", "é", "\U0001f600", "İx", "\x00a", "a'b", "\xa0", "naïve", " "]
    rows = []
    for i in range(300):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randrange(0, 60))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "\r\n", "\x0b"]) for w in words)
        rows.append((text, rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    rows += [("New York City of the New York City of the end", "en")] * 40 + [(None, "en"), ("", None), ("...", "xx")]
    rows.append(("over and out " * 4000, "de"))
    return rows


@pytest.mark.parametrize("bits", [phrases.BITS, 64])
def test_agrees_with_plain_count(spark, bits):
    tune(spark)
    rows = rows_of(3)
    df = spark.createDataFrame([(i, t, g, "p", 1, "x", "y", "z") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(7)
    got = phrases.mine(df, 5, 10, 1000, 30, bits=bits).collect()
    assert sorted(map(tuple, got)) == plain(rows, 5, 10, 1000, 30)


def test_heavy_prefix_is_dealt_over_parts(spark, monkeypatch):
    tune(spark)
    monkeypatch.setattr(phrases, "WORDS_A_PARTITION", 50)
    rows = rows_of(4)
    df = spark.createDataFrame([(t, g) for t, g in rows], "text string, lang string").repartition(5)
    assert sorted(map(tuple, phrases.mine(df, 4, 7, 1000, 2000).collect())) == plain(rows, 4, 7, 1000, 2000)


def test_products_beyond_64_bits(spark):
    found = phrases.Stripes(
        spark.createDataFrame(
            [("en", "", "a", 3_000_000_000), ("en", "", "b", 3_000_000_007), ("en", "a", "b", 2_999_999_999)], "lang string, prefix string, next string, n long"
        ),
        spark.createDataFrame([("en", 9_000_000_000_000_000)], "lang string, total long"),
    )
    row = phrases.collocations(found).first()
    assert row.score == 1000 * 2_999_999_999 * 9_000_000_000_000_000 // (3_000_000_000 * 3_000_000_007)


def test_slices_end_between_pieces():
    data = [b"One two. three", b"", b"x" * 50 + b" y", b"z;z"]
    cut = list(phrases.slices(data, 10))
    assert b"".join(cut) == b"\n".join(data).lower().replace(b".", b"\n").replace(b";", b"\n")
    assert all(c.endswith(b"\n") for c in cut[:-1])


def test_stripes_become_rows_of_elements_at_once(spark):
    # A row for each stripe would be one for each task and prefix.
    rows = spark.createDataFrame([("en", "a b c a b d")] * 4, "lang string, text string").repartition(2)
    found = phrases.counted(rows, phrases.Round(1, 2), 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    got = {(r.prefix, r.next): r.n for r in found.collect()}
    assert got == {("", "a"): 8, ("", "b"): 8, ("", "c"): 4, ("", "d"): 4, ("a", "b"): 8, ("b", "c"): 4, ("c", "a"): 4, ("b", "d"): 4}


def test_no_rows(spark):
    tune(spark)
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).count() == 0
