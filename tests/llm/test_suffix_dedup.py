"""Suffix sorting and removal of repeats, against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from presslake.llm import suffix_dedup as sd
from presslake.llm.common import tune
from presslake.llm.suffixes import common_prefixes, layout, suffix_order


@pytest.mark.parametrize("seed", range(12))
def test_suffix_order_and_prefixes(seed):
    rnd = random.Random(seed)
    letters = rnd.choice([b"a", b"ab", b"abc\x00", bytes(range(0, 0xC0))])
    strings = [bytes(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(rnd.randint(0, 25))]
    strings += strings[:3] + [b"a" * 40, b"a" * 8, b"a" * 16, "é€𝄞".encode() * 4]
    text, begins, room = layout(strings)
    order = suffix_order(text, room)
    where = [(int(begins[i]) + j, s[j:]) for i, s in enumerate(strings) for j in range(len(s))]
    want = [p for p, _ in sorted(where, key=lambda x: (x[1], x[0]))]
    assert order.tolist() == want
    body = dict(where)
    for limit in (5, 8, 33):
        got = common_prefixes(text, order, room, limit).tolist()
        for k in range(1, len(order)):
            a, b = body[order[k - 1]], body[order[k]]
            n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert got[k] == min(n, limit)


def plain_gone(rows, length):
    """For each document, whether each of its bytes goes (one more at the end, which never does)."""
    seen, out = set(), {}
    for doc, text in sorted((i, (t or "").encode()) for i, t in rows):
        gone = np.zeros(len(text) + 1, bool)
        for p in range(len(text) - length + 1):
            gram = text[p : p + length]
            if gram in seen:
                gone[p : p + length] = True
            seen.add(gram)
        out[doc] = gone
    return out


def plain(rows, length):
    out, marks = [], plain_gone(rows, length)
    for doc, text in sorted((i, (t or "").encode()) for i, t in rows):
        gone = marks[doc]
        kept = bytes(b for b, g in zip(text, gone) if not g)
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(text) else 0
        out.append((doc, len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def digest(df):
    out = []
    for r in df.collect():
        n = sum(s.end - s.start for s in r.spans)
        out.append((r.row.doc_id, r.n_bytes, n, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return sorted(out)


def sample(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    say = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared = [say(40) for _ in range(4)]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice([say(rnd.randint(1, 60)), rnd.choice(shared), shared[0]]) for _ in range(rnd.randint(1, 5)))
        rows.append((i * 3 - 20, text))
    rows += [(1000 + i, rows[5][1]) for i in range(8)] + [(2000, rows[5][1][:300] + "x" + rows[5][1][301:])]
    return rows + [(3000, "la " * 900), (3001, "a" * 700), (3002, ""), (3003, None), (3004, "\x00" * 250)]


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 4096), (3, 2)])
def test_agrees_with_plain_removal(spark, seed, hot):
    tune(spark)
    rows = sample(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(7)
    assert digest(sd.remove_repeats(df, hot_segments=hot)) == plain(rows, 100)


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 150)
    texts = [t.encode() for _, t in sample(5, 6) if t]
    whole = {(i, s + k) for i, s, c in zip(*[x.tolist() for x in sd.segments(texts)[:3]]) for k in range(c)}
    cut = list(sd.pieces(texts, 100))
    number, start, count, _, _ = sd.segments([x[2] for x in cut])
    parts = [(cut[i][0], cut[i][1] + s + k) for i, s, c in zip(number.tolist(), start.tolist(), count.tolist()) for k in range(c)]
    assert sorted(parts) == sorted(whole)


def test_rows_without_or_with_shared_ids(spark):
    tune(spark)
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, long), (1, long), (1, long), (2, long), (2, "short"), (None, long)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = sorted([(r.row.doc_id, r.row.text[:5], len(r.kept)) for r in got.collect()], key=repr)
    whole = len(long)
    assert [x for x in sizes if x[0] is None] == [(None, "word0", whole)] * 2
    assert [x for x in sizes if x[0] == 1] == [(1, "word0", whole)] * 2
    assert all(n in (0, whole, 5) for _, _, n in sizes)
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
