"""Tokenising against the tokenizers library, round trips, and the quality of packings."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from presslake.llm import packing
from presslake.llm.common import tune

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN = packing.encoder(PATH)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text("ab '\n\t<|endoftext>é 　\U0001f600's'll1²") | st.text("aA") | st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "a", "\n", "endoftext", "'ll", "é"])).map("".join))
def test_ids_are_those_of_the_library(plain, text):
    assert list(OWN(text)) == plain.encode(text, add_special_tokens=False).ids


def test_special_token_in_a_text(plain):
    assert 50256 in OWN("a <|endoftext|> b")
    assert list(OWN("a <|endoftext|> b")) == plain.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_ids_of_documents(plain, spark, sf_dir):
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert list(OWN(row.text)) == plain.encode(row.text, add_special_tokens=False).ids
    long = "x" * 20000 + " y" * 20000
    assert list(OWN(long)) == plain.encode(long, add_special_tokens=False).ids


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def check_places(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    return len(by)


def test_packs_every_piece_once(spark, plain):
    tune(spark)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["alpha", "be", "gamma ray", "Δ"]) for _ in range(rnd.randint(0, 120))) for _ in range(300)]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "no id", 1), (5, texts[5], 1), (900, None, 1), (901, "", 1), (902, "word " * 3000, 1), (903, "x<|endoftext|>y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(6)
    cut = packing.pieces(docs, PATH, length=64, keep_ids=True)
    packed = packing.pack(cut, length=64, shard_items=100).cache()
    got = packed.collect()
    n = check_places(got, 64)
    assert n >= -(-sum(r.length for r in got) // 64)
    assert n <= 1.03 * sum(r.length for r in got) / 64 + 4
    want = []
    for i, t, _ in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want += [(i, k, s, m, zlib.crc32(np.array(ids[s : s + m], "<u4").tobytes())) for k, (s, m) in enumerate(packing.cut(len(ids), 64))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=repr) == sorted(want, key=repr)
    made = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in got:
        assert made[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_no_rows(spark):
    tune(spark)
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"), PATH)).count() == 0


def test_evolution_keeps_items_and_does_not_get_worse():
    rnd = random.Random(9)
    sizes = sorted((rnd.choice([rnd.randint(1, 1023), rnd.randint(340, 700)]) for _ in range(400)), reverse=True)
    first = packing.best_fit(sizes, range(len(sizes)), 1024)
    population = packing.evolve(sizes, [first], 1024, seed=1, generations=30, most=4)
    for bins in population:
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert max(sum(sizes[i] for i in b) for b in bins) <= 1024
    assert packing.merit(population[0], sizes, 1024) >= packing.merit(first, sizes, 1024)
    again = packing.from_blob(packing.to_blob(population, len(sizes)), len(sizes))
    assert [sorted(map(sorted, p)) for p in again] == [sorted(map(sorted, p)) for p in population]


def test_a_packing_only_crossover_finds():
    # Best fit decreasing needs three bins here; two suffice.
    sizes = [6, 5, 5, 4, 3, 3, 2, 2]
    best = packing.evolve(sizes, [], 15, seed=0, generations=300, most=6)[0]
    assert len(best) == 2
