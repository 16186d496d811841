"""The pipeline's stages against plain versions, each on its own input."""

import random
import re
from collections import Counter

import corpus_pipeline
from presslake.llm import mixing, quality, suffix_dedup
from presslake.llm.common import tune, written
from test_mixing import plain as plain_mix
from test_simhash import plain as plain_components
from test_suffix_dedup import plain_gone

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghéü") for _ in range(rnd.randint(1, 8)))
    shared = " ".join(word() for _ in range(50))
    rows = []
    for i in range(120):
        body = " ".join(word() for _ in range(rnd.randint(1, 150)))
        if i % 4 == 0:
            body = f"{body} {shared} {body[:20]}"
        rows.append((i, body, "en", f"s{i % 5}", len(body)))
    rows += [(200 + i, rows[7][1], "de", "s1", rows[7][4]) for i in range(5)]
    rows += [(300, None, None, None, None), (301, "", "en", "s2", 0)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_stages_do_what_they_say(spark, sf_dir):
    tune(spark)
    rows, docs = corpus(spark)
    one = corpus_pipeline.keep_first_of_near_copies(spark, docs, sf_dir)
    assert one.schema.names == docs.schema.names
    want = {i for i, _, c in plain_components([(r[0], r[1]) for r in rows]) if i == c}
    assert {r.doc_id for r in one.collect()} == want

    two = corpus_pipeline.cut_repeats(spark, docs, sf_dir)
    assert two.columns == docs.columns
    gone = plain_gone([(r[0], r[1]) for r in rows], 100)
    texts = {}
    for r in rows:
        kept, at = "", 0
        for char in r[1] or "":
            size = len(char.encode())
            kept += "" if any(gone[r[0]][at : at + size]) else char
            at += size
        if not any(gone[r[0]]):
            texts[r[0]] = (r[1], r[4])
        elif kept:
            texts[r[0]] = (kept, len(kept))
    assert {r.doc_id: (r.text, r.n_chars) for r in two.collect()} == texts

    three = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    counts = Counter(r.doc_id for r in three.collect())
    assert dict(counts) == {i: x[3] for i, x in plain_mix([(r[0], r[1], r[3]) for r in rows]).items() if x[3]}


def test_rejected_documents_go_and_the_rest_stays_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.keep_good(spark, docs, sf_dir)
    assert kept.schema == docs.schema
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    scores = {r.doc_id: r._score for r in quality.score(docs, model, ["doc_id"]).collect()}
    assert {r.doc_id: r.text for r in kept.collect()} == {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] >= 0.5}


CLASHING = ("_score _text row text_ mark found spans kept new cut n_bytes fp fingerprint component_id label features "
            "_row _id _mark _copies key size times copies line turn all piece start length ids ids_crc32 sequence_id offset").split()  # fmt: skip


def test_columns_of_any_name_are_carried_along(spark, sf_dir):
    rows, docs = corpus(spark)
    wide = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in CLASHING])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, sf_dir)
        assert got.columns == wide.columns, name
        want = sorted(map(tuple, stage(spark, docs, sf_dir).collect()), key=repr)
        found = got.collect()
        assert sorted((tuple(r[c] for c in docs.columns) for r in found), key=repr) == want, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASHING), name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, wide, sf_dir).columns == last(spark, docs, sf_dir).columns


def test_only_characters_that_are_cut_in_two_go(spark, sf_dir):
    rnd = random.Random(3)
    shared = "é" + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzöä") for _ in range(150)) + "ü"
    rows = [(1, "start \ufffd one " + shared + " end \ufffd keep"), (2, "other \ufffd two ĩ" + shared[1:-1] + "û \ufffd tail")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, sf_dir).collect()}
    assert got == {1: rows[0][1], 2: "other \ufffd two  \ufffd tail"}


def test_whole_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    by = {}
    for r in out.collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        assert sum(n for _, n in places) <= 1024
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
    assert len(by) > 10


def test_empty_corpus(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_nothing_that_grows_with_the_corpus_is_broadcast(spark):
    # Spark takes a running sum's rows, the turns made of each and the windows of a segment for as large as what they come from:
    # in the mix, 0.5 GB of documents gave broadcasts of 42 and 59 MB.
    tune(spark)
    _, docs = corpus(spark)
    mixed = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key#" in mixed
    assert not re.search(r"BroadcastHashJoin [^\n]*(line|_?mark|_g\d)#", mixed)

    segments = written(spark.range(300).selectExpr("id % 40 as high", "1L as low", "id as doc_id", "cast(id as int) as start"), "segments")
    windows = suffix_dedup._hot_windows(segments)
    assert windows.count() == 260
    assert "BroadcastHashJoin" not in windows._jdf.queryExecution().executedPlan().toString()
    asked = segments.selectExpr("doc_id", "start", "1 as count", "1L as anchor", "cast(1 as byte) as kind")
    fetched = suffix_dedup._fetched(docs.select("doc_id", "text"), asked, 100)
    assert "BroadcastHashJoin" not in fetched._jdf.queryExecution().executedPlan().toString()
