"""The compression classifiers: held-out accuracy on the given tables, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from presslake.llm import compression, quality, toxicity
from presslake.llm.common import tune
from presslake.llm.queries import QUERIES


def held_out(spark, name, label, threshold):
    sf = "/root/testdata/sf0.1"
    out = QUERIES[name](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    y, p = rows[label].to_numpy(), rows["predicted"].to_numpy()
    assert ((rows["score"] >= 0) & (rows["score"] <= 1)).all()
    assert (p == (rows["score"] >= threshold)).all()
    return (p == y).mean(), max(y.mean(), 1 - y.mean())


def test_quality_on_held_out_rows(spark):
    right, base = held_out(spark, "op7_quality_classifier", "quality", 0.5)
    assert right > 0.95 > base


def test_toxicity_on_held_out_rows(spark):
    right, base = held_out(spark, "op9_toxicity", "toxic", 0.3)
    assert right > base + 0.04


def test_toxic_texts_are_caught_by_the_trained_pair(spark):
    # The larger table: recall of toxic and share of clean texts above the threshold, held out.
    path = "/root/testdata/check_s"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    tune(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), labels, "toxic", train=fold != 2)
    rows = docs.where(fold == 2).join(labels, "doc_id").select("doc_id", "text", "toxic")
    rows = toxicity.score(rows, model, ["toxic"]).toPandas()
    caught = rows["_score"] >= 0.3
    assert caught[rows["toxic"] == 1].mean() >= 0.9 and caught[rows["toxic"] == 0].mean() <= 0.03


SCHEMA = "doc_id long, text string, _score string, label int"


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module):
    tune(spark)
    rows = [(1, "good words here", "x", 1), (2, None, None, None), (None, "no id", "y", 0), (3, "", "z", 0), (1, "good words here", "x", 1)]
    rows += [(4, "bad " * 50000, "q", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0), (4, 0), (9, 1)], "doc_id long, mark int")
    for given in (labels, labels.where("false"), labels.where("mark = 1")):
        model = module.fit(docs, given, "mark")
        out = module.score(docs.drop("_score"), model, ["doc_id"]).collect()
        assert len(out) == len(rows)
        assert all(0 <= r._score <= 1 for r in out)
    assert module.score(docs.where("false").drop("_score"), model, ["doc_id"]).count() == 0


def test_samples_are_bounded_and_disjoint(spark):
    rows = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    a = {r.doc_id for r in compression.sample_ids(rows, 0, 40).collect()}
    b = {r.doc_id for r in compression.sample_ids(rows, 1, 40).collect()}
    assert len(a) == len(b) == 40 and not a & b
    assert a == {r.doc_id for r in compression.sample_ids(rows.repartition(7), 0, 40).collect()}


def test_logistic_fits_and_stays_finite():
    x = np.random.default_rng(3).normal(size=(400, 2))
    y = (x[:, 0] > 0).astype(int)
    model = compression.logistic(x, y)
    assert ((compression.probability(model, x) > 0.5) == y).mean() > 0.97
    assert np.allclose(compression.probability(compression.logistic(x, y * 0), x), 0.5 / 401)


def test_words_of_copies_do_not_count():
    toxic = [b"a nasty b c"] * 30 + [b"%d vile %d" % (i, i + 1) for i in range(30)]
    plain = [b" ".join(b"%d" % (i * 7 % 400) for i in range(2000))]
    own, ordinary = toxicity.dictionaries(toxic, plain, 1024, 64, 1, 6, 4.0, 12)
    assert b" vile" in own and b"nasty" not in own and b"vile" not in ordinary
    assert toxicity.differing(toxic, plain, 1, 6, 4.0) == sorted(b" %d vile %d " % (i, i + 1) for i in range(30))


def test_background_covers_all_pieces():
    texts = [b"%04d " % i * 100 for i in range(4000)]
    plain = toxicity.background(texts, 65536)
    assert 60000 < len(plain) <= 65536 and {int(w) // 500 for w in plain.split()[:-1] if len(w) == 4} == set(range(8))
    assert toxicity.background([], 100) == b"" and toxicity.background([b"abc"], 100) == b"abc"


@pytest.mark.parametrize("name,label,module,threshold", [("op7_quality_classifier", "quality", quality, 0.5), ("op9_toxicity", "toxic", toxicity, 0.3)])
def test_scores_against_plain_ones(spark, name, label, module, threshold):
    # Sizes by a compressor made here for every call, the logistic line written out.
    import zstandard

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    mod, left = (3, 1) if module is quality else (4, 2)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(mod))
    tune(spark)
    model = module.fit(docs.select("doc_id", "text"), labels, label, train=fold != left)
    got = {r.doc_id: (r.score, r.predicted) for r in QUERIES[name](spark, sf).collect()}

    def size(content, raw, text):
        kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT
        held = zstandard.ZstdCompressionDict(content, dict_type=kind)
        return len(zstandard.ZstdCompressor(level=model.level, dict_data=held, write_content_size=False, write_dict_id=False).compress(text))

    for r in docs.orderBy("doc_id").limit(40).collect():
        text = (r.text or "").encode()
        if module is quality:
            a, b = size(model.good, model.raw, text), size(model.bad, model.raw, text)
            x = [(b - a) / max(a, b), (b - a) / max(a, b) * np.log1p(len(text)), a / (len(text) + 20)]
        else:
            w = text.lower().split()
            parts = [b" " + b" ".join(w[k : k + 8]) + b" " for k in range(0, len(w), 8)]
            gains = np.array(sorted(size(model.ordinary, True, p) - size(model.toxic, True, p) for p in parts) or [0])
            x = [gains.max(), gains[-3:].mean(), gains.mean(), (gains >= 4).mean(), (gains >= 3).mean()]
        k = model.calibration
        want = 1 / (1 + np.exp(-(np.dot((np.array(x) - k["mean"]) / k["scale"], k["weights"]) + k["bias"])))
        assert got[r.doc_id][0] == pytest.approx(want, rel=1e-9) and got[r.doc_id][1] == (got[r.doc_id][0] >= threshold)


def test_toxic_phrases_of_ordinary_words(spark):
    # Every word is as frequent in ordinary texts; only the order of words tells.
    tune(spark)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(200)]
    phrases = [" ".join(words[k : k + 8]) for k in range(0, 160, 8)]
    rows = []
    for i in range(600):
        text = " ".join(rng.permutation(phrases)[:6]) if i % 2 else " ".join(rng.choice(words[:160], 48))
        rows.append((i, text, i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.where("doc_id < 400"), "toxic")
    out = toxicity.score(docs.where("doc_id >= 400"), model, ["doc_id", "toxic"]).collect()
    assert sum((r._score >= 0.5) == (r.toxic == 1) for r in out) > 0.95 * len(out)
