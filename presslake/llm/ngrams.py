"""An interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

Words are 64-bit hashes. A word's bucket is the top of its hash, so the buckets' sorted arrays, one after another, are
sorted as a whole. A task counts the pairs of its own texts and sends each bucket one packed block; a bucket adds its
blocks up. Pairs live in the bucket of their first word, where the statistics of the word as a context are formed;
contexts so frequent that one bucket would be too large are spread by the pair's hash (see heavy_words), and their
statistics are added up in a second step. That step also gathers, for each word, how many different words it follows.

The files lie in the shared folder, one pair file and one word file for each bucket, and grow with the corpus. Workers
map them, so that all tasks of a machine share the pages in memory and nothing is sent from the driver but the folder's
name and a few totals.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import bounded, in_chunks, own_columns, shared_folder, shuffle_partitions, utf8

# Hashes of the start and end of a text; a word's hash is never one of them.
BEGIN, END = 1, 0
FLUSH_PAIRS = 2 << 20
CHUNK_BYTES = 2 << 20
CACHED_WORDS = 1 << 19
# What the files hold beside their sorted keys.
PAIR = [("count", "<u4")]
WORD = [("count", "<u8"), ("before", "<u4"), ("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")]


class Hashes(dict):
    """Word to hash, for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        value = max(2, xxhash.xxh3_64_intdigest(word))
        self[word] = value
        return value


def pair_hash(first, second):
    """One hash of two; as for words, other pairs with the same hash are counted as the same."""
    import numpy as np

    h = (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + second
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def tokens_of(texts: list[bytes], known: Hashes):
    """(hashes of all words and ends, tokens of each text): A-Z lower-cased words, then one end for each text."""
    import numpy as np

    lists = [t.lower().split() for t in texts]
    counts = np.fromiter((len(x) + 1 for x in lists), np.int64, len(lists))
    get = known.__getitem__
    flat = []
    for words in lists:
        flat += map(get, words)
        flat.append(END)
    return np.array(flat, np.uint64), counts


def with_first(tokens, counts):
    """The token before each token; BEGIN before the first of a text."""
    import numpy as np

    first = np.concatenate([np.array([BEGIN], np.uint64), tokens[:-1]])
    first[np.concatenate([[0], np.cumsum(counts)[:-1]])[: len(counts)]] = BEGIN
    return first


def bucket_of(hashes, buckets: int):
    import numpy as np

    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def home_of(first, pair, heavy, buckets: int):
    """The bucket of a pair: its first word's, or, if that is a heavy one, one by the pair's own hash."""
    import numpy as np

    return bucket_of(np.where(np.isin(first, heavy), pair, first), buckets)


def summed(keys: list, values):
    """Distinct rows of the key arrays (sorted) and the sums of values."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    keys, values = [k[order] for k in keys], values[order]
    if not len(order):
        return keys, values
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(values, at)


def block(*columns) -> bytes:
    import numpy as np
    import zstandard

    head = np.array([len(columns[0])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unblock(data: bytes, kinds: list[str]) -> list:
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def pair_block(first, second, count) -> bytes:
    """Pairs sorted by their first words, each of which is kept once."""
    import numpy as np

    starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    times = np.diff(np.append(starts, len(first)))
    return block(first[starts], times.astype("<u4")) + b"|" + block(second, count.astype("<u4"))


def pairs_of(data: bytes) -> tuple:
    import numpy as np
    import zstandard

    # The first frame ends where a decompressor stops reading.
    stream = zstandard.ZstdDecompressor().decompressobj()
    stream.decompress(data)
    rest = stream.unused_data
    first, times = unblock(data[: len(data) - len(rest)], ["<u8", "<u4"])
    second, count = unblock(rest[1:], ["<u8", "<u4"])
    return np.repeat(first, times), second, count


def heavy_words(texts: DataFrame, rows: int = 2000, share: float = 0.002) -> list[int]:
    """Hashes of the words that are at least a share of the tokens of a bounded sample: at most 1 / share words.

    They only decide in which bucket a pair is counted, not what is counted, so the sample changes no result.
    """
    import numpy as np

    ids = bounded(texts.select("doc_id"), rows, "doc_id").distinct()
    sample = texts.join(F.broadcast(ids), "doc_id", "left_semi").select(F.substring("text", 1, 20000).alias("text")).limit(2 * rows)
    tokens, _ = tokens_of([(r.text or "").encode() for r in sample.collect()], Hashes())
    words, counts = np.unique(np.append(tokens, np.uint64(BEGIN)), return_counts=True)
    return [int(w) for w in words[(counts >= share * len(tokens)) | (words == BEGIN)]]


def local_path(folder: str) -> str:
    """The folder as workers open it; a model can only be mapped from a folder that is mounted on every machine."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if folder.startswith("/"):
        return folder
    raise ValueError("the n-gram model is memory-mapped: spark.checkpoint.dir must be a mounted folder (file:/...)")


def save(path: str, keys, values) -> None:
    """Write whole and then rename, so that a task that runs again, or twice, leaves whole files."""
    import numpy as np

    for name, array in (("keys", keys), ("values", values)):
        part = f"{path}-{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, f"{path}-{name}.npy")


def _counted(texts: DataFrame, heavy: list[int], buckets: int) -> DataFrame:
    """(bucket, data): blocks of (first, second, count) from every task's texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        often = np.array(heavy, np.uint64)

        def flush(firsts, seconds, counts):
            (first, second), count = summed([np.concatenate(firsts), np.concatenate(seconds)], np.concatenate(counts))
            where = home_of(first, pair_hash(first, second), often, buckets)
            order = np.argsort(where, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
                data = pair_block(first[part], second[part], count[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(where[part[0]])], pa.int32()), pa.array([data], pa.binary())], ["bucket", "data"]
                )

        known, held, size = Hashes(), [], 0
        for batch in batches:
            rows = utf8(batch.column(0))
            for i, j in in_chunks(rows, CHUNK_BYTES):
                tokens, counts = tokens_of(rows[i:j], known)
                (first, second), count = summed([with_first(tokens, counts), tokens], np.ones(len(tokens), np.int64))
                held.append((first, second, count))
                size += len(first)
                if size >= FLUSH_PAIRS:
                    yield from flush(*zip(*held))
                    held, size = [], 0
        if held:
            yield from flush(*zip(*held))

    return texts.select("text").mapInArrow(run, "bucket int, data binary")


TOTALS = "n1 long, n2 long, n3 long, n4 long, tokens long, words long, types long"


def _pairs(counted: DataFrame, folder: str, buckets: int) -> DataFrame:
    """Writes the pair files. (bucket, kind, data, totals): blocks for the buckets of words, and counts of counts."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        here = table.column("bucket")[0].as_py()
        parts = [pairs_of(d) for d in table.column("data").to_pylist()]
        (first, second), count = summed(
            [np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])],
            np.concatenate([p[2] for p in parts]).astype(np.int64),
        )
        pair = pair_hash(first, second)
        order = np.argsort(pair)
        save(f"{folder}/pairs-{here}", pair[order], count[order].astype("<u4").view(PAIR))
        rows = []

        def deal(kind, word, columns):
            where = bucket_of(word, buckets)
            by = np.argsort(where, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(where[by])) + 1):
                if len(part):
                    rows.append((int(where[part[0]]), kind, block(word[part], *(c[part] for c in columns)), [0] * 7))

        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        columns = [np.add.reduceat(x.astype(np.int64), starts) for x in (count, count == 1, count == 2, count >= 3)]
        deal("context", first[starts], columns)
        (follower,), times = summed([second], np.ones(len(second), np.int64))
        deal("follower", follower, [times])
        ends = int(count[second == END].sum())
        if ends:
            deal("ends", np.array([END], np.uint64), [np.array([ends], np.int64)])
        rows.append((here, "totals", None, [int((count == k).sum()) for k in (1, 2, 3, 4)] + [int(count.sum()), 0, 0]))
        names = [x.split()[0] for x in TOTALS.split(", ")]
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in rows], pa.int32()),
                "kind": pa.array([r[1] for r in rows], pa.string()),
                "data": pa.array([r[2] for r in rows], pa.binary()),
                **{n: pa.array([r[3][k] for r in rows], pa.int64()) for k, n in enumerate(names)},
            }
        )

    return counted.groupBy("bucket").applyInArrow(run, f"bucket int, kind string, data binary, {TOTALS}")


def _words(pairs: DataFrame, folder: str) -> DataFrame:
    """Writes the word files; one row of totals for each bucket: of pairs as they came, of words in w1 to w4, and of those with three or more before them in w5."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        here = table.column("bucket")[0].as_py()
        found = {"context": [], "follower": [], "ends": []}
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            if data is not None:
                found[kind].append(unblock(data, ["<u8"] + ["<i8"] * (4 if kind == "context" else 1)))

        def columns(kind, width):
            return [np.concatenate([p[k] for p in found[kind]] or [np.zeros(0, np.int64)]) for k in range(width)]

        context, follower, ends = columns("context", 5), columns("follower", 2), columns("ends", 2)
        words = np.unique(np.concatenate([context[0], follower[0]]).astype(np.uint64))
        out = np.zeros(len(words), WORD)
        at = np.searchsorted(words, context[0].astype(np.uint64))
        for name, values in zip(("total", "n1", "n2", "n3"), context[1:]):
            np.add.at(out[name], at, values.astype(out[name].dtype))
        np.add.at(out["before"], np.searchsorted(words, follower[0].astype(np.uint64)), follower[1].astype(np.uint32))
        # A word is followed as often as it occurs; an end is not followed by anything, and a beginning is no token.
        out["count"] = np.where(words == BEGIN, 0, out["total"])
        out["count"][words == END] = int(ends[1].sum())
        save(f"{folder}/words-{here}", words, out)
        before = out["before"]
        row = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before >= 3).sum())]
        return pa.table({
            **{f"w{k}": pa.array([v], pa.int64()) for k, v in enumerate(row, 1)},
            "words": pa.array([int((out["count"] > 0).sum())], pa.int64()),
            "types": pa.array([int(before.sum())], pa.int64()),
            **{n: pa.array([sum(table.column(n).to_pylist())], pa.int64()) for n in ("n1", "n2", "n3", "n4", "tokens")},
        })

    schema = "w1 long, w2 long, w3 long, w4 long, w5 long, words long, types long, n1 long, n2 long, n3 long, n4 long, tokens long"
    return pairs.groupBy("bucket").applyInArrow(run, schema)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """What is taken off counts of one, two, and three or more, estimated from the numbers of such counts.

    Where a corpus is too small for the estimate, fixed discounts stand in; all lie within the count they are taken off.
    """
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class NgramModel:
    folder: str
    buckets: int
    heavy: tuple[int, ...]
    tokens: int
    words: int
    types: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    level: tuple[int, int, int]  # words with 1, 2, 3 or more different words before them


def fit(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        buckets: int | None = None) -> NgramModel:
    """The model of all rows of docs for which train holds. A null text is empty: one end. Repeated rows count again."""
    spark = docs.sparkSession
    rows = docs if train is None else docs.where(train)
    texts = own_columns(rows, doc_id=id_col, text=text_col)
    buckets = buckets or shuffle_partitions(spark)
    folder = local_path(f"{shared_folder(spark)}/ngrams-{uuid.uuid4().hex}")
    os.makedirs(folder)
    heavy = heavy_words(texts)
    sums = _words(_pairs(_counted(texts, heavy, buckets), folder, buckets), folder)
    t = sums.groupBy().sum().first()
    total = {c[4:-1]: v or 0 for c, v in t.asDict().items()}
    w = [total[f"w{k}"] for k in (1, 2, 3, 4)]
    return NgramModel(
        folder, buckets, tuple(heavy), total["tokens"], total["words"], total["types"],
        discounts(*(total[f"n{k}"] for k in (1, 2, 3, 4))), discounts(*w), (w[0], w[1], total["w5"]),
    )


class Reader:
    """A model's files, mapped."""

    def __init__(self, model: NgramModel):
        import numpy as np

        self.model, self.heavy = model, np.array(model.heavy, np.uint64)
        self.files: dict[tuple[str, int], object] = {}

    def _file(self, kind: str, bucket: int):
        import numpy as np

        key = (kind, bucket)
        if key not in self.files:
            path = f"{self.model.folder}/{kind}-{bucket}"
            none = np.zeros(0, np.uint64), np.zeros(0, PAIR if kind == "pairs" else WORD)
            there = os.path.exists(f"{path}-values.npy")
            self.files[key] = tuple(np.load(f"{path}-{x}.npy", mmap_mode="r") for x in ("keys", "values")) if there else none
        return self.files[key]

    def look_up(self, kind: str, keys, where, fields: list[str]) -> list:
        """The fields of sorted distinct keys, each in its bucket; zeros for absent ones."""
        import numpy as np

        out = [np.zeros(len(keys), np.int64) for _ in fields]
        order = np.argsort(where, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
            if not len(part):
                continue
            column, values = self._file(kind, int(where[part[0]]))
            if not len(column):
                continue
            at = np.minimum(np.searchsorted(column, keys[part]), len(column) - 1)
            hit = column[at] == keys[part]
            found = values[at[hit]]
            for into, field in zip(out, fields):
                into[part[hit]] = found[field]
        return out

    def score(self, texts: list[bytes], known: Hashes):
        """(tokens, known tokens, base score, score) of each text, logarithms to base 10."""
        import numpy as np

        m, buckets = self.model, self.model.buckets
        tokens, counts = tokens_of(texts, known)
        first = with_first(tokens, counts)
        words, at = np.unique(np.concatenate([tokens, first]), return_inverse=True)
        second_at, first_at = at[: len(tokens)], at[len(tokens) :]
        fields = ["count", "before", "total", "n1", "n2", "n3"]
        count, before, total, n1, n2, n3 = self.look_up("words", words, bucket_of(words, buckets), fields)
        count = np.where(words == BEGIN, 0, count)

        d1, d2, d3 = m.word_discounts
        ones, twos, more = m.level
        # The lowest level: how many words come before, discounted, and the rest shared by all words and the unknown.
        off = np.choose(np.minimum(before, 3), [0.0, d1, d2, d3])
        rest = (d1 * ones + d2 * twos + d3 * more) / max(1, m.types)
        lower = (before - off) / max(1, m.types) + (rest if m.types else 1.0) / (m.words + 1)

        pair = pair_hash(first, tokens)
        pairs, pair_at = np.unique(pair, return_inverse=True)
        home = np.zeros(len(pairs), np.uint64)
        home[pair_at] = home_of(first, pair, self.heavy, buckets)
        (seen,) = self.look_up("pairs", pairs, home, ["count"])
        seen = seen[pair_at]
        e1, e2, e3 = m.pair_discounts
        all_ = total[first_at]
        off = np.choose(np.minimum(seen, 3), [0.0, e1, e2, e3])
        left = e1 * n1[first_at] + e2 * n2[first_at] + e3 * n3[first_at]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(all_ > 0, (seen - off + left * lower[second_at]) / all_, lower[second_at])
        base = np.log10((count[second_at] + 1) / (m.tokens + m.words + 1))
        edges = np.concatenate([[0], np.cumsum(counts)[:-1]])
        add = lambda x: np.add.reduceat(x, edges)
        return counts, add((count[second_at] > 0).astype(np.int64)), add(base), add(np.log10(p))


def score(docs: DataFrame, model: NgramModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The keep columns of docs with _n_tokens, _n_known, _base_score and _score of the whole text.

    The probability of a text is that of its words and its end. A null text is empty: its end alone. With an empty
    model every token has probability 1, of base score as of score: nothing is known but the one unknown word.
    """
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        reader, known = Reader(model), Hashes()
        for batch in batches:
            texts = utf8(batch.column(len(keep)))
            parts = [reader.score(texts[i:j], known) for i, j in in_chunks(texts, CHUNK_BYTES)]
            found = [pa.array(np.concatenate(c)) for c in zip(*parts)] if parts else [pa.array([])] * 4
            if texts:
                names = [*keep, "_n_tokens", "_n_known", "_base_score", "_score"]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *found], names)

    schema = rows.select(*[f"`{c}`" for c in keep]).schema
    schema = schema.add("_n_tokens", "long").add("_n_known", "long").add("_base_score", "double").add("_score", "double")
    return rows.mapInArrow(run, schema)
