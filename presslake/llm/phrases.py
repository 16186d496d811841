"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

A task counts the windows of its own texts and sends one stripe for each prefix, (prefix, next words, counts), those of a
bucket of prefixes in one row; stripes of a prefix meet after one shuffle and are added element by element. The merged stripes are the only structure: an element
is the frequency of prefix + word, the stripe of the empty prefix holds the words and its sum their number, the largest
element of a stripe says whether an extension to the right subsumes the prefix, and the same elements keyed by what
follows their first word say it for the left.

Four rounds over the texts: words, pairs, triples, then all longer windows. No phrase is more frequent than a part of
it, so a round only counts windows whose parts were frequent in the rounds before. What was frequent travels as a bit
table of fixed size: a collision lets a window be counted for nothing and changes no count, however full the table is.

A stripe never meets whole if its prefix begins with a frequent word: it is dealt by its next words over a number of
parts in proportion to that word's share of the corpus. A task holds its words as numbers, FLUSH_WORDS at most, and
reads texts in slices of SLICE_BYTES, cut between pieces.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presslake.llm.common import own_columns, shuffle_partitions, utf8, written

SLICE_BYTES = 2 << 20
FLUSH_WORDS = 6 << 20
FLUSH_DIFFERENT = 1 << 20
BITS = 1 << 26
WORDS_A_PARTITION = 2_000_000
MOST_PARTITIONS = 20_000
BUCKETS_A_PARTITION = 4
_EMITTED = "lang string, bucket int, stripes array<struct<prefix: binary, next: array<binary>, n: array<long>>>"
# What separates pieces and words.
BETWEEN_PIECES = b".,;:!?\n\x0b\x0c\r"
BETWEEN_WORDS = b" \t"


def _byte_table() -> bytes:
    table = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        table[c] = c + 32
    for c in BETWEEN_PIECES:
        table[c] = ord("\n")
    for c in BETWEEN_WORDS:
        table[c] = ord(" ")
    return bytes(table)


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """The texts, lower-cased, separators made equal, in slices that end between pieces; a longer piece stays whole."""
    data = b"\n".join(texts).translate(_byte_table())
    start = 0
    while start < len(data):
        stop = len(data)
        if stop - start > limit:
            cut = data.rfind(b"\n", start, start + limit)
            if cut < 0:
                cut = data.find(b"\n", start + limit)
            stop = cut + 1 if cut >= 0 else stop
        yield data[start:stop]
        start = stop


class Numbers(dict):
    """Word to its number, in order of appearance; 0 stands for nothing, 1 for the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class Held:
    """The texts of one language that a task holds, as numbers of words, -1 between pieces."""

    def __init__(self):
        self.numbers, self.codes, self.size = Numbers(), [], 0

    def add(self, texts: list[bytes]) -> None:
        import numpy as np

        for data in slices(texts):
            tokens = data.replace(b"\n", b" \n ").split(b" ")
            codes = np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))
            codes = codes[codes != 0]
            codes[codes == 1] = -1
            self.codes += [codes, np.array([-1], np.int32)]
            self.size += len(codes) + 1

    def full(self) -> bool:
        return self.size >= FLUSH_WORDS or len(self.numbers) >= FLUSH_DIFFERENT

    def taken(self):
        """(codes, words)"""
        import numpy as np
        import pyarrow as pa

        return np.concatenate(self.codes), pa.array(list(self.numbers), pa.binary())


class Seeds(dict):
    """Language to the seed of its words' hashes."""

    def __missing__(self, lang: str) -> int:
        self[lang] = zlib.crc32(lang.encode())
        return self[lang]


def word_hashes(words, lang: str):
    """A hash of each word of an Arrow array, other ones in other languages."""
    import numpy as np
    import xxhash

    seed = Seeds()[lang]
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def joined_hash(before, following):
    """The hash of a phrase and one more word."""
    import numpy as np

    h = (before ^ (before >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + following
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _is_set(bits, hashes):
    import numpy as np

    place = hashes % np.uint64(len(bits) * 64)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def bit_table(rows: DataFrame, bits: int = BITS):
    """Bits set for the phrases of rows (lang, prefix, next); at most bits / 64 rows are collected."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        seeds = Seeds()
        for batch in batches:
            found = []
            for lang, prefix, word in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), utf8(batch.column(2))):
                hashes = np.array([xxhash.xxh64_intdigest(w, seeds[lang]) for w in [*prefix.split(), word]], np.uint64)[:, None]
                found.append(functools.reduce(joined_hash, hashes))
            if found:
                place = np.concatenate(found) % np.uint64(bits)
                mask = np.uint64(1) << (place & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(mask.view(np.int64))], ["at", "mask"])

    found = rows.select("lang", "prefix", "next").mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return table


@dataclass(frozen=True)
class Round:
    """Which windows a pass counts: their lengths in words, and what earlier passes found frequent."""

    low: int
    high: int
    frequent: tuple = ()  # broadcast bit tables of the frequent words, pairs, ...
    parts: object = None  # broadcast {lang: {word: parts}} of words whose stripes are dealt over several parts
    spread: int = 1  # parts of the empty prefix's stripe
    buckets: int = 1


def _windows(codes, words, lang: str, round: Round) -> Iterator[tuple]:
    """The stripes of what a task holds, a length at a time: Arrow arrays of buckets and of their stripes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    hashes = word_hashes(words, lang)
    good = codes >= 0
    if round.frequent:
        good &= _is_set(round.frequent[0].value, hashes)[codes]
    parts = np.ones(len(words), np.int64)
    heavy = round.parts.value.get(lang, {}) if round.parts is not None else {}
    if heavy:
        found = pc.index_in(words, value_set=pa.array(list(heavy), pa.binary())).to_numpy(zero_copy_only=False)
        seen = np.flatnonzero(~np.isnan(found))
        parts[seen] = np.array(list(heavy.values()), np.int64)[found[seen].astype(np.int64)]
    # gram: for each place with a counted window of this length its number among the different ones; ids: their words.
    at = np.flatnonzero(good)
    gram, ids = codes[at].astype(np.int64), [np.arange(len(words))]
    for size in range(1, round.high + 1):
        if size > 1:
            fits = at + size - 1 < len(codes)
            at, gram = at[fits], gram[fits]
            last = at + size - 1
            fits = good[last]
            # The parts that end in the window's last word; those that end before it were looked at before.
            for length, table in enumerate(round.frequent[1:size], 2):
                ends = last[fits]
                parts_of = functools.reduce(joined_hash, [hashes[codes[ends - back]] for back in range(length - 1, -1, -1)])
                fits[fits] = _is_set(table.value, parts_of)
            at, gram, last = at[fits], gram[fits], last[fits]
            key = gram * len(words) + codes[last]
            key, gram, count = np.unique(key, return_inverse=True, return_counts=True)
            before, following = key // len(words), key % len(words)
            ids = [x[before] for x in ids] + [following]
        else:
            count = np.bincount(gram, minlength=len(words))
            before = np.zeros(len(words), np.int64)
        if size < round.low or not len(count):
            continue
        spread = np.full(len(count), round.spread) if size == 1 else parts[ids[0]]
        part = ((hashes[ids[-1]] >> np.uint64(20)) % spread.astype(np.uint64)).astype(np.int64)
        home = np.zeros(len(count), np.uint64)
        for x in ids[:-1]:
            home = joined_hash(home, hashes[x])
        bucket = (joined_hash(home, part.astype(np.uint64)) % np.uint64(round.buckets)).astype(np.int64)
        order = np.flatnonzero(count)
        order = order[np.lexsort((before[order], bucket[order]))]
        if not len(order):
            continue
        opens = _changes(bucket[order])
        starts = np.flatnonzero(opens | _changes(before[order]))
        heads = order[starts]
        taken = [words.take(pa.array(x[heads])) for x in ids[:-1]]
        prefix = pc.binary_join_element_wise(*taken, pa.scalar(b" ", pa.binary())) if taken else pa.array([b""] * len(heads), pa.binary())
        ends = pa.array(np.append(starts, len(order)).astype(np.int32))
        following = pa.ListArray.from_arrays(ends, words.take(pa.array(ids[-1][order])))
        counts = pa.ListArray.from_arrays(ends, pa.array(count[order].astype(np.int64)))
        firsts = np.flatnonzero(opens[starts])
        found = pa.StructArray.from_arrays([prefix, following, counts], ["prefix", "next", "n"])
        yield (
            pa.array(bucket[heads[firsts]].astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(np.append(firsts, len(heads)).astype(np.int32)), found),
        )


def _changes(values):
    """Where a value differs from the one before it."""
    import numpy as np

    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def _elements(stripes: Column) -> Column:
    """(prefix, next, n) of all elements of a row's stripes."""

    def of_one(stripe: Column) -> Column:
        each = F.arrays_zip(stripe["next"].alias("next"), stripe["n"].alias("n"))
        return F.transform(each, lambda e: F.struct(stripe["prefix"].alias("prefix"), e["next"].alias("next"), e["n"].alias("n")))

    return F.flatten(F.transform(stripes, of_one))


def counted(rows: DataFrame, round: Round, partitions: int) -> DataFrame:
    """(lang, prefix, next, n) of rows (lang, text): each task's stripes, shuffled by prefix, added up."""
    round = replace(round, buckets=BUCKETS_A_PARTITION * partitions)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["lang", "bucket", "stripes"]

        def stripes(lang: str) -> Iterator:
            for columns in _windows(*held.pop(lang).taken(), lang, round):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *columns], names)

        held: dict[str, Held] = {}
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                held.setdefault(lang, Held()).add(texts)
                if held[lang].full():
                    yield from stripes(lang)
            while sum(x.size for x in held.values()) >= FLUSH_WORDS or sum(len(x.numbers) for x in held.values()) >= FLUSH_DIFFERENT:
                yield from stripes(max(held, key=lambda x: held[x].size))
        for lang in list(held):
            yield from stripes(lang)

    emitted = rows.mapInArrow(run, _EMITTED)
    met = emitted.repartition(partitions, "lang", "bucket")
    # Rows are made of elements only: a task has a stripe for each prefix it meets, so their number may grow with tasks times prefixes.
    each = met.select("lang", "bucket", F.inline(_elements(F.col("stripes"))))
    summed = each.groupBy("lang", "bucket", "prefix", "next").agg(F.sum("n").alias("n"))
    return summed.select("lang", F.col("prefix").cast("string").alias("prefix"), F.col("next").cast("string").alias("next"), "n")


@dataclass(frozen=True)
class Stripes:
    """elements: (lang, prefix, next, n), merged, of all phrases with n >= min_count; totals: (lang, total) words."""

    elements: DataFrame
    totals: DataFrame


def stripes(docs: DataFrame, max_words: int = 5, min_count: int = 100, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> Stripes:
    """Merged stripes of all phrases of 1 to max_words words that occur min_count times or more in their language."""
    spark = docs.sparkSession
    rows = own_columns(docs, lang=lang_col, text=text_col).withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("und")))
    some = shuffle_partitions(spark)
    words = written(counted(rows, Round(1, 1, spread=BUCKETS_A_PARTITION * some), some), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    total = totals.agg(F.sum("total")).first()[0] or 0
    frequent = words.where(F.col("n") >= min_count)
    partitions = min(max(some, -(-total // WORDS_A_PARTITION)), MOST_PARTITIONS)
    share = max(1, total // partitions)
    # Fewer words than partitions have more than a share.
    heavy = frequent.where(F.col("n") > share).select("lang", "next", "n").collect()
    broadcast = spark.sparkContext.broadcast
    by_lang: dict[str, dict[bytes, int]] = {}
    for r in heavy:
        by_lang.setdefault(r.lang, {})[r.next.encode()] = -(-r.n // share)
    parts = broadcast(by_lang)
    elements, tables, last = frequent, (), frequent
    for low, high, name in ((2, 2, "pairs"), (3, 3, "triples"), (4, max_words, "longer")):
        if low <= max_words:
            tables = (*tables, broadcast(bit_table(last, bits)))
            found = counted(rows, Round(low, high, tables, parts), partitions)
            last = written(found.where(F.col("n") >= min_count), f"phrase-{name}")
            elements = elements.unionByName(last)
    return Stripes(elements, totals)


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(found: Stripes, scale: int = 1000, best: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two or more words.

    A phrase counts by its weakest cut, floor(scale * a * n / (l * r)), the first of equal ones. A phrase that always
    stands in the same longer one is left out: if any longer phrase has its frequency, one that is longer by one word
    has it too, so the largest elements to the right and to the left decide.
    """
    word_list = F.split("phrase", " ")
    phrases = found.elements.withColumn("phrase", F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")))
    phrases = phrases.select("lang", "prefix", "phrase", "n")
    pairs_up = phrases.where("prefix <> ''")
    right = pairs_up.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("n").alias("extended"))
    rest = F.substring("phrase", F.instr("phrase", " ") + 1, F.length("phrase"))
    left = pairs_up.groupBy("lang", rest.alias("phrase")).agg(F.max("n").alias("extended"))
    subsuming = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("extended").alias("extended"))
    whole = pairs_up.select("lang", "phrase", F.col("n").alias("a")).join(subsuming, ["lang", "phrase"], "left")
    whole = whole.where(F.col("a") > F.coalesce("extended", F.lit(0)))
    cut = whole.select("lang", "phrase", "a", word_list.alias("words"), F.posexplode(F.sequence(F.lit(1), F.size(word_list) - 1)).alias("_", "k"))
    cut = cut.select("lang", "phrase", "a", "k", _joined(F.slice("words", F.lit(1), F.col("k"))).alias("first"),
                     _joined(F.slice("words", F.col("k") + 1, F.size("words"))).alias("rest"))
    first = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    second = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cut = cut.join(first, ["lang", "first"]).join(second, ["lang", "rest"]).join(found.totals, "lang")
    big = "decimal(38,0)"
    score = F.expr(f"(CAST({scale} AS {big}) * CAST(a AS {big}) * CAST(total AS {big})) div (CAST(l AS {big}) * CAST(r AS {big}))")
    weakest = cut.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "total")
    weakest = weakest.agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", F.col("total").alias("n"), "cut.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = weakest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, max_words: int = 5, min_count: int = 100, scale: int = 1000, best: int = 2000,
         text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> DataFrame:
    """Each language's best collocations: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z), split into pieces at . , ; : ! ? and line ends, those into words at blanks and tabs.
    a, l and r count the phrase and the two parts of its weakest cut, n all words of the language. A null language is
    'und'; null and empty texts hold no words; repeated rows count as often as they stand there; an empty table gives no
    rows. Equal scores are ordered by a, falling, then by the phrase's bytes. Other columns are not looked at.
    """
    return collocations(stripes(docs, max_words, min_count, text_col, lang_col, bits), scale, best)

