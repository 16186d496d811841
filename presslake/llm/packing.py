"""Best-fit packing of tokenised documents into sequences, by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut from their ends, so that all pieces but the first fill a sequence of their own;
only shorter pieces are packed. They are dealt into shards of bounded size. A shard's packings evolve on several islands:
crossover puts whole well-filled bins of one parent into another, removes the bins that held the same pieces and
best-fits what was displaced; after each epoch an island's best packing moves to the next island of the shard. Islands
are rows, an epoch is one distributed step, and each epoch's state is written, so a lost executor costs its part of one
epoch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presslake.llm.common import own_columns, shuffle_partitions, utf8, written

LENGTH = 1024
END_ID = 2
SHARD_ITEMS, ISLANDS, EPOCHS = 65536, 4, 3
GENERATIONS, POPULATION = 6, 3
# The pre-tokenising pattern that byte-level vocabularies of this kind share.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str):
    """A function from a text to its ids, for a byte-level BPE vocabulary file of the tokenizers library.

    The same vocabulary is run by tiktoken, which gives the same ids several times faster. As in the library, a special
    token's string in a text is that token.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    # Byte-level vocabularies write a byte as itself if it is printable, else as the next unused character above 255.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    encode = getattr(encoding, "encode_to_numpy", encoding.encode)
    return lambda text: encode(text, allowed_special="all")


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, size) of a document's pieces: only the first may be shorter than length."""
    first = total % length or min(total, length)
    return [(0, first), *((at, length) for at in range(first, total, length))]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and, if asked for, ids: the pieces of every row of docs, row by row.

    A null text is empty, and so a single end id. Null and repeated doc_ids are carried along.
    """
    rows = own_columns(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = encoder(tokenizer)
        for batch in batches:
            texts = utf8(batch.column(1))
            for at in range(0, len(texts), 64):
                owner, out, ids_out = [], [], []
                for k, text in enumerate(texts[at : at + 64], at):
                    ids = np.append(np.asarray(encode(text.decode("utf-8", "replace")), "<u4"), np.uint32(end_id)).astype("<u4")
                    for n, (start, size) in enumerate(cut(len(ids), length)):
                        part = ids[start : start + size]
                        owner.append(k)
                        out.append((n, start, size, zlib.crc32(part.tobytes())))
                        if keep_ids:
                            ids_out.append(part.astype(np.int32))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [batch.column(0).take(pa.array(owner)), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    more = "piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return rows.mapInArrow(run, StructType([*rows.select("doc_id").schema, *StructType.fromDDL(more)]))


class Bins:
    """Bins of one capacity, found by what is left in them. Items are numbers into sizes."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] = ()):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int] | None] = []
        self.room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some bin has r left
        for items in bins:
            self.add(items)

    def add(self, items: list[int]) -> None:
        self._file(len(self.items), self.capacity - sum(map(self.sizes.__getitem__, items)))
        self.items.append(items)

    def _file(self, bin_: int, left: int) -> None:
        self.room[left].append(bin_)
        self.mask |= 1 << left

    def fit(self, item: int) -> None:
        """Put an item where it leaves the least room, or into a new bin."""
        size = self.sizes[item]
        fitting = self.mask >> size
        if not fitting:
            self.add([item])
            return
        left = (fitting & -fitting).bit_length() - 1 + size
        same = self.room[left]
        bin_ = same.pop()
        if not same:
            self.mask ^= 1 << left
        self.items[bin_].append(item)
        self._file(bin_, left - size)


def best_fit(sizes: list[int], order, capacity: int) -> list[list[int]]:
    bins = Bins(sizes, capacity)
    for item in order:
        bins.fit(item)
    return bins.items


def merit(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among equals, bins that are full or empty rather than half full."""
    return -len(bins), sum((sum(map(sizes.__getitem__, b)) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(mother: list[list[int]], father: list[list[int]], sizes: list[int], capacity: int, rng) -> list[list[int]]:
    """Inject well-filled bins of father into mother, drop the bins of mother they overlap, best-fit what is displaced."""
    fills = [sum(map(sizes.__getitem__, b)) for b in father]
    bar = sorted(fills)[len(fills) // 2]
    injected = [b for b, f in zip(father, fills) if f >= bar and rng.random() < 0.5]
    taken = set().union(*injected) if injected else set()
    kept, displaced = [list(b) for b in injected], []
    for b in mother:
        # Bins that overlap go, and so do some of the emptiest, whose items may fit better elsewhere.
        if taken.isdisjoint(b) and (sum(map(sizes.__getitem__, b)) >= bar or rng.random() < 0.7):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    bins = Bins(sizes, capacity, kept)
    for item in sorted(displaced, key=lambda i: -sizes[i]):
        bins.fit(item)
    return bins.items


def evolve(sizes: list[int], population: list[list[list[int]]], capacity: int, seed: int,
           generations: int = GENERATIONS, most: int = POPULATION) -> list[list[list[int]]]:
    """A population after some generations, best first. It ends early at a packing that cannot be improved."""
    import random

    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    while len(population) < most:
        spread = 0.0 if not population and seed % ISLANDS == 0 else 0.1
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + spread * rng.random()))
        population.append(best_fit(sizes, order, capacity))
        if len(population[-1]) <= least:
            break
    ranked = sorted(((merit(p, sizes, capacity), k, p) for k, p in enumerate(population)), reverse=True)
    count = len(ranked)
    for _ in range(generations):
        if -ranked[0][0][0] <= least or len(ranked) < 2:
            break
        mother, father = ranked[0][2], ranked[rng.randrange(1, len(ranked))][2]
        if rng.random() < 0.5:
            mother, father = father, mother
        child = crossover(mother, father, sizes, capacity, rng)
        ranked.append((merit(child, sizes, capacity), count, child))
        count += 1
        ranked = sorted(ranked, reverse=True)[:most]
    return [p for _, _, p in ranked]


def to_blob(population: list[list[list[int]]], items: int) -> bytes:
    """For each packing, the bin of each item."""
    import numpy as np

    out = np.zeros((len(population), items), "<i4")
    for row, bins in zip(out, population):
        if items:
            row[np.concatenate([np.asarray(b) for b in bins])] = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    return out.tobytes()


def from_blob(blob: bytes, items: int) -> list[list[list[int]]]:
    import numpy as np

    out = []
    for row in np.frombuffer(blob, "<i4").reshape(-1, items) if items else []:
        order = np.argsort(row, kind="stable")
        edges = np.flatnonzero(np.diff(row[order])) + 1
        out.append([x.tolist() for x in np.split(order, edges)])
    return out


def _islands(items: DataFrame, islands: int) -> DataFrame:
    """(shard, island, sizes, packings): every shard's sizes, largest first, on each of its islands."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        shard = table.column("shard")[0].as_py()
        sizes = np.sort(table.column("length").to_numpy())[::-1].astype("<i4").tobytes()
        return pa.table(
            {
                "shard": pa.array([shard] * islands, pa.int64()),
                "island": pa.array(range(islands), pa.int32()),
                "sizes": pa.array([sizes] * islands, pa.binary()),
                "packings": pa.array([b""] * islands, pa.binary()),
            }
        )

    return items.select("shard", "length").groupBy("shard").applyInArrow(run, "shard long, island int, sizes binary, packings binary")


def _epoch(state: DataFrame, parts: int, epoch: int, islands: int, capacity: int, generations: int, most: int) -> DataFrame:
    """One epoch on every island. Each passes its population on to itself and its best packing to the next island."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        shard, island = table.column("shard")[0].as_py(), table.column("island")[0].as_py()
        sizes = np.frombuffer(table.column("sizes")[0].as_py(), "<i4").tolist()
        blobs = sorted(table.column("packings").to_pylist(), key=len, reverse=True)
        population = [p for blob in blobs for p in from_blob(blob, len(sizes))]
        seed = (epoch * 1_000_003 + shard) * islands + island
        population = evolve(sizes, population, capacity, seed, generations, most)
        rows = [(shard, island, population), (shard, (island + 1) % islands, population[:1])]
        return pa.table(
            {
                "shard": pa.array([r[0] for r in rows], pa.int64()),
                "island": pa.array([r[1] for r in rows], pa.int32()),
                "sizes": pa.array([table.column("sizes")[0].as_py()] * 2, pa.binary()),
                "packings": pa.array([to_blob(r[2], len(sizes)) for r in rows], pa.binary()),
            }
        )

    spread = state.repartition(parts, "shard", "island")  # few bytes, much work: not to be gathered into few tasks
    return spread.groupBy("shard", "island").applyInArrow(run, state.schema)


def _placed(items: DataFrame, state: DataFrame, capacity: int) -> DataFrame:
    """items with sequence_id and offset by the best packing of their shard."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        order = pc.sort_indices(left, sort_keys=[("length", "descending"), ("row_no", "ascending")])
        left = left.take(order)
        n, sizes = left.num_rows, left.column("length").to_pylist()
        best = max((p for b in right.column("packings").to_pylist() for p in from_blob(b, n)), key=lambda p: merit(p, sizes, capacity))
        bin_of, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, items in enumerate(best):
            at = 0
            for i in items:
                bin_of[i], offset[i] = k, at
                at += sizes[i]
        shard = left.column("shard")[0].as_py()
        left = left.append_column("sequence_id", pa.array(bin_of + (shard << 32)))
        return left.append_column("offset", pa.array(offset)).drop_columns(["shard", "row_no"])

    schema = StructType([f for f in items.schema if f.name not in ("shard", "row_no")])
    schema = schema.add("sequence_id", "long").add("offset", "long")
    best = state.select("shard", "packings").groupBy("shard")
    return items.groupBy("shard").cogroup(best).applyInArrow(run, schema)


def pack(given: DataFrame, length: int = LENGTH, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS,
         epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """given (length, and any other columns but row_no, shard, sequence_id, offset) with sequence_id and offset.

    Every row is one item of 1 to length tokens. A full one is a sequence alone. Shards hold about shard_items items,
    whatever the number of rows; no sequence crosses shards, which costs at most about one sequence a shard. Equal rows
    are separate items. Without rows there are no sequences.
    """
    rows = written(given.withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    full = rows.where(F.col("length") >= length)
    full = full.select(*given.columns, (-F.col("row_no") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_ = rows.where(F.col("length") < length)
    shards = max(1, round(open_.count() / shard_items))
    items = open_.withColumn("shard", F.pmod(F.xxhash64("row_no"), F.lit(shards).cast("long")))
    state = _islands(items, islands)
    parts = min(shards * islands, 8 * shuffle_partitions(given.sparkSession))
    for epoch in range(epochs):
        state = written(_epoch(state, parts, epoch, islands, length, generations, population), "islands")
    return full.unionByName(_placed(items, state, length))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pack() of pieces with their ids: the sequences themselves, at most a sequence's length each."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(ordered["ids"]).alias("ids"))
