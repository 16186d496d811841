"""SimHash near-duplicates, compared at the anchors of a covering code.

A fingerprint has 64 bits; a pair is linked when at most two of them differ, so one of the two 32-bit halves differs in
at most one bit. Each half is covered by the code (31-bit Hamming code) x (one free bit): every half lies within its
covering radius 1 of an anchor, its home. A half is replicated to every anchor within radius + threshold, 1 + 1 bits,
so a fingerprint meets, at the other one's home, each fingerprint that it has to be compared with.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import never_broadcast, own_columns, utf8, written
from presslake.llm.components import components

MAX_BITS = 2
SEED = 42


def fingerprint_of(text: bytes, shingle: int, seed: int = SEED) -> int:
    """The 64-bit SimHash of the lower-cased words of a text, 0 without words."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.uint64)
    pairs = zip(starts[:n].tolist(), last.tolist())
    hashes = np.fromiter((digest(joined[i:j], seed) for i, j in pairs), "<u8", n)
    for i in range(0, n, 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    return int(np.packbits(counts > n // 2, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; row-local."""
    rows = own_columns(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [fingerprint_of(x, shingle) for x in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("fp", "long"))


def anchors_of(half):
    """For 32-bit halves (uint32 array): the home anchors, and a matrix of all anchors within two bits (repeats allowed)."""
    import numpy as np

    # Bits 0-30 hold positions 1-31 of the Hamming code, bit 31 is free. The syndrome is the exclusive or of the
    # positions that are set.
    syndrome = np.zeros(len(half), np.uint32)
    for place in range(1, 32):
        syndrome ^= ((half >> np.uint32(place - 1)) & np.uint32(1)) * np.uint32(place)
    flip = np.concatenate([[0], np.uint32(1) << np.arange(31, dtype=np.uint32)]).astype(np.uint32)
    home = half ^ flip[syndrome]
    near = [home, home ^ np.uint32(1 << 31)]
    for place in range(1, 32):
        # Two flips at positions p and p ^ syndrome lead to an anchor; with syndrome 0 they cancel out.
        near.append(half ^ flip[place] ^ flip[syndrome ^ np.uint32(place)])
    return home, np.stack(near, axis=1)


def _anchored(fps: DataFrame, visiting: bool) -> DataFrame:
    """fps (fp) with key: its home anchor of each half, or all anchors it visits."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part in (0, 1):
                half = ((fp >> np.uint64(32 * part)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                home, near = anchors_of(half)
                if visiting:
                    near.sort(axis=1)
                    keep = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
                    anchor, owner = near[keep], np.repeat(fp, keep.sum(1))
                else:
                    anchor, owner = home, fp
                key = anchor.astype(np.int64) | (part << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner.view(np.int64))], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: each pair of distinct fingerprints of fps (fp) that differ in one or two bits, once."""
    home = _anchored(fps, False).select("key", F.col("fp").alias("a"))
    guest = _anchored(fps, True).select("key", F.col("fp").alias("b"))
    diff = F.expr("a ^ b")
    low = F.bit_count(diff.bitwiseAND(F.lit(0xFFFFFFFF)))
    # A pair close in both halves meets in both; the lower half alone reports it.
    once = (F.col("key") < F.lit(1 << 32)) & (low <= 1) | (F.col("key") >= F.lit(1 << 32)) & (low > 1)
    met = home.join(never_broadcast(guest), "key")
    return met.where((F.col("a") < F.col("b")) & (F.bit_count(diff) <= MAX_BITS) & once).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    A null text is empty; texts without words have fingerprint zero and link like any other. Rows whose id is null get
    a fingerprint and a component, whose id is null if no row in it has an id. Repeated rows give repeated results.
    Equal fingerprints are one node with its smallest id, so a group of copies is one row in every later step.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes)).withColumnRenamed("node", "fp")
    least = roots.join(never_broadcast(nodes), "fp").groupBy("root").agg(F.min("first_id").alias("least_id"))
    labels = never_broadcast(nodes).join(roots.join(least, "root"), "fp", "left").select(
        "fp", F.coalesce("least_id", "first_id").alias("component_id")
    )
    return never_broadcast(prints).join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that lead their component; of rows that repeat the leading id, all stay. Null ids stay."""
    keep = near_duplicates(docs, shingle, id_col, text_col).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(keep, docs[id_col] == keep.doc_id, "left_semi")
    return named.unionByName(docs.where(F.col(id_col).isNull()))
