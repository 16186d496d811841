"""Removal of byte strings that occurred earlier in the corpus, by suffix sorting.

A string of min_len bytes is a repeat when the same bytes start earlier: in a smaller doc_id, or earlier in the
document. Every byte covered by a repeat goes. The work is laid out as follows.

1. Anchors. Among the hashes of all 32-byte grams in a window of min_len bytes, the least (leftmost of equals) anchors
   the window. Equal windows have equal anchors at equal offsets, so only windows that share an anchor need comparing.
   Consecutive windows with one anchor form a segment.
2. Byte-identical segments of one anchor collapse to the earliest before and after the shuffle: the others are repeats
   as a whole, so a group of copies costs one row per task however large it is.
3. Anchors left with several different segments go to two-stage suffix sorting, whole anchors together; windows whose
   neighbours in suffix order share min_len bytes are equal, and all but the earliest are repeats.
4. An anchor with more than hot_segments different segments would make one large sorting block. Its windows are keyed
   by their own 128-bit digest instead and meet in a partial aggregate: the same answer for any number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presslake.llm.common import in_chunks, never_broadcast, shuffle_partitions, utf8, written
from presslake.llm.suffixes import common_prefixes, layout, suffix_order

MIN_LEN = 100
GRAM = 32
HOT_SEGMENTS = 4096
SORT_BYTES = 1 << 20
FLUSH_SEGMENTS = 1 << 18
SCAN_BYTES = 1 << 20
PIECE = 2 << 20
LONG, INT = "<i8", "<i4"


def grams(data):
    """A 64-bit hash of the 32 bytes at each place, by doubling."""
    import numpy as np

    table = np.random.Generator(np.random.PCG64(32)).integers(1, 1 << 63, 256, dtype=np.uint64)
    h = table[data]
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:] if len(h) > step else h[:0]
        h ^= h >> np.uint64(29)
        step *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def segments(texts: list[bytes], min_len: int = MIN_LEN):
    """(text number, first start, count of starts, anchor hash, content digest) of each segment of the texts."""
    import numpy as np
    import xxhash

    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    joined = b"".join(texts)
    none = np.zeros(0, np.int64)
    if len(joined) < min_len:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = grams(np.frombuffer(joined, np.uint8))
    # The place in the low bits makes the leftmost of equals the least, and tells where the least is.
    bits = max(1, int(len(gram)).bit_length())
    low = np.uint64((1 << bits) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width, reach = min_len - GRAM + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    anchor = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)[: len(anchor)]
    valid = np.arange(len(anchor)) + min_len <= ends[owner]
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(valid & change)
    stops = np.append(np.flatnonzero(change | ~valid), len(anchor))
    counts = stops[np.searchsorted(stops, starts, side="right")] - starts
    digest, view = xxhash.xxh3_64_intdigest, memoryview(joined)
    pairs = zip(starts.tolist(), (starts + counts + min_len - 1).tolist())
    content = np.fromiter((digest(view[i:j]) for i, j in pairs), np.uint64, len(starts))
    number = owner[starts]
    return number, starts - (ends - lengths)[number], counts, gram[anchor[starts]], content


def pieces(texts: list[bytes], min_len: int) -> Iterator[tuple[int, int, bytes]]:
    """(text number, offset, bytes): very long texts in pieces that share the windows' overlap."""
    for i, text in enumerate(texts):
        if len(text) <= PIECE:
            yield i, 0, text
        else:
            for at in range(0, len(text) - min_len + 1, PIECE):
                yield i, at, text[at : at + PIECE + min_len - 1]


def pack(doc, start, count, anchor=None, content=None) -> bytes:
    """Columns one after another; the well-compressible ones are compressed."""
    import numpy as np
    import zstandard

    small = zstandard.ZstdCompressor(level=1).compress(
        b"".join([doc.astype(LONG).tobytes(), start.astype(INT).tobytes(), count.astype(INT).tobytes()])
    )
    head = np.array([len(doc), len(small)], LONG).tobytes()
    return head + small + (b"" if anchor is None else anchor.tobytes() + content.tobytes())


def unpack(blob: bytes):
    import numpy as np
    import zstandard

    n, size = np.frombuffer(blob, LONG, 2)
    small = zstandard.ZstdDecompressor().decompress(blob[16 : 16 + size])
    doc = np.frombuffer(small, LONG, n)
    start, count = np.frombuffer(small, INT, n, 8 * n), np.frombuffer(small, INT, n, 12 * n)
    rest = np.frombuffer(blob, np.uint64, offset=16 + size) if len(blob) > 16 + size else np.zeros(0, np.uint64)
    return doc, start, count, rest[:n], rest[n:]


def collapse(doc, start, count, anchor, content):
    """(order, first): an order by anchor, content and place, and which entries are the earliest of their content."""
    import numpy as np

    order = np.lexsort((start, doc, content, anchor))
    first = np.ones(len(order), bool)
    if len(order):
        a, c = anchor[order], content[order]
        first[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    return order, first


def _anchored(docs: DataFrame, min_len: int, buckets: int) -> DataFrame:
    """(bucket, settled, blob): the segments of docs (doc_id, text), packed by bucket of their anchors."""

    def flush(kept):
        import numpy as np

        doc, start, count, anchor, content = (np.concatenate(x) for x in zip(*kept))
        order, first = collapse(doc, start, count, anchor, content)
        again, order = order[~first], order[first]
        if len(again):
            yield int(doc[again[0]] % buckets), True, pack(doc[again], start[again], count[again])
        # Anchors are least hashes and so mostly small; mixed again they spread evenly.
        bucket = ((anchor[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)
        by = np.argsort(bucket, kind="stable")
        order, bucket = order[by], bucket[by]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for part in np.split(np.arange(len(order)), cuts):
            if len(part):
                at = order[part]
                yield int(bucket[part[0]]), False, pack(doc[at], start[at], count[at], anchor[at], content[at])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(rows):
            for row in rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[0]], pa.int32()), pa.array([row[1]]), pa.array([row[2]], pa.binary())],
                    ["bucket", "settled", "blob"],
                )

        kept, held = [], 0
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), np.int64)
            cut = list(pieces(utf8(batch.column(1)), min_len))
            for i, j in in_chunks([x[2] for x in cut], SCAN_BYTES):
                number, start, count, anchor, content = segments([x[2] for x in cut[i:j]], min_len)
                whose = np.array([x[0] for x in cut[i:j]], np.int64)[number] if len(number) else number
                shift = np.array([x[1] for x in cut[i:j]], np.int64)[number] if len(number) else number
                kept.append((ids[whose], start + shift, count, anchor, content))
                held += len(number)
                if held >= FLUSH_SEGMENTS:
                    yield from out(flush(kept))
                    kept, held = [], 0
        if held:
            yield from out(flush(kept))

    return docs.mapInArrow(run, "bucket int, settled boolean, blob binary")


def _settle(anchored: DataFrame, hot_segments: int) -> DataFrame:
    """(kind, doc_id, start, count, anchor): kind 0 repeats as a whole, 1 segments to sort, 2 segments of hot anchors."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        settled = table.column("settled").to_pylist()
        blobs = [unpack(x) for x in table.column("blob").to_pylist()]
        none = np.zeros(0, np.int64)
        parts = [(np.zeros(len(d), np.int8), d, s, c, np.zeros(len(d), np.uint64)) for x, (d, s, c, _, _) in zip(settled, blobs) if x]
        open_ = [b for x, b in zip(settled, blobs) if not x]
        if open_:
            doc, start, count, anchor, content = (np.concatenate(x) for x in zip(*open_))
            order, first = collapse(doc, start, count, anchor, content)
            again = order[~first]
            parts.append((np.zeros(len(again), np.int8), doc[again], start[again], count[again], anchor[again]))
            order = order[first]
            heads = anchor[order]
            edge = np.flatnonzero(np.diff(heads, prepend=~heads[:1])) if len(heads) else none
            size = np.diff(np.append(edge, len(heads)))
            many = np.repeat(size, size)
            for kind, mask in ((1, (many > 1) & (many <= hot_segments)), (2, many > hot_segments)):
                at = order[mask]
                parts.append((np.full(len(at), kind, np.int8), doc[at], start[at], count[at], anchor[at]))
        kind, doc, start, count, anchor = (np.concatenate(x) for x in zip(*parts)) if parts else [none] * 5
        return pa.table(
            {
                "kind": pa.array(kind.astype(np.int8)),
                "doc_id": pa.array(doc.astype(np.int64)),
                "start": pa.array(start.astype(np.int32)),
                "count": pa.array(count.astype(np.int32)),
                "anchor": pa.array(anchor.astype(np.uint64).view(np.int64)),
            }
        )

    return anchored.groupBy("bucket").applyInArrow(run, "kind byte, doc_id long, start int, count int, anchor long")


def _fetched(docs: DataFrame, wanted: DataFrame, min_len: int) -> DataFrame:
    """(anchor, doc_id, start, count, bytes) of segments to sort; for hot anchors a row per window: (high, low, doc_id, start)."""
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "start", "count", "anchor")).alias("asked"))
    found = docs.join(never_broadcast(asked), "doc_id").select("doc_id", "text", "asked")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        names = ["anchor", "doc_id", "start", "count", "body", "high", "low"]
        for batch in batches:
            rows = []
            for doc, text, asks in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()):
                for ask in asks:
                    s, n = ask["start"], ask["count"]
                    if ask["kind"] == 1:
                        rows.append((ask["anchor"], doc, s, n, text[s : s + n + min_len - 1], None, None))
                        continue
                    for p in range(s, s + n):
                        digest = xxhash.xxh3_128_intdigest(text[p : p + min_len])
                        high, low = (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)
                        rows.append((None, doc, p, 1, None, high, low))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return found.mapInArrow(run, "anchor long, doc_id long, start int, count int, body binary, high long, low long")


def repeats_in_block(doc, start, bodies: list[bytes], min_len: int):
    """(doc, place) of the windows of a block of segments that are not the earliest of their kind."""
    import numpy as np

    text, begins, room = layout(bodies)
    order = suffix_order(text, room)
    order = order[room[order] >= min_len]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(common_prefixes(text, order, room, min_len) < min_len)
    segment = np.searchsorted(begins, order, side="right") - 1
    docs, places = doc[segment], start[segment] + order - begins[segment]
    by = np.lexsort((places, docs, group))
    again = by[1:][group[by][1:] == group[by][:-1]]
    return docs[again], places[again]


def _sorted_blocks(fetched: DataFrame, min_len: int, blocks: int) -> DataFrame:
    """(doc_id, start, count): the repeats among the segments to sort."""
    ready = fetched.where("body is not null").withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))

    def run(table):
        import numpy as np
        import pyarrow as pa

        anchor = table.column("anchor").to_numpy()
        doc, start = table.column("doc_id").to_numpy(), table.column("start").to_numpy().astype(np.int64)
        bodies = table.column("body").to_pylist()
        order = np.argsort(anchor, kind="stable")
        sizes = np.cumsum(np.fromiter((len(bodies[i]) for i in order), np.int64, len(order)))
        edges = np.append(np.flatnonzero(np.diff(anchor[order])) + 1, len(order))
        found, begin = [], 0
        for k, end in enumerate(edges):
            # Whole anchors together, about SORT_BYTES at a time.
            grown = sizes[edges[k + 1] - 1] if k + 1 < len(edges) else None
            if grown is None or grown - (sizes[begin - 1] if begin else 0) > SORT_BYTES:
                part = order[begin:end]
                found.append(repeats_in_block(doc[part], start[part], [bodies[i] for i in part], min_len))
                begin = end
        docs, places = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 2
        by = np.lexsort((places, docs))
        docs, places = docs[by], places[by]
        head = np.ones(len(docs), bool)
        head[1:] = (docs[1:] != docs[:-1]) | (places[1:] != places[:-1] + 1)
        runs = np.flatnonzero(head)
        count = np.diff(np.append(runs, len(docs)))
        return pa.table({"doc_id": docs[runs], "start": places[runs].astype(np.int32), "count": count.astype(np.int32)})

    return ready.groupBy("block").applyInArrow(run, "doc_id long, start int, count int")


def _hot_windows(fetched: DataFrame) -> DataFrame:
    """(doc_id, start, count): the repeats among the windows of hot anchors."""
    rows = fetched.where("high is not null").select("high", "low", "doc_id", "start")
    first = rows.groupBy("high", "low").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
    again = never_broadcast(rows).join(first.where("n > 1"), ["high", "low"])
    return again.where(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", F.lit(1).alias("count"))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of the rows that take part."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.where("doc_id is not null")
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.xxhash64("text")).alias("mark"))
    repeated = repeated.where("n > 1").select("doc_id", "mark")
    if repeated.isEmpty():
        return rows
    kept = rows.join(repeated, "doc_id", "left").where("mark is null or mark = xxhash64(text)")
    return kept.select("doc_id", "text").dropDuplicates(["doc_id"])


def repeats(docs: DataFrame, min_len: int = MIN_LEN, id_col: str = "doc_id", text_col: str = "text",
            hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, found): for each document with repeats, runs (start, count) of places where a repeat of min_len bytes starts.

    Rows with a null id take no part. Of rows that share an id, one text (that of the greatest xxhash64) takes part.
    Runs may touch or overlap; merged() makes byte ranges of them.
    """
    if min_len < GRAM:
        raise ValueError(f"min_len is at least {GRAM}")
    spark = docs.sparkSession
    rows = _judged(docs, id_col, text_col)
    buckets = 2 * shuffle_partitions(spark)
    settled = written(_settle(_anchored(rows, min_len, buckets), hot_segments), "anchors")
    fetched = written(_fetched(rows, settled.where("kind > 0"), min_len), "segments")
    found = settled.where("kind = 0").select("doc_id", "start", "count")
    found = found.union(_sorted_blocks(fetched, min_len, buckets)).union(_hot_windows(fetched))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("found"))


def merged(found: list[dict], min_len: int) -> list[tuple[int, int]]:
    """Byte ranges covered by windows of min_len bytes at the given starts."""
    out: list[list[int]] = []
    for start, stop in sorted((x["start"], x["start"] + x["count"] - 1 + min_len) for x in found):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, min_len: int = MIN_LEN, id_col: str = "doc_id", text_col: str = "text",
                   hot_segments: int = HOT_SEGMENTS, whole_characters: bool = False) -> DataFrame:
    """docs' rows as struct `row`, with kept (binary: the bytes that stay), n_bytes and spans (removed ranges).

    With whole_characters, a character of which a removed range takes a part goes as a whole; spans are as found.

    A null text is empty: nothing is removed and kept has no bytes. Rows with a null id come back whole. Of rows that
    share an id, one text is judged, and rows with that text share its result; rows with another text come back whole.
    """
    found = repeats(docs, min_len, id_col, text_col, hot_segments)
    mark = F.xxhash64(F.col(f"row.`{text_col}`"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("doc_id", F.col(f"row.`{id_col}`").cast("long"))
    if not _unique(docs, id_col):
        chosen = _judged(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("mark"))
        found = found.join(chosen, "doc_id")
        joined = rows.withColumn("mark", mark).join(found, ["doc_id", "mark"], "left")
    else:
        joined = rows.join(found, "doc_id", "left")
    ready = joined.select("row", F.col(f"row.`{text_col}`").alias("text"), "found")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            kept, spans, sizes = [], [], []
            for text, found in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                gone = merged(found or [], min_len)
                at, stay = 0, []
                for a, b in gone:
                    if whole_characters:
                        a, b = _to_characters(text, a, b)
                    stay.append(text[at:a])
                    at = b
                kept.append(b"".join([*stay, text[at:]]))
                spans.append([{"start": a, "end": b} for a, b in gone])
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(spans, span)],
                ["row", "kept", "n_bytes", "spans"],
            )

    more = StructType.fromDDL("kept binary, n_bytes long, spans array<struct<start: bigint, end: bigint>>")
    schema = StructType([*ready.select("row").schema, *more])
    return ready.mapInArrow(run, schema)


def _to_characters(text: bytes, start: int, stop: int) -> tuple[int, int]:
    """The range widened to whole UTF-8 characters."""
    while start > 0 and text[start] & 0xC0 == 0x80:
        start -= 1
    while stop < len(text) and text[stop] & 0xC0 == 0x80:
        stop += 1
    return start, stop


def _unique(docs: DataFrame, id_col: str) -> bool:
    return docs.groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).count().where("count > 1 and doc_id is not null").isEmpty()
