"""License scan by diagonal voting.

Every rolling k-gram of a text's words is hashed and joined with the places of the templates' k-grams. A hit votes for
its diagonal, the place of the text at which the template would begin. Votes are added up by (text, template, diagonal);
neighbouring diagonals, as words put in or left out shift the rest, are merged, and the span they point to is verified
against the template word by word.

A template has gram length min(k, its words), so a phrase of two words is found like a long one. Exact templates need all
of their grams on one diagonal and each such diagonal is a place; others are accepted at an edit distance of at most
(1 - similarity) of their words. With E such edits and grams of k words, T - k + 1 - k * E grams survive on diagonals
at most E apart: that is the number of votes asked for, 1 at least.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presslake.functions.binding import with_computed
from presslake.llm.common import utf8, written

# Templates of at most so many grams are sent to every task; more are joined by a shuffle.
BROADCAST_GRAMS = 200_000
# What is lower-cased and what is no word.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = "".join(chr(c) for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))


@dataclass(frozen=True)
class Template:
    """A license notice; exact ones are phrases that are searched as they are."""

    label: str
    text: str
    exact: bool = False


# Phrases that name a license.
PHRASES = [
    Template("mit", "mit license", exact=True),
    Template("apache", "apache license", exact=True),
    Template("gpl", "general public license", exact=True),
]

# Wording of public license notices.
NOTICES = [
    Template("mit", "Released under the MIT License."),
    Template("mit", "Licensed under the MIT License."),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0."),
    Template(
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at",
    ),
    Template(
        "apache",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations",
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version",
    ),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template(
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template("cc-by", "Licensed under CC BY 4.0."),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: bytes) -> list[bytes]:
    """The words of a text: A-Z lower-cased, runs of digits, a-z and all that is not ASCII."""
    return text.translate(_TO_WORDS).split()


_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


@dataclass(frozen=True)
class _Known:
    """A template as words, with its gram length and the edits it may differ by."""

    label: str
    words: tuple
    exact: bool
    gram: int
    edits: int

    @property
    def votes(self) -> int:
        return max(1, len(self.words) - self.gram + 1 - self.gram * self.edits)


def _known(templates: Sequence[Template], k: int, similarity: float) -> list[_Known]:
    found = []
    for t in templates:
        words = tuple(words_of(t.text.encode()))
        if not words:
            raise ValueError(f"a template without words: {t.label}")
        edits = 0 if t.exact else int((1 - similarity) * len(words) + 1e-9)
        found.append(_Known(t.label, words, t.exact, min(k, len(words)), edits))
    return found


def _words(text: Column) -> Column:
    """words_of in Spark. Characters are exchanged and the text split at blanks: a pattern of words takes six times as long."""
    return F.array_remove(F.split(F.translate(text, UPPER + NO_WORD, LOWER + " " * len(NO_WORD)), " "), "")


def _key(text: Column, id: Column) -> list[Column]:
    """128 bits that tell rows apart; rows with the same id and text share them."""
    return [F.xxhash64(id, text).alias("k1"), F.xxhash64(text, id, F.lit("key")).alias("k2")]


def _grams(words: Column, length: int) -> Column:
    """(at, h) of all grams of so many words."""
    last = F.size(words) - F.lit(length - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.slice(words, i, F.lit(length))).alias("h")))


def template_grams(docs: DataFrame, known: list[_Known]) -> DataFrame:
    """(h, template, place) of the templates' grams, hashed by the same expression as the texts'."""
    spark = docs.sparkSession
    rows = [(i, [w.decode() for w in t.words], t.gram) for i, t in enumerate(known)]
    made = spark.createDataFrame(rows, "template int, words array<string>, gram int")
    sizes = sorted({t.gram for t in known})
    each = [made.where(F.col("gram") == g).select("template", F.inline(_grams(F.col("words"), g))) for g in sizes]
    grams = each[0]
    for more in each[1:]:
        grams = grams.unionByName(more)
    grams = grams.select("h", "template", F.col("at").alias("place"))
    return F.broadcast(grams) if sum(len(t.words) for t in known) <= BROADCAST_GRAMS else grams


def spans(docs: DataFrame, known: list[_Known], id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, spans array<struct<template, diagonal>>) of texts with places to verify."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = rows.select(*_key(F.col("text"), F.col("id")), "text")
    worded = with_computed(keyed, "words", _words(F.col("text"))).select("k1", "k2", "words")
    sizes = sorted({t.gram for t in known})
    rolled = worded.select("k1", "k2", F.inline(F.concat(*[_grams(F.col("words"), g) for g in sizes])))
    hits = rolled.join(template_grams(docs, known), "h")
    hits = hits.select("k1", "k2", "template", (F.col("at") - F.col("place")).alias("diagonal"), "place").distinct()
    votes = hits.groupBy("k1", "k2", "template", "diagonal").agg(F.count("*").alias("votes"))
    facts = F.element_at(F.array(*[F.struct(F.lit(len(t.words)).alias("size"), F.lit(t.edits).alias("edits"), F.lit(t.votes).alias("needed")) for t in known]), F.col("template") + 1)
    votes = votes.withColumn("t", facts)
    line = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(line) > F.col("t.edits")
    votes = votes.withColumn("island", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(line))
    whole = Window.partitionBy("k1", "k2", "template", "island")
    # An island wider than its template is several places; each piece of it is looked at.
    votes = votes.withColumns({"begin": F.min("diagonal").over(whole), "total": F.sum("votes").over(whole)})
    votes = votes.withColumn("piece", F.floor((F.col("diagonal") - F.col("begin")) / F.col("t.size")))
    enough = votes.where(F.col("total") >= F.col("t.needed"))
    best = enough.groupBy("k1", "k2", "template", "island", "piece").agg(F.max(F.struct("votes", (-F.col("diagonal")).alias("minus"))).alias("best"))
    return best.groupBy("k1", "k2").agg(F.collect_list(F.struct("template", (-F.col("best.minus")).alias("diagonal"))).alias("spans"))


def closest(template, window) -> tuple[int, int, int]:
    """(edits, start, end): the part of window nearest to template by edit distance, the first of the shortest ends."""
    import numpy as np

    def ends(t, w):
        steps = np.arange(len(w) + 1)
        row = np.zeros(len(w) + 1, np.int64)
        for i, word in enumerate(t):
            new = np.empty_like(row)
            new[0] = i + 1
            new[1:] = np.minimum(row[:-1] + (w != word), row[1:] + 1)
            row = np.minimum.accumulate(new - steps) + steps
        return row

    row = ends(template, window)
    end = int(np.argmin(row))
    back = ends(template[::-1], window[:end][::-1])
    return int(row[end]), end - int(np.argmin(back)), end


def verified(text: bytes, wanted: list[tuple[int, int]], known: list[_Known]) -> list[tuple]:
    """(template, start, end, similarity) of the places of a text that are what they seemed to be."""
    import numpy as np

    words = words_of(text)
    found = []
    for i, diagonal in wanted:
        t = known[i]
        if t.edits == 0:
            if diagonal >= 0 and tuple(words[diagonal : diagonal + len(t.words)]) == t.words:
                found.append((i, diagonal, diagonal + len(t.words), 1.0))
            continue
        low = max(0, diagonal - t.edits)
        part = words[low : max(0, diagonal + len(t.words) + t.edits)]
        number = {w: n for n, w in enumerate(dict.fromkeys(t.words))}
        edits, start, end = closest(np.array([number[w] for w in t.words]), np.array([number.get(w, -1) for w in part], np.int64))
        if edits <= t.edits:
            found.append((i, low + start, low + end, 1 - edits / len(t.words)))
    return found


def decided(found: list[tuple], known: list[_Known]) -> tuple:
    """(n_base, first, last, base_labels, labels, score, spans) of a text's verified places.

    Of overlapping notices with different labels those nearer to their templates count.
    """
    base = sorted((s, known[i].label) for i, s, _, _ in found if known[i].exact)
    notices = sorted({(s, e, known[i].label, sim) for i, s, e, sim in found if not known[i].exact}, key=lambda x: (-x[3], x[0] - x[1], x))
    kept: list[tuple] = []
    for s, e, label, sim in notices:
        if not any(s < e2 and s2 < e and label2 != label and sim2 > sim for s2, e2, label2, sim2 in kept):
            kept.append((s, e, label, sim))
    names = sorted({x for _, x in base})
    every = sorted({*names, *(x[2] for x in kept)})
    score = 1.0 if base else max((x[3] for x in kept), default=0.0)
    return len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(names), ",".join(every), score, sorted(kept)


_FOUND = (
    "k1 long, k2 long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "notices array<struct<start: long, end: long, label: string, similarity: double>>"
)


def scan(docs: DataFrame, phrases: Sequence[Template] = tuple(PHRASES), notices: Sequence[Template] = tuple(NOTICES), k: int = 3,
         similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, notices) of every row.

    base: places of the exact phrases; labels: theirs and those of notices found within the similarity, sorted and
    comma-joined, '' if there are none; score: the best similarity, 0 if there is nothing; notices: the spans in words,
    by start. A notice is found if one of its k-grams is whole. Null and empty texts have no words; rows with the same id
    and text get the same result; a null id is kept; an empty table gives no rows. Overlapping notices with different
    labels: the nearer one counts, both if they are equally near. Other columns are not looked at. A text is held whole
    by the task that verifies it, and its grams are an array in its row.
    """
    known = _known([*phrases, *notices], k, similarity)
    wanted = spans(docs, known, id_col, text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keyed = rows.select(*_key(F.col("text"), F.col("id")), "id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                            ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                            ("notices", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("similarity", pa.float64())])))])
        for batch in batches:
            out = []
            for k1, k2, text, asked in zip(*(batch.column(i).to_pylist() for i in (0, 1)), utf8(batch.column(2)), batch.column(3).to_pylist()):
                *facts, spans_found = decided(verified(text, [(x["template"], x["diagonal"]) for x in asked], known), known)
                kept = [dict(zip(("start", "end", "label", "similarity"), x)) for x in spans_found]
                out.append(dict(zip(schema.names, (k1, k2, *facts, kept))))
            yield pa.RecordBatch.from_pylist(out, schema)

    found = keyed.drop("id").join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(run, _FOUND)
    # Rows that share id and text gave the same line each.
    found = written(found.dropDuplicates(["k1", "k2"]), "license-spans")
    counted = keyed.select("k1", "k2", F.col("id").alias(id_col), F.size(_words(F.col("text"))).cast("long").alias("n_words"))
    none = {"n_base": F.lit(0), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    joined = counted.join(found, ["k1", "k2"], "left")
    filled = joined.withColumns({c: F.coalesce(F.col(c), v.cast(dict(found.dtypes)[c])) for c, v in none.items()})
    return filled.withColumn("notices", F.coalesce("notices", F.array().cast(dict(found.dtypes)["notices"]))).drop("k1", "k2")
