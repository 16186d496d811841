"""Toxicity by compression distance of windows.

A text is cut into windows of some words. Each is compressed once with a zstandard dictionary trained on toxic text and
once with one trained on ordinary text; the size differences of all windows are calibrated into one score.

Both dictionaries come from zstandard's trainer, given windows of one width. The ordinary one sees all windows of the
ordinary sample. A toxic text is ordinary in most of its windows, so the toxic one sees the windows around what differs:
those whose middle word has varied contexts (the word before and after) and is more frequent in toxic than in ordinary
text. Counting contexts rather than occurrences leaves out what repeats only because its document was copied. Where no
word differs, it sees all windows of the toxic sample. Both are followed by the same background of ordinary text, so that
a window of ordinary words has the same size under both.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from presslake.llm import compression as c

WIDTH = 5
# Bytes of one piece in the background; the segment and match lengths that the trainer counts by.
SLICE, SEGMENT, MATCH = 64, 16, 6


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    level: int
    words: int
    calibration: dict


def windows(text: bytes, words: int) -> list[bytes]:
    """The text, lower-cased (A-Z), in windows of words words; the last one may be shorter."""
    w = text.lower().split()
    return [b" %b " % b" ".join(w[i : i + words]) for i in range(0, len(w), words)]


def features(toxic: bytes, ordinary: bytes, level: int, words: int):
    """The function from a text to WIDTH numbers: the largest gains of its windows, their mean, the shares of high ones."""
    by_toxic, by_ordinary = (c.compressor(x, level, True).compress for x in (toxic, ordinary))

    def of(text: bytes) -> tuple[float, ...]:
        gains = sorted(len(by_ordinary(x)) - len(by_toxic(x)) for x in windows(text, words))
        if not gains:
            return (0.0,) * WIDTH
        top, n = gains[-3:], len(gains)
        return gains[-1], sum(top) / len(top), sum(gains) / n, sum(g >= 4 for g in gains) / n, sum(g >= 3 for g in gains) / n

    return of


def contexts(texts: list[bytes]) -> Counter:
    """Of each word, in how many different contexts it stands."""
    seen = set()
    for text in texts:
        w = text.split()
        seen.update(zip(w, [b"", *w], [*w[1:], b""]))
    return Counter(w for w, _, _ in seen)


def differing(toxic: list[bytes], ordinary: list[bytes], side: int, min_contexts: int, lift: float) -> list[bytes]:
    """The different windows of toxic texts, of a word and side words before and after it, around words that differ.

    A word differs if it has min_contexts contexts or more in toxic texts and, for the number of words in all of them,
    more than lift times as many as in ordinary ones.
    """
    own, other = contexts(toxic), contexts(ordinary)
    all_own, all_other = (sum(len(text.split()) for text in part) or 1 for part in (toxic, ordinary))
    differs = {w for w, n in own.items() if n >= min_contexts and n / all_own > lift * (other[w] + 0.5) / all_other}
    found = set()
    for text in toxic:
        w = text.split()
        found.update(b" %b " % b" ".join(w[max(0, i - side) : i + side + 1]) for i, x in enumerate(w) if x in differs)
    return sorted(found)


def trained(samples: list[bytes], size: int, level: int) -> bytes:
    """A dictionary of at most size bytes trained on samples; of too few to train on, their plain content."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def background(texts: list[bytes], size: int) -> bytes:
    """At most size bytes: the beginnings of texts evenly spread over all of them."""
    step = max(1, -(-len(texts) * SLICE // size))
    each = max(SLICE, size * step // max(1, len(texts)))
    return b" ".join(x[:each] for x in texts[::step])[:size]


def dictionaries(toxic: list[bytes], ordinary: list[bytes], size: int, plain_bytes: int, side: int, min_contexts: int,
                 lift: float, level: int) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries from lower-cased samples, each trained part before the same background."""
    usual = [sorted({w for text in part for w in windows(text, 2 * side + 1)}) for part in (toxic, ordinary)]
    special = differing(toxic, ordinary, side, min_contexts, lift) or usual[0]
    plain = background([x for x in ordinary if x], plain_bytes)
    return trained(special, size, level) + plain, trained(usual[1], size, level) + plain


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: Column | None = None, per_class: int = 4000,
        piece_chars: int = 4000, calibration_rows: int = 10000, dictionary_bytes: int = 2048, plain_bytes: int = 65536,
        side: int = 1, min_contexts: int = 6, lift: float = 4.0, level: int = 12, words: int = 8,
        id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from labels (doc_id, label 0 or 1; 1 is toxic) of docs.

    Bounds as for quality: per_class rows of each label with piece_chars characters of each come to the driver;
    calibration_rows whole texts give WIDTH numbers each. plain_bytes of the ordinary pieces are the background, SLICE
    bytes of a piece. Only one label, or none: the score is that share for every text. Labels that are null or neither
    0 nor 1, and those of null or unknown ids, are not learnt from; of several labels of an id the least counts.
    """
    rows = c.labelled(labels, label, id_col, train)
    few = c.sample_ids(rows, 0, per_class, "label = 1").union(c.sample_ids(rows, 0, per_class, "label = 0"))
    sample = [(x, t.lower()) for x, t in c.pieces(docs, few, piece_chars, id_col, text_col)]
    parts = [[t for x, t in sample if x == k] for k in (1, 0)]
    toxic, ordinary = dictionaries(*parts, dictionary_bytes, plain_bytes, side, min_contexts, lift, level)
    model = c.calibrated(
        docs, c.sample_ids(rows, 1, calibration_rows), lambda: features(toxic, ordinary, level, words), WIDTH, id_col, text_col
    )
    return ToxicityModel(toxic, ordinary, level, words, model)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The keep columns of docs with _score, the chance of label 1.

    Whole texts, row by row, so repeated rows and null ids are scored like others and an empty table gives no rows. A
    null text is an empty one; it has no windows and the score of WIDTH zeros. A very long text is one list of numbers,
    one for each window. Columns called _score or _text travel in a struct of keep, as corpus_pipeline does.
    """
    toxic, ordinary, level, words = model.toxic, model.ordinary, model.level, model.words
    return c.scored(docs, text_col, lambda: features(toxic, ordinary, level, words), WIDTH, model.calibration, keep)
