"""Two-stage suffix sorting of a block of byte strings, and the common prefixes of neighbours in suffix order.

A suffix is small when it is less than the suffix that starts one byte later. Only small suffixes are sorted directly;
every other one is induced: scanning buckets (suffixes that share their first byte) in ascending order, the suffix one
byte ahead of each scanned suffix takes the next free place in its own bucket.
"""

from __future__ import annotations

PAD = 16  # zeros behind each string; they end its suffixes


def layout(strings: list[bytes]):
    """(text, places, room): the strings in one uint8 array, each followed by zeros.

    room holds, for every place, the bytes up to the end of its string (0 at the zeros). UTF-8 has no byte above 0xF4
    and none of 0xC0 and 0xC1, so raising the bytes below 0xC0 by one keeps the order and frees 0 for the ends.
    """
    import numpy as np

    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]]) if len(strings) else np.zeros(0, np.int64)
    raised = np.arange(256, dtype=np.uint8)
    raised[:0xC0] += 1
    total = int(lengths.sum()) + PAD * len(strings)
    text, room = np.zeros(total, np.uint8), np.zeros(total, np.int64)
    body = raised[np.frombuffer(b"".join(strings), np.uint8)]
    inside = np.arange(len(body)) + np.repeat(np.arange(len(strings)) * PAD, lengths)
    text[inside] = body
    room[inside] = np.repeat(starts + lengths, lengths) - inside
    return text, starts, room


def words_at(text, places, room, depth: int):
    """The eight bytes at places + depth as sortable integers; nothing behind the end of a string counts."""
    import numpy as np

    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    live = room[places] > depth
    at = np.where(live, places + depth, 0)
    return np.where(live, np.ascontiguousarray(eights[at]).view(">u8").ravel().astype(np.uint64), np.uint64(0))


def is_small(text):
    """Whether each suffix is less than the one a byte later; a zero counts as less than whatever follows."""
    import numpy as np

    n = len(text)
    if n == 0:
        return np.zeros(0, bool)
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    rises = np.ones(n, bool)
    rises[:-1] = text[:-1] < text[1:]
    # In a run of equal bytes, the last one decides.
    runs = np.flatnonzero(differs)
    return np.repeat(rises[runs], np.diff(np.concatenate([[-1], runs]))) | (text == 0)


def sort_directly(text, places, room):
    """The given suffixes in order; those equal up to the ends of their strings stay in order of place."""
    import numpy as np

    places = np.sort(places)
    open_, depth = np.arange(len(places)), 0
    order = places.copy()
    group = np.zeros(len(places), np.int64)  # suffixes that are still equal have the same number
    while len(open_):
        key = words_at(text, order[open_], room, depth)
        by = np.lexsort((key, group[open_]))
        sorted_places, sorted_key, sorted_group = order[open_][by], key[by], group[open_][by]
        order[open_] = sorted_places
        new = np.ones(len(by), bool)
        new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (sorted_group[1:] != sorted_group[:-1])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        alone = new & np.concatenate([new[1:], [True]])
        depth += 8
        # One that ended just here goes before those that go on, so it stays for one more round.
        open_ = open_[~alone & (room[sorted_places] >= depth)]
    return order


def suffix_order(text, room):
    """All suffixes that start inside a string, in order."""
    import numpy as np

    small = is_small(text)
    inside = room > 0
    direct = sort_directly(text, np.flatnonzero(small & inside), room)
    parts = np.split(direct, np.searchsorted(text[direct], np.arange(1, 257)))
    induced: list[list] = [[] for _ in range(257)]
    out = []

    def induce(ahead, own: int):
        """Place what precedes the scanned suffixes; returns what belongs to the bucket being scanned."""
        ahead = ahead[(ahead >= 0)]
        ahead = ahead[inside[ahead] & ~small[ahead]]
        heads = text[ahead]
        later = ahead[heads > own]
        if len(later):
            by = np.argsort(text[later], kind="stable")
            heads_of = text[later][by]
            cuts = np.flatnonzero(np.diff(heads_of)) + 1
            for piece in np.split(later[by], cuts):
                induced[text[piece[0]]].append(piece)
        return ahead[heads == own]

    # The end of a string is less than every byte, and ends are in order of place.
    induce(np.flatnonzero((room == 1)), 0)
    for c in range(1, 256):
        own = [np.concatenate(induced[c])] if induced[c] else []
        if not own and not len(parts[c]):
            continue
        wave = own[0] if own else np.zeros(0, np.int64)
        while len(wave):  # runs of this byte induce within the bucket
            ahead = wave - 1
            ahead = ahead[ahead >= 0]
            wave = ahead[inside[ahead] & ~small[ahead] & (text[ahead] == c)]
            if len(wave):
                own.append(wave)
        bucket = np.concatenate([*own, parts[c]])
        out.append(bucket)
        induce(bucket - 1, c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text, order, room, limit: int):
    """Bytes that each suffix of order shares with the one before it, counted up to limit; 0 for the first."""
    import numpy as np

    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for depth in range(0, limit, 8):
        if not len(live):
            break
        here, there = order[live], order[live - 1]
        differ = words_at(text, here, room, depth) ^ words_at(text, there, room, depth)
        odd = differ != 0
        first = (differ.astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(1)
        same = np.where(odd, first, 8)
        left = np.minimum(room[here], room[there]) - depth
        shared[live] += np.minimum(same, np.maximum(left, 0))
        live = live[~odd & (left > 8)]
    return np.minimum(shared, limit)
