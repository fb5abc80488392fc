"""Suffix arrays by two-stage sorting (Itoh and Tanaka 1999), and their adjacent common prefixes, on numpy arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, numbered from 2 in byte order, with 1 behind each text; and where each text starts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.ones(first[-1], np.uint16)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    body = np.frombuffer(b"".join(texts), np.uint8)
    known = np.bincount(body, minlength=256) > 0
    out[inside] = (np.cumsum(known) + 1).astype(np.uint16)[body]
    return out, first[:-1]


class Keys:
    """The next symbols at each place, packed in order into 63 bits; 0 stands for the end of all."""

    def __init__(self, text: np.ndarray):
        self.bits = int(text.max(initial=1)).bit_length()
        self.width = 63 // self.bits
        padded = np.concatenate((text.astype(_U), np.zeros(self.width, _U)))
        self.packed = np.zeros(len(text) + 1, _U)
        for j in range(self.width):
            self.packed |= padded[j : j + len(self.packed)] << _U(self.bits * (self.width - 1 - j))

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.packed[np.minimum(places, len(self.packed) - 1)]


def is_smaller(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts behind it."""
    ahead = np.append(text[1:], 0)
    change = np.append(np.flatnonzero(text != ahead), len(text) - 1)
    return np.repeat(text[change] < ahead[change], np.diff(change, prepend=-1))


def _tied(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose keys are not told apart yet, and the number of each one's group."""
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    tied = ~new
    tied[:-1] |= ~new[1:]
    group = np.cumsum(new[tied]) - 1
    return at[tied], group


def sort_directly(keys: Keys, places: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes at places in order, by their next symbols, then the next ones where those are equal, and so on down to depth.
    One key holds the group of suffixes that are equal so far and as many symbols as fit beside it."""
    first = keys.at(places)
    by = np.argsort(first)
    order = places[by]
    at, group = _tied(np.arange(len(order)), first[by])
    done = keys.width
    while len(at) and (depth is None or done < depth):
        symbols = max(1, (63 - int(group[-1]).bit_length()) // keys.bits)
        shift = _U(keys.bits * symbols)
        key = (group.astype(_U) << shift) | (keys.at(order[at] + done) >> _U(keys.bits * (keys.width - symbols)))
        by = np.argsort(key)
        order[at] = order[at[by]]
        at, group = _tied(at, key[by])
        done += symbols
    return order


def suffix_array(text: np.ndarray, keys: Keys | None = None, depth: int | None = None) -> np.ndarray:
    """Suffix array in two stages: only suffixes smaller than their successors are sorted by comparing; the others are
    induced by one scan of the buckets from the smallest up, each put behind what its bucket already has.

    A bucket is scanned in waves: all it holds so far at once, then what that put into the same bucket. With a depth,
    suffixes that agree in so many symbols stand together, in any order; enough to find common prefixes up to it.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    keys = Keys(text) if keys is None else keys
    small = is_smaller(text)
    direct = sort_directly(keys, np.flatnonzero(small), depth)
    top = int(text.max()) + 1
    cuts = np.searchsorted(text[direct], np.arange(top + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(top)]
    large = ~small

    def induce(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[large[before]]
        if len(before):
            symbol = text[before]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            edges = np.concatenate(([0], np.flatnonzero(np.diff(symbol)) + 1, [len(symbol)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                waiting[int(symbol[a])].append(before[a:b])

    out: list[np.ndarray] = []
    induce(np.array([n]))
    for symbol in range(top):
        done = 0
        while done < len(waiting[symbol]):
            wave = waiting[symbol][done:]
            done = len(waiting[symbol])
            batch = np.concatenate(wave)
            out.append(batch)
            induce(batch)
        waiting[symbol] = []
        rest = direct[cuts[symbol] : cuts[symbol + 1]]
        if len(rest):
            out.append(rest)
            induce(rest)
    return np.concatenate(out)


def common_prefixes(keys: Keys, order: np.ndarray, left: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Common prefix of each suffix in order and the one before it, within one text; left: symbols up to each text's end.
    With a depth, those that don't reach it may be given too small.

    The symbols themselves are compared, as many at a time as a key packs.
    """
    ends = np.minimum(left[order], np.append(0, left[order[:-1]]))
    out = np.zeros(len(order), np.int64)
    live = np.flatnonzero(ends >= (1 if depth is None else depth))
    done, most = 0, int(ends.max(initial=0)) if depth is None else depth
    while len(live) and done < most:
        differ = keys.at(order[live - 1] + done) ^ keys.at(order[live] + done)
        if depth is not None:
            beyond = max(0, done + keys.width - depth)
            same = differ >> _U(keys.bits * beyond) == 0
            out[live[same]] = min(depth, done + keys.width)
        else:
            same = differ == 0
            agree = np.zeros(len(live), np.int64)
            for j in range(1, keys.width + 1):
                agree += differ >> _U(keys.bits * (keys.width - j)) == 0
            out[live] = done + agree
        live = live[same]
        done += keys.width
    return np.minimum(out, ends)


def _shared(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array; where in it a suffix shares a window with the one before it; which suffixes hold a window; where each text starts."""
    text, first = join(texts)
    keys = Keys(text)
    order = suffix_array(text, keys, window)
    sizes = np.diff(first, append=len(text))
    left = np.repeat(first + sizes - 1, sizes) - np.arange(len(text))
    return order, common_prefixes(keys, order, left, window) >= window, left[order] >= window, first


def byte_repeats(texts: list[bytes], places: np.ndarray, ranks: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the starts of the strings of `window` bytes that occur more than once, and of those of them that a text of a
    lower rank holds too or that stand further left in the same one. A text occurs as often as it has places."""
    if not texts:
        return []
    order, shared, fits, first = _shared(texts, window)
    owner = np.repeat(np.arange(len(texts)), np.diff(first, append=len(order)))[order]
    # neighbours that share a window are one string
    heads = np.flatnonzero(~shared)
    group = np.cumsum(~shared) - 1
    often = fits & (np.add.reduceat(places[owner], heads)[group] > 1)
    late = often & (np.minimum.reduceat(ranks[owner], heads)[group] < ranks[owner])
    # further left in one text: all of a text's own places but the leftmost
    mine = np.flatnonzero(often & (np.bincount(group)[group] > 1))
    by = mine[np.lexsort((order[mine], owner[mine], group[mine]))]
    again = (group[by[1:]] == group[by[:-1]]) & (owner[by[1:]] == owner[by[:-1]])
    late[by[1:][again]] = True
    out = []
    for hit in (often, late):
        at = np.sort(order[hit])
        edges = np.searchsorted(at, np.append(first, at[-1] + 1 if len(at) else 0))
        out.append([at[a:b] - f for a, b, f in zip(edges[:-1], edges[1:], first, strict=True)])
    return list(zip(*out, strict=True))
