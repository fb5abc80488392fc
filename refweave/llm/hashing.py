"""Hashes of words, shingles and byte strings, computed over whole Arrow buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
#: Bytes that part words: blank and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at a time.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits (the finalizer of splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


TABLE = mix(np.arange(1, 257, dtype=_U) * _U(BASE))
LOWER = np.arange(256)
LOWER[65:91] += 32
TABLE_LOWER = TABLE[LOWER]


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_tables: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        _tables[:] = [powers(BASE, n), powers(_INVERSE, n)]
    return _tables


def words(body: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word of the texts, and the n + 1 offsets of each text's words.

    Works on pieces of about PIECE bytes that end where a word does, so that memory follows the words alone.
    """
    table = TABLE_LOWER if lower else TABLE
    n = len(body)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge = edge[:n]
    blank = SPACE[body]
    hashes, starts, ends = [], [], []
    at = 0
    while at < n:
        to = min(n, at + PIECE)
        while to < n:  # on to the end of the word
            stop = np.flatnonzero(blank[to : to + 4096] | edge[to : to + 4096])
            if len(stop):
                to += int(stop[0])
                break
            to = min(n, to + 4096)
        gap = blank[at:to]
        first = ~gap
        first[1:] &= gap[:-1] | edge[at + 1 : to]
        last = ~gap
        last[:-1] &= gap[1:] | edge[at + 1 : to]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            up, down = _power_tables(to - at + 1)
            sums = np.zeros(to - at + 1, _U)
            np.cumsum(table[body[at:to]] * up[: to - at], out=sums[1:])
            hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U)))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return none.astype(_U), none, none, np.zeros(len(offsets), np.int64)
    s = np.concatenate(starts)
    return np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, offsets, "left")


def doc_slices(offsets: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about most bytes, or one longer document."""
    doc, docs = 0, len(offsets) - 1
    while doc < docs:
        to = max(doc + 1, int(np.searchsorted(offsets, offsets[doc] + most, "right")) - 1)
        yield doc, to
        doc = to


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values, by doubling: as long as hashes, and of no use in the last k - 1 places."""
    out, part, width, done = np.zeros(0, _U), hashes.astype(_U, copy=True), 1, 0
    while True:
        if k == width:
            return part
        if k & width:
            if not done:
                out = np.zeros(len(hashes), _U)
            out[: len(out) - done or None] += part[done:] * _U(pow(BASE, done, 1 << 64)) if done < len(out) else _U(0)
            done += width
        if done == k:
            return out
        nxt = part.copy()
        if width < len(part):
            nxt[:-width] += part[width:] * _U(pow(BASE, width, 1 << 64))
        part, width = nxt, width * 2


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values; as long as the windows that fit."""
    width, low = 1, keys
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
    return low


#: Values cut into runs at a time: few enough to stay in a core's cache.
BLOCK = 1 << 17


def segments(hashes: np.ndarray, bounds: np.ndarray, window: int, k: int, table: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Cuts the windows of `window` consecutive values (words or bytes) into runs that share their minimizer.

    hashes: of the values, or bytes to look up in table; bounds: the n + 1 offsets of the documents, which no window
    crosses. A window's minimizer is the k consecutive values in it with the least hash, the leftmost if several have it;
    so equal windows have equal minimizers at equal places, wherever they stand. Returns arrays: start (first window),
    windows (how many), anchor (hash of the minimizer), content (hash of all values the run covers), doc.
    Every window lies in exactly one run, and the windows of one run differ. Documents are taken in blocks of about BLOCK
    values; a longer one is cut into pieces that overlap by a window, so memory is bounded however long a text is.
    """
    parts = []
    for doc, to in doc_slices(bounds, BLOCK):
        for at in range(int(bounds[doc]), max(int(bounds[doc]) + 1, int(bounds[to]) - window + 1), BLOCK) if to == doc + 1 else (int(bounds[doc]),):
            end = min(int(bounds[to]), at + BLOCK + window - 1) if to == doc + 1 else int(bounds[to])
            values = hashes[at:end] if table is None else table[hashes[at:end]]
            cut = np.clip(bounds[doc : to + 1] - at, 0, end - at)
            found = _segments(values, cut, window, k)
            if found is not None:
                parts.append((found[0] + at, *found[1:4], found[4] + doc))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(_U), none.astype(_U), none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments(hashes: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...] | None:
    n = len(hashes)
    if n < window:
        return None
    gram = mix(runs(hashes, k)[: n - k + 1])
    bits = max(1, int(n).bit_length())
    keys = gram >> _U(bits)
    keys <<= _U(bits)
    keys |= np.arange(len(keys), dtype=_U)
    place = sliding_min(keys, window - k + 1)
    place &= _U((1 << bits) - 1)
    fits = np.ones(len(place), bool)
    for b in bounds[1:-1]:
        fits[max(0, b - window + 1) : b] = False
    if bounds[-1] - window + 1 < len(fits):
        fits[max(0, bounds[-1] - window + 1) :] = False
    turn = np.ones(len(place) + 1, bool)
    np.not_equal(place[1:], place[:-1], out=turn[1:-1])
    turn[bounds[bounds <= len(place)]] = True
    before = np.concatenate(([False], fits))
    after = np.concatenate((fits, [False]))
    start = np.flatnonzero(after & (turn | ~before))
    stop = np.flatnonzero(before & (turn | ~after)) - 1
    if not len(start):
        return None
    content = (stop - start + 1).astype(_U)
    for ends in (start, stop):
        for off in [*range(0, window - k, k), window - k]:
            content = content * _U(BASE) + gram[ends + off]
        content = mix(content)
    return start, stop - start + 1, gram[place[start].astype(np.int64)], content, np.searchsorted(bounds, start, "right") - 1
