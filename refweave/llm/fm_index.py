"""A compressed FM-index over a shard of texts: a wavelet matrix of packed bits over the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; text holds small integers, and 0 parts texts (earlier zeros are smaller)."""
    n = len(text)
    rank = text.astype(np.int64)
    zeros = np.flatnonzero(text == 0)
    rank += len(zeros)
    rank[zeros] = np.arange(len(zeros))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1 if width < n else 0
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        if new[order[-1]] == n - 1 or width >= n:
            return order
        rank, width = new, width * 2


class BitVector:
    """Packed bits with a count before each word: rank in constant time at 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(_U)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words)))).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word, bit = i >> 6, (i & 63).astype(_U)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & ((_U(1) << bit) - _U(1)))


class WaveletMatrix:
    """rank of any symbol in log2(alphabet) bit ranks."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        now = symbols
        for level in reversed(range(self.levels)):
            bit = (now >> level & 1).astype(np.uint8)
            self.bits.append(BitVector(bit))
            self.zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in zip(reversed(range(self.levels)), self.bits, self.zeros, strict=True):
            ones = bits.rank(i)
            i = np.where(symbol >> level & 1 == 1, zeros + ones, i - ones)
        return i


class FMIndex:
    """Backward search over integer texts that zeros part. symbols are 1 to sigma - 1.

    The suffix array is not kept: besides the wavelet matrix there is only, in as few bytes as it takes, which text each suffix
    in order belongs to.
    """

    def __init__(self, text: np.ndarray, sigma: int):
        self.n = len(text)
        order = suffix_order(text)
        self.wavelet = WaveletMatrix(text[order - 1], sigma)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.base = self.wavelet.down(np.arange(sigma), np.zeros(sigma, np.int64))
        owner = np.cumsum(text == 0) - (text == 0)
        self.text_of = owner[order].astype(np.min_scalar_type(int(owner.max(initial=0))))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with symbol and go on as those in [low, high)."""
        at = self.less[symbol] - self.base[symbol]
        return at + self.wavelet.down(symbol, low), at + self.wavelet.down(symbol, high)

    def matching(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed text against the index: how far back from each end (up to most) what stands
        there occurs at least twice in the index, and the suffix interval of those that reach most."""
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        live = np.arange(len(ends))
        for step in range(most):
            at = ends[live] - step
            a, b = self.extend(text[at], low[live], high[live])
            go = (b - a >= 2) & (text[at] > 0)
            live, a, b = live[go], a[go], b[go]
            low[live], high[live] = a, b
            length[live] = step + 1
            if not len(live):
                break
        return length, low, high


def word_repeats(texts: list[bytes], places: np.ndarray, ranks: np.ndarray, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the windows of `window` words that occur more than once, and those of them that a text of a lower rank holds
    too or that stand further left in the same one. A text occurs as often as it has places."""
    if not texts:
        return []
    split = [t.split() for t in texts]
    lengths = np.array([len(x) for x in split], np.int64)
    known: dict[bytes, int] = {}
    flat: list[int] = []
    for ws in split:
        flat.extend([known.setdefault(w, len(known) + 1) for w in ws])
        flat.append(0)
    text = np.array(flat, np.int64)
    index = FMIndex(text, len(known) + 1)
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    counts = np.maximum(lengths - window + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(counts)))[:-1], counts)
    length, low, high = index.matching(text, place + first[owner] + window - 1, window)
    hit = np.flatnonzero(length == window)
    late = np.zeros(len(hit), bool)
    if len(hit):
        lows, where = np.unique(low[hit], return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[where] = high[hit]
        pairs = np.column_stack((lows, highs)).ravel()
        lowest = np.minimum.reduceat(np.append(ranks[index.text_of], len(texts)), pairs)[::2][where]
        late = ranks[owner[hit]] > lowest
        # the same window further left in one text: of a text's windows in one interval, all but the leftmost
        by = np.lexsort((place[hit], owner[hit], where))
        again = np.zeros(len(hit), bool)
        again[by[1:]] = (where[by[1:]] == where[by[:-1]]) & (owner[hit][by[1:]] == owner[hit][by[:-1]])
        late |= again
    # a text of several places occurs more than once as a whole
    found = [np.flatnonzero((length == window) | (places[owner] > 1)), hit[late]]
    edges = [np.searchsorted(owner[x], np.arange(len(texts) + 1)) for x in found]
    return [tuple(place[x[e[i] : e[i + 1]]] for x, e in zip(found, edges, strict=True)) for i in range(len(texts))]
