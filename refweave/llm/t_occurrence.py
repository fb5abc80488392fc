"""T-occurrence search over inverted lists with DivideSkip (Li, Lu and Lu 2008)."""

from __future__ import annotations

import heapq
from itertools import groupby

import numpy as np

#: Weight of the probes in DivideSkip's number of long lists, T / (MU log2(longest list) + 1). Probes run on arrays here and
#: near copies share most of their long lists, so that more lists count as long than with the paper's 0.0085.
MU = 0.0005


def needed(size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Overlap from which sets of these sizes have a Jaccard similarity of percent / 100 or more."""
    return -(-percent * (size + sizes) // (100 + percent))


class Lists:
    """Inverted lists over sorted token sets: for each token, the members that hold it, in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        members = np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(tokens, kind="stable")
        tokens, self.members = tokens[by], members[by]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        self.start = np.append(np.flatnonzero(new), len(tokens))
        self.tokens = tokens[self.start[:-1]]

    def search(self, query: np.ndarray, percent: int, allowed: np.ndarray | None = None) -> np.ndarray:
        """Members whose Jaccard similarity with query reaches percent / 100; allowed: a mask of those that are asked about."""
        size = len(query)
        if not size or not len(self.tokens):
            return np.zeros(0, np.int64)
        most, least = size * 100 // percent, -(-size * percent // 100)
        able = (self.sizes >= least) & (self.sizes <= most)
        if allowed is not None:
            able &= allowed
        if not able.any():
            return np.zeros(0, np.int64)
        need = needed(size, self.sizes, percent)
        threshold = int(need[able].min())
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        if len(at) < threshold:
            return np.zeros(0, np.int64)
        lengths = self.start[at + 1] - self.start[at]
        at = at[np.argsort(lengths, kind="stable")]
        longest = int(lengths.max())
        long = min(threshold - 1, int(threshold / (MU * np.log2(longest + 1) + 1)))
        short, rest = at[: len(at) - long], at[len(at) - long :]
        members, counts = self._merged(short, able)
        keep = counts >= need[members] - long
        members, counts = members[keep], counts[keep]
        for i, token in enumerate(rest[::-1]):  # the longest first: nearly all hold it
            if not len(members):
                break
            row = self.members[self.start[token] : self.start[token + 1]]
            place = np.minimum(np.searchsorted(row, members), len(row) - 1)
            counts = counts + (row[place] == members)
            keep = counts + (long - 1 - i) >= need[members]
            if not keep.all():
                members, counts = members[keep], counts[keep]
        return members[counts >= need[members]]

    def _merged(self, tokens: np.ndarray, able: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members on the short lists that are able to link, and on how many of them they are: one merge on a heap."""
        rows = (self.members[self.start[t] : self.start[t + 1]] for t in tokens)
        merged = heapq.merge(*(r[able[r]].tolist() for r in rows))
        out = np.array([(m, sum(1 for _ in same)) for m, same in groupby(merged)], np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]
