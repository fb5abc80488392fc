"""The numpy kernels against brute force on random small inputs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from refweave.llm import fm_index, hashing, packing, sharding, suffix_array
from refweave.llm.t_occurrence import Lists


def test_words_are_cut_and_hashed_alike_anywhere():
    texts = [b"", b"  ", b"a b\tc\r\nd", b"A b", b"x" * 5000, " é ü y ".encode(), b"a b"]
    body, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = hashing.words(body, offsets)
    was, hashing.PIECE = hashing.PIECE, 3
    try:
        pieces = hashing.words(body, offsets)
    finally:
        hashing.PIECE = was
    for a, b in zip(whole, pieces, strict=True):
        assert (a == b).all()
    h, s, e, w = whole
    assert [bytes(body[a:b]) for a, b in zip(s, e, strict=True)] == [x for t in texts for x in t.split()]
    assert np.diff(w).tolist() == [len(t.split()) for t in texts]
    assert h[0] == h[w[6]] and h[0] != h[w[3]]
    assert hashing.words(body, offsets, lower=True)[0][w[3]] == h[0]


def test_segments_hold_every_window_once_and_align_equal_windows():
    rng = random.Random(3)
    for block in (8, 1 << 17):
        was, hashing.BLOCK = hashing.BLOCK, block
        try:
            for _ in range(60):
                docs = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(4)]
                flat, bounds = np.array([x for d in docs for x in d], np.uint8), np.cumsum([0, *map(len, docs)])
                start, windows, anchor, content, doc = hashing.segments(flat, bounds, 6, 3, hashing.TABLE)
                seen, by_window, by_content = [], {}, {}
                for s, n, a, c, d in zip(start, windows, anchor, content, doc, strict=True):
                    whole = bytes(flat[s : s + n + 5])
                    assert by_content.setdefault((int(a), int(c)), whole) == whole
                    for i in range(s, s + n):
                        assert bounds[d] <= i and i + 6 <= bounds[d + 1]
                        seen.append(i)
                        assert by_window.setdefault(bytes(flat[i : i + 6]), int(a)) == int(a)
                assert sorted(seen) == [i for a, b in zip(bounds, bounds[1:], strict=False) for i in range(a, b - 5)]
        finally:
            hashing.BLOCK = was


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(150):
        texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd\xff\x00") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        texts = list(dict.fromkeys(texts))
        text, _ = suffix_array.join(texts)
        order = suffix_array.suffix_array(text)
        plain = text.tolist()
        assert order.tolist() == sorted(range(len(plain)), key=lambda i: plain[i:])
        ends = np.flatnonzero(text == 1)
        left = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text))
        got = suffix_array.common_prefixes(suffix_array.Keys(text), order, left)
        for i in range(1, len(order)):
            a, b, n = order[i - 1], order[i], 0
            while n < min(left[a], left[b]) and plain[a + n] == plain[b + n]:
                n += 1
            assert got[i] == n


def _plain_repeats(texts, places, ranks, w):
    """Texts are sequences of items; the windows that occur more than once, and those of them that occur earlier."""
    counts, found = Counter(), defaultdict(set)
    for i, x in enumerate(texts):
        for j in range(len(x) - w + 1):
            counts[tuple(x[j : j + w])] += places[i]
            found[tuple(x[j : j + w])].add((ranks[i], i, j))
    out = []
    for i, x in enumerate(texts):
        often = [j for j in range(len(x) - w + 1) if counts[tuple(x[j : j + w])] > 1]
        out.append((often, [j for j in often if any(r < ranks[i] or (h == i and k < j) for r, h, k in found[tuple(x[j : j + w])])]))
    return out


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_indexes_find_repeats(kind):
    rng = random.Random(2)
    find = suffix_array.byte_repeats if kind == "bytes" else fm_index.word_repeats
    for trial in range(200):
        if kind == "bytes":
            texts = [bytes(rng.choice(b"ab" if trial % 2 else b"abcd\xff\x00") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        else:
            texts = [b" ".join(rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        n, w = len(texts), rng.randint(2, 6)
        places, ranks = np.array([rng.choice([1, 1, 1, 3]) for _ in texts]), np.array(rng.sample(range(n), n) if trial % 3 else [rng.randrange(n) for _ in texts])
        plain = [list(t) for t in texts] if kind == "bytes" else [t.split() for t in texts]
        assert [(a.tolist(), b.tolist()) for a, b in find(texts, places, ranks, w)] == _plain_repeats(plain, places.tolist(), ranks.tolist(), w)
    assert find([], np.zeros(0, np.int64), np.zeros(0, np.int64), 5) == []


def test_matching_statistics():
    text = np.array([1, 2, 3, 1, 2, 0, 3, 1, 2, 0])
    index = fm_index.FMIndex(text, 4)
    length, _, _ = index.matching(text, np.arange(len(text)), 5)
    assert length.tolist() == [1, 2, 1, 2, 3, 0, 1, 2, 3, 0]


def test_t_occurrence_search_is_exact():
    rng = random.Random(4)
    for _ in range(200):
        sets = [np.array(sorted(rng.sample(range(25), rng.randint(1, 20))), np.uint64) for _ in range(12)]
        lists, percent = Lists(sets), rng.choice([50, 80, 85])
        for q in sets:
            plain = {i for i, s in enumerate(sets) if 100 * len(set(q) & set(s)) >= percent * len(set(q) | set(s))}
            assert set(lists.search(q, percent).tolist()) == plain


def _sequential_best_fit(lengths, size):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(size - x)
    return len(rooms)


def test_packing_plan_is_valid_and_no_worse_than_plain_best_fit():
    rng = random.Random(5)
    for _ in range(200):
        size = rng.choice([10, 30])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 60))]
        counts = Counter(lengths)
        rows, sequences = packing.plan(dict(counts), size)
        held = {}
        for length, n in counts.items():
            for rank in range(n):
                at = int(np.searchsorted(rows[length][:, 0], rank, "right")) - 1
                first, seq, offset = rows[length][at]
                held.setdefault(int(seq + rank - first), []).append((int(offset), length))
        assert sorted(held) == list(range(sequences))
        for parts in held.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= size
        assert len(packing.best_fit(dict(counts), size)) <= sum(counts.values())
        assert sum(n for _, n in packing.best_fit(dict(counts), size)) == _sequential_best_fit(lengths, size)
        assert sequences <= _sequential_best_fit(lengths, size)


def test_three_pieces_are_fixed_where_they_dominate():
    fixed, left = packing.reduce_dominated({2: 3, 3: 1, 5: 1, 6: 1}, 10)
    assert sum(n for _, n in fixed) + len(packing.best_fit(left, 10)) == packing.plan({2: 3, 3: 1, 5: 1, 6: 1}, 10)[1] == 2
    assert packing.plan({3: 1, 6: 3, 7: 1, 11: 1}, 20)[1] == packing.plan({6: 1, 7: 1, 8: 1, 10: 1, 13: 1, 14: 1}, 30)[1] == 2
    assert any(len(held) == 3 for held, _ in packing.reduce_dominated({6: 2, 5: 1, 4: 2, 3: 1}, 14)[0])


def test_cuts():
    assert packing.cuts(5, 4) == [(0, 1), (1, 4)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)]
    assert packing.cuts(4, 4) == [(0, 4)] and packing.cuts(1, 4) == [(0, 1)]


def test_room_tree_gives_the_tightest_room():
    rng = random.Random(6)
    tree, plain = sharding.RoomTree(), []
    for step in range(500):
        if rng.random() < 0.6 or not plain:
            plain.append((rng.randint(0, 50), step))
            tree.add(*plain[-1])
        else:
            size = rng.randint(0, 55)
            fits = [x for x in plain if x[0] >= size]
            want = min(fits) if fits else None
            assert tree.take(size) == want
            if want:
                plain.remove(want)


def _best_fit_one_by_one(sizes, capacity):
    rooms, load = [], []
    for x in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if not fits:
            rooms.append(capacity)
            load.append(0)
            fits = [(capacity, len(rooms) - 1)]
        _, i = min(fits)
        rooms[i] -= x
        load[i] += x
    return load


def test_best_fit_of_equal_sizes_at_once_is_that_of_one_by_one():
    rng = random.Random(7)
    for trial in range(300):
        counts = Counter(rng.randint(1, 40) for _ in range(rng.randint(1, 80)))
        sizes = sorted(counts, reverse=True)
        capacity = rng.randint(40, 200)
        rows, shards = sharding.best_fit_decreasing(sizes, [counts[s] for s in sizes], capacity)
        load = [0] * shards
        for i, to, n in rows:
            load[to] += n * sizes[i]
        assert load == _best_fit_one_by_one(sorted(counts.elements(), reverse=True), capacity)


def test_shards_are_even():
    rng = random.Random(7)
    counts = Counter(rng.randint(1, 1000) for _ in range(2000))
    sizes = sorted(counts, reverse=True)
    load = [0] * 8
    for i, to, n in sharding.pack_into(sizes, [counts[s] for s in sizes], 8):
        load[to] += n * sizes[i]
    assert sum(load) == sum(s * n for s, n in counts.items())
    assert max(load) - min(load) <= 8
    assert sharding.pack_into([], [], 8) == [] and sharding.pack_into([5], [1], 8) == [(0, 0, 1)]
