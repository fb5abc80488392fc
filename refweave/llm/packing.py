"""Operator 8, best-fit packing: token sequences of fixed size, by dominance reduction and then best fit.

Only the histogram of piece lengths decides how pieces are packed, and it has as many rows as a sequence has tokens, however
large the corpus is. On it, Martello and Toth's reduction first fixes sets that provably dominate all others with the same
piece: a piece that nothing fits beside; the largest partner that fits, where it fills the sequence or where no two others
would fit; and where two but not three would, that partner alone if no two together are larger, or with the largest third
piece if no two that are both larger than the third would fit. What remains is packed by best fit, largest first. Equal sequences are handled at once, so that the plan is a
few thousand rows: which sequences take pieces of this length, from which rank on, at which place. Each piece then only
needs its rank among those of its length, which is counted in cells of bounded size, and looks its place up.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table, tidy, with_key

SIZE, CELL = 2048, 20_000
PIECES = "did long, dkey long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters on which the fast reader of the vocabulary is known to agree with tokenizers' own; other texts take the latter.
COMMON = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ‐-‧€]*")


class Encoder:
    """Token ids of a byte-level BPE, as tokenizers gives them by default: strings of added tokens in a text are those tokens."""

    def __init__(self, vocabulary: str, ranks: str | None):
        self.vocabulary, self.fast = vocabulary, None
        with open(vocabulary, "rb") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens") or ()]
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    @cached_property
    def slow(self):
        """Loaded when a text needs it, for it takes far more memory."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def ids(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or COMMON.fullmatch(text)) and not any(t in text for t in self.added):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple[str, str | None], Encoder] = {}


def vocabulary_paths() -> tuple[str, str | None]:
    """The default vocabulary: the file of tokenizers, and the same ranks for the fast reader."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cuts(tokens: int, size: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: only the first may be shorter than size."""
    first = tokens % size or size
    return [(0, min(first, tokens)), *((s, size) for s in range(first, tokens, size))] if tokens > size else [(0, tokens)]


def _pieces(paths: tuple[str, str | None], size: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(paths) or _encoders.setdefault(paths, Encoder(*paths))
        names = ["did", "dkey", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        for batch in batches:
            did, dkey, doc_id = (batch.column(c).to_pylist() for c in ("did", "dkey", "doc_id"))
            out: list[list] = [[] for _ in names]
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encoder.ids(text.as_py() or ""), end], "<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), size)):
                    part = ids[start : start + length]
                    row = [did[i], dkey[i], doc_id[i], piece, start, length, zlib.crc32(part.tobytes())]
                    for column, value in zip(out, row + [part.astype(np.int32)] * with_ids, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names)

    return run


class Counts:
    """A multiset of lengths that gives the largest up to a limit and the smallest."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v}
        self.sorted = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.sorted.remove(length)

    def give(self, length: int) -> None:
        if length not in self.counts:
            insort(self.sorted, length)
        self.counts[length] = self.counts.get(length, 0) + 1

    def largest(self, limit: int) -> int | None:
        at = bisect_right(self.sorted, limit)
        return self.sorted[at - 1] if at else None

    def smallest(self, n: int, above: int = 0) -> int | None:
        """The sum of the n smallest that are larger than `above`; None if there are not so many."""
        total = 0
        for at in range(bisect_right(self.sorted, above), len(self.sorted)):
            some = min(n, self.counts[self.sorted[at]])
            total, n = total + some * self.sorted[at], n - some
            if not n:
                return total
        return None

    def largest_pair(self, limit: int) -> int:
        """The largest sum of two up to a limit; 0 if no two fit."""
        best = 0
        for low in self.sorted:
            if 2 * low > limit:
                break
            high = self.largest(limit - low)
            if high > low or self.counts[low] > 1:
                best = max(best, low + high)
        return best


def _dominating(left: Counts, room: int) -> tuple[int, ...] | None:
    """Of the pieces that are left, those whose set dominates every other that fits the room beside a piece; None if not known."""
    partner = left.largest(room)
    if partner is None:
        return ()
    fits = lambda total: total is not None and total <= room
    if partner == room or not fits(left.smallest(2)):
        return (partner,)
    if fits(left.smallest(3)):
        return None
    if partner >= left.largest_pair(room):
        return (partner,)
    left.take(partner, 1)
    third = left.largest(room - partner)
    left.give(partner)
    # of any two that fit, the larger is at most the partner, and the smaller at most the third
    return (partner, third) if third is not None and not fits(left.smallest(2, third)) else None


def reduce_dominated(counts: dict[int, int], size: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences that some best packing contains, as (lengths, how many), and the lengths that are left."""
    left, fixed = Counts(counts), []
    again = True
    while again:
        again = False
        for length in sorted(left.counts, reverse=True):
            while length in left.counts:
                left.take(length, 1)  # the piece itself is no partner of its own
                beside = _dominating(left, size - length)
                left.give(length)
                if beside is None:
                    break
                held = (length, *beside)
                n = min(left.counts[x] // held.count(x) for x in held)  # what dominates still does with fewer pieces left
                fixed.append((held, n))
                for x in held:
                    left.take(x, n)
                again = True
    return fixed, left.counts


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: exactly the sequences that taking the pieces one by one would give."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    free: list[int] = []  # sorted room sizes

    def add(room: int, held: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            free.insert(int(np.searchsorted(free, room)) if free else 0, room)
        rooms[room].append((held, n))

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = int(np.searchsorted(free, length)) if free else 0
            if at < len(free):
                room = free[at]
                held, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    free.pop(at)
            else:
                room, held, n = size, (), -(-todo // (size // length))
            each = room // length
            full = min(n, todo // each)
            if full:
                add(room - each * length, held + (length,) * each, full)
            todo -= full * each
            rest = n - full
            if rest and todo:
                some = min(todo, each)
                add(room - some * length, held + (length,) * some, 1)
                todo -= some
                rest -= 1
            if rest and held:
                add(room, held, rest)
    return [(held, n) for groups in rooms.values() for held, n in groups]


def plan(counts: dict[int, int], size: int) -> tuple[dict[int, np.ndarray], int]:
    """For each length, rows (first rank, first sequence, offset) in order of rank: pieces from that rank on go to one
    sequence after another. Also the number of sequences."""
    fixed, left = reduce_dominated(counts, size)
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequences = 0
    for held, n in fixed + best_fit(left, size):
        offset = 0
        for length in held:
            rank = ranks.get(length, 0)
            out.setdefault(length, []).append((rank, sequences, offset))
            ranks[length] = rank + n
            offset += length
        sequences += n
    return {k: np.array(v, np.int64) for k, v in out.items()}, sequences


def _look_up(rows_of: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                mine = np.flatnonzero(length == x)
                rows = rows_of[x]
                at = np.searchsorted(rows[:, 0], rank[mine], "right") - 1
                sequence[mine] = rows[at, 1] + rank[mine] - rows[at, 0]
                offset[mine] = rows[at, 2]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, size: int = SIZE, vocabulary: tuple[str, str | None] | None = None, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset; with_ids, also ids.

    A document is the ids of its text and then the id end; null and empty texts are that one id. Documents of more than size ids
    are cut into pieces of size, the first of which may be shorter. Sequences hold at most size ids, without gaps from 0.
    Rows equal in all columns are documents of their own, and rows without doc_id are packed too. Other columns are ignored. Empty table: empty result.
    """
    keyed = with_key(docs.select("doc_id", "text")).select("did", "dkey", F.col("row.doc_id").cast("long").alias("doc_id"), "text")
    columns = PIECES + (", ids array<int>" if with_ids else "")
    pieces = staged(keyed.mapInArrow(tidy(_pieces(vocabulary or vocabulary_paths(), size, end, with_ids)), columns), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # size rows at most
    rows_of, _ = plan(counts, size)
    cells = F.create_map(*(F.lit(x) for pair in ((k, -(-v // CELL)) for k, v in sorted(counts.items()) if v > CELL) for x in pair)) if any(v > CELL for v in counts.values()) else None
    cell = F.lit(0) if cells is None else F.pmod(F.xxhash64("did", "dkey", "piece"), F.coalesce(cells[F.col("length")], F.lit(1)))
    dealt = pieces.withColumn("cell", cell.cast("int"))
    sizes = dealt.groupBy("length", "cell").count()
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "cell").orderBy("did", "dkey", "piece")
    ranked = dealt.withColumn("at", F.row_number().over(within) - 1).join(bases, ["length", "cell"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids), (F.col("base") + F.col("at")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + ("ids array<int>, " if with_ids else "") + "sequence_id long, offset long"
    return ranked.mapInArrow(tidy(_look_up(rows_of)), schema)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; null texts are one token."""
    return pack(table(spark, sf_dir, "documents"))
