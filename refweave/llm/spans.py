"""How both span removers bring equal windows of different documents together without shuffling every window.

1. Each document's windows (20 words, 200 bytes, ...) are cut into runs that share their minimizer (hashing.segments);
   equal windows always lie in runs of the same anchor. A run becomes one small row: anchor and content hash, where it stands.
   Hashes only deal texts out: what is a repeat, the index of step 4 says.
2. Rows meet by anchor. Runs of one content are one text, with its first place and the number of its places. A run that many
   documents of a batch hold is one row of that batch here; the batch's other places of it wait for the index's answer.
3. Of each anchor with more than one place, the text of each content travels, cut from the document of its first place: to
   the room of the anchor, where it meets the anchor's other contents, and to the rooms where places wait for the
   answer about it. A room has few places a batch of documents, however many documents hold a run.
4. A shard is some rooms with about SHARD bytes of text. The operator builds its index over them (an FM-index or a suffix
   array), and with it finds the windows that occur more than once, or earlier too. All repeats come from there: those of a
   content's first place from its windows, those of its other places likewise.
5. The repeated windows go back to their documents by key. Texts meet what is asked of them, and found in them, by hashing the
   latter, which is far smaller; sorting texts for it takes far more of an executor's memory.

Nothing here depends on sizes of tables: no counts are capped and all windows of all texts take part. Tasks read their rows
in order of anchor or room, and hold one shard; an anchor of more than WIDE contents is taken apart into single windows,
which spread by their own hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import groups_of, staged, text_buffers, tidy, whole_keys, with_key

_U = np.uint64
#: Bytes of text in one index shard, unless one room alone has more; places that are answered at a time.
SHARD, ROWS = 1 << 18, 1 << 17
#: Contents of an anchor beyond which its windows are dealt out singly.
WIDE = 4096
#: Places that wait in the room of their anchor, or one room of their own; places of one batch to a room.
WAIT, EACH = 256, 8

RUNS = "anchor long, content long, did long, dkey long, start int, windows int, places int, room long"
FOUND = "did long, dkey long, start int, windows int, content long, room long, places int, rooms array<long>, wide boolean"
PIECES = "room long, content long, did long, dkey long, start int, windows int, places int, body binary"
SPANS = "did long, dkey long, start int, windows int"

#: find(texts, places, ranks, window): for each text, which of its windows occur more than once and which of them earlier too. A text
#: counts as often as it has places; ranks: the order of the texts' first places.
Find = Callable[[list[bytes], np.ndarray, np.ndarray, int], list[tuple[np.ndarray, np.ndarray]]]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c if k == "binary" else np.ascontiguousarray(c, kinds[k].to_pandas_dtype()), type=kinds[k]) for (_, k), c in zip(fields, columns, strict=True)], [n for n, _ in fields])


def _rooms(anchor: np.ndarray, content: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The rooms in which places of a content wait."""
    return hashing.mix(anchor.view(_U) + hashing.mix(content.view(_U) + hashing.mix(number.astype(_U) + _U(1)))).view(np.int64)


def _in_order(anchor, content, did, dkey, start, *rest):
    """Columns in order of anchor, content and place (and of the last of rest), where a content begins and where a place."""
    order = np.lexsort((*rest[-1:], start, dkey, did, content, anchor))
    out = [x[order] for x in (anchor, content, did, dkey, start, *rest)]
    anchor, content, did, dkey, start = out[:5]
    new = np.ones(len(order), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    place = new.copy()
    place[1:] |= (did[1:] != did[:-1]) | (dkey[1:] != dkey[:-1]) | (start[1:] != start[:-1])
    return out, new, place


def _cut(window: int, k: int, by_words: bool):
    """One row for each content of a batch, with its first place and the number of its places, and one for each other place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            body, offsets = text_buffers(batch.column("text"))
            found = []
            for a, b in hashing.doc_slices(offsets):
                part, bounds = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if by_words:
                    values, _, _, bounds = hashing.words(part, bounds)
                    start, windows, anchor, content, doc = hashing.segments(values, bounds, window, k)
                else:
                    start, windows, anchor, content, doc = hashing.segments(part, bounds, window, k, hashing.TABLE)
                found.append((start - bounds[doc], windows, anchor, content, doc + a))
            start, windows, anchor, content, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(start):
                continue
            did, dkey = (batch.column(c).to_numpy()[doc] for c in ("did", "dkey"))
            columns, new, place = _in_order(anchor.view(np.int64), content.view(np.int64), did, dkey, start, windows)
            columns, new = [x[place] for x in columns], new[place]
            group = np.cumsum(new) - 1
            places = np.bincount(group)[group]
            spread = 1 << np.ceil(np.log2((places - 1) // EACH + 1)).astype(np.int64)
            salt = hashing.mix(did[:1].view(_U) + hashing.mix(dkey[:1].view(_U)))[0] >> _U(1)  # of the batch
            room = np.where(places > 1, _rooms(columns[0], columns[1], spread + salt.astype(np.int64) % spread), 0)
            yield _batch(RUNS, *columns, np.where(new, places, 0), room)

    return run


def _meet(wide_from: int, wait: int):
    """From a partition in order of anchor: each content whose anchor has several places, with the rooms it is asked about in;
    and each other place, with the room it waits in."""
    none = lambda n: pa.nulls(n, pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, "anchor", lambda held: sum(b.num_rows for b in held) >= ROWS):
            columns = [c.to_numpy() for c in rows.columns]
            waits = columns[6] == 0
            _, content, did, dkey, start, windows, places, room = (x[waits] for x in columns)
            yield _batch(FOUND, did, dkey, start, windows, content, room, places, none(len(did)), np.zeros(len(did), bool))
            anchor, content, did, dkey, start, windows, places, room = (x[~waits] for x in columns)
            if not len(anchor):
                continue
            # of rows of one place (repeated documents), that with the most places in its batch comes first
            (anchor, content, did, dkey, start, windows, places, room, _), new, place = _in_order(anchor, content, did, dkey, start, windows, places, room, -places)
            group = np.cumsum(new) - 1
            total = np.bincount(group[place], places[place])
            edge = groups_of(anchor)
            family = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            contents = np.add.reduceat(new.astype(np.int64), edge[:-1])[family]
            other = place & ~new
            waiting = np.add.reduceat(other.astype(np.int64), edge[:-1])[family]
            wide = contents > wide_from
            shared = (contents > 1) & ~wide  # the anchor has a room
            first = np.flatnonzero(new)[group]
            number = np.cumsum(other) - np.cumsum(other)[first] - 1
            own = _rooms(anchor, content, 1 + np.maximum(number, 0) // wait)  # the first is that of places of small batches too
            stay = np.where(shared & (waiting <= wait), anchor, own)
            yield _batch(FOUND, did[other], dkey[other], start[other], windows[other], content[other], stay[other], np.zeros(int(other.sum()), np.int32), none(int(other.sum())), np.zeros(int(other.sum()), bool))
            asked = new & ((contents > 1) | (total[group] > 1))
            where = np.concatenate((np.flatnonzero(new & shared), np.flatnonzero(places > 1), np.flatnonzero(other)))
            kind = np.repeat([0, 1, 2], [int((new & shared).sum()), int((places > 1).sum()), int(other.sum())])
            rooms = np.where(kind == 0, anchor[where], np.where(kind == 1, room[where], stay[where]))
            by = np.lexsort((rooms, group[where]))
            owner, rooms = group[where][by], rooms[by]
            once = np.ones(len(by), bool)
            once[1:] = (owner[1:] != owner[:-1]) | (rooms[1:] != rooms[:-1])
            counts = np.bincount(owner[once], minlength=len(total))[group[asked]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(rooms[once]))
            yield _batch(FOUND, did[asked], dkey[asked], start[asked], windows[asked], content[asked], anchor[asked], np.minimum(total[group[asked]], 1 << 30).astype(np.int32), lists, wide[asked])

    return run


def _fetch(window: int, by_words: bool):
    """The texts that are asked about, once for each room. Windows of wide anchors have rooms of their own; equal ones of a batch go
    there as one text, with its first place, and the other places wait in a room of the batch."""

    def hashed(part: bytes) -> int:
        code = np.frombuffer(b" ".join(part.split()) if by_words else part, np.uint8)
        return int(hashing.mix(hashing.runs(hashing.TABLE[code], len(code))[:1]).view(np.int64)[0])

    def singles(apart: dict[int, dict[tuple[int, int, int], tuple[int, bytes]]]) -> Iterator[tuple]:
        for room, held in apart.items():
            (did, dkey, s), (_, part) = first = min(held.items())
            total = min(sum(n for n, _ in held.values()), 1 << 30)
            yield room, room, did, dkey, s, 1, total, part
            if len(held) > 1:
                aside = int(_rooms(*(np.array([x], np.int64) for x in (room, did ^ dkey, s)))[0])
                yield aside, room, did, dkey, s, 1, total, part
                yield from ((aside, room, *place, 1, 0, None) for place in held if place != first[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text"), [batch.column(c).to_pylist() for c in ("did", "dkey")]
            out: list[tuple] = []
            apart: dict[int, dict[tuple[int, int, int], tuple[int, bytes]]] = {}
            held, asked = 0, batch.column("asked")
            for i in range(batch.num_rows):
                body, did, dkey = (texts[i].as_py() or "").encode(), keys[0][i], keys[1][i]
                begin = end = None
                if by_words:
                    _, begin, end, _ = hashing.words(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
                for x in asked[i].as_py():
                    start, windows = x["start"], x["windows"]
                    if x["rooms"]:
                        piece = body[begin[start] : end[start + windows + window - 2]] if by_words else body[start : start + windows + window - 1]
                        out += [(room, x["content"], did, dkey, start, windows, x["places"], piece) for room in x["rooms"]]
                        held += len(piece) * len(x["rooms"])
                    if x["wide"]:
                        for s in range(start, start + windows):
                            part = body[begin[s] : end[s + window - 1]] if by_words else body[s : s + window]
                            apart.setdefault(hashed(part), {})[did, dkey, s] = (x["places"], part)
                            held += len(part)
                if held > 32 * SHARD or i == batch.num_rows - 1:
                    out += singles(apart)
                    yield _batch(PIECES, *(zip(*out, strict=True) if out else [[]] * 8))
                    out, apart, held = [], {}, 0

    return run


def _spans(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of consecutive numbers."""
    if not len(hits):
        return hits, hits
    edges = np.concatenate(([0], np.flatnonzero(np.diff(hits) != 1) + 1, [len(hits)]))
    return hits[edges[:-1]], np.diff(edges)


def _index(find: Find, window: int, first: bool):
    """From a partition in order of room, texts before the places that wait for them: the repeated windows of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, "room", lambda held: sum(b.num_rows for b in held) >= ROWS or sum(b.column("body").nbytes for b in held) >= 4 * SHARD):
            yield from _answered(rows, find, window, first)

    return run


def _answered(rows: pa.Table, find: Find, window: int, first: bool) -> Iterator[pa.RecordBatch]:
    room, content, did, dkey, start, windows, places = (rows.column(c).to_numpy() for c in rows.column_names[:7])
    text = np.flatnonzero(places > 0)
    order = text[np.lexsort((-places[text], start[text], dkey[text], did[text], room[text]))]
    again = (room[order[1:]] == room[order[:-1]]) & (did[order[1:]] == did[order[:-1]]) & (dkey[order[1:]] == dkey[order[:-1]]) & (start[order[1:]] == start[order[:-1]])
    order = order[np.concatenate((np.ones(min(1, len(order)), bool), ~again))]  # a document's rows may be repeated
    bodies = [x.as_py() for x in rows.column("body").combine_chunks().take(pa.array(order))]
    size, room_edges, at = np.cumsum([0, *map(len, bodies)]), groups_of(room[order]), 0
    often_at, often_n, texts_of, late_out = [], [], [], []
    while at < len(room_edges) - 1:
        to = max(at + 1, int(np.searchsorted(size[room_edges[1:]], size[room_edges[at]] + SHARD, "right")))
        a, b = int(room_edges[at]), int(room_edges[to])
        at, mine = to, order[a:b]
        by = np.lexsort((start[mine], dkey[mine], did[mine]))
        step = np.zeros(len(mine), np.int64)
        step[1:] = (did[mine][by][1:] != did[mine][by][:-1]) | (dkey[mine][by][1:] != dkey[mine][by][:-1]) | (start[mine][by][1:] != start[mine][by][:-1])
        ranks = np.empty(len(mine), np.int64)
        ranks[by] = np.cumsum(step)
        for i, (often, late) in zip(range(a, b), find(bodies[a:b], places[mine].astype(np.int64), ranks, window), strict=True):
            for hits, kept in ((often, True), (late if first else often, False)):
                s, n = _spans(hits)
                if kept:
                    often_at.append(s)
                    often_n.append(n)
                    texts_of.append(np.full(len(s), i))
                elif len(s):
                    late_out.append((np.full(len(s), order[i]), s, n))
    if late_out:
        i, s, n = (np.concatenate(x) for x in zip(*late_out, strict=True))
        yield _batch(SPANS, did[i], dkey[i], start[i] + s, n)
    wait = np.flatnonzero(places == 0)
    if not len(wait):
        return
    key = lambda i: hashing.mix(room[i].view(_U) + hashing.mix(content[i].view(_U)))
    mine = key(order)
    by = np.argsort(mine, kind="stable")
    at = by[np.minimum(np.searchsorted(mine[by], key(wait)), len(by) - 1)]
    assert (room[order[at]] == room[wait]).all() and (content[order[at]] == content[wait]).all(), "a place waits for a text that did not come"
    owner, s, n = (np.concatenate(x) for x in (texts_of, often_at, often_n))
    count = np.bincount(owner, minlength=len(order))
    begin = np.cumsum(count) - count
    many = count[at]
    span = np.repeat(begin[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    i = np.repeat(wait, many)
    yield _batch(SPANS, did[i], dkey[i], start[i] + s[span], n[span])


def repeats(docs: DataFrame, find: Find, window: int, k: int, by_words: bool, first: bool) -> DataFrame:
    """did, dkey, text, row and the repeated windows of each document, as runs: spans array<struct<start, windows>>, null if none.

    first: a window counts as repeated only if it also starts earlier, by document (id, then key) and place; otherwise if
    it also starts anywhere else. Documents equal in id and text are one, and each of their rows comes out.
    """
    docs = with_key(docs)
    cut = docs.where("text is not null").mapInArrow(tidy(_cut(window, k, by_words)), RUNS)
    # places that wait are dealt out by place, so that a run that many documents hold doesn't meet in one task
    dealt = cut.repartition(F.when(F.col("places") == 0, F.xxhash64("did", "dkey", "start")).otherwise(F.col("anchor")))
    met = staged(dealt.sortWithinPartitions("anchor").mapInArrow(tidy(_meet(WIDE, WAIT)), FOUND), "runs")
    asked = met.where("rooms is not null").groupBy("did", "dkey").agg(F.collect_list(F.struct("start", "windows", "content", "places", "rooms", "wide")).alias("asked"))
    pieces = docs.join(asked.hint("shuffle_hash"), ["did", "dkey"]).mapInArrow(tidy(_fetch(window, by_words)), PIECES)
    waiting = met.where("rooms is null").select("room", "content", "did", "dkey", "start", "windows", "places", F.lit(None).cast("binary").alias("body"))
    rooms = pieces.unionByName(waiting).repartition("room").sortWithinPartitions("room", F.desc("places"))
    spans = rooms.mapInArrow(tidy(_index(find, window, first)), SPANS)
    spans = spans.groupBy("did", "dkey").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    return docs.join(spans.hint("shuffle_hash"), ["did", "dkey"], "left")


def covered(spans: list | np.ndarray | None, window: int) -> list[tuple[int, int]]:
    """The maximal runs of items that the windows cover, in order; spans: (start, windows) pairs."""
    out: list[list[int]] = []
    for start, windows in sorted(spans or ()):
        end = start + windows + window - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]
