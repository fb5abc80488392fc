"""Operator 6, n-gram Jaccard join: near copies by shingle sets, verified by T-occurrence search with DivideSkip.

1. Each text becomes the sorted set of the hashes of its shingles; texts of equal sets are one node from here on.
2. Candidates, exactly: two sets that link differ in at most D shingles, where D follows from their sizes. Cut the hash
   space into more than D ranges, and at least one range holds the same shingles in both (Arasu et al. 2006). So each set
   gives a signature for each range, and linked sets share one at least. A room is all that share a signature.
   There are a third and SPARE more ranges than that takes, and each set leaves as many out: first those of the fewest shingles that
   aren't common, by which a passage, or one shingle that texts share by chance, would tie them together. What is in a range
   alone says where it comes in this order. Of the ranges in which two sets agree, more than either leaves out, one is left in the set that
   leaves out more of the order, and so in both. Which shingles are common comes from a bounded sample, on which no link depends.
3. The rooms tie nodes into clusters, by the node of the least hash in each. A cluster of up to CLUSTER shingles is searched
   in one task: every member in the inverted lists of all, but for those that are already in its component.
4. Larger clusters, which passages that many texts share may make, are cut down first, by the shingles that are rarest in them: sets
   that link share one of the rarest of each, and the first of these that both hold must stand so far up in both that what
   follows is still enough (prefixes and their positions, as in PPJoin: Xiao et al. 2008). Of the sets that have a shingle up
   there, sorted by size, each is tied to the next smaller one that it might link with: no pairs are made. What that can't cut down is
   searched piecewise: first, in each room the node of the least hash against all others; then, of the sets of a rare shingle
   that are still in several components, blocks of BLOCK against each other. Neither loses a link.
Searches build inverted lists over the candidates' shingles, merge the short ones on a heap and probe the long ones
(t_occurrence.py). Rooms meet by signature; equal nodes and rooms of one batch of documents are combined before the shuffle.
Tasks read their rows in order of room, shingle or cluster, and hold one at a time. Whole texts are joined with rows of a few numbers
by hashing the latter, a partition of which is far smaller than its texts: sorting the texts takes over 700 MB more of an executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .common import NO_ID, Forest, component_ids, components, give_back, groups_of, sorted_groups, staged, table, text_buffers, tidy, unstage, whole_keys, with_facts, with_key
from .t_occurrence import Lists

_U = np.uint64
#: Members of a room that are searched at a time, and candidates that are searched together for one query.
BLOCK = 512
#: Shingles of a cluster that one task may search.
CLUSTER = 2_000_000
#: Rows of rooms and shingles that are looked at together.
ROWS = 1 << 17
#: Bytes of text whose signatures are made at a time.
SLICE = 1 << 22
#: Ranges beyond D + 1 and a third of D, of which each set leaves out as many.
SPARE = 6
#: Parts of all rooms that are shuffled one after another, so that only one lies on disk at a time.
PASSES = 4
#: Texts of the sample from which shingles that several of them hold count as common, and about their bytes at most.
SAMPLE, SAMPLE_BYTES = 32_000, 1 << 28


def shingle_sets(body: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: n words, or all words where there are fewer; none without words."""
    for x, y in hashing.doc_slices(offsets):
        words, _, _, bounds = hashing.words(body[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], lower=True)
        grams = hashing.mix(hashing.runs(words, n)) if len(words) else words
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                found = np.sort(grams[a : b - n + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:  # as one shingle, told apart from shingles of n words
                part = words[a:b]
                yield hashing.mix(hashing.runs(part, len(part))[:1] + _U((b - a) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            else:
                yield words[:0]


class Bands:
    """Ranges of set sizes [low, high] such that sets that link lie in one band or in neighbours."""

    def __init__(self, percent: int):
        self.percent, self.high = percent, [0]

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            low = self.high[-1] + 1
            self.high.append(max(low, low * 100 // self.percent))
        return int(np.searchsorted(self.high, size))

    def differences(self, band: int) -> int:
        """Most shingles in which sets that link may differ, if the smaller is of this band."""
        high = self.high[band]
        return (high + high * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    def signatures(self, tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
        """A hash for each range of the hash space in which this set and a set that it links with may agree, but for those that hold
        the fewest shingles beside common ones (sorted)."""
        size = len(tokens)
        if not size:
            return np.zeros(0, _U)
        plain = np.zeros(size + 1, np.int64)
        if len(common):
            np.cumsum(common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens, out=plain[1:])
        else:
            plain = np.arange(size + 1)
        own = self.of(size)
        sums = np.zeros(size + 1, _U)
        np.cumsum(hashing.mix(tokens), out=sums[1:])
        out = []
        for band in (own - 1, own):
            if band < 1 or self.high[band] * 100 // self.percent < size:
                continue
            differ = self.differences(band)
            if not differ:  # only equal sets link
                continue
            parts = differ + 1 + SPARE + differ // 3
            edges = np.searchsorted(tokens, (np.arange(1, parts, dtype=np.float64) / parts * 2.0**64).astype(_U))
            edges = np.concatenate(([0], edges, [size]))
            value, place = sums[edges[1:]] - sums[edges[:-1]], np.arange(parts)
            keep = np.lexsort((place, value, np.diff(edges), plain[edges[1:]] - plain[edges[:-1]]))[parts - differ - 1 :]
            out.append(hashing.mix(value[keep] + hashing.mix(place[keep].astype(_U) + _U(band << 32))))
        return np.concatenate(out) if out else np.zeros(0, _U)


def node_of(tokens: np.ndarray) -> np.ndarray:
    return hashing.mix(hashing.mix(tokens ^ _U(0xD6E8FEB86659FD93)).sum(dtype=_U, keepdims=True) + _U(len(tokens)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE bytes of text."""
    for batch in batches:
        if batch.num_rows:
            for a, b in hashing.doc_slices(text_buffers(batch.column("text"))[1], SLICE):
                yield batch.slice(a, b - a)


def _sampled(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = list(shingle_sets(*text_buffers(batch.column("text")), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["token"])

    return run


def _broadcast(tokens: DataFrame) -> Broadcast:
    """The sorted tokens that occur more than once, and how often."""
    often = staged(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token", F.least("n", F.lit((1 << 31) - 1)).cast("int").alias("n")), "common")
    found = often.toArrow()
    unstage(often)
    token, n = found.column("token").to_numpy().view(_U), found.column("n").to_numpy()
    del found
    by = np.argsort(token)
    out = tokens.sparkSession.sparkContext.broadcast((token[by], n[by]))
    del token, n, by
    give_back()
    return out


def common_shingles(docs: DataFrame, n: int) -> Broadcast:
    """A broadcast of the sorted shingles that several distinct texts of a sample of docs (did, dkey, text) hold, and how many hold
    them: about SAMPLE texts, and SAMPLE_BYTES of them, which bounds its size."""
    known = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    share = min(1.0, SAMPLE / max(1, known[0]), SAMPLE_BYTES / max(1, known[1] or 0))
    sample = docs.where(F.pmod(F.xxhash64("dkey", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["dkey"]).select("text")
    return _broadcast(sample.mapInArrow(tidy(_sampled(n)), "token long"))


def common_in_sets(sets: DataFrame) -> Broadcast:
    """The same of sets (node, tokens): about SAMPLE of them."""
    known = sets.agg(F.count("*"), F.sum(F.size("tokens"))).first()
    share = min(1.0, SAMPLE / max(1, known[0]), SAMPLE_BYTES / (8 * max(1, known[1] or 0)))
    return _broadcast(sets.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.explode("tokens").alias("token")))


def _sign(n: int, percent: int, common):
    """did, dkey, node, size of each document; signatures and first candidates where the batch has not had the node or room yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in _slices(batches):
            sets = list(shingle_sets(*text_buffers(batch.column("text")), n))
            nodes = np.concatenate([node_of(t) for t in sets]).view(np.int64)
            sizes = np.array([len(t) for t in sets], np.int64)
            first = np.zeros(len(sets), bool)
            first[np.unique(nodes, return_index=True)[1]] = True
            signed = [bands.signatures(t, common.value[0]) if f else t[:0] for t, f in zip(sets, first, strict=True)]
            del sets
            owner = np.repeat(np.arange(len(signed)), [len(x) for x in signed])
            rooms = np.concatenate(signed).view(np.int64)
            # of a room's members in this batch, the one of the least hash stands for it
            by = np.lexsort((nodes[owner], rooms))
            rooms, owner = rooms[by], owner[by]
            edges = groups_of(rooms)
            lead = np.repeat(owner[edges[:-1]], np.diff(edges))
            other = owner != lead
            pairs = np.unique(np.column_stack((owner[other], lead[other])), axis=0)
            stands = ~other
            order = np.argsort(owner[stands], kind="stable")
            counts = np.bincount(owner[stands], minlength=len(nodes))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(rooms[stands][order]))
            near = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], np.arange(len(nodes) + 1)), pa.int32()), pa.array(nodes[pairs[:, 1]]))
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("dkey"), pa.array(nodes), pa.array(sizes), lists, near], ["did", "dkey", "node", "size", "rooms", "near"])

    return run


def _many(held: list[pa.RecordBatch]) -> bool:
    return sum(b.num_rows for b in held) >= ROWS


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (room, node) rows in order of room, each room's node of the least hash with each other one."""
    for rows in whole_keys(batches, "room", _many):
        room, node = (rows.column(c).to_numpy() for c in ("room", "node"))
        by = np.lexsort((node, room))
        room, node = room[by], node[by]
        edges = groups_of(room)
        lead = np.repeat(node[edges[:-1]], np.diff(edges))
        pairs = np.column_stack((lead, node))[node != lead]
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        yield _pairs(pairs)


def _pairs(pairs: np.ndarray | list) -> pa.RecordBatch:
    pairs = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], ["u", "v"])


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(x) for x in values])))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(values).view(np.int64)))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = list(shingle_sets(*text_buffers(batch.column("text")), n))
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), batch.column("large"), _lists(sets)], ["node", "root", "large", "tokens"])

    return run


def prefix(tokens: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rarest tokens of a set, so many that sets that link share one of each's; and the size up to which a set can link whose
    first common token with this one that is. Common tokens come in order of how many hold them, all others before them."""
    size = len(tokens)
    number = size - -(-size * percent // 100) + 1 if size else 0
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], tokens), len(common[0]) - 1)
        tokens = tokens[np.argsort(np.where(common[0][at] == tokens, common[1][at], 0), kind="stable")]
    return tokens[:number], (size - np.arange(number)) * (100 + percent) // percent - size


def _prefixes(percent: int, common: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = _tokens(pa.Table.from_batches([batch]))
                found = [prefix(t, percent, common.value) for t in sets]
                counts = [len(t) for t, _ in found]
                token, most = (np.concatenate(x) for x in zip(*found, strict=True))
                node, size = (np.repeat(x, counts) for x in (batch.column("node").to_numpy(), [len(t) for t in sets]))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token.view(np.int64), node, size, most)], ["token", "node", "size", "most"])

    return run


def ties(token: np.ndarray, node: np.ndarray, size: np.ndarray, most: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of nodes that join all that may link by one of these tokens, at most one for each row.

    Of two sets that link, the larger allows for the smaller (its most is at least the other's size), and the smaller
    for one that is larger than itself. So sets that allow for their own size are tied in order of size as far as sizes may link, and any other
    set to the largest of these that it allows for."""
    by = np.lexsort((size, token))
    token, node, size, most = (x[by] for x in (token, node, size, most))
    group = np.cumsum(np.concatenate(([0], token[1:] != token[:-1]))) if len(token) else token
    early = np.flatnonzero(most >= size)
    late = np.flatnonzero(most < size)
    a, b = early[:-1], early[1:]
    keep = (group[a] == group[b]) & (100 * size[a] >= percent * size[b])
    chained = np.column_stack((node[a[keep]], node[b[keep]]))
    if not len(early) or not len(late):
        return chained
    key = lambda g, s: g.astype(np.int64) << 40 | np.clip(s, 0, (1 << 40) - 1)
    at = np.searchsorted(key(group[early], size[early]), key(group[late], most[late]), "right") - 1
    other = early[np.maximum(at, 0)]
    keep = (at >= 0) & (group[other] == group[late]) & (100 * size[other] >= percent * size[late])
    return np.concatenate((chained, np.column_stack((node[other[keep]], node[late[keep]]))))


def _tied(percent: int):
    """From (token, node, size, most) rows in order of token: the ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, "token", _many):
            yield _pairs(ties(*(rows.column(c).to_numpy() for c in ("token", "node", "size", "most")), percent))

    return run


def _tokens(rows: pa.Table) -> list[np.ndarray]:
    column = rows.column("tokens").combine_chunks()
    flat = np.asarray(column.flatten()).view(_U)
    offsets = np.asarray(column.offsets) - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _search_cluster(percent: int):
    """Groups (root): all members of a cluster; gives links that join its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["root"]):
            node, sets = rows.column("node").to_numpy(), _tokens(rows)
            lists, forest = Lists(sets), Forest(len(sets))
            roots = np.arange(len(sets))
            out: list[tuple[int, int]] = []
            for x in range(len(sets)):
                other = roots != roots[x]
                if not other.any():
                    break
                found = [y for y in lists.search(sets[x], percent, other).tolist() if forest.join(x, y)]
                if found:
                    out += [(int(node[x]), int(node[y])) for y in found]
                    roots = np.array([forest.root(y) for y in forest.up])
            yield _pairs(out)

    return run


def _search_stars(percent: int):
    """Groups (u, part): u's own row and its candidates' rows; gives the links of u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["u", "part"]):
            u, v = rows.column("u").to_numpy(), rows.column("v").to_numpy()
            sets = _tokens(rows)
            own = int(np.flatnonzero(u == v)[0])
            rest = np.flatnonzero(u != v)
            found = rest[Lists([sets[i] for i in rest]).search(sets[own], percent)]
            yield pa.RecordBatch.from_arrays([pa.array(u[found]), pa.array(v[found])], ["u", "v"])

    return run


def _mixed_rooms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (room, node, comp) rows in order of room, the members of rooms with several components; a set of members once."""
    for rows in whole_keys(batches, "room", _many):
        room, node, comp = (rows.column(c).to_numpy() for c in ("room", "node", "comp"))
        by = np.lexsort((node, room))
        room, node, comp = room[by], node[by], comp[by]
        edges = groups_of(room)
        sizes = np.diff(edges)
        mixed = np.maximum.reduceat(comp, edges[:-1]) != np.minimum.reduceat(comp, edges[:-1])
        key = hashing.mix(np.add.reduceat(hashing.mix(node.view(_U)), edges[:-1])).view(np.int64)
        which = np.flatnonzero(mixed)[np.unique(key[mixed], return_index=True)[1]]
        take = np.concatenate([np.arange(edges[i], edges[i + 1]) for i in which] or [which])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(key[which], sizes[which]), np.repeat(sizes[which], sizes[which]), node[take], comp[take])], ["key", "members", "node", "comp"])


def _search_rooms(percent: int):
    """Groups (key, i, j): the members of blocks i and j of a room; gives links that join their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["key", "i", "j"]):
            node, comp, block, i, j = (rows.column(c).to_numpy() for c in ("node", "comp", "block", "i", "j"))
            comp = np.unique(comp, return_inverse=True)[1]
            forest = Forest(int(comp.max()) + 1)
            sets = _tokens(rows)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            lists = Lists([sets[x] for x in right])
            out: list[tuple[int, int]] = []
            for x in left.tolist():
                roots = np.array([forest.root(c) for c in range(len(forest.up))])
                other = roots[comp[right]] != roots[comp[x]]
                if not other.any():
                    continue
                for y in right[lists.search(sets[x], percent, other)].tolist():
                    if forest.join(int(comp[x]), int(comp[y])):
                        out.append((int(node[x]), int(node[y])))
            yield _pairs(out)

    return run


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a group of keys together, in order, over all partitions: few bytes may mean much work here."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys)


def _blocks(rooms: DataFrame) -> DataFrame:
    """key, node, comp, block, i, j: the members of rooms (room, node, comp) of several comps, each set of members once, dealt out
    so that any two members of a room meet in one group (key, i, j)."""
    mixed = rooms.repartition("room").sortWithinPartitions("room").mapInArrow(tidy(_mixed_rooms), "key long, members long, node long, comp long").dropDuplicates(["key", "node"])
    blocks = mixed.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    blocks = blocks.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return blocks.select("key", "node", "comp", "block", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"))


def _cut_down(prefixes: DataFrame, percent: int) -> DataFrame:
    """node, root: clusters that the ties of prefixes (token, node, size, most) make."""
    return components(prefixes.repartition("token").sortWithinPartitions("token").mapInArrow(tidy(_tied(percent)), "u long, v long"))


def _piecewise(sets: DataFrame, prefixes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links u, v of clusters too large for one task, from their sets (node, tokens), prefixes and candidates (u, v)."""
    many = pairs.groupBy("u").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK))
    dealt = with_facts(pairs, many, "u", pairs.count()).withColumn("part", F.pmod(F.xxhash64("v"), "parts").cast("int"))
    owns = many.select("u", F.col("u").alias("v"), F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"))
    asked = dealt.select("u", "v", "part").unionByName(owns).join(sets.select(F.col("node").alias("v"), "tokens"), "v")
    links = staged(_dealt(asked, "u", "part").mapInArrow(tidy(_search_stars(percent)), "u long, v long"), "links")

    comps = components(links)
    rooms = prefixes.select(F.col("token").alias("room"), "node").join(comps, "node", "left").select("room", "node", F.coalesce("root", "node").alias("comp"))
    rest = _dealt(_blocks(rooms).join(sets, "node"), "key", "i", "j").mapInArrow(tidy(_search_rooms(percent)), "u long, v long")
    return links.unionByName(rest)


def _searched(sets: DataFrame, percent: int) -> DataFrame:
    """Links u, v from sets (root, node, tokens), each cluster in one task."""
    return _dealt(sets.select("root", "node", "tokens"), "root").mapInArrow(tidy(_search_cluster(percent)), "u long, v long")


def _with_size(clusters: DataFrame) -> DataFrame:
    """clusters (node, root, size, ...) with large: whether the whole is too large for one task."""
    clusters = staged(clusters, "sized")
    return with_facts(clusters, clusters.groupBy("root").agg((F.sum("size") > CLUSTER).alias("large"), F.count("*").alias("n")), "root", clusters.count())


def _starred(rooms: DataFrame) -> DataFrame:
    """Candidates u, v of rooms (room, node)."""
    return rooms.repartition("room").sortWithinPartitions("room").mapInArrow(tidy(_stars), "u long, v long")


def _labels(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """did, dkey, n_shingles, component_id, group of each document of docs (did, dkey, text, ...), once."""
    common = common_shingles(docs, n)
    signed = staged(docs.mapInArrow(tidy(_sign(n, percent, common)), "did long, dkey long, node long, size long, rooms array<long>, near array<long>"), "signed")
    linkable = signed.where("size > 0")
    rooms = linkable.select(F.explode("rooms").alias("room"), "node")
    stars = [staged(_starred(rooms.where(F.pmod("room", F.lit(PASSES)) == i)).distinct(), "stars") for i in range(PASSES)]
    nearby = linkable.select(F.explode("near").alias("u"), F.col("node").alias("v"))
    pairs = staged(reduce(DataFrame.unionByName, stars, nearby).distinct(), "pairs")
    wide, signed = signed, staged(signed.select("did", "dkey", "node", "size"), "nodes")
    unstage(wide, *stars)

    members = signed.where("size > 0").select("did", "dkey", "node")
    clusters = components(pairs)
    one = signed.where("size > 0").groupBy("node").agg(F.min(F.struct("did", "dkey", "size")).alias("x"))
    one = staged(_with_size(one.join(clusters, "node").select("node", "root", "x.did", "x.dkey", "x.size")), "clusters")
    texts = docs.select("did", "dkey", "text").join(one.drop("size").hint("shuffle_hash"), ["did", "dkey"]).select("node", "root", "large", "text")
    sets = texts.mapInArrow(tidy(_sets(n)), "node long, root long, large boolean, tokens array<long>")
    links = staged(_searched(sets.where("not large"), percent), "links")
    if one.where("large").limit(1).count():
        sets = staged(sets.where("large").select("node", "tokens"), "sets")
        prefixes = staged(sets.mapInArrow(tidy(_prefixes(percent, common_in_sets(sets))), "token long, node long, size long, most long"), "prefixes")
        finer = staged(_with_size(_cut_down(prefixes, percent).join(one.select("node", "size"), "node")), "finer")
        links = staged(links.unionByName(_searched(finer.where("not large").join(sets, "node"), percent)), "links")
        if finer.where("large").limit(1).count():
            left = staged(finer.where("large").select("node"), "left")
            mine = lambda rows, c: rows.join(left.withColumnRenamed("node", c), c, "left_semi")
            rest = staged(mine(sets, "node"), "sets")
            unstage(sets)
            sets = rest
            links = staged(links.unionByName(_piecewise(sets, mine(prefixes, "node"), mine(mine(pairs, "u"), "v").select("u", "v"), percent)), "links")
        unstage(sets, prefixes)
    unstage(pairs)

    found = component_ids(members, links)
    nodes = members.groupBy("node").agg(F.min("did").alias("least"), F.count("*").alias("n")).join(found, "node", "left")
    nodes = staged(nodes.select("node", "n", F.coalesce("component_id", "least").alias("component"), F.coalesce("root", "node").alias("group")), "nodes")
    once = signed.select("did", "dkey", "node", F.col("size").alias("n_shingles")).dropDuplicates(["did", "dkey"])
    linked = with_facts(once.where("n_shingles > 0"), nodes, "node", signed.count())
    bare = once.where("n_shingles = 0").withColumns({"component": F.col("did"), "group": F.lit(None).cast("long")})
    return linked.unionByName(bare).select("did", "dkey", "n_shingles", F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"), "group")


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents that links join: two link if their sets of n-word shingles have a Jaccard similarity of percent
    / 100 or more. Words are lower-cased (A-Z) runs of bytes other than blank and tab to carriage return; a text of
    fewer than n words has one shingle, all its words.

    Returns did (doc_id; missing ids as the largest long), dkey (hash of the text), text, row (the other columns of
    docs, under any names), n_shingles, component_id (smallest did that links reach, null where that document has no id), group
    (a number of the component; null for documents without shingles).
    Null and empty texts, and texts without words: n_shingles 0, linked with nothing. Rows of one doc_id are documents of
    their own; rows equal in id and text are one, and each comes out. Empty table: empty result.
    """
    docs = with_key(docs)
    return docs.join(_labels(docs, n, percent).hint("shuffle_hash"), ["did", "dkey"])


def first_of_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without near copies: of each group that jaccard_groups finds, the document of the
    smallest doc_id stays, once. Documents without shingles stay; of those equal in doc_id and text, one."""
    keyed = with_key(docs)
    found = staged(_labels(keyed, n, percent).select("did", "dkey", "group"), "labels")
    firsts = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min(F.struct("did", "dkey")).alias("x")).select("x.did", "x.dkey")
    keys = firsts.unionByName(found.where(F.col("group").isNull()).select("did", "dkey"))
    once = keyed.join(keys.hint("shuffle_hash"), ["did", "dkey"]).dropDuplicates(["did", "dkey"])
    return once.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by 4-word shingles at a Jaccard similarity of 0.85; those without words link with nothing."""
    out = jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)
    return out.select("row.doc_id", "n_shingles", "component_id")


SQL = r"""
WITH words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM words
), tokens AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), often AS (
  SELECT t FROM tokens GROUP BY t HAVING count(*) > 1
), shared AS (
  SELECT k.doc_id, k.n, k.t FROM tokens k SEMI JOIN often o ON k.t = o.t
), counted AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * b.n >= 85 * a.n AND 100 * a.n >= 85 * b.n GROUP BY ALL
), links AS (
  SELECT x, y FROM counted WHERE 100 * c >= 85 * (nx + ny - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  WITH RECURSIVE r(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM r JOIN both_ways b ON r.y = b.x)
  SELECT x, min(y) AS low FROM r GROUP BY x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.low, s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON s.doc_id = r.x
"""
