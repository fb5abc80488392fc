"""Operator 1, embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors are one node. A table's hash has two parts. The signs against the first random hyperplanes name a room, where a
node's vector travels once; there they are told apart further by FINE hashes of more hyperplanes, none of which
leaves the task. Nodes that share a room and one of its finer hashes are compared exactly. So a vector moves once for many tables, and only
vectors and keys do: codes are computed where they are needed. The bits follow from the number of nodes, so that rooms and buckets
stay small as tables grow, and the number of rooms a node goes to follows from the bits, so that a pair at the threshold itself is found
with probability RECALL (nearer pairs are likelier). A room of more than BLOCK nodes is compared in blocks, so a task never
holds more than two of them. A pair counts in the first table where it meets; tasks return one row a node, with its number
of links and the least node it is tied to, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, component_ids, groups_of, ordered_id, sorted_groups, staged, table, tidy, with_facts

THRESHOLD, RECALL, SEED = 0.9, 0.97, 11
#: Finer hashes of a room; nodes that a room should have; nodes of a block; rows that are compared at a time.
FINE, ROOM, BLOCK, ROWS = 16, 8192, 16_384, 128


@dataclass
class Plan:
    """Bits of a room's name and of its finer hashes, and how many rooms a node goes to."""

    bits: int
    fine: int
    rooms: int


def plan_tables(nodes: int, threshold: float = THRESHOLD, recall: float = RECALL, room: int | None = None) -> Plan:
    agree = 1 - math.acos(threshold) / math.pi
    room = room or ROOM
    bits = max(0, math.ceil(math.log2(max(nodes, 1) / room)))
    fine = max(2, round(math.log2(max(min(nodes, room), 2))) - 4)
    found = agree**bits * (1 - (1 - agree**fine) ** FINE)
    return Plan(bits, fine, max(1, math.ceil(math.log(1 - recall) / math.log(1 - found))))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(column: str) -> F.Column:
    """Vectors that have a direction: no null or non-finite component, and one that isn't zero."""
    x = F.col(column)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


class Planes:
    """The random hyperplanes of a plan, for vectors of one length."""

    def __init__(self, plan: Plan, dim: int, seed: int):
        self.plan = plan
        rng = np.random.default_rng([seed, dim])
        self.coarse = rng.standard_normal((dim, plan.rooms, plan.bits))
        self.fine = rng.standard_normal((dim, plan.rooms, FINE, plan.fine))

    def _codes(self, x: np.ndarray, planes: np.ndarray) -> np.ndarray:
        bits = planes.shape[-1]
        signs = (x @ planes.reshape(len(planes), -1) > 0).reshape(len(x), math.prod(planes.shape[1:-1]), bits)
        return signs @ (1 << np.arange(bits, dtype=np.int64))

    def rooms(self, x: np.ndarray) -> np.ndarray:
        """The room of each row in each table."""
        return self._codes(x, self.coarse) if self.plan.bits else np.zeros((len(x), self.plan.rooms), np.int64)

    def buckets(self, x: np.ndarray, tab: int) -> np.ndarray:
        """The finer hashes of each row in one of a table's rooms."""
        return self._codes(x, self.fine[:, tab])

    def met(self, x: np.ndarray, y: np.ndarray, tab: int) -> np.ndarray:
        """Whether rows of x and y share a bucket of an earlier table."""
        out = np.zeros(len(x), bool)
        for t in range(tab):
            live = np.flatnonzero(~out)
            if self.plan.bits:
                mine = self.coarse[:, t : t + 1]
                live = live[self._codes(x[live], mine)[:, 0] == self._codes(y[live], mine)[:, 0]]
            out[live] = (self.buckets(x[live], t) == self.buckets(y[live], t)).any(axis=1)
        return out


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length and their vectors."""
    flat, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[(offsets[rows][:, None] + np.arange(size)).ravel()].reshape(len(rows), size)


def _rooms_of(plan: Plan, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, Planes] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros((batch.num_rows, plan.rooms), np.int64)
            for rows, x in _by_length(batch.column("x")):
                if x.shape[1] not in planes:
                    planes[x.shape[1]] = Planes(plan, x.shape[1], seed)
                codes[rows] = planes[x.shape[1]].rooms(unit_rows(x))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * plan.rooms, pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(np.asarray(batch.column("x").offsets)).astype(np.int32)), lists], ["node", "dim", "rooms"])

    return run


def _links(x: np.ndarray, codes: np.ndarray, block: np.ndarray, i: int, j: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of blocks i and j that share one of the codes and reach the threshold, each once."""
    for t in range(codes.shape[1]):
        order = np.lexsort((block, codes[:, t]))
        edges = groups_of(codes[order, t])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            mine = order[a:b]
            left, right = (mine, mine) if i == j else (mine[block[mine] == i], mine[block[mine] == j])
            for at in range(0, len(left), ROWS):
                some = left[at : at + ROWS]
                p, q = np.nonzero(x[some] @ x[right].T >= threshold)
                p, q = some[p], right[q]
                keep = p < q if i == j else np.ones(len(p), bool)
                for s in range(t):
                    keep &= codes[p, s] != codes[q, s]
                if keep.any():
                    yield p[keep], q[keep]


def _compare(plan: Plan, threshold: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["tab", "room", "dim", "i", "j"]):
            node, weight, block = (rows.column(c).to_numpy() for c in ("node", "weight", "block"))
            tab, i, j = (rows.column(c)[0].as_py() for c in ("tab", "i", "j"))
            column = rows.column("x").combine_chunks()
            x = unit_rows(np.asarray(column.flatten()).reshape(len(column), -1))
            planes = Planes(plan, x.shape[1], seed)
            by = np.argsort(node, kind="stable")
            rank = np.empty(len(node), np.int64)
            rank[by] = np.arange(len(node))
            up, links = np.arange(len(node)), np.zeros(len(node))  # a forest over ranks
            for a, b in _links(x, planes.buckets(x, tab), block, i, j, threshold):
                new = ~planes.met(x[a], x[b], tab)
                links += np.bincount(a[new], weight[b[new]], len(node)) + np.bincount(b[new], weight[a[new]], len(node))
                a, b = rank[a], rank[b]
                while True:
                    high, low = np.maximum(up[a], up[b]), np.minimum(up[a], up[b])
                    apart = high != low
                    if not apart.any():
                        break
                    np.minimum.at(up, high[apart], low[apart])
                    while (up[up] != up).any():
                        up = up[up]
            out = np.flatnonzero((links > 0) | (up[rank] != rank))
            yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(links[out].astype(np.int64)), pa.array(node[by[up[rank[out]]]])], ["node", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): row (all its columns), vid (vec_id; missing ids as the largest long),
    n_links (other vectors of cosine >= threshold found), component_id (smallest vec_id that links reach, null where that has
    none), kept (it is that one).

    Null and zero vectors, and those with null or non-finite components, link with nothing. Vectors link only with those
    of as many components. Rows that share a vec_id are vectors of their own; rows of equal vectors link with each other.
    Empty table: empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(ordered_id(F.col("vec_id")).alias("vid"), F.when(usable("embedding"), F.col("embedding")).alias("x"), F.struct("*").alias("row"))
    hashes = F.xxhash64("x"), F.xxhash64(F.lit(1), "x")  # nodes are told apart by 128 bits
    rows = rows.withColumn("node", F.when(F.col("x").isNotNull(), hashes[0])).withColumn("other", F.when(F.col("x").isNotNull(), hashes[1]))
    grouped = rows.where("x is not null").groupBy("node", "other").agg(F.count("*").alias("weight"), F.min("vid").alias("least"), F.first("x").alias("x"))
    nodes = staged(grouped, "vectors")
    number = nodes.count()
    if nodes.select("node").distinct().count() < number:
        raise ValueError("two vectors share a hash; use another one")
    plan = plan_tables(number, threshold, recall)

    placed = nodes.mapInArrow(tidy(_rooms_of(plan, seed)), "node long, dim int, rooms array<long>").select("node", "dim", F.posexplode("rooms").alias("tab", "room"))
    room = ["tab", "room", "dim"]
    sizes = placed.groupBy(*room).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    dealt = with_facts(placed.withColumn("key", F.struct(*room)), sizes.select(F.struct(*room).alias("key"), "blocks", "n"), "key", number * plan.rooms)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*room, "node", "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    cell = [*room, "i", "j"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = dealt.join(nodes.select("node", "weight", "x"), "node").repartition(tasks, *cell).sortWithinPartitions(*cell)
    found = staged(groups.mapInArrow(tidy(_compare(plan, threshold, seed)), "node long, links long, root long"), "near")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = component_ids(nodes.select(F.col("least").alias("did"), "node"), found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    known = nodes.select("node", "weight", "least").join(links, "node", "left").join(comps, "node", "left")
    known = staged(known.select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"), F.col("weight").alias("n")), "known")
    mine = rows.select("row", "vid", "node")
    out = with_facts(mine.where("node is not null"), known, "node", known.agg(F.sum("n")).first()[0] or 0)
    out = out.unionByName(mine.where("node is null").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vid")}))
    return out.select("row", "vid", F.col("n_links").cast("long").alias("n_links"), F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"), (F.col("vid") == F.col("component_id")).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more among all embeddings, their numbers and components; unusable vectors link with nothing."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("row.vec_id", "n_links", "component_id", "kept")
