"""Operator 7, sharding: best-fit-decreasing bin packing of indivisible groups into shards of equal size.

Rows of equal text form a group. Only the histogram of group sizes decides how groups are packed: largest first, each into
the shard with the tightest room that holds it, found in a balanced tree of rooms; groups of one size are placed at once, just as
one by one. The capacity is the least found with which that takes no more than the wanted shards. The histogram's
sizes differ, and their sum is at most all bytes B, so it has no more than about sqrt(2 B ln B) rows (a few 10^7 for 100 TB, and
thousands in practice): the driver's part follows that, not the number of groups.
Groups then look up where their rank among those of their size goes, and rows their place in their group. Nothing is
gathered for that: sizes, and groups, with more than a cell's rows are counted in cells, and only a cell's rows are sorted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ordered_id, staged, table

#: Cells have about CELL rows; where more than LARGE sizes or groups would be larger, as many as leaves LARGE of them.
SHARDS, CELL, LARGE = 8, 20_000, 4096
GROUP = ["g", "size", "text_crc32"]


class RoomTree:
    """A treap of (room, shard) pairs: the tightest room that holds a size in logarithmic time."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]

    @staticmethod
    def _priority(key: tuple[int, int]) -> int:
        x = (key[0] * 0x9E3779B97F4A7C15 ^ key[1] * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
        return (x ^ x >> 29) * 0x94D049BB133111EB & (1 << 64) - 1

    @classmethod
    def _split(cls, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Keys under key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = cls._split(node[3], key)
            node[3] = low
            return node, high
        low, high = cls._split(node[2], key)
        node[2] = high
        return low, node

    @classmethod
    def _join(cls, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = cls._join(low[3], high)
            return low
        high[2] = cls._join(low, high[2])
        return high

    def add(self, room: int, shard: int) -> None:
        key = (room, shard)
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self._priority(key), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least room of at least size, of the first shard that has it."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        key = node[0]
        first, rest = self._split(high, (key[0], key[1] + 1))
        self.root = self._join(low, rest)
        return key


def best_fit_decreasing(sizes: list[int], counts: list[int], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """For groups of sizes (falling), counts of each: rows (index of the size, shard, how many groups), in the order in which groups
    are placed, and the number of shards; None if it takes more than most.

    A shard that took a group has less room than before, so it stays the tightest as long as another one fits: it takes
    all of them at once."""
    tree, shards, out = RoomTree(), 0, []
    for i, (size, left) in enumerate(zip(sizes, counts, strict=True)):
        while left:
            found = tree.take(size)
            if found is None:
                if shards == most or size > capacity:
                    return None
                found = (capacity, shards)
                shards += 1
            room, to = found
            n = min(left, room // size)
            out.append((i, to, n))
            tree.add(room - n * size, to)
            left -= n
    return out, shards


def pack_into(sizes: list[int], counts: list[int], shards: int) -> list[tuple[int, int, int]]:
    """best_fit_decreasing's rows at the least capacity found that takes no more than shards: from the mean up in growing steps, then by bisection."""
    if not sizes:
        return []
    total = sum(s * n for s, n in zip(sizes, counts, strict=True))
    low = at = max(sizes[0], -(-total // shards))
    best, step = None, 1
    while best is None:
        best = best_fit_decreasing(sizes, counts, at, shards)
        if best is None:
            low, at, step = at + 1, at + step, step * 2
    high = at
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, counts, middle, shards)
        if found:
            best, high = found, middle
        else:
            low = middle + 1
    return best[0]


def _cell(cells: Column, *by: str) -> Column:
    return F.when(cells > 1, F.pmod(F.xxhash64(*by, F.lit(7)), cells)).otherwise(F.lit(0)).cast("int")


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, cell, before: how many rows of the same keys lie in lower cells."""
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*keys, "cell").count().select(*keys, "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))


def shard(docs: DataFrame, shards: int = SHARDS, cell: int = CELL) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 1), text_crc32, shard (0 to shards - 1), slot (from 0, without gaps in a shard).

    Rows of equal text stay together; null counts as the empty text, of size 1 and crc32 0. Sizes of shards are as
    equal as best fit makes them. Rows equal in all columns get slots of their own; rows without doc_id come last in their
    group or cell. Other columns are ignored, whatever their names. Empty table: empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = staged(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g")), "rows")
    groups = staged(rows.groupBy(*GROUP).agg(F.count("*").alias("n")).withColumn("bytes", F.col("n") * F.col("size")), "groups")
    found = groups.groupBy("bytes", "n").agg(F.count("*").alias("groups")).orderBy(F.desc("bytes"), "n").toArrow()
    sizes, each, counts = (found.column(c).to_pylist() for c in ("bytes", "n", "groups"))
    cell = max(cell, -(-sum(n * k for n, k in zip(each, counts, strict=True)) // LARGE))

    base, ranks = [0] * shards, [0] * len(sizes)
    plan: list[list[dict]] = [[] for _ in sizes]
    for i, to, k in pack_into(sizes, counts, shards):
        plan[i].append({"rank": ranks[i], "shard": to, "base": base[to]})
        base[to] += each[i] * k
        ranks[i] += k
    kind = pa.list_(pa.struct([("rank", pa.int64()), ("shard", pa.int32()), ("base", pa.int64())]))
    parts = pa.table({"bytes": pa.array(sizes, pa.int64()), "n": pa.array(each, pa.int64()), "parts": pa.array(plan, kind)})
    large = [(s, n, -(-k // cell)) for s, n, k in zip(sizes, each, counts, strict=True) if k > cell]  # LARGE at most, like the next
    large = F.broadcast(spark.createDataFrame(large, "bytes long, n long, cells long"))

    named = groups.join(large, ["bytes", "n"], "left").withColumn("cell", _cell(F.col("cells"), *GROUP))
    places = _counted(named, "bytes", "n").join(staged(spark.createDataFrame(parts), "plan"), ["bytes", "n"])
    at = F.col("before") + F.row_number().over(Window.partitionBy("bytes", "n", "cell").orderBy(*GROUP)) - 1
    ranked = named.join(places, ["bytes", "n", "cell"]).select(*GROUP, "n", "parts", at.alias("at"))
    part = F.element_at(F.filter("parts", lambda p: p["rank"] <= F.col("at")), -1)
    placed = ranked.select(*GROUP, "n", "at", part.alias("p")).select(*GROUP, "n", F.col("p.shard").alias("shard"), (F.col("p.base") + (F.col("at") - F.col("p.rank")) * F.col("n")).alias("start"))
    placed = staged(placed, "placed")

    hot = placed.where(F.col("n") > cell).withColumn("cells", F.ceil(F.col("n") / cell))
    dealt = rows.join(F.broadcast(hot.select(*GROUP, "cells")), GROUP, "left").withColumn("cell", _cell(F.col("cells"), "doc_id"))
    starts = hot.join(F.broadcast(_counted(dealt.where("cells > 1"), *GROUP)), GROUP).select(*GROUP, "cell", "shard", (F.col("start") + F.col("before")).alias("start"))
    starts = starts.unionByName(placed.where(F.col("n") <= cell).select(*GROUP, F.lit(0).alias("cell"), "shard", "start"))
    slot = F.col("start") + F.row_number().over(Window.partitionBy(*GROUP, "cell").orderBy(ordered_id(F.col("doc_id")))) - 1
    return dealt.join(starts, [*GROUP, "cell"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of equal bytes; documents of equal text share a shard. Null ids and texts are sharded like others."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
