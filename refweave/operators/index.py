"""The backlink index and its statistics, from edges (source, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host_of


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each edge once. Combined before the shuffle, which spreads by the whole edge, so that hot targets don't matter."""
    return edges.select("target", "source").distinct()


def backlinks(edges: DataFrame) -> DataFrame:
    """target, sources: the sorted, duplicate-free pages that link to each target."""
    return edges.groupBy("target").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def backlinks_in_chunks(edges: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """target, chunk, sources: as backlinks(), but a target of more sources than `chunk` gets several rows, so that no row
    grows without bound. Chunk 0, 1, ... of a target follow each other by hash of the source, each sorted in itself."""
    # at most one target for every chunk edges, so few that they can be broadcast; counted before the shuffle
    hot = edges.groupBy("target").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts")).where("parts > 1")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("source"), "parts")).otherwise(0).cast("int")
    dealt = edges.join(F.broadcast(hot), "target", "left").select("target", part.alias("chunk"), "source")
    return dealt.groupBy("target", "chunk").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def joined(chunks: DataFrame) -> DataFrame:
    """target, sources: the chunks of each target in one row, in order. A line of text needs that; Parquet should keep the chunks."""
    known = chunks.groupBy("target").agg(F.max("chunk").alias("most")).where("most > 0").select("target")
    rows = chunks.join(F.broadcast(known), "target", "left_semi").groupBy("target").agg(F.sort_array(F.flatten(F.collect_list("sources"))).alias("sources"))
    return chunks.join(F.broadcast(known), "target", "left_anti").select("target", "sources").unionByName(rows)


def merge_indexes(*indexes: DataFrame) -> DataFrame:
    """The index of all edges of some indexes: inserting is idempotent, so they may overlap."""
    edges = indexes[0]
    for other in indexes[1:]:
        edges = edges.unionByName(other)
    return backlinks(edges.select("target", F.explode("sources").alias("source")))


def fan_in(edges: DataFrame) -> DataFrame:
    """target, fan_in, without gathering the sources: distinct edges are counted."""
    return distinct_edges(edges).groupBy("target").agg(F.count("*").alias("fan_in"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: links_emitted (before duplicates go), backlink_keys, backlink_edges, max_fan_in, distinct_sources.

    The edges are read once: a shuffle makes them distinct, and another counts both of their ends, each combined before it."""
    once = edges.groupBy("target", "source").agg(F.count("*").alias("n"))
    end = lambda name: F.struct(F.lit(name == "target").alias("is_target"), F.col(name).alias("key"), F.col("n"))
    ends = once.select(F.explode(F.array(end("target"), end("source"))).alias("e")).select("e.*")
    counted = ends.groupBy("is_target", "key").agg(F.count("*").alias("degree"), F.sum("n").alias("n"))
    of_targets = lambda c: F.when(F.col("is_target"), c)
    return counted.agg(
        F.coalesce(F.sum(of_targets(F.col("n"))), F.lit(0)).alias("links_emitted"),
        F.count(of_targets(F.lit(1))).alias("backlink_keys"),
        F.coalesce(F.sum(of_targets(F.col("degree"))), F.lit(0)).alias("backlink_edges"),
        F.coalesce(F.max(of_targets(F.col("degree"))), F.lit(0)).alias("max_fan_in"),
        F.count(F.when(~F.col("is_target"), 1)).alias("distinct_sources"),
    )


def skew_profile(edges: DataFrame) -> DataFrame:
    """fan_in, keys: how many targets have each number of sources."""
    return fan_in(edges).groupBy("fan_in").agg(F.count("*").alias("keys"))


def top_targets(edges: DataFrame, k: int) -> DataFrame:
    """The k targets of most sources, ties by name."""
    return fan_in(edges).orderBy(F.desc("fan_in"), "target").limit(k)


def top_targets_per_host(edges: DataFrame, k: int) -> DataFrame:
    """host, rank, target, fan_in: each host's k targets of most sources."""
    ranked = fan_in(edges).withColumn("host", host_of(F.col("target")))
    order = Window.partitionBy("host").orderBy(F.desc("fan_in"), "target")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("host", "rank", "target", "fan_in")


def resolved_targets(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of index (target, ...) whose target is one of pages (target)."""
    return index.join(pages.select("target"), "target", "left_semi")


def dangling_targets(index: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of index (target, ...) whose target is none of pages (target)."""
    return index.join(pages.select("target"), "target", "left_anti")


def integer_median(values: Column) -> Column:
    """The median of whole numbers; of an even count, the whole mean of the middle two."""
    return F.floor(F.percentile(values, 0.5)).cast("long")


def tsv_lines(index: DataFrame) -> DataFrame:
    """value: target, a tab, and the sources parted by blanks (URLs may hold commas)."""
    return index.select(F.concat_ws("\t", F.col("target"), F.array_join("sources", " ")).alias("value"))
