"""Synthetic link graphs with a power-law fan-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _address(i: Column) -> Column:
    return F.concat(F.lit("https://site"), (i % 500).cast("string"), F.lit(".example/page/"), i.cast("string"))


def generate(spark: SparkSession, pages: int = 20_000, links: int = 10, seed: int = 42, skew: float = 1.0) -> DataFrame:
    """source, target: `links` draws a page, without self-links, repeats kept. Targets lean to low numbers by u ** (1 + skew), or
    are uniform if skew is 0 or less. Numbers come from a hash of page, draw and seed, so any partitioning gives the same graph."""
    drawn = spark.range(pages).select("id", F.explode(F.sequence(F.lit(0), F.lit(links - 1))).alias("j")) if links > 0 else spark.range(0).select("id", F.lit(0).alias("j"))
    u = F.shiftrightunsigned(F.xxhash64("id", "j", F.lit(seed)), 11).cast("double") / float(1 << 53)
    target = F.floor(F.lit(float(pages)) * (F.pow(u, F.lit(1.0 + skew)) if skew > 0 else u))
    edges = drawn.withColumn("t", F.greatest(F.lit(0), F.least(F.lit(pages - 1), target.cast("long")))).where("t <> id")
    return edges.select(_address(F.col("id")).alias("source"), _address(F.col("t")).alias("target"))
