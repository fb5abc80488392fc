"""Writers: the index as TSV, edges and partitions as Parquet, counters as METRIC lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import bucket
from ..operators.index import joined, tsv_lines

#: Pages in one file of a partition.
PAGES_PER_FILE = 200


def write_tsv(index: DataFrame, path: str, ordered: bool = False) -> None:
    """One line a target, of its chunks if it has several. ordered: sorted over all files (a range shuffle); else each task writes what it has."""
    index = joined(index) if "chunk" in index.columns else index
    tsv_lines(index.orderBy("target") if ordered else index).write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str) -> None:
    """The extracted relation, for later runs."""
    edges.select("source", "target").write.mode("overwrite").parquet(path)


def write_partitions(edges: DataFrame, path: str, partitions: int = 32, pages_per_file: int = PAGES_PER_FILE) -> None:
    """Pages with links (source, targets) in folders part=0, 1, ... by the stable hash of their address. A folder gets as many tasks as
    its size takes. read_edges() reads them back."""
    pages = edges.groupBy("source").agg(F.collect_list("target").alias("targets"))
    pages = pages.withColumn("part", bucket(F.col("source"), partitions).cast("int"))
    pages.hint("rebalance", "part").write.mode("overwrite").option("maxRecordsPerFile", pages_per_file).partitionBy("part").parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """source, target of what write_edges() or write_partitions() wrote."""
    rows = spark.read.parquet(path)
    return rows.select("source", F.explode("targets").alias("target")) if "targets" in rows.columns else rows.select("source", "target")


def metric_lines(counters: DataFrame) -> DataFrame:
    """value: "METRIC name=value" for each column of a one-row table."""
    pairs = F.array(*(F.concat(F.lit(f"METRIC {c}="), F.col(c).cast("string")) for c in counters.columns))
    return counters.select(F.explode(pairs).alias("value"))
