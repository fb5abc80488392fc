"""Incremental indexing of pages and edges that keep arriving. The batch engine has no counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import backlinks, distinct_edges
from ..schemas import EDGES

#: Batches after which deltas are merged into one base.
EVERY = 16


def stream_distinct(edges: DataFrame) -> DataFrame:
    """New edges of a stream, each once over its whole life (the state holds all edges)."""
    return edges.dropDuplicates(["target", "source"])


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers of folders name=0, name=1, ... whose write has finished, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return []
    found = [s.getPath() for s in fs.listStatus(path(folder)) if s.isDirectory() and fs.exists(path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix(f"{name}=")) for p in found)


def _drop(spark: SparkSession, folders: list[str]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in folders:
        path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(folder), True)


def read_edges(spark: SparkSession, table: str) -> DataFrame:
    """source, target: the last base, and the deltas after it. Edges may be repeated over these."""
    bases = _numbers(spark, f"{table}/base", "upto")
    upto = bases[-1] if bases else -1
    folders = [f"{table}/base/upto={upto}"] * bool(bases) + [f"{table}/delta/batch={n}" for n in _numbers(spark, f"{table}/delta", "batch") if n > upto]
    return spark.read.schema(EDGES).parquet(*folders) if folders else spark.createDataFrame([], EDGES)


def maintain_edges(edges: DataFrame, table: str, checkpoint: str, every: int = EVERY) -> StreamingQuery:
    """Appends each batch's distinct edges under table as Parquet, one folder a batch, overwritten if the batch is run again; so
    reading table gives the same set however often batches fail. After each `every` batches, what is there becomes one new
    base and the folders it replaces go, so that their number stays bounded. read_index() builds the index from it."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        distinct_edges(batch).write.mode("overwrite").parquet(f"{table}/delta/batch={number}")
        if (number + 1) % every == 0:
            old = _numbers(spark, f"{table}/base", "upto")
            if number not in old:  # else this batch ran before, and its base is whole
                distinct_edges(read_edges(spark, table)).write.mode("overwrite").parquet(f"{table}/base/upto={number}")
            _drop(spark, [f"{table}/base/upto={n}" for n in old if n < number] + [f"{table}/delta/batch={n}" for n in _numbers(spark, f"{table}/delta", "batch") if n <= number])

    return edges.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, table: str) -> DataFrame:
    """The index over all batches so far."""
    return backlinks(read_edges(spark, table))
