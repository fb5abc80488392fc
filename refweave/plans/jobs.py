"""Ingest once, index often: the two halves of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import pages_to_edges
from ..operators.index import backlinks_in_chunks, stats
from ..sources import edgelist, files, pagefile, sinks, warc, wikidump


def ingest(spark: SparkSession, kind: str, *paths: str, include_internal: bool = False, max_pages: int | None = None) -> DataFrame:
    """source, target of inputs of a kind: warc, wikipedia (internal links count there, and only articles), edges, prepared or
    parquet (url, html). Edge lists and prepared files keep self-loops."""
    if kind == "prepared":
        return _unioned([pagefile.edges(pagefile.read(spark, p)) for p in paths])
    if kind == "parquet":
        return pages_to_edges(spark.read.parquet(*paths), include_internal, max_pages=max_pages)
    found = [f for p in paths for f in files.resolve(spark, p, kind)]
    if kind == "edges":
        return edgelist.read(spark, *found)
    if kind == "warc":
        return pages_to_edges(warc.html_pages(warc.read(spark, *found)), include_internal, max_pages=max_pages)
    if kind != "wikipedia":
        raise ValueError(f"no such kind of input: {kind}")
    plain = [f for f in found if f.lower().endswith(".ndjson")]
    packed = [f for f in found if f not in plain]
    pages = [wikidump.read(spark, *packed)] * bool(packed) + [wikidump.read_ndjson(spark, *plain)] * bool(plain)
    return pages_to_edges(_unioned(pages), include_internal=True, articles_only=True, max_pages=max_pages)


def _unioned(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def index(spark: SparkSession, edges: DataFrame, output: str | None = None) -> DataFrame:
    """The index of edges, in chunks (backlinks_in_chunks); also written as TSV, a line a target, if there is an output."""
    found = backlinks_in_chunks(edges)
    if output:
        sinks.write_tsv(found, output)
    return found


def metrics(edges: DataFrame) -> DataFrame:
    """One row of counters: pages (distinct sources) and those of operators.index.stats."""
    return stats(edges).select(F.col("distinct_sources").alias("pages"), "links_emitted", "backlink_keys", "backlink_edges", "max_fan_in")
