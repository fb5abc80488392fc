"""Prepared page files: "URL x" begins a page, "LINK y" adds a link to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """parse() of all *.page files under path, at any depth."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.page").text(path, wholetext=True)
    return parse(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def parse(files: DataFrame) -> DataFrame:
    """path, page (number in its file), source, targets (in order, repeats kept) of page files (path, value).

    Links before the first page are nobody's; lines of other kinds are ignored, as are links without a target. A page
    without an address has the source "".
    """
    pages = files.select("path", F.posexplode(F.split("value", r"(?m)^URL(?= )")).alias("page", "body")).where("page > 0")
    lines = F.split("body", r"\r?\n")
    links = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("LINK ")), lambda x: F.trim(F.substring(x, F.lit(6), F.length(x)))), lambda x: x != "")
    return pages.select("path", "page", F.trim(F.element_at(lines, 1)).alias("source"), links.alias("targets"))


def edges(pages: DataFrame) -> DataFrame:
    """source, target of pages as read() gives them."""
    return pages.select("source", F.explode("targets").alias("target"))


def counters(pages: DataFrame) -> DataFrame:
    """One row: page_files, pages (with an address), links_emitted."""
    return pages.agg(F.countDistinct("path").alias("page_files"), F.count(F.when(F.col("source") != "", 1)).alias("pages"), F.coalesce(F.sum(F.size("targets")), F.lit(0)).cast("long").alias("links_emitted"))
