"""Plain edge lists: two ids a line, parted by a tab, a blank or a comma."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r"^([^\t ,]+)[\t ,]\s*([^\t ,]+)"


def parse(lines: DataFrame) -> DataFrame:
    """source, target, malformed of lines (value). Empty lines and those that begin with # or % are no lines; what lacks
    one of both ids (a leading separator, nothing behind it) is malformed. Further columns are ignored."""
    kept = lines.where(~F.col("value").rlike("^(#|%|$)"))
    found = kept.select(F.regexp_extract("value", _LINE, 1).alias("source"), F.regexp_extract("value", _LINE, 2).alias("target"))
    return found.withColumn("malformed", (F.col("source") == "") | (F.col("target") == ""))


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """source, target of all good lines of text files, gzipped or not. Self-loops and repeats stay."""
    return parse(spark.read.text(list(paths))).where("not malformed").select("source", "target")


def malformed(spark: SparkSession, *paths: str) -> DataFrame:
    """One row: malformed, the number of bad lines."""
    return parse(spark.read.text(list(paths))).agg(F.coalesce(F.sum(F.col("malformed").cast("long")), F.lit(0)).alias("malformed"))


def adjacency(edges: DataFrame) -> DataFrame:
    """source, targets: all targets of a source, repeats and self-loops kept. Lines of a source count as one record wherever they stand."""
    return edges.groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("targets"))
