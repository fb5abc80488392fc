"""Operator 3, mixing sources to target weights: Poisson replication.

A source's rate is the bytes it should have in the mix over the bytes it has. Each document draws its number of copies by
inverting the Poisson distribution of that mean at a number from 0 to 1 that only its id and the seed decide; it is
repeated so often, and the copies are shuffled globally by a hash of id, copy and seed. All of it is built-in
expressions. Rates join by broadcast while there are no more than SOURCES of them, and otherwise by a salted join, since
one source may have a third of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Power of a source's size that gives its weight where none are given; copies in the mix as a share of all bytes.
ALPHA, SHARE, SEED = 0.5, 1.0, 17
#: Sources up to which the rates are broadcast; parts into which larger joins are salted.
SOURCES, SALTS = 100_000, 64
#: A larger rate is drawn as the sum of equal parts of at most this mean.
PART = 16.0


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 sum."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k with u < P(X <= k), X of mean rate (0 to PART)."""
    # 80 terms leave less than 2**-52 of a mean of 16
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.lit(0).alias("k"))
    step = lambda a, i: F.when(u < a["c"], a).otherwise(F.struct((a["p"] * rate / i).alias("p"), (a["c"] + a["p"] * rate / i).alias("c"), i.cast("int").alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda a: a["k"])


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, share: float = SHARE, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The rows of docs (doc_id, text, source, ...), repeated: columns row (all of docs), copy (from 0), copies, rate, order_key.

    weights: of the sources; without it, a source weighs its bytes to the power alpha. Sources without weight get no copies.
    The mix has about share times the bytes of docs, and within a partition rows are in order of order_key.
    Null source: a source of its own (None in weights). Null text: no bytes, drawn like others. A source without bytes has
    rate 0 if all its texts are empty. Rows that share a doc_id draw the same number, so repeated rows are repeated alike; texts of any
    length are moved as they are. Empty table: empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), F.col("doc_id").alias("id"))
    size = F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long")
    sizes = docs.select(F.col("source").cast("string").alias("source"), size.alias("size")).groupBy("source").agg(F.sum("size").alias("bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(alpha)))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double").withColumnRenamed("source", "name")
        sizes = sizes.join(given, sizes["source"].eqNullSafe(given["name"]), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("name")
    known = sizes.count()
    totals = sizes.agg(F.sum("weight").alias("w"), F.sum("bytes").alias("b")).first()
    all_weight, all_bytes = float(totals["w"] or 0), float(totals["b"] or 0)
    rates = sizes.select(F.col("source").alias("of"), F.when((F.col("bytes") > 0) & F.lit(all_weight > 0), F.col("weight") / F.lit(all_weight or 1.0) * F.lit(share * all_bytes) / F.col("bytes")).otherwise(F.lit(0.0)).alias("rate"))
    if known <= SOURCES:
        drawn = rows.join(F.broadcast(rates), rows["source"].eqNullSafe(rates["of"]))
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        drawn = rows.join(salted, rows["source"].eqNullSafe(salted["of"]) & (rows["salt"] == salted["salt"]))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    draws = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda a, i: a + poisson_inverse(uniform(seed, F.col("id"), i), F.col("rate") / parts))
    drawn = drawn.select("row", "id", "rate", draws.alias("copies")).where("copies > 0")
    copies = drawn.select("row", "id", "rate", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    keyed = copies.select("row", "copy", "copies", "rate", key.alias("order_key"))
    return keyed.repartition("order_key").sortWithinPartitions("order_key")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that sources weigh as the roots of their bytes; null sources are a source."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("row.doc_id", "row.source", "copy", "copies", "order_key", F.md5(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_md5"))


SQL = """
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS BIGINT) AS bytes FROM documents GROUP BY source
), weighed AS (
  SELECT source, bytes, pow(CAST(bytes AS DOUBLE), 0.5) AS weight FROM sizes
), rates AS (
  SELECT source, CASE WHEN bytes > 0 THEN weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(bytes) FROM weighed) / bytes ELSE 0.0 END AS rate FROM weighed
), steps(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < 80
), drawn AS (
  SELECT d.doc_id, d.source, d.text, CAST(CAST('0x' || substr(md5('17:' || CAST(d.doc_id AS VARCHAR) || ':1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents d
), counted AS (
  SELECT d.doc_id, d.source, any_value(d.text) AS text, CAST(count(*) AS INTEGER) AS copies
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.k < 80 AND d.u >= s.c GROUP BY d.doc_id, d.source
)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, copies, md5('order 17:' || CAST(doc_id AS VARCHAR) || ':' || CAST(copy AS VARCHAR)) AS order_key, md5(coalesce(text, '')) AS text_md5
FROM (SELECT *, unnest(range(0, copies)) AS copy FROM counted)
"""
