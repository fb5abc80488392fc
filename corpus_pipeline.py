"""A corpus made ready for training, in five stages: toxic documents go, one of each group of near copies stays, repeated
passages are cut, sources are mixed to target weights, and what remains is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refweave.llm import jaccard_join, mixing, packing, suffix_dedup, toxicity
from refweave.llm.common import staged, table

#: No SQL for the whole: toxicity is learned and packing is sequential. tests/llm holds the stages against plain versions.
ORACLE_SQL = None
#: Score from which a document is rejected; words of a shingle and similarity in percent; bytes of a repeated passage.
TOXIC, WORDS, PERCENT, PASSAGE = 0.5, 5, 80, 200


def _columns(rows: DataFrame, docs: DataFrame, **new: F.Column) -> DataFrame:
    """The columns of docs from rows that hold them in row and text, some of them anew."""
    return rows.select(*(new[c].alias(c) if c in new else F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC with a lexicon learned from the labelled ones. Null and empty texts stay, as long as
    most labelled texts aren't toxic."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _columns(toxicity.score(docs, lexicon).where(F.col("score") < TOXIC), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies; all documents without words."""
    return jaccard_join.first_of_groups(docs, WORDS, PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of PASSAGE bytes that an earlier document, or the same one further left, holds too. A
    character that a cut parts goes as a whole. Documents of which nothing is left go; texts that were empty or null stay as they are."""
    found = suffix_dedup.remove_repeated_bytes(docs, PASSAGE, keep_first=True, as_text=True)
    left = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    rows = found.withColumn("left", left).where((F.col("n_removed") == 0) | (F.length("left") > 0))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("left")).cast(docs.schema["n_chars"].dataType)
    return _columns(rows, docs, **new)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, once or never, so that sources weigh as the roots of their sizes; shuffled globally. Null sources are a
    source; rows of one doc_id, and repeated rows, are drawn alike; an empty table stays empty (mixing.mix)."""
    return mixing.mix(docs).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens (packing.pack). Null and empty texts are one token;
    repeated rows, and rows without doc_id, are packed each; an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_filter), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
