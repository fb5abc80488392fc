"""Operator 2, substring dedup: repeated word sequences, found with a compressed FM-index per shard.

Texts are streamed against the FM-index of their shard by backward search over its wavelet matrix; the matching statistics
say how far back from each word the text occurs elsewhere, and windows that reach the threshold are reported (fm_index.py).
spans.py deals the texts out so that equal windows always meet in one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy
from .fm_index import word_repeats
from .spans import covered, repeats

#: Words of a window, and of the minimizer by which windows meet.
WINDOW, GRAM = 20, 8
ADDED = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, words, gone, removed = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                have = (text.as_py() or "").encode().split()
                runs = covered([(x["start"], x["windows"]) for x in spans or ()], window)
                left, at = [], 0
                for a, b in runs:
                    left += have[at:a]
                    at = b
                left += have[at:]
                kept.append(b" ".join(left).decode())
                words.append(len(have))
                gone.append(len(have) - len(left))
                removed.append([{"start": a, "end": b} for a, b in runs])
            arrays = [batch.column("row"), batch.column("text"), *(pa.array(x, type=t) for x, t in ((kept, pa.string()), (words, pa.int64()), (gone, pa.int64()), (removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "text", "kept", "n_words", "n_removed", "removed"])

    return run


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """Removes each word that a window of `window` words covers which also starts earlier: in a document of smaller doc_id,
    or further left in the same one. Words are runs of bytes other than blank and tab to carriage return.

    Returns row (the columns of docs but text), text, kept (the remaining words joined by one blank), n_words, n_removed,
    removed (array of start and end word). Columns of docs may have any names; they lie in the struct row.
    Null text: no words, kept is empty. Null doc_id: behind all others. Rows equal in doc_id and text are one document:
    each comes out, and they don't repeat each other. Rows of one doc_id but other texts are documents of their own, in
    the order of a hash of the text. Empty table: empty result.
    """
    gram = gram or min(GRAM, window)
    found = repeats(docs, word_repeats, window, gram, True, True)
    rows = found.select("row", "text", "spans")
    return rows.mapInArrow(tidy(_cut(window)), T.StructType([rows.schema["row"], rows.schema["text"], *ADDED]))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without windows of 20 words that also start earlier; null texts have no words."""
    out = remove_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH split AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM split WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM starts
), late AS (
  SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM late
), places AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS t, count(*) AS n
  FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM split d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
