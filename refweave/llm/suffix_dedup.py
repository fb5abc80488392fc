"""Operator 5, suffix-array dedup: byte strings that occur more than once, found by two-stage suffix sorting.

Each shard sorts only the suffixes that are smaller than their successors, induces the others by bucket scans, and reads
repeats off the common prefixes of neighbours (suffix_array.py). spans.py deals the texts out so that equal strings always
meet in one shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tidy
from .spans import covered, repeats
from .suffix_array import byte_repeats

#: Bytes of a window, and of the minimizer by which windows meet.
WINDOW, GRAM = 200, 64
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", SPAN)])


def _cut(window: int, as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, gone, removed = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                body = (text.as_py() or "").encode()
                runs = covered([(x["start"], x["windows"]) for x in spans or ()], window)
                left = b"".join(body[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(body)], strict=True)) if runs else body
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                size.append(len(body))
                gone.append(len(body) - len(left))
                removed.append([{"start": a, "end": b} for a, b in runs])
            arrays = [batch.column("row"), batch.column("text"), *(pa.array(x, type=t) for x, t in ((kept, pa.string() if as_text else pa.binary()), (size, pa.int64()), (gone, pa.int64()), (removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "text", "kept", "n_bytes", "n_removed", "removed"])

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int | None = None, keep_first: bool = False, as_text: bool = False) -> DataFrame:
    """Removes each byte of the UTF-8 text that a string of `window` bytes covers which also starts anywhere else, in the
    same document or another; with keep_first, which also starts earlier (smaller doc_id, or further left).

    Returns row (the columns of docs but text), text, kept (binary, since cuts may part a character; or with
    as_text a string, without the characters that cuts part), n_bytes, n_removed,
    removed (array of start and end byte). Columns of docs may have any names; they lie in the struct row.
    Null text: empty. Null doc_id: behind all others. Rows equal in doc_id and text are one document: each comes out, and
    they don't repeat each other. Rows of one doc_id but other texts are documents of their own, in the order of a hash of
    the text. Empty table: empty result.
    """
    gram = gram or min(GRAM, window)
    found = repeats(docs, byte_repeats, window, gram, False, keep_first)
    rows = found.select("row", "text", "spans")
    kept = T.StructField("kept", T.StringType() if as_text else T.BinaryType())
    return rows.mapInArrow(tidy(_cut(window, as_text)), T.StructType([rows.schema["row"], rows.schema["text"], kept, *ADDED]))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without strings of 200 bytes that also start elsewhere; null texts have no bytes."""
    out = remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH bodies AS (
  SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), starts AS (
  SELECT doc_id, unnest(range(0, n - 199)) AS s, x FROM bodies WHERE n >= 200
), windows AS (
  SELECT doc_id, s, hash(array_slice(x, s + 1, s + 200)) AS h FROM starts
), often AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), hits AS (
  SELECT w.doc_id, w.s FROM windows w SEMI JOIN often o ON w.h = o.h
), marked AS (
  SELECT doc_id, s, s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 AS gap FROM hits
), numbered AS (
  SELECT doc_id, s, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM marked
), spans AS (
  SELECT doc_id, span, min(s) AS a, max(s) + 200 AS b FROM numbered GROUP BY ALL
), pieces AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM spans
), cut AS (
  SELECT p.doc_id, string_agg(hex(array_slice(d.x, p.was + 1, p.a)), '' ORDER BY p.a) AS front, max(p.b) AS last, sum(p.b - p.a) AS gone, count(*) AS n
  FROM pieces p JOIN bodies d ON p.doc_id = d.doc_id GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(c.gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN c.doc_id IS NULL THEN hex(d.x) ELSE c.front || hex(array_slice(d.x, c.last + 1, d.n)) END)) AS kept_sha256
FROM bodies d LEFT JOIN cut c ON d.doc_id = c.doc_id
"""
