"""Operator 10, exact top-k search: multi-resolution segment statistics, then exact scores for the survivors.

A vector is cut into 1, 4 and 16 segments; of each segment only the mean and the deviation are kept. By Cauchy and Schwarz,
a segment's part of the inner product is at most length * (mean * mean + deviation * deviation), which is the lower bound
of the distance, written for products: |q - x|^2 = |q|^2 + |x|^2 - 2 qx. Coarse to fine, candidates whose bound is under
the k-th best score so far are left out; the others are scored exactly.
Blocks of about BLOCK queries meet chunks of at most CHUNK candidates or so in a grid, of which a task holds one block, the k best
of each of its queries, and TILE candidates at a time. Queries reach their tasks by a shuffle, never by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, ordered_id, staged, table, tidy

K, SCALE, LEVELS = 10, 1024, (1, 4, 16)
BLOCK, CHUNK, TILE = 8192, 4_000_000, 256
#: Share of a tile's pairs from which they are taken all together, as a matrix product; numbers gathered at a time for fewer.
DENSE, GATHER = 1 / 16, 1 << 22
FOUND = "qrow long, qid long, vid long, score long"


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of a row's segments, each times the root of its length: products of rows bound inner products."""
    out = []
    for part in np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])):
        piece = x[:, part]
        mean = piece.mean(axis=1)
        spread = np.sqrt(np.maximum(((piece - mean[:, None]) ** 2).mean(axis=1), 0))
        out += [mean * len(part) ** 0.5, spread * len(part) ** 0.5]
    return np.column_stack(out)


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a with rows j of b, a bounded part at a time."""
    step = max(1, GATHER // a.shape[1])
    return np.concatenate([np.einsum("ij,ij->i", a[i[s : s + step]], b[j[s : s + step]]) for s in range(0, len(i), step)] or [np.zeros(0)])


class Queries:
    """A block of queries of one length, with the k best candidates so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, levels: tuple[int, ...]):
        self.rows, self.ids, self.x, self.k = rows, ids, x, k
        self.levels = [(s, statistics(x, s)) for s in levels]
        self.norm, self.most = np.sqrt((x * x).sum(axis=1)), np.abs(x).max(initial=0)
        none = np.zeros(0, np.int64)
        self.best = (none, none, none)  # query, candidate's id, score
        self.floor = np.full(len(ids), -np.inf)

    def meet(self, rows: np.ndarray, vids: np.ndarray, x: np.ndarray) -> None:
        """A tile of candidates: their rows, ids and vectors."""
        norm = np.sqrt((x * x).sum(axis=1))
        slack = 1e-9 * (1 + self.norm[:, None] * norm[None, :])
        live, pairs = self.rows[:, None] != rows[None, :], None
        for segments, stats in self.levels:
            own = statistics(x, segments)
            if pairs is None:
                live &= stats @ own.T + slack >= self.floor[:, None]
                if live.sum() <= DENSE * live.size:
                    pairs = np.nonzero(live)
            else:
                keep = _products(stats, own, *pairs) + slack[pairs] >= self.floor[pairs[0]]
                pairs = pairs[0][keep], pairs[1][keep]
        if self.most * np.abs(x).max(initial=0) * x.shape[1] < 2**53:
            if pairs is None:
                score = self.x @ x.T
                score[~live] = -np.inf
                if score.shape[1] > self.k:  # what k candidates of this tile beat can't be among the best
                    self.floor = np.maximum(self.floor, np.partition(score, -self.k, axis=1)[:, -self.k])
                pairs = np.nonzero(live & (score >= self.floor[:, None]))
                found = score[pairs].astype(np.int64)
            else:
                found = _products(self.x, x, *pairs).astype(np.int64)
        else:  # beyond what doubles hold exactly
            pairs = np.nonzero(live) if pairs is None else pairs
            exact = [sum(int(a) * int(b) for a, b in zip(self.x[i], x[j], strict=True)) for i, j in zip(*pairs, strict=True)]
            found = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64)
        self._add(pairs[0], vids[pairs[1]], found)

    def _add(self, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        keep = s >= self.floor[q]
        if not keep.any():
            return
        q, v, s = (np.concatenate((a, b[keep])) for a, b in zip(self.best, (q, v, s), strict=True))
        by = np.lexsort((v, ~s, q))  # ~s falls as s rises, without overflow
        q, v, s = q[by], v[by], s[by]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        top = place < self.k
        self.best = q[top], v[top], s[top]
        full = place == self.k - 1
        self.floor[q[full]] = np.maximum(self.floor[q[full]], s[full])


def _matrix(rows: pa.Table, scale: int) -> np.ndarray:
    """Vectors of one length, as whole numbers."""
    column = rows.column("x").combine_chunks()
    return np.floor(scale * np.asarray(column.flatten()).astype(np.float64)).reshape(len(column), -1)


def _search(k: int, scale: int, levels: tuple[int, ...]):
    """From a partition in order of cells (dim, block, chunk), queries first: the k best candidates of each query of a cell."""
    cell_of = lambda rows, i: tuple(rows.column(c)[i].as_py() for c in ("dim", "block", "chunk"))

    def found(queries: Queries | None) -> Iterator[pa.RecordBatch]:
        if queries is not None:
            q, v, s = queries.best
            yield pa.RecordBatch.from_arrays([pa.array(queries.rows[q]), pa.array(queries.ids[q]), pa.array(v), pa.array(s)], ["qrow", "qid", "vid", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, held = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "block", "chunk", "candidate")])
            edges = np.concatenate(([0], np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1, [len(code)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if cell_of(part, 0) != cell:
                    yield from found(queries)
                    cell, queries, held = cell_of(part, 0), None, []
                if not code[a, 3]:
                    held.append(part)
                    continue
                if held:
                    mine, held = pa.concat_tables(held), []
                    queries = Queries(mine.column("row").to_numpy(), mine.column("vid").to_numpy(), _matrix(mine, scale), k, levels)
                if queries is not None:
                    for at in range(0, part.num_rows, TILE):
                        some = part.slice(at, TILE)
                        queries.meet(some.column("row").to_numpy(), some.column("vid").to_numpy(), _matrix(some, scale))
        yield from found(queries)

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, levels: tuple[int, ...] = LEVELS, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors (vec_id, embedding) that is_query holds for, the k other
    rows of the largest inner product of floor(scale * component), ties to the smaller vec_id; all, if there are fewer.

    Null and empty vectors, and those with null or non-finite components, take no part. Rows without vec_id are
    candidates, behind all others in ties. Each row is a query and a candidate of its own, also where rows share a vec_id or are equal: only
    the query's own row is no candidate. Vectors of other lengths are no candidates. Sums beyond a long stay at its end.
    Other columns are ignored, whatever their names. Empty table: empty result.
    """
    spark = vectors.sparkSession
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), ordered_id(F.col("vec_id")).alias("vid"), F.col("embedding").alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = staged(rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & fine).withColumn("dim", F.size("x")), "vectors")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.when(F.col("asks"), 1)) / block).alias("blocks"), F.ceil(F.count("*") / chunk).alias("chunks"))
    sizes = sizes.where("blocks > 0").withColumn("chunks", F.greatest("chunks", F.ceil(F.lit(tasks) / F.col("blocks"))))
    dealt = rows.join(sizes, "dim")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)).alias(n[:-1])
    of = lambda n: F.pmod(F.xxhash64("row", F.lit(n)), n).cast("int").alias(n[:-1])
    asked = dealt.where("asks").select("dim", of("blocks"), numbers("chunks"), F.lit(False).alias("candidate"), "row", "vid", "x")
    given = dealt.select("dim", numbers("blocks"), of("chunks"), F.lit(True).alias("candidate"), "row", "vid", "x")
    cells = asked.unionByName(given).repartition(tasks, "dim", "block", "chunk").sortWithinPartitions("dim", "block", "chunk", "candidate")
    found = cells.mapInArrow(tidy(_search(k, scale, levels)), FOUND)
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("qid").alias("query_id"), "rank", F.when(F.col("vid") < NO_ID, F.col("vid")).alias("vec_id"), "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 rows of the largest products for each row of embeddings whose vec_id is divisible by 100; null vectors take no part."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.row <> c.row AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= 10
"""
