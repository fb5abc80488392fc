"""What the operators share: stage tables, document keys and connected components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents without an id sort behind all others.
NO_ID = (1 << 63) - 1
#: Rows of a batch that goes to a Python worker while a stage table is written, so that texts of some KB stay within its memory.
BATCH, _BATCH = 2_500, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files of a query go as soon as its stage table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of one key from which it is hot, unless more than 4096 keys would be.
HOT = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Without one, a new folder of this machine if it is the only one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="refweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_lock, _writers, _before = threading.Lock(), [], {}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """The session's settings while stage tables are written; the last of concurrent writers restores them."""
    with _lock:
        if not _writers:
            _before.update({k: spark.conf.get(k) for k in (_BATCH, _CLEANUP)})
            most = int(_before[_BATCH])
            spark.conf.set(_BATCH, str(min(most, BATCH) if most > 0 else BATCH))
            spark.conf.set(_CLEANUP, "true")
        _writers.append(1)
    try:
        yield
    finally:
        with _lock:
            _writers.pop()
            if not _writers:
                for k, v in _before.items():
                    spark.conf.set(k, v)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be over
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _writing(spark):
        df.write.parquet(path)
    give_back()
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for df in tables:
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            _drop(df.sparkSession, f)


def ordered_id(doc_id: Column) -> Column:
    """doc_id as a long that is never null: documents without an id come last."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def with_key(docs: DataFrame) -> DataFrame:
    """did, dkey, text, row: dkey tells rows that share a doc_id but not their text apart; rows equal in both are one document.
    row is a struct of the other columns, whatever their names."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(ordered_id(F.col("doc_id")).alias("did"), F.xxhash64(F.col("text")).alias("dkey"), F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a missing id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def bounded_sample(rows: DataFrame, most: int, most_bytes: int) -> dict[str, list]:
    """Columns of the rows (h, text, ...), whose h differ, of the least h, in its order: at most `most`, and most_bytes of text. Texts
    of more than a 64th of that are left out, so that no single one takes the place of all others."""
    rows = rows.where(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes // 64)
    sizes = rows.select("h", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).orderBy("h").limit(most).toArrow()
    h, total = sizes["h"].to_numpy(), np.cumsum(sizes["size"].to_numpy(), dtype=np.int64)
    fits = int(np.searchsorted(total, most_bytes, "right"))
    got = (rows.where(F.col("h") <= int(h[fits - 1])) if fits else rows.limit(0)).toArrow()
    order = np.argsort(got["h"].to_numpy(), kind="stable").tolist() if got.num_rows else []
    columns = {name: got[name].to_pylist() for name in got.column_names}
    del got
    give_back()
    return {name: [values[i] for i in order] for name, values in columns.items()}


def give_back() -> None:
    """Returns this process's memory of work that is over to the system, where the C library can; it would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """kernel, after which a worker gives its memory back: workers outlive their tasks and wait beside the JVM for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets into them, without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offs[0] : offs[-1]], offs - offs[0]


def groups_of(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array, and its length."""
    if len(keys) == 0:
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


class Forest:
    """Union-find over small integers; the smaller root stays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each batch's links, each node tied to the smallest of its tree."""
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            forest.join(x, y)
        roots = np.array([forest.root(i) for i in range(len(nodes))], dtype=np.int64)
        keep = roots != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[roots[keep]])], ["u", "v"])


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, full: Callable[[list[pa.RecordBatch]], bool]) -> Iterator[pa.Table]:
    """A partition in order of key as tables that hold each key whole, each as small as full allows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if not full(held):
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        if cut:
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by keys, one after another."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        code = np.column_stack([rows.column(k).to_numpy() for k in keys])
        edges = np.concatenate(([0], np.flatnonzero((code[1:] != code[:-1]).any(axis=1)) + 1, [len(code)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = rows.slice(a, b - a)
            if held and any(held[-1].column(k)[0] != part.column(k)[0] for k in keys):
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def with_facts(rows: DataFrame, facts: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with facts (key, n, ...): one row a key, n of which are in rows, all of which are about total.

    Keys of more than HOT rows, or of one 4096th of all if that is more, are at most 4096: these facts are broadcast, and only
    rows of other keys meet by key."""
    limit = max(HOT, total >> 12)
    if total <= limit:
        return rows.join(facts.drop("n"), key, how)
    hot = facts.where(F.col("n") > limit).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(F.col("n") <= limit).drop("n"), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable from each node that links (long columns u, v) name.

    Batches are contracted to forests where they lie; then rounds of large-star and small-star (Kiveris et al. 2014) run
    until no link moves. Each round aggregates one minimum a node before it joins, so no task holds a node's neighbours.
    """
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    now = staged(links.where("u <> v").mapInArrow(tidy(_contract), "u long, v long").distinct(), "links")
    total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while total[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = with_facts(both.where("v > u"), least, "u", 2 * total[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_facts(down, low, "u", 2 * total[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        after = staged(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
        was, total = total, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(now)
        now = after
        if tuple(was) == tuple(total):
            break
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def component_ids(members: DataFrame, links: DataFrame) -> DataFrame:
    """node, root, component_id: a node's component, and the smallest did that links (u, v: nodes) reach from it, for each node of
    members (did, node) that has links."""
    roots = components(links)
    least = members.groupBy("node").agg(F.min("did").alias("did"))  # before the join: a node may have any number of members
    of = staged(least.join(roots, "node"), "roots")
    firsts = of.groupBy("root").agg(F.min("did").alias("component_id"), F.count("*").alias("n"))
    return with_facts(of.select("node", "root"), firsts, "root", of.count()).select("node", "root", "component_id")
