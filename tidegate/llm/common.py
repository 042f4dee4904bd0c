"""What the operators share: reading tables, tables cut out of their lineage, links to components.

Conventions that hold for every operator here:

* a null text counts as the empty text; a null id is kept and comes back as null;
* only the named columns are used, so columns with clashing names never reach a join;
* Python code runs over Arrow batches, and what it keeps is bounded by a documented parameter.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import ship

#: Documents and bytes in an Arrow batch. Together with ``chunks`` they bound what Python holds at once.
ROWS_PER_BATCH = 1000
BYTES_PER_BATCH = 16 << 20
#: Bytes of text that a judge or a writer of documents sees at once, but for a single longer one.
JUDGED_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS_PER_BATCH rows and BYTES_PER_BATCH bytes (one row at least), unless
    the session has settings of its own. The settings stay with the session: plans read them when they run."""
    for key, plain, ours in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", ROWS_PER_BATCH),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), BYTES_PER_BATCH),
    ):
        if spark.conf.get(key, plain).removesuffix("b") == plain:
            spark.conf.set(key, str(ours))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``body`` (the text as UTF-8 bytes, empty for null)."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"),
    )


def fold(id_col: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo ``modulus``: which fold a document is in."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- tables in the shared folder


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent and the master is this process (tests), a temporary folder takes its
    place and the setting is made for the session, so that it is read in one place only. A cluster
    without the setting is an error: executors wouldn't see one another's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidegate-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder once and read back: a short lineage that
    survives the loss of any executor."""
    return written_at(df, shared_dir(df.sparkSession, name))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared place that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


# ---------------------------------------------------------------- rows by their ids

#: Bytes up to which a table of ids may be broadcast.
BROADCAST_BYTES = 2 << 20
#: Cells of the bitmap that stands for a larger one: 2 MB for the driver, whatever the table's size.
ID_CELLS = 1 << 24


def is_small(df: DataFrame, each: F.Column | None = None) -> bool:
    """Whether the table, counted as 32 bytes a column or as ``each`` says, is within BROADCAST_BYTES."""
    each = F.lit(32 * len(df.columns)) if each is None else each
    return df.agg(F.coalesce(F.sum(each), F.lit(0))).first()[0] <= BROADCAST_BYTES


def parted(docs: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose id is in ``ids`` (one column ``id_col``, distinct) and those whose id is
    not or is null, with the columns of ``docs``. A small ``ids`` is broadcast. Of a larger one a bitmap of hashes is:
    rows outside it stay where they are, and only the others are shuffled to be held against the ids."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if is_small(ids):
        return docs.join(F.broadcast(ids), id_col, "left_semi").select(*columns), docs.join(F.broadcast(ids), id_col, "left_anti").select(*columns)
    bucket, bits, held = (f"{name}_{uuid.uuid4().hex}" for name in ("bucket", "bits", "held"))  # no columns of the caller's
    cell = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(ID_CELLS))
    table = written(ids.groupBy(F.bitmap_bucket_number(cell).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias(bits)), "bitmap")
    at = F.bitmap_bit_position(cell).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = docs.withColumn(bucket, F.bitmap_bucket_number(cell)).join(F.broadcast(table), bucket, "left")
    marked = marked.withColumn(held, F.col(id_col).isNotNull() & F.coalesce(F.call_function("getbit", byte, at.bitwiseAND(7)) == 1, F.lit(False)))
    maybe, never = (marked.where(rows).select(*columns) for rows in (F.col(held), ~F.col(held)))
    return maybe.join(ids, id_col, "left_semi").select(*columns), never.unionAll(maybe.join(ids, id_col, "left_anti").select(*columns))


# ---------------------------------------------------------------- Arrow batches


def chunks(batches: Iterable[pa.RecordBatch], most_bytes: int, column: str = "body") -> Iterator[pa.Table]:
    """The rows in tables of about ``most_bytes`` bytes of ``column``, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for k, n in enumerate(lens.tolist()):
            if size and size + n > most_bytes:
                if k > start:
                    held.append(batch.slice(start, k - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, k
                pa.default_memory_pool().release_unused()
            size += n
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def strings(part: pa.Table | pa.RecordBatch, column: str = "body") -> pa.StringArray:
    """The texts as Arrow strings; bytes that are no UTF-8 are replaced."""
    got = part.column(column)
    got = got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
    got = pa.concat_arrays(got.chunks) if isinstance(got, pa.ChunkedArray) else got
    try:
        return got.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in got.to_pylist()], pa.string())


def bodies(part: pa.Table | pa.RecordBatch, column: str = "body") -> list[bytes]:
    return part.column(column).to_pylist()


def ids(part: pa.Table | pa.RecordBatch, column: str = "id") -> pa.Array:
    got = part.column(column)
    return got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got


_claims: dict[str, Callable[[], object]] = {}


def trimmed(spark: SparkSession | None = None) -> None:
    """Gives memory that is held but not used back to the system, where the C library can: that of
    this process, and with ``spark`` (on the driver) that of the driver's JVM too, whose heap else grows with the
    garbage of plans that have run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    if spark is not None:
        spark._jvm.System.gc()


def claim(owner: str, clear: Callable[[], object] = lambda: None) -> None:
    """Says that a worker process now works for ``owner``, whose caches ``clear`` empties. Workers serve one
    operator after another, and the caches of those before are emptied."""
    others = [k for k in _claims if k != owner]
    for k in others:
        _claims.pop(k)()
    if others:
        trimmed()
    _claims[owner] = clear


class Interner(dict):
    """Numbers strings in the order in which they are first seen; ``items_`` has them by number."""

    def __init__(self):
        self.items_: list = []

    def __missing__(self, key):
        n = self[key] = len(self.items_)
        self.items_.append(key)
        return n


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lens[0] of them), then the same for 1, 2 ..."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lens)


# ---------------------------------------------------------------- components


#: A node with more links than this, or than one in 100,000 of all, is a hub: there are few of them.
HUB_LINKS, MOST_HUBS = 200, 100_000
#: Links (16 bytes each) up to which one task finishes the search: steps over all partitions would only wait for tasks to start.
FEW_LINKS = 1 << 17


def _with_least(rows: DataFrame, low: DataFrame, n_links: int, most: int) -> DataFrame:
    """``u``, ``v`` and ``m``, the value that ``low`` (``u``, ``m``, ``n``: rows) has for u. Hubs are
    at most MOST_HUBS rows (2 * n_links rows are there, and each has more than its share of them)
    and meet their rows by broadcast; other nodes have few rows and meet theirs by a shuffle.
    ``most``: of the links of any node; where it shows that there is no hub the plan is the join alone."""
    hub = max(HUB_LINKS, 2 * n_links // MOST_HUBS)
    if most <= hub:
        return rows.join(low.select("u", "m"), "u")
    hubs, rest = F.broadcast(low.where(F.col("n") > hub).select("u", "m")), low.where(F.col("n") <= hub).select("u", "m")
    return rows.join(hubs, "u").unionAll(rows.join(hubs, "u", "left_anti").join(rest, "u"))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and least reachable nodes of a table of links that fits in memory."""
    rows = [np.stack([batch.column(k).to_numpy() for k in range(2)]) for batch in batches]
    nodes, at = np.unique(np.concatenate(rows, axis=1) if rows else np.zeros((2, 0), np.int64), return_inverse=True)
    root = forest(len(nodes), *at.reshape(2, -1))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node: rows ``node``, ``root``.

    Alternating large-star and small-star steps over the link table; every step is a grouped
    minimum (partial sums first) joined back, and is written out. A hub's rows stay where they are
    and are told its minimum, so neither a long chain nor a hub gathers in one task. The number of
    steps grows with the logarithm of the largest component; the table of the step before is
    removed. As soon as at most FEW_LINKS links are left, in all, one task solves them in memory.
    Nodes without links don't appear.
    """
    spark = edges.sparkSession
    path = shared_dir(spark, "links")
    now = written_at(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), path)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while seen[0] > FEW_LINKS:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        most = low.agg(F.max("n")).first()[0]
        large = _with_least(both.where("v > u"), low, seen[0], most).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            _with_least(large, low2, seen[0], most)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        before, path = path, shared_dir(spark, "links")
        now = written_at(small, path)
        here = mark(now)
        removed(spark, before)
        trimmed(spark)
        if here == seen:
            break
        seen = here
    else:
        roots = written(now.repartition(1).mapInArrow(_roots, "node long, root long"), "roots")
        removed(spark, path)
        trimmed(spark)
        return roots
    nodes = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of ``n`` nodes' components, for links a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(work, schema)


# ---------------------------------------------------------------- rows that pass or change


def kept(docs: DataFrame, judge: Callable[[], Callable[[pa.StringArray], np.ndarray]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that a judge keeps by their texts. The judge
    is made once for each task and sees whole texts, JUDGED_BYTES at a time; null counts as empty."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("judge")
        keep = judge()
        for part in chunks(batches, JUDGED_BYTES, text_col):
            texts = pc.fill_null(strings(part, text_col), "")
            yield from part.filter(pa.array(keep(texts), pa.bool_())).to_batches()

    return docs.mapInArrow(work, docs.schema)


def rewritten(docs: DataFrame, writer: Callable[[], Callable[[list[bytes]], list[bytes]]], text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with their texts as a writer returns them; null texts stay null, and a
    column of text lengths follows."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("writer")
        write = writer()
        for part in chunks(batches, JUDGED_BYTES, text_col):
            names = part.schema.names
            at = names.index(text_col)
            old = part.column(at).cast(pa.binary()).to_pylist()
            new = write([b or b"" for b in old])
            texts = pa.array([None if a is None else b.decode("utf-8", "replace") for a, b in zip(old, new, strict=True)], pa.string())
            part = part.set_column(at, part.schema.field(at), texts.cast(part.schema.field(at).type))
            if length_col in names:
                k = names.index(length_col)
                part = part.set_column(k, part.schema.field(k), pc.utf8_length(texts).cast(part.schema.field(k).type))
            yield from part.to_batches()

    return docs.mapInArrow(work, docs.schema)
