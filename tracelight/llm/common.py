"""Helpers that the operators of this subpackage share.

``Store`` keeps intermediate tables in the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver see that folder, so a lost
executor costs a retry of its tasks and never a table.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these: space, tab, LF, VT, FF, CR.
SPACES = r"[ \t\n\x0B\f\r]"
WORD = r"[^ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once a row however often ``body`` names it."""
    return F.transform(F.array(value), body).getItem(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in order, as an array; empty for an empty text."""
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster; a temporary one only on a local master that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="tracelight-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Arrow batches between the JVM and Python hold so many rows and bytes at most, as texts can be long.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless they are smaller already."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """Tables written to the shared folder and read back, which cuts their lineage."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.base, self.paths = spark, f"{shared_dir(spark)}/tracelight/{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame, **options) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}"
        # the shuffle files of this write go with it: what comes later reads the table
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        if not self.paths:  # what is still there goes when the application ends
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = True
        out._tracelight_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for df in tables:
            p = jvm.org.apache.hadoop.fs.Path(df._tracelight_path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Return memory that a Python worker has freed to the system, as the worker lives on for other stages."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def grouped(run: Callable) -> Callable:
    """Marks (key, batches) -> batches for ``applyInArrow``, which reads type hints to stream a group's batches."""
    import pyarrow as pa

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "rows": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def plan_bytes(df: DataFrame, text_col: str) -> int:
    """The planner's estimate of the size of a table in bytes, from file sizes; texts are measured where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else int(df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


#: Entries that a batch should have for each bucket, over 10 bytes of input each: fewer would make rows of little but overhead.
ENTRIES_BYTES = 640


def deal(total: int, bucket_bytes: int) -> tuple[int, float]:
    """How many hash-range buckets an exchange between batches and buckets has, and the factor by which its batches grow.

    There are as many buckets as parts of ``bucket_bytes`` in the input, without a ceiling. But a batch sends a row to each bucket,
    so beyond some tens of GB both sides grow with the square root of the input, to where batch * bucket = 640 * total bytes:
    at 100 TB, batches and buckets of 250 MB of input.
    """
    side = max(bucket_bytes, (ENTRIES_BYTES * total) ** 0.5)
    buckets = 8
    while buckets * side < total:
        buckets *= 2
    return buckets, side / bucket_bytes


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint on a table whose counted rows are within a bound; larger ones join by shuffles.

    Without the hint, the planner would shuffle the other side, with its texts, before it knows how small this one is.
    """
    return F.broadcast(df) if rows <= most else df


def connected_components(store: Store, edges: DataFrame) -> DataFrame:
    """(node, component) for each end of the edges (u, v): the smallest node that it reaches.

    Alternates large-star and small-star steps until no edge changes. Edges stay distributed; a node with
    many edges meets its minimum by a join, which splits when it is skewed, never in one group.
    """
    u, v = F.col("u"), F.col("v")

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def flat(e: DataFrame) -> DataFrame:
        return e.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()

    edges = store.put(flat(edges.select("u", "v")))
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v"))
        # what a large-star leaves isolated keeps its link to the minimum
        grown = flat(large.union(least.where(u != F.col("m")).select("u", F.col("m").alias("v"))))
        small = grown.groupBy("u").agg(F.min("v").alias("m"))
        shrunk = flat(grown.join(small, "u").select(v.alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))))
        new = store.put(shrunk)
        after = state(new)
        store.drop(edges)
        edges = new
        if after == before:
            break
        before = after
    roots = edges.select(v.alias("node"), v.alias("component")).distinct()
    return edges.select(u.alias("node"), v.alias("component")).union(roots)
