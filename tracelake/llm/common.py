"""What the training-data operators share: table access, materialised steps, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``. Only a session with one local process may leave it unset (tests): it gets a temporary one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tracelake-")
        sc.setCheckpointDir(at)
    return at


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialise(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    ``spent`` deletes the files of a step that nothing reads any more; what is left goes when the application ends.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark).rstrip('/')}/tracelake/{spark.sparkContext.applicationId}"
    path = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    fs, at = _file_system(spark, top)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def spent(*steps: DataFrame) -> None:
    """Delete the files of materialised steps. The caller knows that no frame still to be computed reads them."""
    for df in steps:
        fs, at = _file_system(df.sparkSession, df._written)
        fs.delete(at, True)


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Hand texts to Python in batches of about this many bytes, however long single rows are.

    This sets ``spark.sql.execution.arrow.maxBytesPerBatch`` for the session, as Spark reads it when a frame is computed,
    after the operator has returned. Other queries of the session get the same small batches, and the same results.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def free(docs: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores added as it takes to clash with no column of docs."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def row_hash(docs: DataFrame) -> Column:
    """A 128-bit hash over all columns of a row, as a struct of two longs; a null differs from any value."""
    plain = lambda c, t: F.to_json(F.struct(c)) if "map<" in t or "variant" in t else c
    own = [x for n, t in docs.dtypes for x in (docs[f"`{n}`"].isNull(), plain(docs[f"`{n}`"], t))]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit(1), *own).alias("b"))


def trim() -> None:
    """Give memory that a task no longer uses back to the system; the worker stays for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64, in place where it can."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Cut a batch so that the named text column of each piece holds about ``limit`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


BROADCAST_ROWS = 500_000


def small(df: DataFrame, weight: Column | None = None, rows: int | None = None) -> DataFrame:
    """df of narrow rows (keys and numbers), to be broadcast if it was counted to have at most so many, else as it is.

    weight: how many narrow values a row holds, where it is more than one. df should be a written table: counting
    reads it.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    n = df.limit(rows + 1).count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if n <= rows else df


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """Connected components of an undirected edge list: rows (node, component), component the smallest node.

    Alternates large-star and small-star steps until nothing changes; each step is a min-aggregate (combined before
    the shuffle, so a hub is no hot spot) and an equi-join back, which adaptive execution splits where a hub is hot.
    Nodes without edges do not appear. Null ends are dropped.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            return out.where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        out = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    seen = None
    for _ in range(rounds):
        half = materialise(star(e, True), "star")
        whole = materialise(star(half, False), "star")
        spent(e, half)
        e = whole
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod("u", F.lit(1 << 20)) + F.pmod("v", F.lit(1 << 20)))).first()
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    top = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return top.unionByName(top.select(F.col("component").alias("node"), "component").distinct())


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are over (it does so when their plans are collected)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
