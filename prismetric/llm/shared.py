"""What several operators share: the shared work folder, written tables, splitting hot groups, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where every process sees one disk, an unset folder is replaced by a temporary one
    (removed at exit). On a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.prismetric.work.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="prismetric-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.prismetric.work.dir", found)
    return f"{found.rstrip('/')}/prismetric/{spark.sparkContext.applicationId}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: its lineage ends there, and lost
    executors cost nothing that lies before it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Remove every table that this application wrote; results that are still lazy can't be read after that."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixture of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for ``rows`` with at most about ``each`` in one, never fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def whole_text(name: str) -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, root)`` for every node of an edge.

    Contraction: in each round every node points to the least of itself and its neighbours (in an order that
    is hashed anew each round, so that long paths shrink by a constant factor too), edges move to what their
    ends point to, and loops and repeats go. The rounds' pointers are composed backwards at the end. Every
    step is an aggregation or an equality join; the driver sees only counts. ``root`` is some node of the
    component, the same for all its nodes.
    """
    pointers = []
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not e.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(pointers)), c).alias("h"), c.alias("n"))
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
        p = written(low.select(F.col("a").alias("node"), F.least(rank(F.col("a")), F.col("m"))["n"].alias("to")), "pointers")
        pointers.append(p)
        ends = e.join(p.select(F.col("node").alias("a"), F.col("to").alias("pa")), "a").join(p.select(F.col("node").alias("b"), F.col("to").alias("pb")), "b")
        e = written(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not pointers:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = pointers.pop().withColumnRenamed("to", "root")
    while pointers:
        later = labels.select(F.col("node").alias("to"), F.col("root").alias("end"))
        labels = pointers.pop().join(later, "to", "left").select("node", F.coalesce("end", "to").alias("root"))
    return written(labels, "labels")


def running(df: DataFrame, group: list[str], chunk: str, order: list[str], value: str, into: str) -> DataFrame:
    """``df`` with ``into``: the sum of ``value`` over the rows before it in its group, by (chunk, order).

    Two levels: sums within (group, chunk), where a chunk is small, then an offset for each chunk, so that a
    group of any size is shared by many tasks. Chunks must not be null.
    """
    inner = Window.partitionBy(*group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, chunk).agg(F.sum(value).alias("__sum"))
    names = {c: f"__{c}" for c in [*group, chunk]}
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(outer), F.lit(0))).drop("__sum").withColumnsRenamed(names)
    same = [df[c].eqNullSafe(offsets[n]) for c, n in names.items()]
    out = df.withColumn("__within", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(offsets, same)
    return out.withColumn(into, F.col("__before") + F.col("__within")).drop("__before", "__within", *names.values())
