"""Helpers the operators share: tables, staging, row keys, exact positions, components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gaugeworks.session import shared_dir

ROW_BITS = 33
"""Bits below the partition number in ``monotonically_increasing_id``."""
KEY = ["k1", "k2"]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_BYTES = "4m"
"""Size of an Arrow batch, unless the session sets it: Spark's 64 MB are held several times over by JVM and Python in each task."""
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_work: ContextVar[str | None] = ContextVar("work", default=None)


def importable(fn: Callable) -> Callable:
    """Lets tasks import this package from where the driver has it.

    On a cluster the package is installed or sent along (``--py-files``); this serves a
    driver that found it on ``sys.path`` only. The session's Arrow batches are
    bounded for these tasks.
    """
    @wraps(fn)
    def run(spark: SparkSession, *args):
        root = str(Path(__file__).resolve().parents[2])
        known = spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)
        if spark.conf.get(_BATCH_CONF, None) is None:
            spark.conf.set(_BATCH_CONF, BATCH_BYTES)
        return fn(spark, *args)
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one, or below that of the ``finished`` result in the making; nothing is there yet."""
    return f"{_work.get() or shared_dir(spark).rstrip('/') + '/llm'}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: cuts lineage and fixes what a recomputation could change.

    The shuffle files of the write go when it ends, as nothing reads them again; else they
    stay until the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_CONF)
        else:
            spark.conf.set(_CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The staged result of ``build``; the tables that were staged on the way to it are deleted.

    Nothing reads them any more once the result is stored, so a lost executor costs a
    reread of the result only.
    """
    work = new_folder(spark, f"{name}-work")
    before = _work.set(work)
    try:
        result = build()
    finally:
        _work.reset(before)
    result = stage(result, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(work)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return result


def row_key(*columns: str | Column) -> list[Column]:
    """128 bits (two longs, KEY) that stand for the values of a row.

    They depend on the values alone, so every scan gives the same ones. Rows equal
    in all the columns share them.
    """
    return [F.xxhash64(F.lit(i), *columns).alias(name) for i, name in enumerate(KEY)]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def positions(df: DataFrame, by: list[str], name: str, as_column: str = "position") -> DataFrame:
    """Adds the place (from 0, gapless) of each row in the order of ``by``.

    Rows are dealt out by range and sorted there, so no task holds more than its
    range; the ranges' offsets come from a table with one row per range. ``df`` must
    give the same rows each time it is read (staged), since ranges are sampled first.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    placed = stage(df.repartitionByRange(*by).sortWithinPartitions(*by)
                   .select("*", F.spark_partition_id().alias("_part"), within.alias("_within")), name)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (placed.join(before, "_part")
            .withColumn(as_column, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of the links (``a``, ``b``).

    Each round hooks every root to the smallest root linked to it, shortens the chains
    to their ends and replaces links by links between roots; links between more than
    one root at least halve the roots they join, so rounds grow with the logarithm of
    the longest path. Groups are only ever reduced by ``min``; nothing is collected.
    """
    spark = edges.sparkSession
    node_type = edges.schema["a"].dataType
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), f"{name}-links")
    labels = stage(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
                   .withColumn("root", F.col("node")), f"{name}-roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
                       .withColumn("to", F.least("node", "to")), f"{name}-parents")
        while True:  # pointer jumping
            up = parent.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = stage(parent.join(up, "to").select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")),
                           f"{name}-parents")
            parent = jumped.select("node", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = stage(labels.join(parent.select(F.col("node").alias("root"), "to"), "root", "left")
                       .select("node", F.coalesce("to", "root").alias("root")), f"{name}-roots")
        left = parent.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = stage(edges.join(left, "a").join(right, "b").where("ra <> rb")
                      .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), f"{name}-links")
    return spark.createDataFrame([], T.StructType([T.StructField("node", node_type), T.StructField("root", node_type)])) \
        if labels.isEmpty() else labels
