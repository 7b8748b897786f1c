"""Cutting lineage in the shared folder, and numbering rows without gathering them in one task."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Counted rows of a table that is broadcast; one with more is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Seconds that checkpoints leave at least between two releases of the driver's native memory.
RELEASE_S = 4


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a folder of our own only where that is unset and all run on this machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def release_native(spark: SparkSession) -> None:
    """Gives the native memory that the driver's JVM holds but doesn't use back to the system.

    Compiling plans and their code takes and frees native memory in small pieces, of which the C library keeps hundreds of MB
    in a long session, whatever the data. Where Java or the system offers no such release (before 17.0.9, no glibc) nothing happens.
    """
    context, java = spark.sparkContext, spark._jvm.java
    if getattr(context, "_factloom_keeps_native", False):
        return
    try:
        # by reflection on the public interface, as the server's own class is closed to callers
        server = java.lang.Class.forName("javax.management.MBeanServer")
        args = context._gateway.new_array(java.lang.Object, 4)
        args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        types = context._gateway.new_array(java.lang.Class, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[k] = java.lang.Class.forName(name)
        server.getMethod("invoke", types).invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        context._factloom_keeps_native = True


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder. Now and then the driver's unused native memory goes back to the system."""
    shared_dir(df.sparkSession)
    done, context = df.checkpoint(eager=True), df.sparkSession.sparkContext
    if time.monotonic() - getattr(context, "_factloom_released", -RELEASE_S) >= RELEASE_S:
        release_native(df.sparkSession)
        context._factloom_released = time.monotonic()
    return done


def stash(df: DataFrame) -> DataFrame:
    """df as compressed Parquet in the shared folder: a checkpoint for wide rows, of which readers then take only their columns.

    Shuffles that made it are given back: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    cleans = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(cleans, None)
    spark.conf.set(cleans, "true")
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    finally:
        spark.conf.unset(cleans) if was is None else spark.conf.set(cleans, was)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has few rows; rows is its count."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def placed(df: DataFrame, keys: list[Column | str], name: str) -> DataFrame:
    """df with `name`: the place of each row, from 1, in the order of keys, which must be total.

    Rows are sorted in ranges; a range's rows are numbered by its own task, from the count of the ranges before it.
    """
    rows = checkpoint(df.orderBy(*keys).withColumn("_range", F.spark_partition_id()))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per partition
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    out = rows.join(F.broadcast(before), "_range").withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) + F.col("_before"))
    return out.drop("_range", "_before")
