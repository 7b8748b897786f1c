"""Append-only logs as partitioned Parquet, and snapshots derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def append_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Appends a batch as a folder of its own; the same batch delivered again replaces it, so nothing counts twice."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_note(spark: SparkSession, text: str, path: str, at: str) -> None:
    """Appends a note (at, text) to a log of JSON lines, such as that of frictions."""
    spark.createDataFrame([(at, text)], "at string, text string").coalesce(1).write.mode("append").json(path)


def write_documents(rows: DataFrame, path: str, name: str, text: str) -> None:
    """One text file for each row, in a folder by its name: hypotheses as documents."""
    rows.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def upsert_snapshot(rows: DataFrame, path: str, keys: list[str], version: int) -> DataFrame:
    """Writes version `version` of a snapshot: that before it with rows in place of those of equal keys; gives it back. Old versions stay readable."""
    spark, before = rows.sparkSession, f"{path}/version={version - 1}"
    if version > 0:
        old = spark.read.parquet(before)
        rows = old.join(rows, keys, "left_anti").unionByName(rows)
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")
    return spark.read.parquet(f"{path}/version={version}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
