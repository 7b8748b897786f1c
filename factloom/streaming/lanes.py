"""Structured Streaming lanes: fragments without repeats, items by day, and appends to the fact log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import GRADE_RANK, RuleSet
from ..operators.classify import stance
from ..operators.sentiment import terms_in
from ..sources.sinks import append_batch


def sentiment_items(rules: RuleSet, fragments: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream of fragments (text, canonical_id, ts) with stance and item_id; repeats within the watermark go.

    Rows without event time belong to the batch lane; they are filtered out here.
    """
    own = fragments.filter("ts is not null").withColumn("stance", stance(rules, F.col("text")))
    own = own.withColumn("item_id", F.substring(F.sha1(F.concat_ws("|", "canonical_id", F.col("ts").cast("string"), "text").cast("binary")), 1, 16))
    return own.withWatermark("ts", late).dropDuplicatesWithinWatermark(["item_id"])


def density_by_day(items: DataFrame, late: str = "7 days") -> DataFrame:
    """Items by entity and day, emitted when the watermark has passed the day."""
    return items.withWatermark("ts", late).groupBy("canonical_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("canonical_id", F.col("w.start").alias("day"), "n")


def watch_stream(rules: RuleSet, fragments: DataFrame, terms: list[str], late: str = "7 days") -> DataFrame:
    """Items of a stream of fragments (text, ts): a row for each of a few watched terms that the text contains, repeats left out."""
    hits = fragments.withColumn("canonical_id", F.explode(terms_in(F.col("text"), terms)))
    return sentiment_items(rules, hits, late)


def undated(fragments: DataFrame) -> DataFrame:
    """Fragments (text, timestamp) without a time: legal, but no stream can order them; the batch lane takes them."""
    return fragments.filter(F.coalesce(F.col("timestamp"), F.lit("")) == "")


def log_appends(occurrences: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends each batch to the occurrence log under its number; a batch that is delivered again replaces itself."""
    return occurrences.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: append_batch(batch, path, number))


def index_builds(facts: DataFrame, path: str, checkpoint: str, encode: Callable[[DataFrame], DataFrame], id_col: str = "fact_id") -> DataStreamWriter:
    """A writer that encodes each batch's facts which the index lacks; encode gives rows (id, embedding)."""

    def build(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([id_col])
        if _exists(spark, path):
            known = spark.read.option("basePath", path).parquet(path).filter(F.col("batch") != number).select(id_col)
            new = new.join(known, id_col, "left_anti")
        append_batch(encode(new), path, number)

    return facts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(build)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


STATE = "sources array<string>, level string, valid_at string, status string, invalid_at string, occurrences long"
FACT = f"canonical_id string, predicate string, object string, {STATE}"


def fact_states(occurrences: DataFrame) -> DataFrame:
    """A stream of fact occurrences as a stream of each touched entity's facts after them, kept as keyed state.

    Occurrences: canonical_id, predicate, object, strength, level, source, valid_at, seq, and object decides what is about the
    same. A batch's occurrences of an entity are taken in order of seq; a superseded fact that comes again is active again.
    """
    ranks = {level: rank for level, rank in GRADE_RANK.items()}

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        facts = {(f["predicate"], f["object"]): f for f in json.loads(state.get[0])} if state.exists else {}
        for row in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            at, strength = row.valid_at or "", None if pd.isna(row.strength) else int(row.strength)
            f = facts.setdefault((row.predicate, row.object), {"predicate": row.predicate, "object": row.object, "strength": strength, "sources": [], "level": row.level, "valid_at": "", "status": "active", "invalid_at": None, "occurrences": 0})
            f["occurrences"] += 1
            if row.source and row.source not in f["sources"]:
                f["sources"] = sorted([*f["sources"], row.source])
            if ranks.get(row.level, -1) > ranks.get(f["level"], -1):
                f["level"] = row.level
            if at:
                f["valid_at"] = min(f["valid_at"], at) if f["valid_at"] else at
            if f["status"] == "superseded":
                f["status"], f["invalid_at"] = "active", None
            for other in facts.values() if strength else ():
                if other is not f and other["object"] == row.object and other["status"] == "active" and other["strength"] and strength > other["strength"] and at >= other["valid_at"]:
                    other["status"], other["invalid_at"] = "superseded", at
        state.update((json.dumps(list(facts.values())),))
        yield pd.DataFrame([{"canonical_id": key[0], **{k: v for k, v in f.items() if k != "strength"}} for f in facts.values()])

    return occurrences.groupBy("canonical_id").applyInPandasWithState(step, FACT, "facts string", "update", GroupStateTimeout.NoTimeout)
