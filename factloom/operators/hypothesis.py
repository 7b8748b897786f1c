"""Hypotheses with evidence for and against, and the counters of an ingest run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import grade_rank


def confidence(hypotheses: DataFrame, evidence: DataFrame) -> DataFrame:
    """hypotheses (hyp_id) with n_evidence and confidence: the weight for by the weight of all, grade rank + 1 each; 0.5 without any."""
    weight = grade_rank(F.col("grade"), 1) + 1
    sums = evidence.groupBy("hyp_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("side") == "for", weight).otherwise(0)).alias("f"), F.sum(weight).alias("w"))
    out = hypotheses.join(sums, "hyp_id", "left")
    return out.withColumn("n_evidence", F.coalesce("n", F.lit(0))).withColumn("confidence", F.when(F.col("w") > 0, F.col("f") / F.col("w")).otherwise(F.lit(0.5))).drop("n", "f", "w")


def status(hypotheses: DataFrame, resolutions: DataFrame) -> DataFrame:
    """hypotheses with status: the latest resolution (hyp_id, outcome, seq), open without one."""
    last = resolutions.groupBy("hyp_id").agg(F.max_by("outcome", "seq").alias("outcome"))
    return hypotheses.join(last, "hyp_id", "left").withColumn("status", F.coalesce("outcome", F.lit("open"))).drop("outcome")


def ingest_report(findings: DataFrame) -> DataFrame:
    """One row of counters: findings by category, with doubts, with high doubts."""
    count = lambda c: F.count_if(F.col("category") == c)
    return findings.agg(F.count("*").alias("findings"), count("hard_fact").alias("hard_facts"), count("quant_fact").alias("quant_facts"), count("structure").alias("structures"), count("background").alias("background"), F.count_if("doubted").alias("doubts"))


def next_number(hypotheses: DataFrame) -> int:
    """The number of the next hypothesis: one more than the greatest; other ids than H and digits don't count."""
    return 1 + (hypotheses.agg(F.max(F.regexp_extract(F.col("hyp_id").cast("string"), r"^H?(\d+)$", 1).try_cast("int"))).first()[0] or 0)


def listed(hypotheses: DataFrame, evidence: DataFrame, resolutions: DataFrame) -> DataFrame:
    """hypotheses with n_evidence, confidence and status, from the logs of evidence and resolutions: nothing is ever changed in place."""
    return status(confidence(hypotheses, evidence), resolutions)
