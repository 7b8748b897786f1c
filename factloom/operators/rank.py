"""Ranking: relevance, grade, recency and votes; then source kinds in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_grams, coverage, normalize, recency
from ..lineage import placed
from .classify import grade_rank


def cross_entity_noise(facts: DataFrame, canonical_id: str, aliases: list[str]) -> DataFrame:
    """Facts of the entity itself, and those of others whose text names one of its aliases."""
    text = normalize(F.concat(*[F.coalesce(c, F.lit("")) for c in ("claim", "object", "subject")]))
    names = F.array(*[F.lit(a) for a in aliases]) if aliases else F.array().cast("array<string>")
    return facts.filter((F.col("canonical_id") == canonical_id) | F.exists(names, lambda a: text.contains(a)))


def score(query: str, canonical_id: str | None, as_of: Column, semantic: Column | None = None) -> tuple[Column, Column]:
    """(relevance, score) over fact columns claim, object, canonical_id, level, valid_at, votes."""
    grams = content_grams(F.concat_ws(" ", F.coalesce("claim", F.lit("")), F.coalesce("object", F.lit(""))))
    hit = F.lit(0.0) if canonical_id is None else (F.col("canonical_id") == canonical_id).cast("double")
    relevance = 1.5 * coverage(content_grams(F.lit(query)), grams) + 2.0 * F.coalesce(hit, F.lit(0.0)) + 2.0 * (F.lit(0.0) if semantic is None else semantic)
    total = 2.0 * relevance + grade_rank(F.col("level"), 1) / 4.0 + recency(F.col("valid_at"), as_of) + 0.5 * F.least(F.coalesce("votes", F.lit(0)), F.lit(10)) / 10.0
    return relevance, total


def rank(facts: DataFrame, query: str, canonical_id: str | None, as_of: Column, semantic: Column | None = None) -> DataFrame:
    """Relevant facts with score; the rest goes."""
    relevance, total = score(query, canonical_id, as_of, semantic)
    return facts.withColumn("relevance", relevance).withColumn("score", total).filter("relevance > 0")


def diversify(scored: DataFrame, order: str = "pos", limit: int | None = None) -> DataFrame:
    """scored with place: in each round every source kind gives its best fact left; graded A, B+, B first, then by score.

    Ties go to the fact with the lesser `order` column. A missing kind is a kind of its own. With a limit only the first
    rounds that can reach it are numbered.
    """
    kind = F.coalesce(F.expr("nullif(source_kind, '')"), F.lit("?"))
    out = scored.withColumn("_kind", kind).withColumn("round", F.row_number().over(Window.partitionBy("_kind").orderBy(F.desc("score"), order)))
    if limit is not None:
        out = out.filter(F.col("round") <= limit)
    out = out.withColumn("tier", F.when(F.col("level").isin("A", "B+", "B"), 0).otherwise(1))
    keys = ["round", "tier", F.desc("score"), order]
    if limit is None:
        return placed(out, keys, "place").drop("_kind")
    return out.orderBy(*keys).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*keys))).drop("_kind")  # limit rows
