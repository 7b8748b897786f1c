"""The chat lane: fragments that name watched terms become graded-D sentiment items; the rest stays cold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RuleSet
from ..functions.text import stable_id
from .classify import stance


#: So many terms are looked for in every text, one after the other; more meet the texts on their first characters.
FEW_TERMS = 1000


def watch_hits(fragments: DataFrame, terms: DataFrame, block: int = 2, few: int = FEW_TERMS) -> DataFrame:
    """fragments (text and more) with each watched term (column term) that their text contains, each row once.

    Many terms meet texts on their first characters, an equi join of a key and grams; the text comes back for the check only.
    """
    known = terms.filter("term <> ''").select("term").distinct()
    listed = [r["term"] for r in known.limit(few + 1).collect()]
    if len(listed) <= few:
        return fragments.withColumn("term", F.explode(terms_in(F.col("text"), listed))).dropDuplicates()
    rows = fragments.dropDuplicates().withColumn("_k", F.xxhash64(*fragments.columns))
    grams = F.when(F.length("text") >= block, F.transform(F.sequence(F.lit(1), F.length("text") - block + 1), lambda i: F.substring(F.col("text"), i, F.lit(block)))).otherwise(F.array().cast("array<string>"))
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    spread = rows.select("_k", F.explode(F.array_distinct(F.concat(grams, chars))).alias("_g"))
    keyed = known.select("term", F.substring("term", 1, block).alias("_g"))
    return rows.join(spread.join(keyed, "_g").select("_k", "term").distinct(), "_k").filter(F.col("text").contains(F.col("term"))).drop("_k")


def terms_in(text: Column, terms: list[str]) -> Column:
    """Those of a few terms that a text contains."""
    return F.filter(F.array(*[F.lit(t) for t in terms]).cast("array<string>"), lambda t: text.contains(t))


def raw(fragments: DataFrame, hits: DataFrame) -> DataFrame:
    """Every distinct fragment with raw_id and whether it was kept."""
    own = fragments.withColumn("raw_id", F.substring(F.sha1(F.concat("text", F.coalesce("timestamp", F.lit(""))).cast("binary")), 1, 16)).dropDuplicates(["raw_id"])
    named = hits.select(F.substring(F.sha1(F.concat("text", F.coalesce("timestamp", F.lit(""))).cast("binary")), 1, 16).alias("raw_id")).distinct().withColumn("kept", F.lit(True))
    return own.join(named, "raw_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def items(rules: RuleSet, hits: DataFrame, told: Column | None = None) -> DataFrame:
    """One item per fragment and term: stance, a claim of 60 characters, grade D, unverifiable; equal ones once.

    told is a column of hits with a stance found elsewhere; where it is one of the three, it wins over the words.
    """
    by_words = stance(rules, F.col("text"))
    by_words = by_words if told is None else F.when(told.isin("bullish", "bearish", "neutral"), told).otherwise(by_words)
    out = hits.select(F.col("term").alias("canonical_id"), "text", "timestamp", by_words.alias("stance"), F.substring("text", 1, 60).alias("claim"))
    return out.withColumn("item_id", stable_id(F.col("canonical_id"), F.col("timestamp"), F.col("text"))).withColumn("level", F.lit("D")).withColumn("unverifiable", F.lit(True)).dropDuplicates(["item_id"])


def aggregate(found: DataFrame) -> DataFrame:
    """Per entity: total, bullish, bearish, neutral, net."""
    count = lambda s: F.count_if(F.col("stance") == s)
    return found.groupBy("canonical_id").agg(F.count("*").alias("total"), count("bullish").alias("bullish"), count("bearish").alias("bearish"), count("neutral").alias("neutral"), (count("bullish") - count("bearish")).alias("net"))


def density(found: DataFrame) -> DataFrame:
    """Items by entity and day (the first ten characters of the timestamp)."""
    return found.groupBy("canonical_id", F.substring(F.coalesce("timestamp", F.lit("")), 1, 10).alias("day")).agg(F.count("*").alias("n"))


def promote(found: DataFrame, promotions: DataFrame) -> DataFrame:
    """found with promoted and promoted_by: an entity's earliest promotion (canonical_id, source, seq) at or after the item's seq."""
    later = found.select("item_id", "canonical_id", "seq").join(promotions.select("canonical_id", "source", F.col("seq").alias("_at")), "canonical_id").filter("_at >= seq")
    first = later.groupBy("item_id").agg(F.min_by("source", "_at").alias("promoted_by"))
    return found.join(first, "item_id", "left").withColumn("promoted", F.col("promoted_by").isNotNull())


def stats(found: DataFrame, kept: DataFrame) -> DataFrame:
    """items, promoted, raw_total, raw_kept in one row."""
    a = found.agg(F.count("*").alias("items"), F.count_if("promoted").alias("promoted"))
    b = kept.agg(F.count("*").alias("raw_total"), F.count_if("kept").alias("raw_kept"))
    return a.crossJoin(b)  # one row each
