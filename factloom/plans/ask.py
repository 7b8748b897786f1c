"""The ask bundle: one question through location, recall, noise filter, ranking and diversification, as one DataFrame of sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import RuleSet
from ..functions.text import normalize, recall_tokens
from ..lineage import checkpoint
from ..operators import entities, graph, market, rank, recall
from ..operators.classify import grade_rank, is_security, pricing_frame

#: Rows that an answer shows of each section.
EVIDENCE, INVALIDATED, FOLLOW_UPS, SOURCES, NEIGHBOURS = 8, 5, 5, 12, 8
#: Facts of the entity, facts by keyword and facts by vector that are weighed.
OWN, BY_KEYWORD, BY_VECTOR = 120, 400, 120


def ask(
    question: str, facts: DataFrame, registry: DataFrame, edges: DataFrame, as_of: Column, semantic: DataFrame | None = None, evidence: int = EVIDENCE,
    snapshot: DataFrame | None = None, rules: RuleSet | None = None, include_invalidated: bool = True, use_semantic: bool | None = None,
) -> DataFrame:
    """Rows (section, place, key, text): entity, evidence, invalidated, neighbour, source, doubt, follow_up, frame, weight and warning.

    facts: fact_id, claim, object, subject, canonical_id, level, source_kind, valid_at, votes, status and, for more sections, sources,
    category, severity. semantic: fact_id, score in 0 to 1; it is weighed unless the entity is a security, or as use_semantic says.
    snapshot: canonical_id and the measures of market.environment(); with rules the evidence is weighed anew under its frame. An
    unknown entity falls back to a name that differs in one character, then to none.
    """
    spark = facts.sparkSession
    q = spark.createDataFrame([(0, question)], "qid int, text string")
    located = entities.locate(entities.matches(q, registry)).first()  # one row
    guessed = None if located else entities.fuzzy(q, registry).first()
    cid = (located or guessed or {"canonical_id": None})["canonical_id"]
    security = bool(cid) and spark.range(1).select(is_security(F.lit(cid))).first()[0]
    live = facts.filter(F.col("status").isin("active", "disputed"))
    if security:
        names = [r["alias"] for r in registry.filter(F.col("canonical_id") == cid).select("alias").collect()]  # one entity's aliases
        live = rank.cross_entity_noise(live, cid, names)
    tokens = spark.range(1).select(recall_tokens(F.lit(question))).first()[0]
    best = [grade_rank(F.col("level")).desc(), F.col("votes").desc(), F.col("fact_id")]
    pools = [live.filter(F.col("canonical_id") == (cid or "")).orderBy(*best).limit(OWN).withColumn("pos", F.col("fact_id")), recall.keyword(live, tokens, BY_KEYWORD).withColumn("pos", F.col("fact_id"))]
    weigh = semantic is not None and ((not security) if use_semantic is None else use_semantic)
    if weigh:
        near = semantic.orderBy(F.desc("score"), "fact_id").limit(BY_VECTOR)
        pools.append(live.join(F.broadcast(near.select("fact_id")), "fact_id", "left_semi").withColumn("pos", F.col("fact_id")))
    pool = recall.union_candidates(pools)
    if weigh:
        pool = pool.join(F.broadcast(near.select("fact_id", F.col("score").alias("semantic"))), "fact_id", "left")
    scored = checkpoint(rank.rank(pool, question, cid, as_of, F.coalesce("semantic", F.lit(0.0)) if weigh else None))
    shown = checkpoint(rank.diversify(scored, "fact_id", evidence))

    key, fact = F.col("fact_id").cast("string").alias("key"), F.concat(F.lit("["), "level", F.lit("] "), "claim").alias("text")
    first = lambda df, order, most, section, *columns: df.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order))).select(F.lit(section).alias("section"), "place", *columns)
    told = [(("entity"), 0, cid or "", question)]
    parts = [shown.select(F.lit("evidence").alias("section"), "place", key, fact)]
    if include_invalidated:
        gone = facts.filter((F.col("canonical_id") == (cid or "")) & ~F.col("status").isin("active", "disputed"))
        parts.append(first(gone, best, INVALIDATED, "invalidated", key, F.col("claim").alias("text")))
    around = graph.neighbours(edges, spark.createDataFrame([(cid,)], "node string"))
    around = checkpoint(first(around, [F.desc("votes"), "rel_type", "other"], NEIGHBOURS, "neighbour", F.col("other").alias("key"), F.col("rel_type").alias("text")))
    parts.append(around)
    if "sources" in facts.columns:
        named = scored.select(F.explode("sources").alias("source")).distinct()
        parts.append(first(named, ["source"], SOURCES, "source", F.col("source").alias("key"), F.lit("").alias("text")))
    if "severity" in facts.columns:
        parts.append(first(shown.filter("severity > 0"), [F.desc("severity"), "fact_id"], evidence, "doubt", key, F.col("severity").cast("string").alias("text")))
    weak = F.col("level").isin("C", "D") | (F.col("status") == "disputed")
    parts.append(first(shown.filter(weak), ["place"], FOLLOW_UPS, "follow_up", key, fact))
    if snapshot is not None and security:
        framed = pricing_frame(snapshot.filter(F.col("canonical_id") == cid)).select("frame", "weight")
        parts.append(framed.limit(1).select(F.lit("frame").alias("section"), F.lit(0).alias("place"), F.col("frame").alias("key"), F.col("weight").alias("text")))
        if rules is not None:
            parts.append(market.reweight(rules, shown.withColumn("all", F.lit("")), "all").select(F.lit("weight").alias("section"), F.lit(0).alias("place"), F.concat_ws("/", F.col("fast").cast("string"), F.col("slow").cast("string")).alias("key"), F.array_join("samples", "; ").alias("text")))
    found = not shown.isEmpty()
    warnings = [
        (guessed, "corrected", cid or ""), (not cid and found, "no entity, found by keyword and vector", ""), (not cid and not found, "no entity and nothing found", ""),
        (not found and around.isEmpty(), "no evidence", ""), (security and snapshot is not None and parts and snapshot.filter(F.col("canonical_id") == cid).isEmpty(), "no market data", ""),
    ]
    told += [("warning", k, name, text) for k, (if_, name, text) in enumerate(warnings) if if_]
    return reduce(DataFrame.union, parts, spark.createDataFrame(told, "section string, place int, key string, text string"))


def registry_of(names: DataFrame) -> DataFrame:
    """A registry (alias, canonical_id) from names (name, canonical_id)."""
    return names.select(normalize(F.col("name")).alias("alias"), "canonical_id").filter("alias <> ''").distinct()
