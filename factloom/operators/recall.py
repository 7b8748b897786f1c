"""Candidate recall: keywords, grams and vectors, united in order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_grams, cosine


#: Query vectors that are compared at a time.
QUERY_BLOCK = 16_384


def keyword(facts: DataFrame, tokens: list[str], limit: int, columns: tuple[str, ...] = ("claim", "object", "subject"), order: str = "fact_id") -> DataFrame:
    """Facts in whose columns any token stands, case ignored; no token, no fact."""
    if not tokens:
        return facts.limit(0)
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(t.lower()) for c in columns for t in tokens])
    return facts.filter(hit).orderBy(order).limit(limit)


def gram_topk(facts: DataFrame, query: str, limit: int, order: str = "fact_id") -> DataFrame:
    """Facts by shared grams with the query, then votes."""
    scored = facts.withColumn("overlap", F.size(F.array_intersect(content_grams(F.col("claim")), content_grams(F.lit(query)))))
    return scored.filter("overlap > 0").orderBy(F.desc("overlap"), F.desc("votes"), order).limit(limit)


def vector_topk(vectors: DataFrame, query: list[float], limit: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The exact nearest vectors by cosine: one scan and a bounded sort."""
    scored = vectors.withColumn("cosine", cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])))
    return scored.orderBy(F.desc("cosine"), id_col).limit(limit)


def vector_search(vectors: DataFrame, queries: DataFrame, limit: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, id and cosine (six digits) of the nearest vectors to each query vector, ties by id; exact, every vector is compared.

    Queries go to the tasks in blocks of about `block`, so what is broadcast doesn't grow with them; a batch of vectors keeps
    its nearest for each query of a block, and only these are ranked together. Vectors and queries must not be null; zero
    vectors have cosine 0 with all.
    """
    spark, kind = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    parts = max(1, math.ceil(queries.count() / block))
    slim = vectors.select(id_col, F.col(vector_col).cast("array<double>").alias("v"))
    found = None
    for part in range(parts):
        own = queries.filter(F.pmod(F.xxhash64(id_col), F.lit(parts)) == part).select(id_col, F.col(vector_col).cast("array<double>").alias("v")).collect()
        shared = spark.sparkContext.broadcast(([r[0] for r in own], [r[1] for r in own]))
        near = slim.mapInPandas(_nearest(shared, limit, id_col), f"query_id {kind}, {id_col} {kind}, cosine double")
        found = near if found is None else found.union(near)
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), id_col)
    return found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= limit).drop("_n")


def _nearest(shared, limit: int, id_col: str):
    """For each batch of vectors the nearest to each query, ties at the end included."""

    def unit(v: list) -> np.ndarray:
        m = np.array(v, float).reshape(len(v), -1)
        return m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, wanted = shared.value
        if not ids:
            return
        q, names = unit(wanted), np.array(ids)
        for frame in frames:
            if not len(frame):
                continue
            v, own = unit(frame["v"].tolist()), frame[id_col].to_numpy()
            for at in range(0, len(q), 512):
                near = np.round(q[at : at + 512] @ v.T, 6) + 0.0
                least = np.partition(near, len(own) - limit, axis=1)[:, len(own) - limit] if len(own) > limit else np.full(len(near), -np.inf)
                i, j = np.nonzero(near >= least[:, None])
                yield pd.DataFrame({"query_id": names[at + i], id_col: own[j], "cosine": near[i, j]})

    return run


def vector_score(vectors: DataFrame, ids: DataFrame, query: list[float], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cosines of the given ids, 0 at least."""
    own = vectors.join(ids, id_col, "left_semi")
    return own.withColumn("cosine", F.greatest(F.lit(0.0), cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))))


def index_delta(index: DataFrame, live: DataFrame, id_col: str) -> DataFrame:
    """(id, action): what an incremental vector build has to encode and what it has to delete."""
    todo = live.join(index, id_col, "left_anti").select(id_col, F.lit("encode").alias("action"))
    return todo.union(index.join(live, id_col, "left_anti").select(id_col, F.lit("delete").alias("action")))


def index_applied(index: DataFrame, encoded: DataFrame, live: DataFrame, id_col: str) -> DataFrame:
    """The index after a build: what is still live, with newly encoded rows in place of old ones."""
    return index.join(encoded, id_col, "left_anti").unionByName(encoded).join(live, id_col, "left_semi")


def live_scores(scored: DataFrame, facts: DataFrame, id_col: str = "fact_id") -> DataFrame:
    """Facts that vector recall found (id, score), with the score; superseded and invalidated ones don't come."""
    return facts.filter(F.col("status").isin("active", "disputed")).join(scored.select(id_col, "score"), id_col)


def store_counts(index: DataFrame, stores: DataFrame) -> DataFrame:
    """(store, priority, vectors) for each store (store, priority): how many vectors it holds, 0 without any."""
    held = index.groupBy("store").agg(F.count("*").alias("vectors"))
    return stores.join(held, "store", "left").withColumn("vectors", F.coalesce("vectors", F.lit(0)))


def best_store(counts: DataFrame, prefer: str | None = None) -> DataFrame:
    """The store to ask: that with most vectors, ties by priority; or the preferred one, if it is there, else the first by priority. One row."""
    first = F.desc("vectors") if prefer is None else F.when(F.col("store") == prefer, 0).otherwise(1)
    return counts.orderBy(first, "priority").limit(1)


def union_candidates(pools: list[DataFrame], id_col: str = "fact_id", order: str = "pos") -> DataFrame:
    """The pools' rows by id, the first pool's first; each has a column `pos` that orders it."""
    tagged = reduce(DataFrame.unionByName, [p.withColumn("pool", F.lit(k)) for k, p in enumerate(pools)])
    return tagged.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("pool", order))).filter("_n = 1").drop("_n")


def not_naming(claim: Column, aliases: Column) -> Column:
    """Whether a normalised text names none of the aliases."""
    return ~F.exists(aliases, lambda a: claim.contains(a))
