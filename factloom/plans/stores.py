"""Queries of the composed engine: cards as models write them, the ingest, the chat lane, deep checks, stores and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import LATIN
from ..operators import classify, critique, entities, hypothesis, ingest, ledger, market, recall
from ..sources import cards
from . import findings as P
from . import sentiment as S
from . import views as V
from .registry import query
from .views import MENTIONS, NORMAL, SERIES


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cards in JSON, with entities and numbers of every kind a model may write."""
    p = V.table(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("string")
    card = F.concat(
        F.lit('{"id": "c'), n, F.lit('", "type": "minutes", "date": null, "entities": ["bare", {"name": "e'), n, F.lit('"}, {"name": "s'), n, F.lit('", "kind": "stock", "code": "600'), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"),
        F.lit('"}, {"kind": "stock"}, 7], "findings": [{"claim": "k'), n, F.lit('", "page": "two", "entities": ["a", {"name": "b"}, {"x": 1}], "numbers": ["12%", '), F.col("p_size").cast("string"),
        F.lit(', {"value": 1.5, "context": "ic", "page": 3, "_v": "ok"}, null, [1]]}, "junk", {"evidence": "no claim"}], "factors": [{"name": "f", "performance": {"IC": 0.25, "t": "x"}}, 3]}'),
    )
    return cards.parsed(p.select(F.when(F.col("p_partkey") % 10 == 0, F.lit("[1]")).when(F.col("p_partkey") % 10 == 1, F.lit("{broken")).otherwise(card).alias("v")), "v")


@query("""SELECT 'c' || p_partkey AS doc_id, pos::BIGINT AS pos, claim.replace('#', p_partkey::VARCHAR) AS claim, numbers.replace('#', p_size::VARCHAR) AS numbers, own, 'e' || p_partkey || ':concept, s' || p_partkey || ':stock' AS entities
FROM part, (VALUES (0, 'k#', '12%:, #:, 1.5:ic', 'a,b,'), (1, '因子「f」', '0.25:IC, x:t', 'f')) AS f(pos, claim, numbers, own) WHERE p_partkey % 10 > 1""")
def card_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and entities of cards with mixed values."""
    f = cards.findings(_mixed(spark, sf_dir))
    numbers = F.array_join(F.transform("numbers", lambda n: F.concat(n["value"], F.lit(":"), n["context"])), ", ")
    named = F.array_join(F.transform("entities", lambda e: F.concat(e["name"], F.lit(":"), e["kind"])), ", ")
    return f.select("doc_id", F.col("pos").cast("long").alias("pos"), "claim", numbers.alias("numbers"), F.array_join("own", ",").alias("own"), named.alias("entities"))


@query("SELECT 'c' || p_partkey AS doc_id, 's' || p_partkey AS alias, '600' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') AS code FROM part WHERE p_partkey % 10 > 1")
def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by name within each card."""
    return cards.code_map(_mixed(spark, sf_dir))


_KINDS = ("stock", "fund", "index", "company", "product", "person", "material", "sector")


@query(f"""WITH p AS (SELECT p_partkey, p_name AS name, {list(_KINDS)!r}[p_partkey % {len(_KINDS)} + 1] AS k, CASE p_size % 3 WHEN 0 THEN lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0') WHEN 1 THEN lpad((p_partkey % 1000000)::VARCHAR, 6, '0') || '.OF' END AS code FROM part),
t AS (SELECT *, CASE WHEN k = 'sector' THEN 'concept' ELSE k END AS kind FROM p), m AS (SELECT *, {V._CODE} AS routed FROM t)
SELECT p_partkey, kind, CASE WHEN kind = 'stock' AND code LIKE '%.OF' THEN 'fund:' || code[1:6] WHEN kind = 'stock' AND code IS NOT NULL THEN routed WHEN kind = 'stock' THEN 'stock_pending:' || {NORMAL("name")}
  WHEN code LIKE '%.OF' THEN 'fund:' || code[1:6] ELSE kind || ':' || {NORMAL("name")} END AS entity_id FROM m""")
def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and ids of parts named as entities of eight kinds, with and without codes."""
    p = V.table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    code = F.when(F.col("p_size") % 3 == 0, F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0")).when(F.col("p_size") % 3 == 1, F.concat(F.lpad((F.col("p_partkey") % 1000000).cast("string"), 6, "0"), F.lit(".OF")))
    own = p.select("p_partkey", "p_name", classify.entity_type(kind).alias("kind"), code.alias("code"))
    return own.select("p_partkey", "kind", classify.entity_id(F.col("p_name"), F.col("kind"), F.col("code")).alias("entity_id"))


_MERGED = f"""{MENTIONS}, ids AS (SELECT canonical_id AS id, row_number() OVER (ORDER BY canonical_id) AS n FROM (SELECT DISTINCT canonical_id FROM r)),
mg AS (SELECT a.id AS from_id, b.id AS into_id FROM ids a JOIN ids b ON b.n = a.n + 1 WHERE right(a.id, 1) NOT IN ('0', '5'))"""


def _merges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The registry, and merges of each entity into the next by id, but for ids that end in 0 or 5."""
    from pyspark.sql import Window

    registry = entities.register(LATIN, V.mentions(spark, sf_dir))
    order = Window.orderBy("canonical_id")  # the test tables' registry is small; an engine's merges are given
    n = registry.select("canonical_id").distinct().select("canonical_id", F.lead("canonical_id").over(order).alias("into_id"))
    return registry, n.filter("right(canonical_id, 1) not in ('0', '5') and into_id is not null").select(F.col("canonical_id").alias("from_id"), "into_id")


@query(f"WITH RECURSIVE {_MERGED}, w(id, here, n) AS (SELECT id, id, 0 FROM ids UNION ALL SELECT w.id, into_id, w.n + 1 FROM w JOIN mg ON from_id = here), f AS (SELECT id, arg_max(here, n) AS final FROM w GROUP BY id) SELECT alias, final AS canonical_id FROM r JOIN f ON f.id = canonical_id")
def merge_repoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alias after the merges."""
    registry, merges = _merges(spark, sf_dir)
    return entities.merged(registry, merges).select("alias", "canonical_id")


@query(f"WITH {_MERGED} SELECT DISTINCT display AS term FROM r WHERE kind IN ('stock', 'company') AND canonical_id NOT IN (SELECT from_id FROM mg)")
def watch_terms_unmerged(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, merges = _merges(spark, sf_dir)
    return entities.watch_terms(registry, ("stock", "company"), merges)


@query(f"""WITH {MENTIONS}, o AS (SELECT {NORMAL("p_name")} AS alias, arg_max('hand:' || p_size, p_partkey) AS cid FROM part WHERE p_size > 33 GROUP BY 1 UNION ALL SELECT 'extra', 'hand:extra')
SELECT coalesce(r.alias, o.alias) AS alias, coalesce(cid, canonical_id) AS canonical_id FROM r FULL JOIN o ON o.alias = r.alias""")
def alias_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some aliases set by hand, and one added."""
    p = V.table(spark, sf_dir, "part").filter("p_size > 33").select(T.normalize(F.col("p_name")).alias("alias"), F.concat(F.lit("hand:"), F.col("p_size").cast("string")).alias("canonical_id"), F.col("p_partkey").alias("seq"))
    extra = spark.createDataFrame([("extra", "hand:extra", 0)], "alias string, canonical_id string, seq long")
    return entities.with_overrides(entities.register(LATIN, V.mentions(spark, sf_dir)), p.union(extra)).select("alias", "canonical_id")


@query()
def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards into facts with votes, grade, status and doubts; tests hold the ingest against a plain loop."""
    stores = ingest.ingest(LATIN, P._cards(spark, sf_dir))
    return stores.facts(sources=False).select(*ledger.KEY, "votes", "level", "status", "category", "severity")


@query()
def ingest_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters of that ingest."""
    stores = ingest.ingest(LATIN, P._cards(spark, sf_dir))
    return stores.report(stores.cards)


@query(f"""WITH {S._HITS}, st AS (SELECT *, CASE WHEN length(text) % 2 = 0 THEN 'bullish' ELSE CASE WHEN {V.sql_count('lower(text)', LATIN.bullish)} > {V.sql_count('lower(text)', LATIN.bearish)} THEN 'bullish' WHEN {V.sql_count('lower(text)', LATIN.bullish)} < {V.sql_count('lower(text)', LATIN.bearish)} THEN 'bearish' ELSE 'neutral' END END AS stance FROM ht)
SELECT DISTINCT text, timestamp, CASE WHEN term < 'n' THEN 'known:' || term ELSE 'stock_pending:' || term END AS canonical_id, stance FROM st""")
def feed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat lane with a registry, and stances that are told for texts of even length."""
    terms = S._terms(spark, sf_dir)
    registry = terms.filter("term < 'n'").select(F.col("term").alias("alias"), F.concat(F.lit("known:"), "term").alias("canonical_id"))
    lines = cards.fragments(S._lines(spark, sf_dir)).withColumn("told", F.when(F.length("text") % 2 == 0, "bullish").otherwise("unclear"))
    found, _ = ingest.feed_chat(LATIN, lines, terms, registry, "told")
    return found.select("text", "timestamp", "canonical_id", "stance")


@query(f"""WITH {P._NUMBERED}, bk AS (SELECT DISTINCT finding_id, metric, true AS backed FROM mv WHERE value >= 49),
fc AS (SELECT DISTINCT finding_id, CASE WHEN backed THEN 'low' WHEN value >= high THEN 'high' ELSE 'medium' END AS severity, metric AS detail FROM mv JOIN th USING (metric) LEFT JOIN bk USING (finding_id, metric) WHERE value >= medium)
SELECT finding_id, severity, detail FROM fc""")
def critique_corroborated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excesses, of which those with a figure of 49 or more are corroborated."""
    found = P._numbered(spark, sf_dir)
    values = critique.metrics(LATIN, found)
    backed = values.filter("value >= 49").select("finding_id", "metric")
    flagged = critique.flags(LATIN, found, critique.thresholds(values), corroborated=backed)
    return flagged.select("finding_id", F.explode("flags").alias("f")).filter("f.kind = 'over_optimistic'").select("finding_id", "f.severity", "f.detail")


@query(f"WITH {V.FINDINGS} SELECT fact_id, CASE WHEN quality = 1 THEN 'hard_fact' ELSE {V.category_sql()} END AS category FROM f LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) ON doc_id = fact_id")
def category_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories from elsewhere win where they are valid; here good documents are hard facts and poor ones get an invalid one."""
    told = V.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("fact_id")).agg(F.max("quality").alias("q"))
    f = V.findings(spark, sf_dir).join(told, "fact_id", "left")
    return f.select("fact_id", classify.category(LATIN, "claim", "evidence", F.col("nums"), F.when(F.col("q") == 1, "hard_fact").when(F.col("q") == 0, "nonsense")).alias("category"))


@query(f"""WITH {SERIES}, x AS (SELECT code, ts, close, lag(close, 10) OVER (PARTITION BY code ORDER BY ts, tie) AS b, row_number() OVER (PARTITION BY code ORDER BY ts DESC, tie DESC) AS n FROM s),
l AS (SELECT code, 100 * (close / b - 1) AS ret FROM x WHERE n = 1 AND b IS NOT NULL AND b <> 0), i AS (SELECT ret AS index_ret FROM l WHERE code = 1)
SELECT code, round(ret, 6) AS ret, round(ret - index_ret, 6) AS alpha FROM l LEFT JOIN i ON true""")
def index_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over ten rows in excess of those of the first code."""
    ten = market.latest_return(V.series(spark, sf_dir), 10)
    return market.index_alpha(ten, ten.filter("code = 1").select("ret")).select("code", F.round("ret", 6).alias("ret"), F.round("alpha", 6).alias("alpha"))


@query("SELECT o_orderkey, coalesce(CASE WHEN round_even(o_totalprice / 8, 0) % 2 = 0 THEN 'even' END, 'odd') AS parity, round_even(o_custkey / 8.0, 2) AS half_even FROM orders")
def vendor_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves are rounded to the even neighbour."""
    o = V.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.bround(F.col("o_totalprice").cast("double") / 8, 0) % 2 == 0, "even").otherwise("odd").alias("parity"), F.bround(F.col("o_custkey").cast("double") / 8, 2).alias("half_even"))


_STORES = "st AS (SELECT * FROM (VALUES ('large', 0), ('small', 1), ('empty', 2)) AS t(store, priority))"


def _stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = V.table(spark, sf_dir, "embeddings").select(F.when(F.col("label") < 7, "small").otherwise("large").alias("store"))
    return recall.store_counts(index, spark.createDataFrame([("large", 0), ("small", 1), ("empty", 2)], "store string, priority int"))


@query(f"WITH {_STORES} SELECT store, priority::BIGINT AS priority, count(e.s)::BIGINT AS vectors FROM st LEFT JOIN (SELECT CASE WHEN label < 7 THEN 'small' ELSE 'large' END AS s FROM embeddings) e ON s = store GROUP BY ALL")
def vector_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in each store."""
    return _stores(spark, sf_dir).select("store", F.col("priority").cast("long").alias("priority"), "vectors")


@query(f"WITH {_STORES}, n AS (SELECT store, priority, count(e.s) AS v FROM st LEFT JOIN (SELECT CASE WHEN label < 7 THEN 'small' ELSE 'large' END AS s FROM embeddings) e ON s = store GROUP BY ALL) SELECT 'auto' AS how, (SELECT store FROM n ORDER BY v DESC, priority LIMIT 1) AS store UNION ALL SELECT 'empty', 'empty' UNION ALL SELECT 'absent', 'large'")
def vector_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store that is asked: by size, as preferred, and where the preferred one is absent."""
    counts = _stores(spark, sf_dir)
    picks = [recall.best_store(counts, prefer).select(F.lit(how).alias("how"), "store") for how, prefer in (("auto", None), ("empty", "empty"), ("absent", "none"))]
    return picks[0].union(picks[1]).union(picks[2])


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(coalesce(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 0), 6) AS cosine
FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.embedding IS NOT NULL AND e.embedding IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(coalesce(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0), 0), 6) DESC, e.vec_id) <= 120""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 120 nearest of all vectors to each whose id 20 divides."""
    v = V.table(spark, sf_dir, "embeddings").filter("embedding is not null")
    return recall.vector_search(v, v.filter("vec_id % 20 = 0"), 120)


@query("SELECT vec_id, CASE WHEN label < 3 THEN 1 ELSE 0 END::BIGINT AS fresh FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after a build: live vectors, those of three labels encoded anew, and those that were missing."""
    live = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    index = V.table(spark, sf_dir, "embeddings").select("vec_id", F.lit(0).cast("long").alias("fresh"))
    missing = recall.index_delta(index, live, "vec_id").filter("action = 'encode'").select("vec_id")
    encoded = V.table(spark, sf_dir, "embeddings").filter("label < 3").select("vec_id").union(missing).distinct().withColumn("fresh", F.lit(1).cast("long"))
    return recall.index_applied(index, encoded, live, "vec_id")


@query("SELECT max(p_partkey) + 1 AS next_number FROM part")
def hypothesis_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number after those of the parts; names that aren't numbers don't count."""
    p = V.table(spark, sf_dir, "part").select(F.concat(F.lit("H"), F.col("p_partkey").cast("string")).alias("hyp_id")).union(spark.createDataFrame([("H9x",), (None,)], "hyp_id string"))
    return spark.createDataFrame([(hypothesis.next_number(p),)], "next_number long")


@query("SELECT event_id, props AS found FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects found in answers that wrap them in words, braces and texts with braces."""
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", T.first_json(F.concat(F.lit("Answer: "), "props", F.lit(" - that is all } {"))).alias("found"))


@query("""WITH c AS (SELECT s_suppkey, s_acctbal, lpad((s_suppkey * 7919 % 1000000)::VARCHAR, 6, '0') AS code FROM supplier), k AS (SELECT * FROM c WHERE s_acctbal > 3000)
SELECT c.s_suppkey, CASE WHEN k.code IS NOT NULL THEN 'org' || k.code END AS org_id, CASE WHEN k.code IS NOT NULL THEN 'zz' WHEN c.code[1] IN ('6', '9') THEN 'sh' WHEN c.code[1] IN ('0', '3', '2') THEN 'sz' WHEN c.code[1] IN ('8', '4') THEN 'bj' ELSE '' END AS plate FROM c LEFT JOIN k ON k.s_suppkey = c.s_suppkey""")
def org_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisation ids of codes, of which those of rich suppliers are listed."""
    c = V.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.lpad((F.col("s_suppkey") * 7919 % 1000000).cast("string"), 6, "0").alias("code"))
    listed = c.filter("s_acctbal > 3000").select("code", F.concat(F.lit("org"), "code").alias("org_id"), F.lit("zz").alias("plate"))
    return cards.organisations(c, listed).select("s_suppkey", "org_id", "plate")


@query("SELECT DISTINCT c_nationkey AS code FROM customer WHERE c_mktsegment LIKE '%BUILD%' AND c_nationkey IN (SELECT n_nationkey FROM nation)")
def has_announcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with an announcement on building."""
    c = V.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_mktsegment").alias("title"))
    return cards.has_announcement(V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code")), c, "BUILD")


@query(f"WITH {V.OCCURRENCES}, {V.FOLD}, i AS (SELECT substr(sha1(canonical_id || '|' || predicate || '|' || object), 1, 16) AS fact_id, * FROM facts), k AS (SELECT min(fact_id) AS fact_id FROM i) SELECT fact_id, canonical_id, predicate, object, votes FROM i SEMI JOIN k USING (fact_id)")
def fact_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fact by its id."""
    facts = ledger.fold(V.occurrences(spark, sf_dir))
    facts = facts.withColumn("fact_id", T.stable_id(F.col("canonical_id").cast("string"), F.col("predicate"), F.col("object").cast("string")))
    least = facts.agg(F.min("fact_id")).first()[0]
    return ledger.get(facts, least).select("fact_id", *ledger.KEY, "votes")


@query("SELECT event_id AS fact_id, round(value, 6) AS score FROM events WHERE event_type NOT IN ('error') AND value > 10")
def live_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector hits whose facts still stand."""
    e = V.table(spark, sf_dir, "events")
    facts = e.select(F.col("event_id").alias("fact_id"), F.when(F.col("event_type") == "error", "superseded").when(F.col("event_type") == "click", "disputed").otherwise("active").alias("status"))
    scored = e.filter("value > 10").select(F.col("event_id").alias("fact_id"), F.round("value", 6).alias("score"))
    return recall.live_scores(scored, facts).select("fact_id", "score")
