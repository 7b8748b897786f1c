"""Queries of the question-answering side: recall, ranking, evidence, and checks against documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.rules import LATIN
from ..operators import classify, rank, recall, verify
from . import views as V
from .registry import query
from .views import FINDINGS, GRAMS, NORMAL, RANK, quoted, sql_map

QUESTION = "the thinking of 2024 and order"
AS_OF = "2026-06-30"
ENTITY = "SH600008"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as facts: grade by kind, one listed security per source, dates over two years, votes by id."""
    f = V.findings(spark, sf_dir)
    number = F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(0))
    cid = F.when(number % 4 == 3, F.concat(F.lit("concept:"), "source")).otherwise(F.concat(F.lit("SH600"), F.lpad(number.cast("string"), 3, "0")))
    day = F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), (F.col("fact_id") * 53 % 730).cast("int")), "yyyy-MM-dd")
    return f.select("fact_id", "claim", "evidence", "source", "nums", cid.alias("canonical_id"), F.col("source").alias("subject"), F.substring("claim", 1, 80).alias("object"), F.col("kind").alias("source_kind"), classify.baseline_grade(F.col("kind")).alias("level"), F.when(F.col("fact_id") % 10 == 0, "").otherwise(day).alias("valid_at"), (F.col("fact_id") % 13).alias("votes"))


_FACTS = f"""{FINDINGS},
fa AS (SELECT fact_id, claim, evidence, source, nums, txt, CASE WHEN k % 4 = 3 THEN 'concept:' || source ELSE 'SH600' || lpad(k::VARCHAR, 3, '0') END AS canonical_id, source AS subject, substr(claim, 1, 80) AS object, kind AS source_kind,
  {sql_map('kind', R.BASELINE, quoted('C'))} AS level, CASE WHEN fact_id % 10 = 0 THEN '' ELSE strftime(DATE '{AS_OF}' - (fact_id * 53 % 730)::INT, '%Y-%m-%d') END AS valid_at, fact_id % 13 AS votes
  FROM (SELECT *, coalesce(try_cast(regexp_extract(source, '(\\d+)', 1) AS INT), 0) AS k FROM f))"""
_RECENCY = f"CASE WHEN valid_at = '' THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - date_diff('day', valid_at::DATE, DATE '{AS_OF}') / 365.0)) END"
_SCORED = f"""{_FACTS}, q AS (SELECT {GRAMS(quoted(QUESTION))} AS g),
sc AS (SELECT fa.*, 1.5 * len(list_intersect(g, {GRAMS("claim || ' ' || object")})) / greatest(len(g), 1) + 2.0 * (canonical_id = '{ENTITY}')::INT AS relevance, {_RECENCY} AS rec FROM fa, q),
rk AS (SELECT *, 2 * relevance + {RANK('level', 1)} / 4.0 + rec + 0.5 * least(votes, 10) / 10.0 AS score FROM sc WHERE relevance > 0)"""


@query(f"WITH {_FACTS} SELECT fact_id, claim FROM fa WHERE contains(lower(claim || chr(10) || object || chr(10) || subject), 'order') OR contains(lower(claim || chr(10) || object || chr(10) || subject), 'thinking') OR contains(lower(claim || chr(10) || object || chr(10) || subject), 'thth') ORDER BY fact_id LIMIT 400")
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 facts with one of three tokens."""
    return recall.keyword(_facts(spark, sf_dir), ["order", "thinking", "thth"], 400).select("fact_id", "claim")


@query(f"WITH {_FACTS}, q AS (SELECT {GRAMS(quoted(QUESTION))} AS g), x AS (SELECT fact_id, len(list_intersect(g, {GRAMS('claim')})) AS overlap, votes FROM fa, q) SELECT fact_id, overlap::BIGINT AS overlap FROM x WHERE overlap > 0 ORDER BY overlap DESC, votes DESC, fact_id LIMIT 100")
def gram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.gram_topk(_facts(spark, sf_dir), QUESTION, 100).select("fact_id", F.col("overlap").cast("long").alias("overlap"))


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: that with the least id; one row."""
    return V.table(spark, sf_dir, "embeddings").filter("embedding is not null").orderBy("vec_id").select("embedding").first()[0]


_COSINE = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 0)"
_Q = "(SELECT embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id LIMIT 1) q"


@query(f"SELECT vec_id, round(coalesce({_COSINE}, 0), 6) AS cosine FROM embeddings e, {_Q} ORDER BY coalesce({_COSINE}, 0) DESC, vec_id LIMIT 120")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.vector_topk(V.table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 120).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT vec_id, round(greatest(0, coalesce({_COSINE}, 0)), 6) AS cosine FROM embeddings e, {_Q} WHERE vec_id IN (SELECT doc_id FROM labels)")
def vector_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the vectors that bear a labelled document's id."""
    ids = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id")).distinct()
    return recall.vector_score(V.table(spark, sf_dir, "embeddings"), ids, _vector(spark, sf_dir)).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query("SELECT doc_id AS vec_id, 'encode' AS action FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'delete' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def vector_index_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index over the embeddings lacks and has too much for the documents."""
    return recall.index_delta(V.table(spark, sf_dir, "embeddings").select("vec_id"), V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id")


@query(f"""WITH {_FACTS}, p AS (SELECT fact_id, 0 AS pool, fact_id AS pos FROM fa WHERE canonical_id = '{ENTITY}' UNION ALL SELECT fact_id, 1, -votes FROM fa WHERE contains(lower(claim), 'th') UNION ALL SELECT fact_id, 2, fact_id FROM fa WHERE len(nums) > 0)
SELECT fact_id, pool::BIGINT AS pool, pos::BIGINT AS pos FROM p QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY pool, pos) = 1""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the entity, facts with a keyword, facts with numbers: each fact once, from its first pool."""
    f = _facts(spark, sf_dir)
    pools = [f.filter(F.col("canonical_id") == ENTITY).select("fact_id", F.col("fact_id").alias("pos")), f.filter(F.lower("claim").contains("th")).select("fact_id", (-F.col("votes")).alias("pos")), f.filter(F.size("nums") > 0).select("fact_id", F.col("fact_id").alias("pos"))]
    return recall.union_candidates(pools).select("fact_id", F.col("pool").cast("long").alias("pool"), "pos")


@query(f"WITH {_FACTS} SELECT fact_id, round({_RECENCY}, 6) AS recency FROM fa")
def recency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("fact_id", F.round(T.recency(F.col("valid_at"), F.lit(AS_OF).cast("date")), 6).alias("recency"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rank(_facts(spark, sf_dir), QUESTION, ENTITY, F.lit(AS_OF).cast("date"))


@query(f"WITH {_SCORED} SELECT fact_id, round(relevance, 6) AS relevance, round(score, 6) AS score FROM rk")
def rank_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("fact_id", F.round("relevance", 6).alias("relevance"), F.round("score", 6).alias("score"))


@query(f"WITH {_FACTS} SELECT fact_id FROM fa WHERE canonical_id = '{ENTITY}' OR contains({NORMAL('claim || object || subject')}, 'src8') OR contains({NORMAL('claim || object || subject')}, 'thth')")
def cross_entity_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.cross_entity_noise(_facts(spark, sf_dir), ENTITY, ["src8", "thth"]).select("fact_id")


_DIVERSE = f"""{_SCORED}, rd AS (SELECT *, round(score, 6) AS s, CASE WHEN level IN ('A', 'B+', 'B') THEN 0 ELSE 1 END AS tier FROM rk),
dv AS (SELECT *, row_number() OVER (PARTITION BY source_kind ORDER BY s DESC, fact_id) AS round FROM rd),
pl AS (SELECT *, row_number() OVER (ORDER BY round, tier, s DESC, fact_id) AS place FROM dv)"""


def _diverse(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    return rank.diversify(_ranked(spark, sf_dir).withColumn("score", F.round("score", 6)), "fact_id", limit)


@query(f"WITH {_DIVERSE} SELECT fact_id, source_kind, round, tier::BIGINT AS tier, place FROM pl WHERE place <= 200")
def diversify_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 facts when source kinds take turns."""
    return _diverse(spark, sf_dir, 200).select("fact_id", "source_kind", F.col("round").cast("long").alias("round"), F.col("tier").cast("long").alias("tier"), F.col("place").cast("long").alias("place"))


@query(f"WITH {_DIVERSE} SELECT 'F' || place AS ref, '[' || level || '] ' || source_kind || ' (' || votes || ')' AS line, fact_id FROM pl WHERE place <= 8")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence section of an answer: eight numbered lines."""
    d = _diverse(spark, sf_dir, 8)
    return d.select(F.concat(F.lit("F"), F.col("place").cast("string")).alias("ref"), F.concat(F.lit("["), "level", F.lit("] "), "source_kind", F.lit(" ("), F.col("votes").cast("string"), F.lit(")")).alias("line"), "fact_id")


_FRESH = f"""{_FACTS}, fr AS (SELECT *, regexp_extract(canonical_id, '^(SH|SZ|BJ)(\\d{{6}})$', 2) AS code, CASE WHEN valid_at <> '' THEN date_diff('day', valid_at::DATE, DATE '{AS_OF}') END AS age FROM fa),
fl AS (SELECT * FROM fr WHERE level IN ('C', 'D') AND code <> '' AND length(trim(claim)) >= 10 AND age BETWEEN 0 AND 120)"""


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.fresh_leads(_facts(spark, sf_dir), F.lit(AS_OF).cast("date"))


@query(f"WITH {_FRESH} SELECT fact_id, code, age FROM fl")
def fresh_lead_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fresh(spark, sf_dir).select("fact_id", "code", F.col("age").cast("long").alias("age"))


@query(f"WITH {_FACTS} SELECT fact_id, n::BIGINT AS severity FROM (SELECT fact_id, len(nums) AS n FROM fa WHERE regexp_matches(canonical_id, '^(SH|SZ|BJ)\\d{{6}}$')) WHERE n > 0 ORDER BY n DESC, fact_id LIMIT 10")
def deep_check_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten coded facts to check first; the number of figures stands in for their doubts."""
    f = _facts(spark, sf_dir).withColumn("category", F.lit("hard_fact")).withColumn("severity", F.size("nums").cast("long"))
    return verify.deep_check_candidates(f, 10).select("fact_id", "severity")


_CHECKED = f"""{_FRESH},
dc AS (SELECT '600' || lpad((page_id % 20)::VARCHAR, 3, '0') AS code, page_id AS doc_id, ['重大合同/中标', '诉讼/风险/处罚', '对外投资'][page_id % 3 + 1] AS doc_category, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body FROM pages),
cl AS (SELECT fact_id AS claim_id, code, {V.predicate_sql()} AS predicate, list_filter({GRAMS('claim')}, lambda x: NOT list_contains({GRAMS('subject')}, x)) AS g FROM fl),
dg AS (SELECT code, doc_id, doc_category, list_distinct(list_concat({GRAMS('title')}, {GRAMS(f"substr(body, 1, {verify.DOC_CHARS})")})) AS d FROM dc),
ov AS (SELECT claim_id, doc_id, doc_category, len(list_intersect(g, d)) AS overlap FROM cl JOIN dg USING (code)),
bs AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY overlap DESC, doc_id) = 1),
vd AS (SELECT cl.claim_id, cl.code, coalesce(overlap, 0) AS overlap, CASE WHEN len(g) > 0 AND coalesce(overlap, 0) >= 3 THEN doc_category END AS doc_category, {sql_map('predicate', R.EXPECTED_CATEGORY, quoted(''))} AS expected FROM cl LEFT JOIN bs USING (claim_id)),
vr AS (SELECT *, CASE WHEN doc_category IS NULL THEN 'not_disclosed' WHEN doc_category IN {R.CONTRADICTING} THEN 'contradicted' WHEN expected <> '' AND doc_category <> expected THEN 'not_disclosed' ELSE 'corroborated' END AS verdict FROM vd)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh leads against pages as the disclosures of their code."""
    claims = _fresh(spark, sf_dir).withColumn("predicate", classify.predicate(LATIN, "claim", "evidence")).select(F.col("fact_id").alias("claim_id"), "code", "subject", "claim", classify.mapped(F.col("predicate"), R.EXPECTED_CATEGORY, "").alias("expected"))
    p = V.table(spark, sf_dir, "pages")
    category = F.element_at(F.array(F.lit("重大合同/中标"), F.lit("诉讼/风险/处罚"), F.lit("对外投资")), (F.col("page_id") % 3 + 1).cast("int"))
    docs = p.select(F.concat(F.lit("600"), F.lpad((F.col("page_id") % 20).cast("string"), 3, "0")).alias("code"), F.col("page_id").alias("doc_id"), category.alias("category"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return verify.cross_check(claims, docs)


@query(f"WITH {_CHECKED} SELECT claim_id, code, overlap::BIGINT AS overlap, doc_category, verdict FROM vr")
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("claim_id", "code", F.col("overlap").cast("long").alias("overlap"), "doc_category", "verdict")


@query(f"WITH {_CHECKED} SELECT code, arg_max(verdict, (CASE verdict WHEN 'contradicted' THEN 3 WHEN 'corroborated' THEN 2 ELSE 1 END, -claim_id)) AS verdict, count(*) AS members FROM vr GROUP BY code")
def best_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.best_verdict(_checked(spark, sf_dir), "code", "claim_id")


@query()
def event_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh leads grouped into events; sequential, so tests hold it against a plain loop."""
    leads = _fresh(spark, sf_dir).withColumn("grams", verify.event_grams(F.col("claim"), F.col("subject")))
    return verify.cluster_events(leads)
