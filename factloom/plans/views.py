"""The driver's tables in the shapes that the operators read, in Spark and, equal to them, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.rules import LATIN, pattern
from ..operators.classify import mapped

KINDS = list(R.BASELINE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_map(key: str, table_: dict, default: str) -> str:
    """A rule table as CASE."""
    lit = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table_.items()) + f" ELSE {default} END"


def sql_first(text: str, table_: dict | tuple, default: str, plain: bool = False) -> str:
    """The first name whose words are in the text, as CASE."""
    pairs = table_.items() if isinstance(table_, dict) else table_
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {quoted('|'.join(w) if plain else pattern(tuple(w)))}) THEN {quoted(n)}" for n, w in pairs) + f" ELSE {default} END"


def sql_count(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({text}, {quoted(w)})::INT" for w in words) + ")"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as findings: the first line is the claim, the rest of the text the evidence; every number in the text counts."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    claim = F.substring_index(text, "\n", 1)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.coalesce(F.regexp_extract("source", r"(\d+)", 1).try_cast("int"), F.lit(0)) % len(KINDS)) + 1)
    d = d.select(F.col("doc_id").alias("fact_id"), "lang", "source", claim.alias("claim"), F.substring(text, F.length(claim) + 2, F.length(text)).alias("evidence"), kind.alias("kind"))
    nums = F.regexp_extract_all(F.concat_ws(" ", "claim", "evidence"), F.lit(r"(\d+\.?\d*)"), 1)
    return d.withColumn("nums", nums)


FINDINGS = f"""
f AS (SELECT *, regexp_extract_all(claim || ' ' || evidence, '(\\d+\\.?\\d*)', 1) AS nums, lower(claim || ' ' || evidence) AS txt FROM (
  SELECT doc_id AS fact_id, lang, source, split_part(coalesce(text, ''), chr(10), 1) AS claim,
    substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS evidence,
    {KINDS!r}[(coalesce(try_cast(regexp_extract(source, '(\\d+)', 1) AS INT), 0) % {len(KINDS)}) + 1] AS kind FROM documents))"""


def predicate_sql(rules: R.RuleSet = LATIN) -> str:
    return sql_first("txt", {p: rules.hard[p] for p in R.PRIORITY}, "'HAS_CATALYST'")


def category_sql(rules: R.RuleSet = LATIN) -> str:
    hard = "|".join(pattern(w) for w in rules.hard.values())
    structure = "|".join("|".join(w) for w in rules.structure.values())
    return f"""CASE WHEN regexp_matches(txt, {quoted(pattern(rules.quant))}) AND regexp_matches(txt, '\\d') THEN 'quant_fact'
      WHEN regexp_matches(txt, {quoted(hard)}) AND (regexp_matches(txt, {quoted(rules.date)}) OR len(nums) > 0) THEN 'hard_fact'
      WHEN regexp_matches(txt, {quoted(structure)}) THEN 'structure' ELSE 'background' END"""


_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
PREDICATES = {v: k for k, v in R.PROGRESSION.items()}
LEVELS = ["D", "C", "B", "B+", "A"]


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as occurrences of facts about parts."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    strength = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "N", 2).when(F.col("l_linestatus") == "O", 3).otherwise(4)
    seq = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*_ORDER)).cast("long")
    out = li.select(F.col("l_partkey").alias("canonical_id"), (F.col("l_suppkey") % 3).alias("object"), strength.alias("strength"), F.col("l_orderkey").cast("string").alias("source"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("valid_at"), seq.alias("seq"), (F.col("l_quantity") < 25).alias("unverifiable"), F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.pmod("l_linenumber", F.lit(5)).cast("int") + 1).alias("level"))
    return out.withColumn("predicate", mapped(F.col("strength"), PREDICATES))


OCCURRENCES = f"""
o AS (SELECT *, {sql_map("strength", PREDICATES, "NULL")} AS predicate FROM (
  SELECT l_partkey AS canonical_id, l_suppkey % 3 AS object, CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'N' THEN 2 WHEN l_linestatus = 'O' THEN 3 ELSE 4 END AS strength,
    l_orderkey::VARCHAR AS source, strftime(l_shipdate, '%Y-%m-%d') AS valid_at, row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(_ORDER)}) AS seq,
    l_quantity < 25 AS unverifiable, {LEVELS!r}[l_linenumber % 5 + 1] AS level FROM lineitem))"""
RANK = lambda c, d=-1: sql_map(c, R.GRADE_RANK, str(d))
FOLD = f"""
facts AS (SELECT canonical_id, predicate, object, list_sort(list(DISTINCT source)) AS sources, arg_max(level, {RANK("level")}) AS level, min(valid_at) AS valid_at,
  count(*) AS occurrences, bool_and(unverifiable) AS unverifiable, greatest(count(DISTINCT source), 1) AS votes FROM o GROUP BY ALL)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers supply parts; orders are the sources."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.when(F.col("l_linestatus") == "O", "SUPPLIES").otherwise("UPSTREAM_OF").alias("rel_type"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_orderkey").alias("source"))


EDGES = """
e AS (SELECT 's' || l_suppkey AS src, CASE WHEN l_linestatus = 'O' THEN 'SUPPLIES' ELSE 'UPSTREAM_OF' END AS rel_type, 'p' || l_partkey AS dst, l_orderkey AS source FROM lineitem),
ev AS (SELECT src, rel_type, dst, greatest(count(DISTINCT source), 1) AS votes FROM e GROUP BY ALL)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers as mentions of entities: parts with synthetic codes (every other one), suppliers as companies."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, "stock").otherwise("product").alias("kind"), F.when(F.col("p_size") % 2 == 0, F.lpad(((F.col("p_partkey") * 7919) % 1000000).cast("string"), 6, "0")).alias("code"), F.col("p_partkey").alias("seq"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("company").alias("kind"), F.lit(None).cast("string").alias("code"), (F.col("s_suppkey") + 10_000_000_000).alias("seq"))
    return p.union(s)


_CODE = """CASE WHEN length(code) <> 6 THEN 'stock_pending:' || code WHEN code LIKE '920%' THEN 'BJ' || code WHEN code[1] IN ('6', '5') THEN 'SH' || code
  WHEN code[1] IN ('0', '3', '2') OR code[1:2] IN ('15', '16', '18') THEN 'SZ' || code WHEN code[1] = '9' THEN 'SH' || code WHEN code[1] IN ('8', '4') THEN 'BJ' || code ELSE 'stock_pending:' || code END"""
NORMAL = lambda c: f"translate(lower(coalesce({c}, '')), {quoted(R.DROPPED)}, '')"
GARBAGE = lambda n, k: f"(CASE WHEN trim({n}) = '' THEN true WHEN {k} IN ('stock', 'fund', 'index') THEN false ELSE regexp_matches(trim({n}), {quoted(LATIN.garbage['date'])}) OR regexp_matches(trim({n}), {quoted(LATIN.garbage['legal'])}) OR regexp_matches(trim({n}), {quoted(LATIN.garbage['market'])}) OR trim({n}) IN ({', '.join(map(quoted, LATIN.generic))}) OR ({k} IN ('concept', 'material') AND regexp_matches(trim({n}), {quoted(LATIN.garbage['number'])})) END)"
MENTIONS = f"""
m AS (SELECT p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'stock' ELSE 'product' END AS kind, CASE WHEN p_size % 2 = 0 THEN lpad(((p_partkey * 7919) % 1000000)::VARCHAR, 6, '0') END AS code, p_partkey AS seq FROM part
  UNION ALL SELECT s_name, 'company', NULL, s_suppkey + 10000000000 FROM supplier),
r AS (SELECT alias, arg_min(canonical_id, seq) AS canonical_id, arg_min(kind, seq) AS kind, arg_min(name, seq) AS display, min(seq) AS seq FROM (
  SELECT {NORMAL("name")} AS alias, CASE WHEN code IS NOT NULL THEN {_CODE} WHEN kind = 'stock' THEN 'stock_pending:' || lower(trim(name)) ELSE kind || ':' || trim(name) END AS canonical_id, kind, name, seq
  FROM m WHERE code IS NOT NULL OR NOT {GARBAGE("name", "kind")}) WHERE alias <> '' GROUP BY alias)"""
SECURITY = lambda c: f"regexp_matches({c}, '^((SH|SZ|BJ)\\d|company:|stock_pending:)')"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a price series per user: value is both close and volume."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("code"), "ts", F.col("event_id").alias("tie"), F.col("value").alias("close"), F.col("value").alias("volume"))


SERIES = "s AS (SELECT user_id AS code, ts, event_id AS tie, value AS close, value AS volume FROM events)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sentiment items: purchases and signups are bullish, errors bearish."""
    e = table(spark, sf_dir, "events")
    stance = F.when(F.col("event_type").isin("purchase", "signup"), "bullish").when(F.col("event_type") == "error", "bearish").otherwise("neutral")
    return e.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("canonical_id"), stance.alias("stance"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "ts", F.col("event_id").alias("seq"))


ITEMS = """
i AS (SELECT event_id AS item_id, user_id AS canonical_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'bullish' WHEN event_type = 'error' THEN 'bearish' ELSE 'neutral' END AS stance,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, ts, event_id AS seq FROM events)"""
GRAMS = lambda c: f"list_distinct(list_concat(regexp_extract_all(lower({c}), '([a-z0-9]{{2,}})', 1), flatten(list_transform(regexp_extract_all({c}, '([一-鿿]+)', 1), lambda x: CASE WHEN length(x) = 1 THEN [x] ELSE list_transform(range(1, length(x)), lambda k: substr(x, k, 2)) END))))"
