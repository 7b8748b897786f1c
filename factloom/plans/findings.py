"""Queries over findings: scalar functions, classification, grades, cards, attribution and doubts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions.rules import CHINESE, LATIN, pattern
from ..operators import attribution, classify, critique, hypothesis
from ..sources import cards
from . import views as V
from .registry import query
from .views import FINDINGS, GRAMS, NORMAL, quoted, sql_count, sql_first, sql_map


def joined(c) -> F.Column:
    return F.array_join(F.array_sort(c), " ")


@query(f"SELECT doc_id, {NORMAL('text')} AS normal FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, array_to_string(list_sort({GRAMS('text')}), ' ') AS grams FROM documents")
def content_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", joined(T.content_grams(F.col("text"))).alias("grams"))


@query(f"""WITH {FINDINGS}, g AS (SELECT fact_id, {GRAMS('claim')} AS a, {GRAMS('evidence')} AS b FROM f)
SELECT fact_id, len(list_intersect(a, b))::BIGINT AS shared, CASE WHEN least(len(a), len(b)) > 0 THEN round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) ELSE 0.0 END AS coefficient,
  round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS coverage FROM g""")
def gram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.findings(spark, sf_dir).select("fact_id", T.content_grams(F.col("claim")).alias("a"), T.content_grams(F.col("evidence")).alias("b"))
    return f.select("fact_id", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.round(T.overlap_coefficient(F.col("a"), F.col("b")), 6).alias("coefficient"), F.round(T.coverage(F.col("a"), F.col("b")), 6).alias("coverage"))


@query(f"WITH {FINDINGS} SELECT fact_id, substr(sha1(source || '|' || {V.predicate_sql()} || '|' || {NORMAL('substr(claim, 1, 80)')}), 1, 16) AS stable_id FROM f")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact ids: a claim's first 80 characters are its object."""
    f = V.findings(spark, sf_dir)
    return f.select("fact_id", T.stable_id(F.col("source"), classify.predicate(LATIN, "claim", "evidence"), T.normalize(F.substring("claim", 1, 80))).alias("stable_id"))


@query(r"SELECT doc_id, try_cast(nullif(regexp_extract(text, '(-?\d+\.?\d*)', 1), '') AS DOUBLE) AS num FROM documents")
def parse_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", T.parse_num(F.col("text")).alias("num"))


@query(r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y.%m') || '-' || (2020 + l_quantity::INT % 15) AS span,
  CASE WHEN year(l_shipdate) >= 2000 AND 2020 + l_quantity::INT % 15 >= year(l_shipdate) THEN (2020 + l_quantity::INT % 15 - year(l_shipdate))::DOUBLE END AS years FROM lineitem""")
def backtest_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = V.table(spark, sf_dir, "lineitem")
    out = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.date_format("l_shipdate", "yyyy.MM"), F.lit("-"), (F.col("l_quantity").cast("int") % 15 + 2020).cast("string")).alias("span"))
    return out.withColumn("years", T.backtest_years(F.col("span")))


@query(f"""SELECT conv_id, turn, array_to_string((SELECT list(x ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT unnest(t) AS x, generate_subscripts(t, 1) AS p) GROUP BY x ORDER BY p LIMIT 24)), ' ') AS tokens
FROM (SELECT conv_id, turn, list_concat(list_filter(regexp_split_to_array(text, '[\\s,，、;；。]+'), lambda x: length(x) BETWEEN 2 AND 40), list_sort({GRAMS('text')})) AS t FROM conversations)""")
def recall_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each turn as a question: its pieces, then its grams (here by name), 24 at most."""
    c = V.table(spark, sf_dir, "conversations")
    pieces = F.filter(F.split("text", r"[\s,，、;；。]+"), lambda x: F.length(x).between(2, 40))
    return c.select("conv_id", "turn", F.array_join(F.slice(F.array_distinct(F.concat(pieces, F.array_sort(T.content_grams(F.col("text"))))), 1, 24), " ").alias("tokens"))


@query(f"WITH {FINDINGS} SELECT fact_id, {V.category_sql()} AS category FROM f")
def classify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.findings(spark, sf_dir).select("fact_id", classify.category(LATIN, "claim", "evidence", F.col("nums")).alias("category"))


@query(f"WITH {FINDINGS} SELECT fact_id, {V.predicate_sql()} AS predicate FROM f")
def predicate_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.findings(spark, sf_dir).select("fact_id", classify.predicate(LATIN, "claim", "evidence").alias("predicate"))


@query(f"WITH {FINDINGS} SELECT fact_id, {sql_first('txt', LATIN.structure, 'NULL', True)} AS relation FROM f")
def relation_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.findings(spark, sf_dir).select("fact_id", classify.relation(LATIN, "claim", "evidence").alias("relation"))


@query(f"SELECT page_id, {sql_first('title', LATIN.titles, quoted(LATIN.other_title))} AS category FROM (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages)")
def title_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    return p.select("page_id", classify.title_category(LATIN, F.col("title")).alias("category"))


@query(f"SELECT conv_id, turn, CASE WHEN u > d THEN 'bullish' WHEN d > u THEN 'bearish' ELSE 'neutral' END AS stance FROM (SELECT conv_id, turn, {sql_count('lower(text)', LATIN.bullish)} AS u, {sql_count('lower(text)', LATIN.bearish)} AS d FROM conversations)")
def stance_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.stance(LATIN, F.col("text")).alias("stance"))


@query(f"WITH {FINDINGS} SELECT fact_id, CASE WHEN regexp_matches(claim, {quoted(pattern(LATIN.fast))}) THEN '快变量' WHEN regexp_matches(claim, {quoted(pattern(LATIN.slow))}) THEN '慢变量' ELSE '中性' END AS speed FROM f")
def fact_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.findings(spark, sf_dir).select("fact_id", classify.fact_speed(LATIN, F.col("claim")).alias("speed"))


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM documents), k AS (SELECT name, unnest(['concept', 'stock', 'company']) AS kind FROM w) SELECT name, kind, {V.GARBAGE('name', 'kind')} AS garbage FROM k")
def garbage_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents as a name of three types."""
    w = V.table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("name")).distinct()
    k = w.select("name", F.explode(F.array(F.lit("concept"), F.lit("stock"), F.lit("company"))).alias("kind"))
    return k.select("name", "kind", classify.is_garbage(LATIN, F.col("name"), F.col("kind")).alias("garbage"))


@query(f"SELECT page_id, host, regexp_replace(lower(host), '^www\\.', '') IN ({', '.join(map(quoted, R.MEDIA))}) OR " + " OR ".join(f"ends_with(regexp_replace(lower(host), '^www\\.', ''), '.{m}')" for m in R.MEDIA) + " AS authoritative FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'www.' || ['cls.cn', 'news.stcn.com', 'wcls.cn'][page_id % 7 % 3 + 1] ELSE regexp_extract(url, '//([^/?#:]+)', 1) END AS host FROM pages)")
def authoritative_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages, every third replaced by a media-like one."""
    p = V.table(spark, sf_dir, "pages")
    media = F.element_at(F.array(F.lit("cls.cn"), F.lit("news.stcn.com"), F.lit("wcls.cn")), (F.col("page_id") % 7 % 3 + 1).cast("int"))
    host = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("www."), media)).otherwise(F.regexp_extract("url", "//([^/?#:]+)", 1))
    return p.select("page_id", host.alias("host")).withColumn("authoritative", classify.is_authoritative(F.col("host")))


@query(f"WITH {FINDINGS} SELECT fact_id, {sql_map('kind', R.BASELINE, quoted('C'))} AS level FROM f")
def grade_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.findings(spark, sf_dir).select("fact_id", classify.baseline_grade(F.col("kind")).alias("level"))


@query(f"""WITH {FINDINGS}, l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
g AS (SELECT fact_id, {V.predicate_sql()} AS p, {sql_map('kind', R.BASELINE, quoted('C'))} AS base, CASE quality WHEN 1 THEN 'confirmed' WHEN 0 THEN 'refuted' END AS v FROM f LEFT JOIN l ON fact_id = doc_id)
SELECT fact_id, p AS predicate, CASE WHEN p NOT IN {R.VERIFIABLE} THEN base WHEN v = 'confirmed' THEN 'A' WHEN v = 'refuted' THEN 'D' ELSE {sql_map('base', R.DOWNGRADE, 'NULL')} END AS level, p NOT IN {R.VERIFIABLE} OR v IS NULL AS unverifiable FROM g""")
def grade_two_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand in for the outcome of a verification."""
    lab = V.table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("fact_id")).agg(F.max("quality").alias("quality"))
    f = V.findings(spark, sf_dir).select("fact_id", "kind", classify.predicate(LATIN, "claim", "evidence").alias("predicate")).join(lab, "fact_id", "left")
    verified = F.when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "refuted")
    return f.select("fact_id", "predicate", classify.two_track_grade(F.col("kind"), F.col("predicate"), verified).alias("g")).select("fact_id", "predicate", "g.level", "g.unverifiable")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings with numbers: one per line item, its context the line's comment-like flags."""
    li = V.table(spark, sf_dir, "lineitem")
    n = F.struct(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%")).alias("value"), F.concat(F.lit("x"), F.when(F.col("l_returnflag") == "A", "EN").when(F.col("l_returnflag") == "N", "er").otherwise("zz")).alias("context"), F.col("l_linenumber").cast("int").alias("page"), F.when(F.col("l_linestatus") == "O", "ok").otherwise("bad").alias("_v"))
    g = li.groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.collect_list(n).alias("numbers"))
    o = V.table(spark, sf_dir, "orders")
    return o.join(g, o["o_orderkey"] == g["finding_id"]).select("finding_id", F.concat(F.lit("that "), F.col("o_orderpriority")).alias("claim"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("with 2019.1-"), F.date_format("o_orderdate", "yyyy"))).alias("evidence"), F.when(F.col("o_orderstatus") == "P", F.array().cast("array<struct<value:string,context:string,page:int,_v:string>>")).otherwise(F.col("numbers")).alias("numbers"))


_NUMBERED = """
n0 AS (SELECT l_orderkey AS finding_id, l_quantity::INT::DOUBLE AS v, CASE l_returnflag WHEN 'A' THEN 'xen' WHEN 'N' THEN 'xer' ELSE 'xzz' END AS ctx, l_linestatus = 'O' AS ok FROM lineitem),
nf AS (SELECT finding_id, 'that ' || o_orderpriority AS claim, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'with 2019.1-' || year(o_orderdate) END AS evidence, o_orderstatus = 'P' AS bare, year(o_orderdate) AS y, any_ok
  FROM orders JOIN (SELECT finding_id, bool_or(ok) AS any_ok FROM n0 GROUP BY 1) ON o_orderkey = finding_id),
mv AS (SELECT n0.finding_id, CASE ctx WHEN 'xen' THEN 'annual_return' WHEN 'xer' THEN 'ic' END AS metric, v AS value FROM n0 JOIN nf USING (finding_id) WHERE ctx <> 'xzz' AND NOT bare),
th AS (SELECT metric, quantile_cont(value, 0.95) AS high, quantile_cont(value, 0.9) AS medium FROM mv GROUP BY metric HAVING count(*) >= 8),
fl AS (SELECT DISTINCT finding_id, 'over_optimistic' AS kind, CASE WHEN value >= high THEN 'high' ELSE 'medium' END AS severity, metric AS detail FROM mv JOIN th USING (metric) WHERE value >= medium
  UNION ALL SELECT finding_id, 'no_source', 'high', '' FROM nf WHERE bare
  UNION ALL SELECT finding_id, 'speculative', 'medium', 'that' FROM nf WHERE bare OR NOT any_ok
  UNION ALL SELECT finding_id, 'backtest_weak', 'medium', '' FROM nf WHERE NOT bare
  UNION ALL SELECT finding_id, 'backtest_weak', 'medium', (y - 2019)::VARCHAR FROM nf WHERE NOT bare AND y >= 2019 AND y - 2019 < 3)"""


@query(f"WITH {_NUMBERED} SELECT nf.finding_id, CASE WHEN bare THEN 0 ELSE (SELECT count(*) FROM n0 WHERE n0.finding_id = nf.finding_id AND ok) END::BIGINT AS verified FROM nf")
def verified_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("finding_id", critique.verified_numbers(F.col("numbers")).cast("long").alias("verified"))


@query(f"WITH {_NUMBERED} SELECT finding_id, metric, value FROM mv")
def extract_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return critique.metrics(LATIN, _numbered(spark, sf_dir))


@query(f"WITH {_NUMBERED} SELECT metric, round(high, 6) AS high, round(medium, 6) AS medium FROM th")
def critique_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = critique.thresholds(critique.metrics(LATIN, _numbered(spark, sf_dir)))
    return t.select("metric", F.round("high", 6).alias("high"), F.round("medium", 6).alias("medium"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _numbered(spark, sf_dir)
    return critique.flags(LATIN, found, critique.thresholds(critique.metrics(LATIN, found)))


@query(f"WITH {_NUMBERED} SELECT finding_id, kind, severity, detail FROM fl")
def critique_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("finding_id", F.explode("flags").alias("f")).select("finding_id", "f.kind", "f.severity", "f.detail")


@query(f"WITH {_NUMBERED} SELECT finding_id, max(CASE severity WHEN 'high' THEN 3 ELSE 2 END)::BIGINT AS severity, count(*) AS n_flags FROM fl GROUP BY 1 ORDER BY severity DESC, finding_id LIMIT 15")
def critique_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen most doubted findings."""
    return critique.most_doubted(_flagged(spark, sf_dir), 15).select("finding_id", F.col("severity").cast("long").alias("severity"), F.size("flags").cast("long").alias("n_flags"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cards: their lines are findings, their customer the broker, parts and suppliers the entities; every line also a factor."""
    # lines are dealt to their orders before they get names and become findings, once and not as two lists and two sets
    lines = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus").repartition("l_orderkey")
    li = lines.join(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").join(V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    g = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice").alias("k"), "p_name", "s_name", "l_returnflag", "l_linestatus")).alias("lines"))

    def finding(x: Column) -> Column:
        return F.struct(F.concat(x["p_name"], F.when(x["l_returnflag"] == "R", " with ").otherwise(" of "), x["s_name"]).alias("claim"), x["l_linestatus"].alias("evidence"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<struct<value:string,context:string,page:int,_v:string>>").alias("numbers"), x["k"]["l_linenumber"].cast("int").alias("page"), F.lit("").alias("confidence"))

    def factor(x: Column) -> Column:
        # a map can't be ordered, its entries can
        entries = F.array(F.struct(F.lit("ic").alias("key"), x["k"]["l_quantity"].cast("int").cast("string").alias("value")))
        return F.struct(x["k"].alias("k"), entries.alias("perf"), F.concat(F.lit("f"), x["k"]["l_linenumber"].cast("string")).alias("name"), x["l_returnflag"].alias("intuition"), x["k"]["l_linenumber"].cast("int").alias("page"))

    named = lambda c, kind: F.array_sort(F.array_distinct(F.transform("lines", lambda x: F.struct(x[c].alias("name"), F.lit(kind).alias("kind"), F.lit("").alias("code")))))
    findings = F.transform(F.array_sort(F.transform("lines", lambda x: F.struct(x["k"].alias("k"), finding(x).alias("v")))), lambda x: x["v"])
    factors = F.transform(F.array_sort(F.transform("lines", factor)), lambda x: F.struct(x["name"].alias("name"), x["intuition"].alias("intuition"), F.lit("").alias("formula"), F.map_from_entries(x["perf"]).alias("performance"), x["page"].alias("page")))
    g = g.select("o_orderkey", findings.alias("findings"), factors.alias("factors"), named("p_name", "stock").alias("parts"), named("s_name", "company").alias("sups"))
    o = V.table(spark, sf_dir, "orders").join(g, "o_orderkey")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "P", "minutes").when(F.col("o_orderstatus") == "F", "company").otherwise("quant").alias("type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.concat(F.lit("broker"), F.col("o_custkey").cast("string"))).alias("broker"), F.get("parts", 0)["name"].alias("title"), F.concat("parts", "sups").alias("entities"), "findings", "factors")


_CARDS = """
li AS (SELECT l.*, p_name, s_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) - 1 AS rn, count(*) OVER (PARTITION BY l_orderkey) AS nl
  FROM lineitem l JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
cards AS (SELECT o_orderkey::VARCHAR AS doc_id, CASE o_orderstatus WHEN 'P' THEN 'minutes' WHEN 'F' THEN 'company' ELSE 'quant' END AS card_type, strftime(o_orderdate, '%Y-%m-%d') AS valid_at,
  CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE 'broker' || o_custkey END AS broker, o_orderkey FROM orders),
flat AS (SELECT c.*, rn AS pos, p_name || CASE WHEN l_returnflag = 'R' THEN ' with ' ELSE ' of ' END || s_name AS claim, l_linestatus AS evidence, l_linenumber AS page, 0 AS n_numbers, '' AS own FROM cards c JOIN li ON l_orderkey = o_orderkey
  UNION ALL SELECT c.*, nl + rn, '因子「f' || l_linenumber || '」' || l_returnflag, 'ic=' || l_quantity::INT, l_linenumber, 1, 'f' || l_linenumber FROM cards c JOIN li ON l_orderkey = o_orderkey)"""


@query(f"WITH {_CARDS} SELECT doc_id, pos::BIGINT AS pos, claim, evidence, page::BIGINT AS page, n_numbers::BIGINT AS n_numbers, own, CASE card_type WHEN 'minutes' THEN 'expert_meeting' ELSE 'broker_research' END AS source_kind, valid_at, broker FROM flat")
def card_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cards.findings(_cards(spark, sf_dir))
    return f.select("doc_id", F.col("pos").cast("long").alias("pos"), "claim", "evidence", F.col("page").cast("long").alias("page"), F.size("numbers").cast("long").alias("n_numbers"), F.array_join("own", " ").alias("own"), "source_kind", "valid_at", "broker")


# the entities of a card are its distinct parts (stocks) and suppliers (companies); names are tested as the rules say
@query(f"""WITH {_CARDS},
ent AS (SELECT DISTINCT l_orderkey, p_name AS name, 'stock' AS kind FROM li UNION SELECT DISTINCT l_orderkey, s_name, 'company' FROM li),
fit AS (SELECT l_orderkey, name, kind, min(name) FILTER (kind = 'stock') OVER (PARTITION BY l_orderkey) AS title FROM ent JOIN cards ON o_orderkey = l_orderkey
  WHERE kind = 'stock' OR NOT {V.GARBAGE('name', 'kind')}),
titles AS (SELECT l_orderkey, min(p_name) AS title FROM li GROUP BY 1),
ok AS (SELECT e.l_orderkey, e.name, e.kind, t.title FROM ent e JOIN titles t USING (l_orderkey) JOIN cards ON o_orderkey = e.l_orderkey
  WHERE length(trim(name)) >= 2 AND (kind = 'stock' OR NOT {V.GARBAGE('name', 'kind')}) AND NOT ({' OR '.join(f"contains(lower(trim(name)), {quoted(b)})" for b in LATIN.banks)}) AND NOT (broker <> '' AND contains(lower(name), broker))),
ft AS (SELECT *, claim || ' ' || evidence AS t FROM flat),
agg AS (SELECT ft.doc_id, ft.pos, any_value(t) AS t, any_value(card_type) AS card_type, any_value(broker) AS broker, any_value(own) AS own,
  count(name) FILTER (contains(t, name)) AS h, min(name) FILTER (contains(t, name)) AS h1, count(name) FILTER (contains(t, name) AND kind = 'stock') AS hs, min(name) FILTER (contains(t, name) AND kind = 'stock') AS hs1,
  count(name) AS n, min(name) AS n1, count(name) FILTER (contains(title, name)) AS ti, min(name) FILTER (contains(title, name)) AS ti1, count(name) FILTER (contains(title, name) AND kind = 'stock') AS ts, min(name) FILTER (contains(title, name) AND kind = 'stock') AS ts1
  FROM ft LEFT JOIN ok ON ok.l_orderkey = ft.o_orderkey GROUP BY ft.doc_id, ft.pos),
d AS (SELECT *, CASE WHEN card_type = 'company' THEN CASE WHEN ti > 0 THEN CASE WHEN ti = 1 THEN ti1 WHEN ts = 1 THEN ts1 END WHEN n = 1 THEN n1 END END AS main, CASE WHEN h = 1 THEN h1 WHEN h > 1 AND hs = 1 THEN hs1 END AS named FROM agg)
SELECT doc_id, pos::BIGINT AS pos, coalesce(CASE WHEN own <> '' AND NOT {V.GARBAGE('own', "'concept'")} THEN own END,
  CASE WHEN regexp_matches(t, {quoted(LATIN.disclaimer)}) THEN NULL WHEN regexp_matches(t, {quoted(LATIN.anaphor)}) OR (regexp_matches(t, {quoted(LATIN.relationship)}) AND h = 1) THEN main ELSE coalesce(named, main) END, nullif(broker, ''), {quoted(R.UNKNOWN_SUBJECT)}) AS subject FROM d""")
def subject_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = attribution.attribute(LATIN, cards.findings(_cards(spark, sf_dir), rules=LATIN))
    return f.select("doc_id", F.col("pos").cast("long").alias("pos"), "subject")


@query(f"""WITH {_CARDS}, names AS (SELECT l_orderkey, list_concat(list_sort(list(DISTINCT p_name)), list_sort(list(DISTINCT s_name))) AS names FROM li GROUP BY 1)
SELECT doc_id, pos::BIGINT AS pos, array_to_string(list_distinct_in_order[1:2], '|') AS ends FROM (
  SELECT doc_id, pos, list_concat(CASE WHEN own = '' THEN [] ELSE [own] END, list_filter(names, lambda x: contains(claim, x))) AS list_distinct_in_order FROM flat JOIN names ON l_orderkey = o_orderkey)""")
def edge_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cards.findings(_cards(spark, sf_dir))
    ends = attribution.edge_endpoints(F.col("claim"), F.col("own"), F.transform("entities", lambda e: e["name"]))
    return f.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join(ends, "|").alias("ends"))


@query(f"""WITH {FINDINGS}, c AS (SELECT fact_id, {V.category_sql()} AS category, regexp_matches(txt, {quoted(pattern(LATIN.hedge))}) AS doubted FROM f)
SELECT count(*) AS findings, count(*) FILTER (category = 'hard_fact') AS hard_facts, count(*) FILTER (category = 'quant_fact') AS quant_facts, count(*) FILTER (category = 'structure') AS structures, count(*) FILTER (category = 'background') AS background, count(*) FILTER (doubted) AS doubts FROM c""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.findings(spark, sf_dir)
    f = f.select(classify.category(LATIN, "claim", "evidence", F.col("nums")).alias("category"), classify.finding_text("claim", "evidence").rlike(pattern(LATIN.hedge)).alias("doubted"))
    return hypothesis.ingest_report(f)


@query(f"""WITH {FINDINGS}, ev AS (SELECT doc_id % 97 AS hyp_id, CASE WHEN quality = 1 THEN 'for' ELSE 'against' END AS side, {sql_map('kind', R.BASELINE, quoted('C'))} AS grade FROM labels JOIN f ON fact_id = doc_id),
s AS (SELECT hyp_id, count(*) AS n, sum(CASE WHEN side = 'for' THEN {V.RANK('grade', 1)} + 1 ELSE 0 END) AS fw, sum({V.RANK('grade', 1)} + 1) AS w FROM ev GROUP BY 1)
SELECT p_partkey AS hyp_id, coalesce(n, 0)::BIGINT AS n_evidence, CASE WHEN w > 0 THEN round(fw / w, 6) ELSE 0.5 END AS confidence FROM part LEFT JOIN s ON hyp_id = p_partkey""")
def hypothesis_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as hypotheses; labelled documents are evidence."""
    lab, f = V.table(spark, sf_dir, "labels"), V.findings(spark, sf_dir)
    ev = lab.join(f, lab["doc_id"] == f["fact_id"]).select((F.col("doc_id") % 97).alias("hyp_id"), F.when(F.col("quality") == 1, "for").otherwise("against").alias("side"), classify.baseline_grade(F.col("kind")).alias("grade"))
    out = hypothesis.confidence(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hyp_id")), ev)
    return out.select("hyp_id", F.col("n_evidence").cast("long").alias("n_evidence"), F.round("confidence", 6).alias("confidence"))


@query("""WITH r AS (SELECT l_partkey AS hyp_id, arg_max(l_returnflag, l_orderkey * 1000000 + l_linenumber * 10000 + l_suppkey % 10000) AS outcome FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT p_partkey AS hyp_id, coalesce(outcome, 'open') AS status FROM part LEFT JOIN r ON hyp_id = p_partkey""")
def hypothesis_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large line items resolve their part's hypothesis."""
    li = V.table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    resolutions = li.select(F.col("l_partkey").alias("hyp_id"), F.col("l_returnflag").alias("outcome"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 10000 + F.col("l_suppkey") % 10000).alias("seq"))
    return hypothesis.status(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hyp_id")), resolutions)


# texts of four of the rules' own words, a figure and a date, dealt by part and size
_WORDS = sorted({w for words in (*CHINESE.hard.values(), *CHINESE.structure.values(), CHINESE.quant, CHINESE.bullish, CHINESE.bearish, CHINESE.fast, CHINESE.slow, CHINESE.generic, *[t for _, t in CHINESE.titles]) for w in words})
_MORE = ["", "12%", "2026年3月", "第三条", "中国市场", "2025年", "3.5亿", "《公司法》", "HBM3E"]
_G = CHINESE.garbage


@query(f"""WITH t AS (SELECT p_partkey, {_WORDS!r}[p_partkey * 7 % {len(_WORDS)} + 1] AS a, {_WORDS!r}[(p_partkey * 31 + p_size) % {len(_WORDS)} + 1] AS b, {_MORE!r}[p_size % {len(_MORE)} + 1] AS c FROM part),
f AS (SELECT *, a || ' ' || c || ' ' || b AS claim, lower(a || ' ' || c || ' ' || b || ' ') AS txt, regexp_extract_all(c, '(\\d+\\.?\\d*)', 1) AS nums, CASE WHEN p_partkey < 1000 THEN a ELSE c END AS name FROM t)
SELECT p_partkey, {V.category_sql(CHINESE)} AS category, {V.predicate_sql(CHINESE)} AS predicate, {sql_first('txt', CHINESE.structure, 'NULL', True)} AS relation,
  CASE WHEN {sql_count('lower(claim)', CHINESE.bullish)} > {sql_count('lower(claim)', CHINESE.bearish)} THEN 'bullish' WHEN {sql_count('lower(claim)', CHINESE.bullish)} < {sql_count('lower(claim)', CHINESE.bearish)} THEN 'bearish' ELSE 'neutral' END AS stance,
  {sql_first('claim', CHINESE.titles, quoted(CHINESE.other_title))} AS title, CASE WHEN regexp_matches(claim, {quoted(pattern(CHINESE.fast))}) THEN '快变量' WHEN regexp_matches(claim, {quoted(pattern(CHINESE.slow))}) THEN '慢变量' ELSE '中性' END AS speed,
  trim(name) = '' OR regexp_matches(trim(name), {quoted(_G['date'])}) OR regexp_matches(trim(name), {quoted(_G['legal'])}) OR regexp_matches(trim(name), {quoted(_G['market'])}) OR regexp_matches(trim(name), {quoted(_G['number'])}) OR trim(name) IN ({', '.join(map(quoted, CHINESE.generic))}) AS garbage FROM f""")
def chinese_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Chinese rules over texts made of their own words: category, predicate, relation, stance, title, speed and garbage."""
    at = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i + 1).cast("int"))
    key = F.col("p_partkey")
    t = V.table(spark, sf_dir, "part").select("p_partkey", at(_WORDS, key * 7 % len(_WORDS)).alias("a"), at(_WORDS, (key * 31 + F.col("p_size")) % len(_WORDS)).alias("b"), at(_MORE, F.col("p_size") % len(_MORE)).alias("c"))
    f = t.withColumn("claim", F.concat_ws(" ", "a", "c", "b")).withColumn("evidence", F.lit("")).withColumn("nums", F.regexp_extract_all("c", F.lit(r"(\d+\.?\d*)"), 1)).withColumn("name", F.when(key < 1000, F.col("a")).otherwise(F.col("c")))
    claim = F.col("claim")
    return f.select(
        "p_partkey", classify.category(CHINESE, "claim", "evidence", F.col("nums")).alias("category"), classify.predicate(CHINESE, "claim", "evidence").alias("predicate"), classify.relation(CHINESE, "claim", "evidence").alias("relation"),
        classify.stance(CHINESE, claim).alias("stance"), classify.title_category(CHINESE, claim).alias("title"), classify.fact_speed(CHINESE, claim).alias("speed"), classify.is_garbage(CHINESE, F.col("name"), F.lit("concept")).alias("garbage"),
    )
