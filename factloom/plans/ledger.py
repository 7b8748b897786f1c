"""Queries over the fact ledger, the relation graph and the entity registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import LATIN
from ..operators import classify, entities, graph, ledger
from . import views as V
from .registry import query
from .views import EDGES, FOLD, MENTIONS, NORMAL, OCCURRENCES, RANK, SECURITY, quoted


@query(f"WITH {OCCURRENCES}, {FOLD} SELECT canonical_id, predicate, object, array_to_string(sources, ',') AS sources, level, valid_at, occurrences, unverifiable, votes FROM facts")
def fact_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.fold(V.occurrences(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {OCCURRENCES}, {FOLD} SELECT canonical_id, predicate, object, level, votes FROM facts ORDER BY {RANK('level')} DESC, votes DESC, canonical_id, predicate, object LIMIT 120")
def fact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 120 best facts by grade and votes."""
    return ledger.query(ledger.fold(V.occurrences(spark, sf_dir)), 120).select(*ledger.KEY, "level", "votes")


# each occurrence's segment, and the first stronger, not older one of another fact of the entity within it
_STATUS = f"""{OCCURRENCES},
seg AS (SELECT canonical_id, predicate, object, strength, seq, lead(seq) OVER w AS next_seq, min(valid_at) OVER (w ROWS UNBOUNDED PRECEDING) AS valid_from FROM o WINDOW w AS (PARTITION BY canonical_id, predicate, object ORDER BY seq)),
hit AS (SELECT s.canonical_id, s.predicate, s.object, s.seq, min(n.seq) AS by_seq FROM seg s JOIN o n ON n.canonical_id = s.canonical_id AND n.seq > s.seq AND (s.next_seq IS NULL OR n.seq < s.next_seq)
  AND n.strength > s.strength AND n.object = s.object AND n.valid_at >= s.valid_from GROUP BY ALL),
sup AS (SELECT s.*, h.by_seq, n.valid_at AS by_at, n.predicate AS by_predicate, n.object AS by_object FROM seg s LEFT JOIN hit h USING (canonical_id, predicate, object, seq) LEFT JOIN o n ON n.canonical_id = s.canonical_id AND n.seq = h.by_seq),
st AS (SELECT canonical_id, predicate, object, CASE WHEN arg_max(by_seq IS NOT NULL, seq) THEN 'superseded' ELSE 'active' END AS status,
  max(by_at) FILTER (next_seq IS NULL) AS invalid_at, count(*) FILTER (by_seq IS NOT NULL AND next_seq IS NOT NULL) AS revivals FROM sup GROUP BY ALL)"""


def _same() -> F.Column:
    return F.col("object") == F.col("by_object")


@query(f"WITH {_STATUS} SELECT canonical_id, predicate, object, status, invalid_at FROM st")
def supersede_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.status(V.occurrences(spark, sf_dir), _same()).drop("revivals")


@query(f"WITH {_STATUS} SELECT canonical_id, predicate, object, status, revivals FROM st WHERE revivals > 0")
def fact_revive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that came back after having been superseded."""
    return ledger.status(V.occurrences(spark, sf_dir), _same()).filter("revivals > 0").drop("invalid_at")


@query(f"WITH {_STATUS} SELECT canonical_id, by_predicate AS predicate, by_object AS object, array_to_string(list_sort(list(DISTINCT predicate || '|' || object)), ',') AS supersedes FROM sup WHERE by_seq IS NOT NULL GROUP BY ALL")
def supersede_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.lineage(V.occurrences(spark, sf_dir), _same())
    return found.select("canonical_id", F.col("by_predicate").alias("predicate"), F.col("by_object").alias("object"), F.array_join("supersedes", ",").alias("supersedes"))


@query(f"WITH {_STATUS}, {FOLD}, j AS (SELECT status, level FROM facts JOIN st USING (canonical_id, predicate, object)) SELECT CASE WHEN grouping(status, level) = 1 THEN 'status' WHEN grouping(status, level) = 2 THEN 'level' ELSE 'total' END AS section, coalesce(status, level, '') AS name, count(*) AS n FROM j GROUP BY GROUPING SETS ((status), (level), ())")
def fact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.occurrences(spark, sf_dir)
    return ledger.stats(ledger.fold(log).join(ledger.status(log, _same()), ledger.KEY))


@query("""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'invalidated' WHEN 'click' THEN 'disputed' ELSE 'active' END AS event, strftime(ts, '%Y-%m-%d') AS day FROM events),
l AS (SELECT user_id, arg_max(event, event_id) AS event, arg_max(day, event_id) AS day FROM e GROUP BY 1)
SELECT c_custkey AS id, coalesce(event, 'active') AS status, CASE WHEN event = 'invalidated' THEN day END AS invalid_at FROM customer LEFT JOIN l ON user_id = c_custkey""")
def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as facts; their events contradict, dispute or revive them, and the latest one counts."""
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("event_seq"), F.when(F.col("event_type") == "error", "invalidated").when(F.col("event_type") == "click", "disputed").otherwise("active").alias("event"), F.date_format("ts", "yyyy-MM-dd").alias("at"))
    return ledger.apply_events(V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), e, "id")


@query(f"WITH {_STATUS}, {FOLD} SELECT canonical_id, predicate, object, CASE WHEN status = 'active' AND valid_at < '1995-01-01' THEN 'expired' ELSE status END AS status FROM facts JOIN st USING (canonical_id, predicate, object)")
def expire_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = V.occurrences(spark, sf_dir)
    facts = ledger.fold(log).join(ledger.status(log, _same()), ledger.KEY)
    return ledger.expire_before(facts, "1995-01-01").select(*ledger.KEY, "status")


@query(f"WITH {OCCURRENCES}, {FOLD} SELECT DISTINCT s AS source FROM (SELECT unnest(sources) AS s, level FROM facts) WHERE level = 'A'")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of the facts graded A."""
    return ledger.fold(V.occurrences(spark, sf_dir)).filter("level = 'A'").select(F.explode("sources").alias("source")).distinct()


@query(f"WITH {EDGES} SELECT *, votes < 2 AS low_confidence FROM ev")
def edge_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.votes(V.edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT coalesce(rel_type, 'total') AS rel_type, count(*) AS edges, count(*) FILTER (votes < 2) AS low FROM ev GROUP BY ROLLUP (rel_type)")
def edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(graph.votes(V.edges(spark, sf_dir)))


@query(f"""WITH {EDGES}, n AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_size > 40)
SELECT node, dst AS other, rel_type, votes FROM ev JOIN n ON src = node UNION ALL SELECT node, src, rel_type, votes FROM ev JOIN n ON dst = node""")
def graph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of well-funded suppliers and large parts."""
    s = V.table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("s"), "s_suppkey").alias("node"))
    p = V.table(spark, sf_dir, "part").filter("p_size > 40").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    return graph.neighbours(graph.votes(V.edges(spark, sf_dir)), s.union(p))


_CODES = """c AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'sh' || lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0') WHEN 1 THEN lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0') || '.OF' WHEN 2 THEN (p_partkey % 1000)::VARCHAR ELSE lpad((p_partkey * 7919 % 1000000)::VARCHAR, 6, '0') END AS code FROM part)"""


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.lpad((F.col("p_partkey") * 7919 % 1000000).cast("string"), 6, "0")
    code = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("sh"), number)).when(F.col("p_size") % 5 == 1, F.concat(number, F.lit(".OF"))).when(F.col("p_size") % 5 == 2, (F.col("p_partkey") % 1000).cast("string")).otherwise(number)
    return V.table(spark, sf_dir, "part").select("p_partkey", code.alias("code"))


@query(f"""WITH {_CODES}, d AS (SELECT p_partkey, upper(code) AS code, regexp_replace(code, '\\D', '', 'g') AS d FROM c)
SELECT p_partkey, CASE WHEN contains(code, '.OF') THEN 'fund:' || d WHEN regexp_matches(code, '^(SH|SZ|BJ)\\d+$') THEN code WHEN length(d) <> 6 THEN 'stock_pending:' || lower(code) WHEN d LIKE '920%' THEN 'BJ' || d
  WHEN d[1] IN ('6', '5') THEN 'SH' || d WHEN d[1] IN ('0', '3', '2') OR d[1:2] IN ('15', '16', '18') THEN 'SZ' || d WHEN d[1] = '9' THEN 'SH' || d WHEN d[1] IN ('8', '4') THEN 'BJ' || d ELSE 'stock_pending:' || d END AS market_code FROM d""")
def market_code_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("p_partkey", classify.market_code(F.col("code")).alias("market_code"))


@query(f"""WITH {_CODES}, d AS (SELECT p_partkey, regexp_replace(code, '\\D', '', 'g') AS d, regexp_extract(upper(code), '(SH|SZ|BJ)?[^0-9]*(\\d{{6}})', 1) AS m, regexp_extract(upper(code), '(SH|SZ|BJ)?[^0-9]*(\\d{{6}})', 2) AS n FROM c),
v AS (SELECT *, CASE WHEN m <> '' THEN m WHEN n[1] IN ('6', '9') THEN 'SH' WHEN n[1] IN ('4', '8') THEN 'BJ' ELSE 'SZ' END AS k FROM d)
SELECT p_partkey, CASE WHEN d[1] IN ('6', '9') THEN 'sh' WHEN d[1] IN ('0', '3', '2') THEN 'sz' WHEN d[1] IN ('8', '4') THEN 'bj' ELSE '' END AS plate,
  CASE WHEN n = '' THEN '' ELSE lower(k) || n END AS lower_code, CASE WHEN n = '' THEN '' ELSE n || '.' || k END AS dotted_code FROM v""")
def vendor_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _codes(spark, sf_dir).withColumn("v", classify.vendor_codes(F.col("code")))
    return out.select("p_partkey", classify.plate(F.col("code")).alias("plate"), F.col("v.lower").alias("lower_code"), F.col("v.dotted").alias("dotted_code"))


@query(f"WITH {MENTIONS} SELECT alias, canonical_id, kind, display, seq FROM r")
def entity_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.register(LATIN, V.mentions(spark, sf_dir))


@query(f"""WITH {MENTIONS}, q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN p_name ELSE s_name END AS name, l_suppkey * 100000000 + l_orderkey AS seq FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN r.seq <= q.seq THEN canonical_id ELSE {quoted(entities.UNKNOWN_ID)} END AS canonical_id FROM q LEFT JOIN r ON alias = {NORMAL('name')}""")
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in line items looked up at a time of their own; earlier than the registration they are unknown."""
    li = V.table(spark, sf_dir, "lineitem").join(V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").join(V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    q = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linestatus") == "O", F.col("p_name")).otherwise(F.col("s_name")).alias("name"), (F.col("l_suppkey") * 100000000 + F.col("l_orderkey")).alias("seq"))
    return entities.resolve(entities.register(LATIN, V.mentions(spark, sf_dir)), q).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "canonical_id")


@query(f"WITH {MENTIONS} SELECT DISTINCT display AS term FROM r WHERE kind IN ('stock', 'company')")
def watch_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.watch_terms(entities.register(LATIN, V.mentions(spark, sf_dir)), ("stock", "company"))


@query(f"WITH {MENTIONS} SELECT count(*) AS entities, count(*) FILTER (canonical_id LIKE 'stock_pending:%') AS pending FROM (SELECT DISTINCT canonical_id FROM r)")
def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.stats(entities.register(LATIN, V.mentions(spark, sf_dir)))


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 AND p_partkey > 10 THEN p_partkey // 3 + 1 END AS into_id FROM part),
walk(id, here, n) AS (SELECT id, id, 0 FROM m UNION ALL SELECT w.id, m.into_id, n + 1 FROM walk w JOIN m ON m.id = w.here WHERE m.into_id IS NOT NULL)
SELECT id, arg_max(here, n) AS final FROM walk GROUP BY id""")
def merge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts are merged into one of a third of their number, over and over."""
    p = V.table(spark, sf_dir, "part")
    merges = p.filter("p_size > 25 and p_partkey > 10").select(F.col("p_partkey").alias("from_id"), F.expr("p_partkey div 3 + 1").alias("into_id"))
    return entities.follow_merges(p.select(F.col("p_partkey").alias("id")), merges)


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of the conversations as aliases: those of even length are securities, the others concepts; CRC32 codes them."""
    w = V.table(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("alias")).filter(F.length("alias") >= 4).distinct()
    code = F.concat(F.lit("SH6"), F.lpad((F.conv(F.substring(F.md5(F.col("alias").cast("binary")), 1, 5), 16, 10).cast("long") % 100000).cast("string"), 5, "0"))
    return w.select("alias", F.when(F.length("alias") % 2 == 0, code).otherwise(F.concat(F.lit("concept:"), "alias")).alias("canonical_id"))


_ALIASES = """a AS (SELECT alias, CASE WHEN length(alias) % 2 = 0 THEN 'SH6' || lpad((('0x' || substr(md5(alias), 1, 5))::BIGINT % 100000)::VARCHAR, 5, '0') ELSE 'concept:' || alias END AS canonical_id
  FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS alias FROM conversations) WHERE length(alias) >= 4)"""
# page slugs are the queries; an alias of ASCII letters counts at word borders only
_MATCHES = f"""{_ALIASES}, q AS (SELECT page_id AS qid, {NORMAL("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS q0, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages),
qs AS (SELECT qid, q0, ' ' || regexp_replace(q0, '[^a-z0-9]', ' ', 'g') || ' ' AS q FROM q),
mt AS (SELECT DISTINCT qid, alias, canonical_id, {SECURITY('canonical_id')} AS security FROM qs JOIN a ON contains(q, ' ' || alias || ' ')),
ok AS (SELECT * FROM mt WHERE NOT (security AND EXISTS (SELECT 1 FROM mt n WHERE n.qid = mt.qid AND NOT n.security AND length(mt.alias) < length(n.alias) AND contains(n.alias, mt.alias))))"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = V.table(spark, sf_dir, "pages").select(F.col("page_id").alias("qid"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))
    return entities.matches(q, _aliases(spark, sf_dir))


@query(f"WITH {_MATCHES}, c AS (SELECT qid, alias, canonical_id, 1 AS tier FROM ok WHERE security UNION ALL SELECT qid, alias, canonical_id, 0 FROM mt) SELECT qid, canonical_id FROM c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY tier DESC, length(alias) DESC, alias, canonical_id) = 1")
def entity_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles as questions, conversation words as aliases."""
    return entities.locate(_matches(spark, sf_dir))


@query(f"WITH {_MATCHES} SELECT qid, alias, security FROM ok")
def entity_hijack_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.not_hijacked(_matches(spark, sf_dir)).select("qid", "alias", "security")


@query(f"""WITH {_ALIASES}, w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(html), '[^a-z]+')) AS qid FROM pages),
h AS (SELECT qid, canonical_id FROM w JOIN a ON length(alias) = length(qid) AND length(qid) BETWEEN 2 AND 8 AND canonical_id LIKE 'SH%' AND hamming(alias, qid) = 1)
SELECT qid, min(canonical_id) AS canonical_id FROM h GROUP BY qid HAVING count(DISTINCT canonical_id) = 1""")
def fuzzy_hamming1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page words as misspelt names."""
    w = V.table(spark, sf_dir, "pages").select(F.explode(F.split(F.lower("html"), "[^a-z]+")).alias("qid")).distinct()
    return entities.fuzzy(w.select("qid", F.col("qid").alias("text")), _aliases(spark, sf_dir))
