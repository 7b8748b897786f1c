"""Queries of the chat lane and of the disclosure source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import LATIN
from ..functions.text import epoch_ms_date
from ..operators import sentiment
from ..sources import cards
from . import views as V
from .registry import query
from .views import ITEMS, sql_count


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chat lines; every third with a date in brackets, every third with a bare one."""
    c = V.table(spark, sf_dir, "conversations")
    day = F.concat(F.lit("2026-06-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"))
    text = F.regexp_replace("text", r"\s+", " ")
    return c.select(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("["), day, F.lit(" 09:30] "), text)).when(F.col("turn") % 3 == 1, F.concat(day, F.lit("\t"), text)).otherwise(text).alias("value"))


_LINES = r"""
ln AS (SELECT trim(v) AS v FROM (SELECT CASE turn % 3 WHEN 0 THEN '[2026-06-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || ' 09:30] ' || t WHEN 1 THEN '2026-06-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || chr(9) || t ELSE t END AS v
  FROM (SELECT conv_id, turn, regexp_replace(text, '\s+', ' ', 'g') AS t FROM conversations)) WHERE trim(v) <> ''),
pr AS (SELECT v, regexp_extract(v, '^\s*\[?(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)\]?\s*[\t,:：]?\s*(.*)$', 1) AS ts, trim(regexp_extract(v, '^\s*\[?(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)\]?\s*[\t,:：]?\s*(.*)$', 2)) AS rest FROM ln),
fr AS (SELECT CASE WHEN ts <> '' AND rest <> '' THEN rest ELSE v END AS text, CASE WHEN ts <> '' AND rest <> '' THEN ts ELSE '' END AS timestamp FROM pr)"""
_TERMS = r"tm AS (SELECT DISTINCT lower(regexp_extract(url, '//(?:[a-z]+\.)?([a-z]+)\.example', 1)) AS term FROM pages WHERE regexp_extract(url, '//(?:[a-z]+\.)?([a-z]+)\.example', 1) <> '')"
_HITS = f"{_LINES}, {_TERMS}, ht AS (SELECT DISTINCT text, timestamp, term FROM fr JOIN tm ON contains(text, term))"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site names are the watched terms."""
    name = F.lower(F.regexp_extract("url", r"//(?:[a-z]+\.)?([a-z]+)\.example", 1))
    return V.table(spark, sf_dir, "pages").select(name.alias("term")).filter("term <> ''").distinct()


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.watch_hits(cards.fragments(_lines(spark, sf_dir)), _terms(spark, sf_dir))


@query(f"WITH {_LINES} SELECT text, timestamp FROM fr")
def fragment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.fragments(_lines(spark, sf_dir))


@query(f"WITH {_HITS} SELECT text, timestamp, term FROM ht")
def watch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("text", "timestamp", "term")


@query(f"WITH {_HITS} SELECT DISTINCT text, timestamp FROM fr ANTI JOIN ht USING (text, timestamp)")
def cold_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that name no watched term: kept, but never read further."""
    return sentiment.raw(cards.fragments(_lines(spark, sf_dir)), _hits(spark, sf_dir)).filter("not kept").select("text", "timestamp")


@query(f"""WITH {_HITS}, st AS (SELECT *, {sql_count('lower(text)', LATIN.bullish)} AS u, {sql_count('lower(text)', LATIN.bearish)} AS d FROM ht)
SELECT substr(sha1(term || '|' || timestamp || '|' || text), 1, 16) AS item_id, term AS canonical_id, timestamp, CASE WHEN u > d THEN 'bullish' WHEN d > u THEN 'bearish' ELSE 'neutral' END AS stance, substr(text, 1, 60) AS claim, 'D' AS level, true AS unverifiable FROM st""")
def fragment_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.items(LATIN, _hits(spark, sf_dir)).drop("text")


@query(f"WITH {ITEMS} SELECT canonical_id, count(*) AS total, count(*) FILTER (stance = 'bullish') AS bullish, count(*) FILTER (stance = 'bearish') AS bearish, count(*) FILTER (stance = 'neutral') AS neutral, count(*) FILTER (stance = 'bullish') - count(*) FILTER (stance = 'bearish') AS net FROM i GROUP BY 1")
def sentiment_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.aggregate(V.items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT canonical_id, substr(timestamp, 1, 10) AS day, count(*) AS n FROM i GROUP BY ALL")
def sentiment_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.density(V.items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT canonical_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM i GROUP BY ALL")
def daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming density lane."""
    from ..streaming.lanes import density_by_day

    return density_by_day(V.items(spark, sf_dir)).select("canonical_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


_PROMOTED = f"""{ITEMS}, pm AS (SELECT c_custkey AS canonical_id, c_mktsegment || k AS source, c_custkey * 7 % 5000 + k * 400 AS seq FROM customer, (SELECT unnest([0, 1, 2]) AS k) WHERE c_acctbal > 0),
pf AS (SELECT item_id, arg_min(source, pm.seq) AS promoted_by FROM i JOIN pm ON pm.canonical_id = i.canonical_id AND pm.seq >= i.seq GROUP BY 1)"""


def _promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit have their items promoted at three times."""
    c = V.table(spark, sf_dir, "customer").filter("c_acctbal > 0").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return sentiment.promote(V.items(spark, sf_dir), c.select(F.col("c_custkey").alias("canonical_id"), F.concat("c_mktsegment", F.col("k").cast("string")).alias("source"), (F.col("c_custkey") * 7 % 5000 + F.col("k") * 400).alias("seq")))


@query(f"WITH {_PROMOTED} SELECT item_id, promoted_by IS NOT NULL AS promoted, promoted_by FROM i LEFT JOIN pf USING (item_id)")
def sentiment_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promoted(spark, sf_dir).select("item_id", "promoted", "promoted_by")


@query(f"""WITH {_PROMOTED}, {_HITS}, a AS (SELECT count(*) AS items, count(promoted_by) AS promoted FROM i LEFT JOIN pf USING (item_id)),
b AS (SELECT count(*) AS raw_total, count(*) FILTER (kept) AS raw_kept FROM (SELECT text, timestamp, EXISTS (SELECT 1 FROM ht WHERE ht.text = f.text AND ht.timestamp = f.timestamp) AS kept FROM (SELECT DISTINCT text, timestamp FROM fr) f)) SELECT * FROM a, b""")
def sentiment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = sentiment.raw(cards.fragments(_lines(spark, sf_dir)), _hits(spark, sf_dir))
    return sentiment.stats(_promoted(spark, sf_dir), raw)


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(make_timestamp(event_id * 86400000 * 1000), '%Y-%m-%d') AS day FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON field, and ids as epoch days in milliseconds."""
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.when(F.col("event_id").isNotNull(), epoch_ms_date(F.col("event_id") * 86400000)).alias("day"))


@query("""WITH p AS (SELECT user_id AS code, event_type AS title, strftime(ts, '%Y-%m-%d') AS date, event_id::VARCHAR AS url FROM events),
b AS (SELECT o_custkey AS code, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey::VARCHAR AS url FROM orders),
u AS (SELECT *, 'primary' AS source FROM p UNION ALL SELECT *, 'fallback' FROM b WHERE code NOT IN (SELECT code FROM p))
SELECT code, title, date, url, source FROM u QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC, title, url) <= 3""")
def disclosure_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements per customer: events are the primary source, orders the fallback for customers without any; the newest three each."""
    o, e = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "events")
    p = e.select(F.col("user_id").alias("code"), F.col("event_type").alias("title"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").cast("string").alias("url"))
    b = o.select(F.col("o_custkey").alias("code"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderkey").cast("string").alias("url"))
    return cards.disclosures(p, b, 3)
