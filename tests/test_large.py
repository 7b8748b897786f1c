"""What only larger tables or odd rows bring out."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.plans.registry import ORACLES, QUERIES


def test_dates_of_any_year(spark):
    days = {6_000_000: "18397-06-11", 12_000_000: "34824-11-19", -800_000: "-221-09-04", -719_528: "0000-01-01", None: ""}  # as DuckDB writes them
    found = spark.createDataFrame([(d,) for d in days], "d long").select("d", T.epoch_ms_date(F.col("d") * 86_400_000))
    assert {r[0]: r[1] for r in found.collect()} == days


def test_json_props_takes_event_ids_of_any_size(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    ids = [0, 99_999, 2_932_896, 2_932_897, 6_000_000, 10_000_000, 12_345_678, None]  # the days around the year 10000, and ids of eight digits
    spark.createDataFrame([(i, '{"k": 7}') for i in ids], "event_id long, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["json_props"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(ORACLES["json_props"]).fetchall()) and len(got) == len(ids)


def test_group_alpha_equals_the_pairs(spark):
    from factloom.operators import market

    rng = random.Random(5)
    found = spark.createDataFrame([(c, float(rng.randrange(-4, 5))) for c in range(60) if c % 7], "code long, ret double")
    rows = [(c, rng.choice([0, 1, 2, None]), rng.choice("ab")) for c in range(70)]
    rows += rows[:9] + rows[:3] + [(c, 1, "b") for c in range(20, 24)] + [(500, 9, "alone")]  # members that repeat, members of two groups
    members = spark.createDataFrame(rows, "code long, g int, h string")
    pairs = members.join(members.withColumnRenamed("code", "peer"), ["g", "h"]).select("code", "peer")
    got, want = (sorted(tuple(r) for r in df.collect()) for df in (market.group_alpha(found, members), market.peer_alpha(found, pairs)))
    assert got == want and len(got) > 30


def test_peer_alpha_makes_no_pairs(spark, monkeypatch):
    """Whoever has a hundred thousand peers in a group can't be met with each of them."""
    from factloom.operators import market
    from factloom.plans import views

    n = 100_000
    series = spark.range(n * 3).select((F.col("id") % n).alias("code"), F.col("id").alias("ts"), F.col("id").alias("tie"), (F.col("id") * 7919 % 1009 + 1).cast("double").alias("close"))
    customers = spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("x").alias("c_mktsegment"))
    monkeypatch.setattr(views, "table", lambda *_: customers)
    monkeypatch.setattr(views, "series", lambda *_: series)
    seen = []
    monkeypatch.setattr(market, "peer_alpha", lambda found, peers: seen.append(peers.count()) or found.limit(0).selectExpr("code", "ret", "ret as peer_median", "ret as alpha"))
    assert QUERIES["peer_alpha"](spark, "").count() == n and seen == [0]


def test_peer_alpha_takes_the_last_return_that_there_is(spark, tmp_path):
    """A zero two events before the last leaves no return there; in large tables some codes have one."""
    duckdb = pytest.importorskip("duckdb")
    closes = {0: [1.0, 2.0, 4.0, 0.0, 3.0, 5.0], 1: [0.0, 7.0, 8.0], 2: [1.0, 1.0, 3.0], 3: [5.0, 2.0, 4.0, None, 6.0], 4: [9.0, 9.0]}
    events = [(10 * code + k, f"2024-01-{k + 1:02d}", code, v) for code, values in closes.items() for k, v in enumerate(values)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(5).selectExpr("id as c_custkey", "1 as c_nationkey", "'x' as c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    con = duckdb.connect()
    for name in ("events", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["peer_alpha"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(ORACLES["peer_alpha"]).fetchall()) and {r[0] for r in got} == {0, 2, 3}


def test_ingest_keeps_little_on_disk(spark):
    """Cards and findings lie compressed in the shared folder, each once; no finding travels with its card's entities."""
    from pathlib import Path

    from factloom.functions.rules import LATIN
    from factloom.lineage import shared_dir
    from factloom.operators import ingest
    from factloom.plans import findings

    root = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    before, sf = size(), "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no driver tables here")
    stores = ingest.ingest(LATIN, findings._cards(spark, sf))
    n = stores.findings.count()
    assert n > 10_000 and (size() - before) / n < 100  # bytes a finding, cards included
    votes = lambda df: {tuple(r) for r in df.select("canonical_id", "predicate", "object", "votes", "level", "severity").collect()}
    assert votes(stores.facts()) == votes(stores.facts(sources=False)) != set()


def test_matches_equal_all_pairs(spark):
    from factloom.operators import entities

    rng = random.Random(11)
    signs = ["ab", "abc", "x1", "zzzz", "é", "-", "/", " ", "储", "测试", "A", "😀", "."]
    word = lambda most: "".join(rng.choice(signs) for _ in range(rng.randint(1, most)))
    queries = spark.createDataFrame([(k, word(9)) for k in range(150)] + [(900, None), (901, "")], "qid long, text string")
    aliases = spark.createDataFrame(sorted({(word(3).lower(), c) for c in ("SH600001", "concept:x") for _ in range(80)}) + [("----", "company:y"), ("", "none")], "alias string, canonical_id string")
    every = queries.select("qid", T.normalize(F.col("text")).alias("q")).crossJoin(aliases.filter("alias <> ''")).filter(entities.named(F.col("q"), F.col("alias")))
    got, want = ({(r.qid, r.alias, r.canonical_id) for r in df.collect()} for df in (entities.matches(queries, aliases), every))
    assert got == want and len(got) > 100


def test_aliases_with_a_common_beginning_are_no_candidates(spark, monkeypatch):
    from factloom.operators import entities

    aliases = spark.range(300).select(F.concat(F.lit("common"), F.col("id").cast("string")).alias("alias"), F.lit("concept:x").alias("canonical_id"))
    queries = spark.range(50).select(F.col("id").alias("qid"), F.concat(F.lit("common"), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(entities, "named", lambda *_: F.lit(True))  # so every candidate comes out
    assert entities.matches(queries, aliases).count() == 50
