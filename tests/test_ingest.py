import json
import random
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_ledger import LOG, sequential  # noqa: E402

from factloom.functions import text as T  # noqa: E402
from factloom.functions.rules import CHINESE  # noqa: E402
from factloom.lineage import placed  # noqa: E402
from factloom.operators import critique, entities, hypothesis, ingest, ledger, market, recall  # noqa: E402
from factloom.plans.ask import ask  # noqa: E402
from factloom.sources import cards, sinks  # noqa: E402
from factloom.streaming import lanes  # noqa: E402

CARDS = [
    {"id": "c1", "type": "company", "date": "2026-01-05", "broker": "中金", "title": "精智达点评", "entities": [{"name": "精智达", "kind": "stock", "code": "688627"}, "京东方", {"name": "2025年"}, {"kind": "stock"}, None],
     "findings": [{"claim": "市场传精智达存储测试设备订单 2026年", "evidence": "传闻", "numbers": ["1亿", 3, None, ["x"]], "entities": []}, {"claim": "精智达为京东方提供配套", "evidence": "", "entities": ["精智达", {"name": "京东方"}]}, "junk", {"claim": ""}]},
    {"id": "c2", "type": "industry", "date": "2026-03-01", "broker": "华泰", "title": "半导体", "entities": [{"name": "精 智达", "kind": "stock", "code": "688627"}],
     "findings": [{"claim": "精智达中标存储测试设备订单 2026年3月", "evidence": "公告", "numbers": [], "entities": ["精智达"]}, {"claim": "天气很好", "evidence": "x", "entities": []}, {"claim": "看好上游", "evidence": "", "entities": ["精智达"]}]},
    {"id": "c3", "type": "quant", "date": None, "broker": "", "title": "", "entities": [], "findings": None, "factors": [{"name": "动量", "intuition": "强", "performance": {"年化": "20%", "IC": 0.05}, "page": 3}, 5]},
]


def landed(spark, tmp_path):
    for c in CARDS:
        (tmp_path / f"{c['id']}.json").write_text(json.dumps(c, ensure_ascii=False))
    (tmp_path / "x.json").write_text("[]")
    return cards.read_cards(spark, str(tmp_path))


def test_mixed_values(spark, tmp_path):
    found = landed(spark, tmp_path)
    rows = {(r.doc_id, r.pos): r for r in cards.findings(found).collect()}
    assert len(rows) == 6
    assert [(n.value, n.context) for n in rows["c1", 0].numbers] == [("1亿", ""), ("3", "")]
    assert rows["c1", 1].own == ["精智达", "京东方"] and rows["c3", 0].evidence in ("年化=20%; IC=0.05", "IC=0.05; 年化=20%")
    ents = {(r.doc_id, r.name, r.kind, r.code) for r in cards.card_entities(found).collect()}
    assert ents == {("c1", "精智达", "stock", "688627"), ("c1", "2025年", "concept", None), ("c2", "精 智达", "stock", "688627")}
    assert {(r.doc_id, r.alias) for r in cards.code_map(found).collect()} == {("c1", "精智达"), ("c2", "精智达")}


def test_ingest_from_cards_to_answer(spark, tmp_path):
    found = landed(spark, tmp_path)
    stores = ingest.ingest(CHINESE, found)
    facts = {(r.predicate, r.object): r for r in stores.facts().collect()}
    rumour, order = facts["HAS_ORDER_RUMOR", "市场传精智达存储测试设备订单 2026年"], facts["HAS_CONFIRMED_ORDER", "精智达中标存储测试设备订单 2026年3月"]
    assert rumour.canonical_id == order.canonical_id == "SH688627"
    assert (rumour.status, rumour.invalid_at, order.status) == ("superseded", "2026-03-01", "active")
    assert order.sources == ["c2"] and order.votes == 1 and order.level == "B"
    quant = next(r for r in facts.values() if r.predicate == "HAS_FACTOR_PERFORMANCE")
    assert quant.canonical_id == "concept:动量" and quant.status == "active"
    assert [tuple(r) for r in stores.edges.collect()] == [("SH688627", "SUPPLIES", "concept:京东方", "c1")]
    aliases = {r.alias: r.canonical_id for r in stores.registry.collect()}
    assert aliases["精智达"] == "SH688627" and "2025年" not in aliases
    told = stores.report(found).first()
    assert (told.cards, told.findings, told.hard_facts, told.quant_facts, told.structures, told.background, told.entities_registered) == (3, 6, 2, 1, 1, 2, 3)
    assert told.level_dist == {"B": 3} and told.doubts >= 1
    sizes = {(r.store, r.section, r.name): r.n for r in stores.stats().collect()}
    assert sizes["facts", "total", ""] == 3 and sizes["facts", "status", "superseded"] == 1 and sizes["graph", "edges", "SUPPLIES"] == 1 and sizes["registry", "entities", ""] == stores.registry.select("canonical_id").distinct().count()
    again = ingest.ingest(CHINESE, found.union(found))  # the same cards twice
    assert {(r.predicate, r.object): (r.votes, r.status) for r in again.facts().collect()} == {k: (r.votes, r.status) for k, r in facts.items()}
    verified = spark.createDataFrame([("c2#0", "confirmed")], "finding_id string, outcome string")
    checked = ingest.ingest(CHINESE, found, verification=verified, category=spark.createDataFrame([("c2#1", "hard_fact")], "finding_id string, category string"), merges=spark.createDataFrame([("SH688627", "SZ000001")], "from_id string, into_id string"))
    levels = {r.object: (r.level, r.canonical_id) for r in checked.facts().collect()}
    assert levels["精智达中标存储测试设备订单 2026年3月"] == ("A", "SZ000001") and levels["天气很好"][0] == "B"

    ready = stores.facts()
    edges = stores.edges.select("src", "rel_type", "dst", F.lit(1).cast("long").alias("votes"))
    snapshot = spark.createDataFrame([("SH688627", 20.0, 5.0, 85.0, True, 12.0, None, 80.0, 1.5)], "canonical_id string, ret_10d double, pb double, pb_pct_3y double, loss_making boolean, alpha_10d double, peer_alpha_10d double, range_pct_250 double, vol_ratio double")
    rows = ask("精智达 中标", ready, stores.registry, edges, F.lit("2026-06-30").cast("date"), snapshot=snapshot, rules=CHINESE).collect()
    of = lambda section: [(r.key, r.text) for r in sorted(rows, key=lambda r: r.place) if r.section == section]
    assert of("entity") == [("SH688627", "精智达 中标")] and of("evidence")[0][1].endswith("精智达中标存储测试设备订单 2026年3月")
    assert len(of("invalidated")) == 1 and of("neighbour") == [("concept:京东方", "SUPPLIES")] and ("c2", "") in of("source")
    assert of("frame") == [("困境反转 / 主题定价", "低")] and of("weight")[0][0] == "1/0" and not of("warning")
    lost = ask("无此公司", ready, stores.registry, edges, F.lit("2026-06-30").cast("date")).collect()
    assert {r.key for r in lost if r.section == "warning"} == {"no entity and nothing found", "no evidence"}
    typo = ask("精志达", ready, stores.registry, edges, F.lit("2026-06-30").cast("date")).collect()
    assert [(r.key, r.text) for r in typo if r.section == "warning"][0] == ("corrected", "SH688627")


def test_empty_ingest(spark, tmp_path):
    (tmp_path / "x.json").write_text("[]")
    none = cards.read_cards(spark, str(tmp_path))
    stores = ingest.ingest(CHINESE, none)
    assert stores.facts().count() == stores.edges.count() == stores.registry.count() == 0
    assert stores.report(none).first().cards == 0


def test_feed_chat_and_deep_check(spark, tmp_path):
    (tmp_path / "chat.txt").write_text("[2026-06-10 09:30] 精智达要涨\n\n  \n看空京东方\n无关\n")
    lines = cards.read_fragments(spark, str(tmp_path / "chat.txt"))
    registry = spark.createDataFrame([("精智达", "SH688627")], "alias string, canonical_id string")
    terms = spark.createDataFrame([("精智达",), ("京东方",)], "term string")
    items, raw = ingest.feed_chat(CHINESE, lines, terms, registry)
    assert {(r.canonical_id, r.stance) for r in items.collect()} == {("SH688627", "bullish"), ("stock_pending:京东方", "bearish")}
    assert sorted(r.kept for r in raw.collect()) == [False, True, True]
    facts = spark.createDataFrame([("a", "SH688627", "hard_fact", 2, "精智达", "精智达澄清存储业务传闻", "HAS_CONFIRMED_ORDER", "active"), ("b", "SH688627", "hard_fact", 0, "精智达", "x", "HAS_CAPACITY", "active")], "fact_id string, canonical_id string, category string, severity int, subject string, claim string, predicate string, status string")
    docs = spark.createDataFrame([("688627", 1, "关于澄清存储业务传闻的说明", "澄清/媒体回应", None)], "code string, doc_id long, title string, category string, text string")
    got = {r.fact_id: (r.status, r.verdict) for r in ingest.deep_check(facts, docs, 10).collect()}
    assert got == {"a": ("disputed", "contradicted"), "b": ("active", None)}


def test_streams(spark, tmp_path):
    rng = random.Random(3)
    log = []
    for e in range(12):
        for seq in range(rng.randrange(2, 12)):
            strength = rng.choice([1, 2, 3, 4, None])
            log.append((f"e{e}", f"P{strength}", rng.choice("ab"), strength, rng.choice("ABD"), True, f"d{seq % 3}", rng.choice(["", None, "2026-01-01", "2026-02-01", "2026-03-01"]), seq))
    cut = 5
    for k, part in enumerate(([r for r in log if r[-1] < cut], [r for r in log if r[-1] >= cut])):  # two batches, in order
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
        out = []
        run = lanes.fact_states(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda batch, n, out=out: out.extend(batch.collect())).trigger(availableNow=True).start()
        run.awaitTermination(120)
        states = (states if k else {}) | {(r.canonical_id, r.predicate, r.object): r for r in out}
    want, _ = sequential(log)
    assert {k: (r.status, r.invalid_at) for k, r in states.items()} == {k: (f["status"], f["invalid"]) for k, f in want.items()}
    folded = {(r.canonical_id, r.predicate, r.object): (r.sources, r.level, r.occurrences) for r in ledger.fold(spark.createDataFrame(log, LOG)).collect()}
    assert {k: (r.sources, r.level, r.occurrences) for k, r in states.items()} == folded

    batch = spark.createDataFrame(log[:3], LOG)
    for _ in range(2):  # the batch is delivered again
        sinks.append_batch(batch, str(tmp_path / "log"), 7)
    sinks.append_batch(batch, str(tmp_path / "log"), 8)
    assert sinks.read_log(spark, str(tmp_path / "log")).count() == 6

    facts = "fact_id long, claim string"
    for part in ([(1, "a"), (2, "b"), (1, "a")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, facts).coalesce(1).write.mode("append").parquet(str(tmp_path / "facts"))
        encode = lambda df: df.select("fact_id", F.array(F.length("claim").cast("double")).alias("embedding"))
        lanes.index_builds(spark.readStream.schema(facts).parquet(str(tmp_path / "facts")), str(tmp_path / "index"), str(tmp_path / "icp"), encode).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.fact_id for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [1, 2, 3]

    chat = "text string, ts timestamp"
    spark.createDataFrame([("看好甲和乙", "2026-06-10 09:00:00"), ("看好甲和乙", "2026-06-10 09:00:00"), ("丙", None)], "text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "chat"))
    lanes.watch_stream(CHINESE, spark.readStream.schema(chat).parquet(str(tmp_path / "chat")), ["甲", "乙", "丁"]).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.canonical_id, r.stance) for r in spark.table("watched").collect()) == [("乙", "bullish"), ("甲", "bullish")]
    assert lanes.undated(spark.createDataFrame([("x", ""), ("y", None), ("z", "2026")], "text string, timestamp string")).count() == 2


def test_density_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2026-06-10 09:00:00"), ("a", "2026-06-10 23:00:00"), ("b", "2026-06-11 01:00:00"), ("z", "2026-09-01 00:00:00")], "canonical_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("canonical_id string, ts timestamp").parquet(str(tmp_path / "in"))
    lanes.density_by_day(stream).writeStream.format("memory").queryName("dense").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    batch = {tuple(r) for r in lanes.density_by_day(rows).collect()}
    got = {tuple(r) for r in spark.table("dense").collect()}
    assert got and got <= batch and {r[0] for r in got} >= {"a", "b"}  # the last day waits for the watermark


def test_environment(spark):
    rng = np.random.default_rng(4)
    prices = {c: np.round(50 + rng.normal(0, 1, n).cumsum(), 2) for c, n in (("x", 300), ("y", 80), ("z", 8), ("i", 40))}
    rows = [(c, k, float(v), float(100 + k % 7), k) for c, p in prices.items() for k, v in enumerate(p)]
    df = spark.createDataFrame(rows, "code string, ts int, close double, volume double, tie int")
    pb = [("x", "pb", k, float(k % 13), k) for k in range(40)] + [("x", "pe_ttm", k, float(k - 60), k) for k in range(40)] + [("y", "pb", k, 1.0, k) for k in range(5)]
    val = spark.createDataFrame(pb, "code string, metric string, ts int, close double, tie int")
    peers = spark.createDataFrame([("x", "y"), ("x", "z"), ("x", "x")], "code string, peer string")
    got = {r.code: r for r in market.environment(df.filter("code <> 'i'"), val, df.filter("code = 'i'"), peers).collect()}
    ret = lambda c, n: round(100 * (prices[c][-1] / prices[c][-(n + 1)] - 1), 1)
    assert abs(got["x"].ret_10d - ret("x", 10)) < 0.051 and abs(got["x"].ret_5d - ret("x", 5)) < 0.051 and got["z"].ret_10d is None
    assert abs(got["x"].alpha_10d - (ret("x", 10) - ret("i", 10))) < 0.11 and abs(got["x"].peer_alpha_10d - (ret("x", 10) - ret("y", 10))) < 0.11
    last = prices["x"][-250:]
    assert abs(got["x"].range_pct_250 - 100 * (last[-1] - last.min()) / (last.max() - last.min())) <= 0.51
    assert got["x"].vol_ratio is not None and got["z"].vol_ratio is None and got["x"].loss_making and got["y"].pb is None
    assert got["x"].pb == 0.0 and got["x"].pb_pct_3y == 0


def test_vector_search_and_stores(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 8)).round(2)
    v[50:80] = v[50]
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in recall.vector_search(df, df.filter("vec_id % 20 = 0"), 25, block=4).collect():
        got.setdefault(r.query_id, []).append((-r.cosine, r.vec_id))
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for k in range(0, 300, 20):
        want = sorted((-round(float(c), 6) - 0.0, i) for i, c in enumerate(u @ u[k]))[:25]
        assert [(round(a, 5), b) for a, b in sorted(got[k])] == [(round(a, 5), b) for a, b in want]
    assert recall.vector_search(df, df.limit(0), 5).count() == 0
    s = spark.createDataFrame([("a", 0), ("b", 1)], "store string, priority int")
    counts = recall.store_counts(spark.createDataFrame([("b",), ("b",)], "store string"), s)
    assert recall.best_store(counts).first().store == "b" and recall.best_store(counts, "a").first().store == "a"
    assert recall.best_store(recall.store_counts(s.select("store").limit(0), s)).first().store == "a"


def test_percentiles_and_places(spark):
    rng = np.random.default_rng(6)
    values = {"m": rng.normal(size=997).round(2), "n": np.array([3.0] * 50), "o": np.array([1.0] * 7), "p": np.append(rng.normal(size=400), 1e9)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs], "metric string, value double").repartition(4)
    got = {r.metric: (r.high, r.medium) for r in critique.thresholds(df).collect()}
    assert set(got) == {"m", "n", "p"}
    for k, (high, medium) in got.items():
        assert abs(high - np.percentile(values[k], 95)) < 1e-9 and abs(medium - np.percentile(values[k], 90)) < 1e-9
    order = rng.permutation(500).tolist()
    p = placed(spark.createDataFrame([(k,) for k in order], "k int").repartition(7), ["k"], "place").collect()
    assert all(r.place == r.k + 1 for r in p) and len(p) == 500


def test_one_entity_with_a_hundred_thousand_occurrences(spark):
    log = spark.range(100_000).select(F.lit("hot").alias("canonical_id"), F.concat(F.lit("P"), (F.col("id") % 4 + 1).cast("string")).alias("predicate"), (F.col("id") % 7).cast("string").alias("object"), (F.col("id") % 4 + 1).cast("int").alias("strength"), F.lit("B").alias("level"), F.lit("d").alias("source"), F.lit("2026-01-01").alias("valid_at"), F.col("id").alias("seq"))
    found = ledger.status(log, F.col("object") == F.col("by_object"))
    got = {(r.predicate, r.object): r.status for r in found.collect()}
    want, _ = sequential([(r.canonical_id, r.predicate, r.object, r.strength, "", True, "", r.valid_at, r.seq) for r in log.filter("id >= 0").collect()] if False else [("hot", f"P{k % 4 + 1}", str(k % 7), k % 4 + 1, "", True, "", "2026-01-01", k) for k in range(99_900, 100_000)])
    assert got == {(p, o): f["status"] for (_, p, o), f in want.items()}


def test_small_pieces(spark, tmp_path):
    cases = [("x {\"a\": \"}\"} y", '{"a": "}"}'), ("no", None), ("{ {\"b\": 1}", None), (None, None), ("{}", "{}")]
    got = spark.createDataFrame(cases, "s string, want string").select(T.first_json(F.col("s")).alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)
    h = spark.createDataFrame([("H3",), ("H12",), ("other",)], "hyp_id string")
    assert hypothesis.next_number(h) == 13 and hypothesis.next_number(h.limit(0)) == 1
    done = hypothesis.listed(h, spark.createDataFrame([("H3", "for", "A")], "hyp_id string, side string, grade string"), spark.createDataFrame([("H3", "won", 1)], "hyp_id string, outcome string, seq int"))
    assert {(r.hyp_id, r.status) for r in done.collect()} == {("H3", "won"), ("H12", "open"), ("other", "open")}
    sinks.append_note(spark, "slow", str(tmp_path / "notes"), "2026-01-01")
    sinks.append_note(spark, "dear", str(tmp_path / "notes"), "2026-01-02")
    assert spark.read.json(str(tmp_path / "notes")).count() == 2
    sinks.write_documents(spark.createDataFrame([("H1", "# one\n\ntext")], "n string, t string"), str(tmp_path / "docs"), "n", "t")
    assert spark.read.option("wholetext", True).text(str(tmp_path / "docs")).first().value.startswith("# one")
    stocks = spark.createDataFrame([("600000", "o1", "")], "code string, org_id string, plate string")
    assert {(r.code, r.org_id, r.plate) for r in cards.organisations(spark.createDataFrame([("SH600000",), ("000001",)], "code string"), stocks).collect()} == {("SH600000", "o1", "sh"), ("000001", None, "sz")}
    raw = spark.createDataFrame([("600000", None, "减持公告", "2026-01-02 10:00", "u")], "SECCODE string, TITLE string, BULLETIN_TITLE string, SSEDATE string, URL string")
    landed_ = cards.landed_disclosures(raw)
    got = cards.disclosures(landed_.limit(0), landed_, 3, ("股东增减持",), CHINESE).first()
    assert (got.title, got.date, got.source, got.category) == ("减持公告", "2026-01-02", "fallback", "股东增减持")
    assert cards.has_announcement(landed_.select("code"), cards.disclosures(landed_, landed_, 3, None, CHINESE), "减持", "担保").count() == 0
    many = spark.createDataFrame([(f"t{k}",) for k in range(30)], "term string")
    texts = spark.createDataFrame([("a t7 b t77", "x"), ("nothing", ""), ("a t7 b t77", "x")], "text string, timestamp string")
    from factloom.operators import sentiment

    few, much = (sorted(map(tuple, sentiment.watch_hits(texts, many, few=n).collect())) for n in (1000, 3))
    assert few == much == [("a t7 b t77", "x", "t7")]
    reg = spark.createDataFrame([("a", "A", "stock", "An"), ("b", "B", "stock", "Bn")], "alias string, canonical_id string, kind string, display string")
    merges = spark.createDataFrame([("A", "B")], "from_id string, into_id string")
    assert {r.alias: r.canonical_id for r in entities.merged(reg, merges).collect()} == {"a": "B", "b": "B"}
    assert [r.term for r in entities.watch_terms(reg, ("stock",), merges).collect()] == ["Bn"]


def test_concurrent_writers_and_snapshots(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def write(k):
        rows = [("e", "P", "o", 1, "B", True, f"d{k}", "2026-01-01", 10 * k + j) for j in range(3)]
        sinks.append_batch(spark.createDataFrame(rows, LOG), str(tmp_path / "log"), k)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(12)))
    write(3)  # a batch comes again
    fact = ledger.fold(sinks.read_log(spark, str(tmp_path / "log"))).first()
    assert (fact.votes, fact.occurrences) == (12, 36)
    schema = "k int, v string"
    sinks.upsert_snapshot(spark.createDataFrame([(1, "a"), (2, "b")], schema), str(tmp_path / "snap"), ["k"], 0)
    new = sinks.upsert_snapshot(spark.createDataFrame([(2, "c"), (3, "d")], schema), str(tmp_path / "snap"), ["k"], 1)
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_newest_events(spark):
    from factloom.operators import verify

    clusters = spark.createDataFrame([(1, "c", 1), (2, "c", 1), (3, "c", 3), (4, "d", 4)], "fact_id long, code string, leader long")
    leads = spark.createDataFrame([(1, 5), (2, 6), (3, 2), (4, 5)], "fact_id long, age int")
    assert [(r.leader, r.members) for r in verify.newest_events(clusters, leads, 2).orderBy("age", "leader").collect()] == [(3, 1), (1, 2)]
