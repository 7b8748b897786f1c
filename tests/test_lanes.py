import json

from pyspark.sql import functions as F

from factloom.functions.rules import CHINESE
from factloom.operators import attribution, critique, sentiment, verify
from factloom.plans.ask import ask, registry_of
from factloom.sources import cards, sinks
from factloom.streaming import lanes


def test_cards(spark, tmp_path):
    card = {"id": "c1", "type": "minutes", "date": "2026-05-01", "broker": "中金", "title": "精智达深度", "entities": [{"name": "精智达", "kind": "stock", "code": "688627"}], "findings": [{"claim": "公司中标", "evidence": "e", "entities": [], "numbers": [{"value": "10%", "context": "年化", "_v": "ok"}]}, {"evidence": "no claim"}], "factors": [{"name": "动量", "intuition": "强", "performance": {"IC": "0.05"}, "page": 3}]}
    (tmp_path / "a.json").write_text(json.dumps(card, ensure_ascii=False))
    (tmp_path / "b.json").write_text("[1, 2, 3]")
    (tmp_path / "c.json").write_text("{broken")
    found = cards.read_cards(spark, str(tmp_path))
    assert found.count() == 1
    rows = cards.findings(found).orderBy("pos").collect()
    assert [r.claim for r in rows] == ["公司中标", "因子「动量」强"] and rows[1].evidence == "IC=0.05" and rows[1].numbers[0].context == "IC"
    assert rows[0].source_kind == "expert_meeting" and rows[0].valid_at == "2026-05-01"


def test_attribution(spark):
    ents = [("精智达", "stock"), ("京东方", "company"), ("Goldman", "company"), ("2025年", "company")]
    rows = [
        ("精智达获订单", "company", "精智达点评", "中金", [], "精智达"), ("公司收购京东方", "company", "精智达点评", "中金", [], "精智达"), ("收购京东方股权", "company", "精智达点评", "", [], "精智达"),
        ("精智达与京东方合作", "industry", "x", "中金", [], "精智达"), ("无关", "industry", "x", "中金", [], "中金"), ("无关", "industry", "x", "", [], "未知主体"), ("x", "industry", "x", "", ["2025年", "华为"], "华为"),
        ("Goldman received compensation from 精智达", "company", "精智达", "中金", [], "中金"),
    ]
    df = spark.createDataFrame([(r[0], "", r[1], r[2], r[3], [{"name": n, "kind": k} for n, k in ents], r[4], r[5]) for r in rows], "claim string, evidence string, card_type string, title string, broker string, entities array<struct<name:string,kind:string>>, own array<string>, want string")
    for r in attribution.attribute(CHINESE, df).collect():
        assert r.subject == r.want, (r.claim, r.subject, r.want)
    ends = df.limit(1).select(attribution.edge_endpoints(F.lit("甲供应乙和丙"), F.array(F.lit("甲")), F.array(F.lit("丙"), F.lit("乙"), F.lit("")))).first()[0]
    assert ends == ["甲", "丙"]


def test_critique(spark):
    schema = "finding_id int, claim string, evidence string, numbers array<struct<value:string,context:string,page:int,_v:string>>"
    base = [(k, "收益", "e", [(f"{10 + k}%", "年化收益率", 1, "ok")]) for k in range(20)]
    probes = [(100, "预计很高", "", None), (101, "x", "e", [("90%", "年化收益率", 1, "ok")]), (102, "x", "e", [("12%", "年化收益率", 1, "ok")]), (103, "回测2021-2022", "e", [("1", "IC均值", 1, None)])]
    limits = critique.thresholds(critique.metrics(CHINESE, spark.createDataFrame(base, schema)))
    assert [(r.metric, round(r.high, 6), round(r.medium, 6)) for r in limits.collect()] == [("annual_return", 28.05, 27.1)]
    got = {r.finding_id: [(f.kind, f.severity, f.detail) for f in r.flags] for r in critique.flags(CHINESE, spark.createDataFrame(probes, schema), limits).collect()}
    assert got[100] == [("no_source", "high", ""), ("speculative", "medium", "预计")]
    assert got[101] == [("over_optimistic", "high", "annual_return")] and got[102] == []
    assert got[103] == [("backtest_weak", "medium", ""), ("backtest_weak", "medium", "1")]


def test_fragments_and_sentiment(spark):
    lines = spark.createDataFrame([("[2026-06-10 09:30] 精智达要涨",), ("2026-06-10\t看空精智达 和京东方",), ("  ",), ("没有时间",), ("2026-06-10",), ("[2026-06-10 09:30] 精智达要涨",)], "value string")
    f = cards.fragments(lines)
    assert [tuple(r) for r in f.collect()][:4] == [("精智达要涨", "2026-06-10 09:30"), ("看空精智达 和京东方", "2026-06-10"), ("没有时间", ""), ("2026-06-10", "")]
    hits = sentiment.watch_hits(f, spark.createDataFrame([("精智达",), ("京东方",), ("",)], "term string"))
    items = sentiment.items(CHINESE, hits)
    got = {r.canonical_id: (r.total, r.net) for r in sentiment.aggregate(items).collect()}
    assert got == {"精智达": (2, 0), "京东方": (1, -1)}
    assert {r.day: r.n for r in sentiment.density(items.filter("canonical_id = '精智达'")).collect()} == {"2026-06-10": 2}
    raw = sentiment.raw(f, hits)
    assert raw.count() == 4 and raw.filter("kept").count() == 2
    done = sentiment.promote(items.withColumn("seq", F.lit(5)), spark.createDataFrame([("京东方", "doc", 9), ("京东方", "late", 11), ("精智达", "early", 1)], "canonical_id string, source string, seq int"))
    assert {(r.canonical_id, r.promoted_by) for r in done.collect()} == {("京东方", "doc"), ("精智达", None)}


def test_verification(spark):
    claims = spark.createDataFrame([(1, "688627", "精智达", "精智达中标存储测试设备大单", "重大合同/中标"), (2, "688627", "精智达", "精智达", ""), (3, "000001", "x", "存储测试设备", ""), (4, "688627", "精智达", "澄清传闻存储业务", "")], "claim_id long, code string, subject string, claim string, expected string")
    docs = spark.createDataFrame([("688627", 1, "关于中标存储测试设备的公告", "重大合同/中标", None), ("688627", 2, "关于澄清传闻存储业务的说明", "澄清/媒体回应", "x")], "code string, doc_id long, title string, category string, text string")
    assert {r.claim_id: r.verdict for r in verify.cross_check(claims, docs).collect()} == {1: "corroborated", 2: "not_disclosed", 3: "not_disclosed", 4: "contradicted"}
    leads = [(k, "a" if k % 3 else "b", k % 7, [f"g{(k + j) % 11}" for j in range(5)]) for k in range(30)]
    clusters = []
    want = {}
    for k, code, _, grams in sorted(leads, key=lambda r: (r[2], r[0])):
        hit = next((c for c in clusters if c[0] == code and len(set(grams) & c[1]) >= 3), None)
        if not hit:
            clusters.append(hit := (code, set(grams), k))
        want[k] = hit[2]
    df = spark.createDataFrame(leads, "fact_id long, code string, age int, grams array<string>")
    found = verify.cluster_events(df)
    assert {r.fact_id: r.leader for r in found.collect()} == want
    assert verify.newest_events(found, df, 3).count() == 3
    g = spark.range(1).select(verify.event_grams(F.lit("「精智达」（利好）：与BOE签署备忘录"), F.lit("精智达"))).first()[0]
    assert "mou" in g and "京东" in g and "精智" not in g


def test_disclosures(spark):
    schema = "code string, title string, date string, url string"
    p = spark.createDataFrame([("a", "中标公告", "2026-01-02", "u1"), ("a", "年报", "2026-01-01", "u2")], schema)
    b = spark.createDataFrame([("a", "x", "2027-01-01", "u3"), ("b", "y", "2026-01-01", "u4")], schema)
    assert [(r.code, r.title, r.source) for r in cards.disclosures(p, b, 1).orderBy("code").collect()] == [("a", "中标公告", "primary"), ("b", "y", "fallback")]
    assert cards.has_announcement(p.select("code").distinct(), p, "中标").count() == 1


def test_ask(spark):
    facts = spark.createDataFrame([(1, "精智达中标存储设备", "", "精智达", "SH688627", "A", "official_announcement", "2026-06-01", 2, "active"), (2, "金智达扩产", "", "金智达", "company:金智达", "B", "broker_research", "2026-06-01", 1, "active"), (3, "英伟达与精智达合作", "", "英伟达", "concept:英伟达", "B", "broker_research", "2026-05-01", 1, "active"), (4, "精智达旧传闻", "", "精智达", "SH688627", "D", "social_chat", "2026-01-01", 1, "superseded")], "fact_id long, claim string, object string, subject string, canonical_id string, level string, source_kind string, valid_at string, votes long, status string")
    reg = registry_of(spark.createDataFrame([("精智达", "SH688627"), ("金智达", "company:金智达")], "name string, canonical_id string"))
    edges = spark.createDataFrame([("SH688627", "SUPPLIES", "京东方", 2)], "src string, rel_type string, dst string, votes long")
    rows = ask("精智达 中标", facts, reg, edges, F.lit("2026-06-30").cast("date")).collect()
    assert [r.key for r in rows if r.section == "entity"] == ["SH688627"]
    assert [r.key for r in sorted((r for r in rows if r.section == "evidence"), key=lambda r: r.place)] == ["1", "3"]
    assert [r.key for r in rows if r.section == "invalidated"] == ["4"] and [r.key for r in rows if r.section == "neighbour"] == ["京东方"]


def test_streaming_equals_batch(spark, tmp_path):
    schema = "text string, canonical_id string, ts timestamp"
    rows = [("看好", "a", "2026-06-10 09:00:00"), ("看好", "a", "2026-06-10 09:00:00"), ("看空", "a", "2026-06-11 09:00:00"), ("x", "b", None)]
    batch = spark.createDataFrame(rows, "text string, canonical_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = lanes.sentiment_items(CHINESE, stream).writeStream.format("memory").queryName("items").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.canonical_id, r.stance) for r in spark.table("items").collect())
    assert got == [("a", "bearish"), ("a", "bullish")]
    occ = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    lanes.log_appends(occ, str(tmp_path / "log"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sinks.read_log(spark, str(tmp_path / "log")).count() == 4
