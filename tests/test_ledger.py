import random

from pyspark.sql import functions as F

from factloom.operators import entities, graph, hypothesis, ledger, rank
from factloom.functions.rules import CHINESE

LOG = "canonical_id string, predicate string, object string, strength int, level string, unverifiable boolean, source string, valid_at string, seq long"


def test_fold(spark):
    rows = [("e", "P", "o", 1, "C", True, "docA", "2026-05-01", 1), ("e", "P", "o", 1, "A", True, "docB", "", 2), ("e", "P", "o", 1, "B", False, "docA", "2026-04-01", 3), ("e", "Q", "o", None, "B", True, "", None, 4), ("e", "Q", "o", None, "B", True, None, None, 5)]
    got = {r.predicate: r for r in ledger.fold(spark.createDataFrame(rows, LOG), first=("level",) and ()).collect()}
    assert (got["P"].sources, got["P"].votes, got["P"].level, got["P"].valid_at, got["P"].unverifiable) == (["docA", "docB"], 2, "A", "2026-04-01", False)
    assert got["Q"].votes == 1 and got["Q"].sources == [] and got["Q"].valid_at is None
    assert ledger.fold(spark.createDataFrame([], LOG)).count() == 0


def sequential(log):
    """The state machine, one occurrence after the other: status, invalid_at and lineage."""
    facts, lineage = {}, {}
    for cid, pred, obj, strength, _, _, _, at, seq in sorted(log, key=lambda r: r[-1]):
        key = (cid, pred, obj)
        f = facts.setdefault(key, {"status": "active", "valid": "", "invalid": None, "strength": strength})
        if at:
            f["valid"] = min(f["valid"], at) if f["valid"] else at
        if f["status"] == "superseded":
            f["status"], f["invalid"] = "active", None
        if strength is None:
            continue
        for other, e in facts.items():
            if other != key and other[0] == cid and other[2] == obj and e["status"] == "active" and e["strength"] and strength > e["strength"] and (at or "") >= e["valid"]:
                e["status"], e["invalid"] = "superseded", at or ""
                lineage.setdefault(key, set()).add(f"{other[1]}|{other[2]}")
    return facts, lineage


def test_status_equals_sequential_model(spark):
    rng = random.Random(9)
    log = []
    for e in range(150):
        for seq in range(rng.randrange(2, 14)):
            strength = rng.choice([1, 2, 3, 4, None])
            log.append((f"e{e}", f"P{strength}", rng.choice("ab"), strength, "B", True, f"d{seq}", rng.choice(["", None, "2026-01-01", "2026-02-01", "2026-03-01"]), seq))
    df = spark.createDataFrame(log, LOG).repartition(3)
    same = F.col("object") == F.col("by_object")
    want, lineage = sequential(log)
    got = {(r.canonical_id, r.predicate, r.object): (r.status, r.invalid_at) for r in ledger.status(df, same).collect()}
    assert got == {k: (f["status"], f["invalid"]) for k, f in want.items() if f["strength"]}
    found = {(r.canonical_id, r.by_predicate, r.by_object): set(r.supersedes) for r in ledger.lineage(df, same).collect()}
    assert found == lineage


def test_expire_and_events(spark):
    facts = spark.createDataFrame([(1, "active", "2020-01-01"), (2, "active", ""), (3, "superseded", "2020-01-01"), (4, "active", None), (5, "active", "2026-01-01")], "id int, status string, valid_at string")
    assert {r.id: r.status for r in ledger.expire_before(facts, "2025-01-01").collect()} == {1: "expired", 2: "active", 3: "superseded", 4: "active", 5: "active"}
    events = spark.createDataFrame([(1, 1, "disputed", "x"), (1, 2, "invalidated", "2026-02-02"), (2, 3, "invalidated", "y"), (2, 4, "active", "z")], "id int, event_seq int, event string, at string")
    got = {r.id: (r.status, r.invalid_at) for r in ledger.apply_events(facts.select("id"), events, "id").collect()}
    assert got[1] == ("invalidated", "2026-02-02") and got[2] == ("active", None) and got[3] == ("active", None)


def test_graph(spark):
    e = spark.createDataFrame([("a", "SUPPLIES", "b", s) for s in ("d1", "d1", "d2")] + [("c", "SUPPLIES", "a", "d1"), ("x", "T", "y", None)], "src string, rel_type string, dst string, source string")
    v = graph.votes(e)
    assert {(r.src, r.dst): (r.votes, r.low_confidence) for r in v.collect()} == {("a", "b"): (2, False), ("c", "a"): (1, True), ("x", "y"): (1, True)}
    assert {r.rel_type: (r.edges, r.low) for r in graph.stats(v).collect()} == {"SUPPLIES": (2, 1), "T": (1, 1), "total": (3, 2)}
    assert sorted(r.other for r in graph.neighbours(v, spark.createDataFrame([("a",)], "node string")).collect()) == ["b", "c"]


def test_entities(spark):
    mentions = spark.createDataFrame([("精智达", "stock", "688627", 1), ("智能", "company", None, 2), ("人工智能", "concept", None, 3), ("存储测试设备", "concept", None, 4), ("2025年", "concept", None, 5), ("精 智达", "stock", "000001", 6), ("hbm3e", "concept", None, 7)], "name string, kind string, code string, seq long")
    reg = entities.register(CHINESE, mentions)
    assert {r.alias: r.canonical_id for r in reg.collect()}["精智达"] == "SH688627" and reg.count() == 5
    q = spark.createDataFrame([(1, "存储测试设备 精智达 进展"), (2, "人工智能"), (3, "精志达"), (4, "demand for hbm3e"), (5, "无")], "qid int, text string")
    m = entities.matches(q, reg)
    assert {r.qid: r.canonical_id for r in entities.locate(m).collect()} == {1: "SH688627", 2: "concept:人工智能"}
    assert [(r.qid, r.canonical_id) for r in entities.fuzzy(q, reg).collect()] == [(3, "SH688627")]
    look = spark.createDataFrame([("精智达", 9), ("精智达", 0), ("无名", 9)], "name string, seq long")
    assert sorted(r.canonical_id for r in entities.resolve(reg, look).collect()) == ["SH688627", entities.UNKNOWN_ID, entities.UNKNOWN_ID]
    ids = spark.createDataFrame([(i,) for i in range(8)], "id long")
    merges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6), (6, 5)], "from_id long, into_id long")
    got = {r.id: r.final for r in entities.follow_merges(ids, merges, most=6).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 4)] == [3, 3, 3, 3, 4]
    assert entities.stats(reg).first().pending == 0


def test_diversify_equals_turns(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", "c", None, ""]), round(rng.random(), 1), rng.choice(["A", "B", "C", "D"])) for k in range(60)]
    groups = {}
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        groups.setdefault(r[1] or "?", []).append(r)
    want = []
    while any(groups.values()):
        heads = [g for g in groups.values() if g]
        for g in sorted(heads, key=lambda g: (0 if g[0][3] in ("A", "B+", "B") else 1, -g[0][2], g[0][0])):
            want.append(g.pop(0)[0])
    df = spark.createDataFrame(rows, "pos int, source_kind string, score double, level string")
    assert [r.pos for r in rank.diversify(df).orderBy("place").collect()] == want
    assert [r.pos for r in rank.diversify(df, limit=7).orderBy("place").collect()] == want[:7]


def test_hypothesis(spark):
    h = spark.createDataFrame([(1,), (2,)], "hyp_id int")
    ev = spark.createDataFrame([(1, "against", "A"), (1, "for", "C")], "hyp_id int, side string, grade string")
    got = {r.hyp_id: r for r in hypothesis.confidence(h, ev).collect()}
    assert abs(got[1].confidence - 2 / 7) < 1e-12 and got[2].confidence == 0.5 and got[2].n_evidence == 0
