from datetime import date

from pyspark.sql import functions as F

from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.functions.rules import CHINESE
from factloom.operators import classify as C


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalize_and_grams(spark):
    assert one(spark, T.normalize(F.lit("精智达,获 订单。（A）"))) == "精智达获订单a"
    assert one(spark, T.normalize(F.lit(None).cast("string"))) == ""
    assert set(one(spark, T.content_grams(F.lit("HBM3E 需求旺 x 盛")))) == {"hbm3e", "需求", "求旺", "盛"}
    assert one(spark, T.content_grams(F.lit(""))) == []
    assert one(spark, T.overlap_coefficient(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 1.0


def test_numbers_and_dates(spark):
    assert one(spark, T.parse_num(F.lit("40.12%"))) == 40.12 and one(spark, T.parse_num(F.lit("-5.51"))) == -5.51
    assert one(spark, T.parse_num(F.lit("none"))) is None
    assert one(spark, T.backtest_years(F.lit("回测2013.1-2023.10"))) == 10.0 and one(spark, T.backtest_years(F.lit("2023-2013"))) is None
    as_of = F.lit(date(2026, 6, 30))
    for text, want in (("2026-06-30", 1.0), ("2027-01-01", 1.0), ("2020-01-01", 0.0), ("", 0.0), (None, 0.0), ("2026-06", 0.0), ("2026-13-45", 0.0)):
        assert one(spark, T.recency(F.lit(text).cast("string"), as_of)) == want
    assert abs(one(spark, T.recency(F.lit("2026-04-18 09:30"), as_of)) - (1 - 73 / 365)) < 1e-12
    assert one(spark, T.epoch_ms_date(F.lit(1780272000000))) == "2026-06-01"


FINDINGS = [
    ("2026年6月中标2亿元订单", "", [], "hard_fact", "HAS_CONFIRMED_ORDER"),
    ("因子年化收益12%", "", ["12"], "quant_fact", "HAS_CATALYST"),
    ("公司是上游原材料供应商", "", [], "structure", "HAS_CATALYST"),
    ("行业前景广阔", "", [], "background", "HAS_CATALYST"),
    ("传闻定点后中标", "", ["1"], "hard_fact", "HAS_CONFIRMED_ORDER"),
    ("预计批量供货并扩产", "2026年", [], "hard_fact", "HAS_DELIVERY_VALIDATION"),
]


def test_categories_and_predicates(spark):
    df = spark.createDataFrame([(*f[:3], f[3], f[4]) for f in FINDINGS], "claim string, evidence string, nums array<string>, want string, pred string")
    for r in df.select("*", C.category(CHINESE, "claim", "evidence", F.col("nums")).alias("c"), C.predicate(CHINESE, "claim", "evidence").alias("p")).collect():
        assert (r.c, r.p) == (r.want, r.pred), r
    over = df.limit(1).select(C.category(CHINESE, "claim", "evidence", F.col("nums"), F.lit("structure")).alias("a"), C.category(CHINESE, "claim", "evidence", F.col("nums"), F.lit("odd")).alias("b")).first()
    assert tuple(over) == ("structure", "hard_fact")
    rel = spark.createDataFrame([("A为B提供设备",), ("属于赛道",), ("无",)], "claim string").withColumn("evidence", F.lit(""))
    assert [r[0] for r in rel.select(C.relation(CHINESE, "claim", "evidence")).collect()] == ["SUPPLIES", "BELONGS_TO_SEGMENT", None]


def test_grades(spark):
    assert one(spark, C.baseline_grade(F.lit("foreign_ib_research"))) == "B+" and one(spark, C.baseline_grade(F.lit("odd"))) == "C"
    for kind, pred, found, want in (
        ("broker_research", "HAS_CONFIRMED_ORDER", "confirmed", ("A", False)), ("broker_research", "HAS_CONFIRMED_ORDER", "refuted", ("D", False)),
        ("official_announcement", "HAS_CAPACITY", None, ("B", True)), ("expert_meeting", "HAS_CAPACITY", None, ("C", True)), ("broker_research", "HAS_CATALYST", "refuted", ("B", True)),
    ):
        got = one(spark, C.two_track_grade(F.lit(kind), F.lit(pred), F.lit(found).cast("string")))
        assert tuple(got) == want
    assert tuple(one(spark, C.two_track_grade(F.lit("official_announcement"), F.lit("HAS_CAPACITY"), F.lit(None).cast("string"), checked=False))) == ("A", True)


def test_codes(spark):
    cases = {"600000": "SH600000", "000001": "SZ000001", "300750": "SZ300750", "900901": "SH900901", "200002": "SZ200002", "920002": "BJ920002", "830799": "BJ830799", "510300": "SH510300", "159915": "SZ159915", "sh688627": "SH688627", "123": "stock_pending:123", "001234.OF": "fund:001234", "700000": "stock_pending:700000"}
    df = spark.createDataFrame(list(cases.items()), "code string, want string").withColumn("got", C.market_code(F.col("code")))
    assert all(r.got == r.want for r in df.collect())
    assert one(spark, C.plate(F.lit("688627"))) == "sh" and one(spark, C.plate(F.lit("510300"))) == ""
    assert tuple(one(spark, C.vendor_codes(F.lit("SH603690")))) == ("sh603690", "603690.SH")
    assert one(spark, C.code_of(F.lit("SZ300750"))) == "300750" and one(spark, C.code_of(F.lit("company:x"))) == ""
    assert one(spark, C.is_security(F.lit("stock_pending:1"))) and not one(spark, C.is_security(F.lit("concept:x"))) and not one(spark, C.is_security(F.lit(None).cast("string")))


def test_names_titles_speed_stance_domains(spark):
    for name, kind, want in (("2025年", "material", True), ("Part 52", "concept", True), ("巴西市场", "company", True), ("3.5亿元", "concept", True), ("1688", "company", False), ("精智达", "concept", False), ("2025年", "stock", False), ("  ", "company", True), (None, "stock", True)):
        assert one(spark, C.is_garbage(CHINESE, F.lit(name).cast("string"), F.lit(kind))) is want, name
    assert one(spark, C.title_category(CHINESE, F.lit("关于签订重大合同的公告"))) == "重大合同/中标" and one(spark, C.title_category(CHINESE, F.lit("其它"))) == "其他"
    assert one(spark, C.fact_speed(CHINESE, F.lit("中标订单"))) == "快变量" and one(spark, C.fact_speed(CHINESE, F.lit("护城河"))) == "慢变量"
    assert one(spark, C.stance(CHINESE, F.lit("看好突破,有风险"))) == "bullish" and one(spark, C.stance(CHINESE, F.lit("看空崩"))) == "bearish"
    assert one(spark, C.is_authoritative(F.lit("WWW.news.cls.cn"))) and not one(spark, C.is_authoritative(F.lit("wcls.cn")))
    assert one(spark, C.is_bank(CHINESE, F.lit("Goldman Sachs")))


def test_pricing_frames(spark):
    fields = ("pe_ttm", "pb", "pb_pct_3y", "ret_10d", "range_pct_250", "vol_ratio", "alpha_10d", "peer_alpha_10d")
    rows = [
        ({}, False, R.NO_FRAME, "中"), ({"pb": 3.0, "pb_pct_3y": 90.0}, True, "困境反转 / 主题定价", "低"), ({"ret_10d": 20.0}, False, "板块 beta / 主题驱动", "低"),
        ({"ret_10d": 20.0, "alpha_10d": 30.0, "peer_alpha_10d": 2.0}, False, "常态基本面定价", "中"), ({"pb": 1.0, "pb_pct_3y": 10.0}, False, "价值 / 低估修复", "高"), ({"pb": 1.0}, True, "困境反转(待盈利拐点)", "低"),
    ]
    df = spark.createDataFrame([(k, *[r[0].get(f) for f in fields], r[1], r[2], r[3]) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{f} double" for f in fields) + ", loss_making boolean, want string, w string")
    assert all((r.frame, r.weight) == (r.want, r.w) for r in C.pricing_frame(df).collect())
