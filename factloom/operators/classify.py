"""Rule-based projections: finding categories, predicates, grades, stances, titles, codes, garbage names and pricing frames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.rules import RuleSet, pattern
from ..functions.text import digits, normalize


def mapped(key: Column, table: dict, default=None) -> Column:
    """A small rule table as an expression."""
    out = F.lit(default)
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def finding_text(claim: str, evidence: str) -> Column:
    return F.lower(F.concat(F.coalesce(F.col(claim), F.lit("")), F.lit(" "), F.coalesce(F.col(evidence), F.lit(""))))


def has_metric(claim: str, evidence: str, numbers: Column) -> Column:
    """Numbers of its own, or any digit in the text."""
    return (F.coalesce(F.size(numbers), F.lit(0)) > 0) | F.concat(F.coalesce(F.col(claim), F.lit("")), F.coalesce(F.col(evidence), F.lit(""))).rlike(r"\d")


def category(rules: RuleSet, claim: str, evidence: str, numbers: Column, override: Column | None = None) -> Column:
    """quant_fact, hard_fact, structure or background, the first that applies; a valid override wins."""
    text = finding_text(claim, evidence)
    dated = text.rlike(rules.date) | (F.coalesce(F.size(numbers), F.lit(0)) > 0)
    hard = text.rlike("|".join(pattern(w) for w in rules.hard.values()))
    structure = text.rlike("|".join("|".join(w) for w in rules.structure.values()))
    out = F.when(text.rlike(pattern(rules.quant)) & has_metric(claim, evidence, numbers), "quant_fact").when(hard & dated, "hard_fact").when(structure, "structure").otherwise("background")
    return out if override is None else F.when(override.isin("hard_fact", "structure", "quant_fact", "background"), override).otherwise(out)


def predicate(rules: RuleSet, claim: str, evidence: str) -> Column:
    """The strongest predicate with a hit, HAS_CATALYST without any."""
    text = finding_text(claim, evidence)
    return F.coalesce(*[F.when(text.rlike(pattern(rules.hard[p])), F.lit(p)) for p in R.PRIORITY], F.lit("HAS_CATALYST"))


def relation(rules: RuleSet, claim: str, evidence: str) -> Column:
    """The first relation type with a hit, null without any."""
    text = finding_text(claim, evidence)
    return F.coalesce(*[F.when(text.rlike("|".join(w)), F.lit(t)) for t, w in rules.structure.items()])


def baseline_grade(kind: Column) -> Column:
    return mapped(kind, R.BASELINE, R.UNKNOWN_GRADE)


def grade_rank(level: Column, unknown: int = 0) -> Column:
    return mapped(level, R.GRADE_RANK, unknown)


def two_track_grade(kind: Column, predicate: Column, verification: Column, checked: bool = True) -> Column:
    """struct(level, unverifiable): a verifiable predicate follows its verification (confirmed, refuted, null: not found); others keep the baseline."""
    base = baseline_grade(kind)
    keep = F.struct(base.alias("level"), F.lit(True).alias("unverifiable"))
    if not checked:
        return keep
    made = lambda level, open_: F.struct(level.alias("level"), F.lit(open_).alias("unverifiable"))
    return F.when(~predicate.isin(*R.VERIFIABLE), keep).when(verification == "confirmed", made(F.lit("A"), False)).when(verification == "refuted", made(F.lit("D"), False)).otherwise(made(mapped(base, R.DOWNGRADE), True))


def stance(rules: RuleSet, text: Column) -> Column:
    """bullish or bearish, whichever has more distinct words in the text, else neutral."""
    count = lambda words: reduce(lambda a, b: a + b, [F.lower(text).contains(w).cast("int") for w in words])
    up, down = count(rules.bullish), count(rules.bearish)
    return F.when(up > down, "bullish").when(down > up, "bearish").otherwise("neutral")


def title_category(rules: RuleSet, title: Column) -> Column:
    """The first category with a word in the title."""
    return F.coalesce(*[F.when(title.rlike(pattern(words)), F.lit(name)) for name, words in rules.titles], F.lit(rules.other_title))


def fact_speed(rules: RuleSet, claim: Column) -> Column:
    """快变量 (fast), 慢变量 (slow) or 中性 by the words of a claim."""
    return F.when(claim.rlike(pattern(rules.fast)), "快变量").when(claim.rlike(pattern(rules.slow)), "慢变量").otherwise("中性")


def is_garbage(rules: RuleSet, name: Column, kind: Column) -> Column:
    """Dates, law articles, regional markets, generic words and (as concept or material) bare numbers; coded types never."""
    n = F.trim(name)
    g = rules.garbage
    odd = n.rlike(g["date"]) | n.rlike(g["legal"]) | n.rlike(g["market"]) | n.isin(*rules.generic) | (kind.isin("concept", "material") & n.rlike(g["number"]))
    return F.coalesce(F.when(n.isNull() | (n == ""), True).when(kind.isin(*R.SAFE_TYPES), False).otherwise(odd), F.lit(True))


def is_bank(rules: RuleSet, name: Column) -> Column:
    return F.lower(F.trim(name)).rlike("|".join(re.escape(w) for w in rules.banks))


def is_authoritative(domain: Column) -> Column:
    """Whether a domain is one of the media or under one; only a leading `www.` is taken off."""
    d = F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")
    return reduce(lambda a, b: a | b, [(d == w) | d.endswith("." + w) for w in R.MEDIA])


def market_code(code: Column) -> Column:
    """A security code with its exchange: SH, SZ, BJ, fund:, or stock_pending: where it can't be told."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    d = digits(c)
    first = F.substring(d, 1, 1)
    of = lambda prefix: F.concat(F.lit(prefix), d)
    return (
        F.when(c.contains(".OF"), F.when(d != "", of("fund:")).otherwise(F.concat(F.lit("fund:"), F.lower(c))))
        .when(c.rlike(r"^(SH|SZ|BJ)\d+$"), c)
        .when(F.length(d) != 6, F.concat(F.lit("stock_pending:"), F.lower(c)))
        .when(F.substring(d, 1, 3) == "920", of("BJ"))
        .when(first.isin("6", "5"), of("SH"))
        .when(first.isin("0", "3", "2") | F.substring(d, 1, 2).isin("15", "16", "18"), of("SZ"))
        .when(first == "9", of("SH"))
        .when(first.isin("8", "4"), of("BJ"))
        .otherwise(of("stock_pending:"))
    )


def plate(code: Column) -> Column:
    """Exchange plate of a code by its first digit, empty if unknown."""
    first = F.substring(digits(code), 1, 1)
    return F.when(first.isin("6", "9"), "sh").when(first.isin("0", "3", "2"), "sz").when(first.isin("8", "4"), "bj").otherwise("")


def vendor_codes(cid: Column) -> Column:
    """struct(lower, dotted): sh600000 and 600000.SH; empty without six digits."""
    s = F.upper(F.coalesce(cid, F.lit("")))
    number = F.regexp_extract(s, r"(SH|SZ|BJ)?[^0-9]*(\d{6})", 2)
    named = F.regexp_extract(s, r"(SH|SZ|BJ)?[^0-9]*(\d{6})", 1)
    first = F.substring(number, 1, 1)
    market = F.when(named != "", named).when(first.isin("6", "9"), "SH").when(first.isin("4", "8"), "BJ").otherwise("SZ")
    empty = number == ""
    return F.struct(F.when(empty, "").otherwise(F.concat(F.lower(market), number)).alias("lower"), F.when(empty, "").otherwise(F.concat(number, F.lit("."), market)).alias("dotted"))


def is_security(cid: Column) -> Column:
    return F.coalesce(cid.rlike(r"^((SH|SZ|BJ)\d|company:|stock_pending:)"), F.lit(False))


def code_of(cid: Column) -> Column:
    """Six digits of a listed security's id, empty for others."""
    return F.regexp_extract(F.coalesce(cid, F.lit("")), r"^(SH|SZ|BJ)(\d{6})$", 2)


def entity_type(kind: Column) -> Column:
    return F.when(kind.isin("stock", "company", "fund", "index", "product", "person", "material"), kind).otherwise("concept")


def canonical_id(name: Column, kind: Column, code: Column) -> Column:
    """The market code if there is one, else type:name."""
    return F.when(F.coalesce(code, F.lit("")) != "", market_code(code)).when(kind == "stock", F.concat(F.lit("stock_pending:"), F.lower(F.trim(name)))).otherwise(F.concat(kind, F.lit(":"), F.trim(name)))


def entity_id(name: Column, kind: Column, code: Column) -> Column:
    """The id an ingest gives: stocks by their market code or as pending, funds outside the exchange by their code, all else as type:name, normalised."""
    coded = F.coalesce(code, F.lit("")) != ""
    plain = normalize(name)
    return (
        F.when((kind == "stock") & coded, market_code(code))
        .when(kind == "stock", F.concat(F.lit("stock_pending:"), plain))
        .when(coded & F.upper(code).contains(".OF"), market_code(code))
        .otherwise(F.concat(kind, F.lit(":"), plain))
    )


def pricing_frame(snapshot: DataFrame) -> DataFrame:
    """snapshot with frame and weight, by a decision list over nullable measures.

    Measures: pe_ttm, pb, pb_pct_3y, ret_10d, range_pct_250, vol_ratio, alpha_10d, peer_alpha_10d, loss_making. Missing
    measures never decide; without price and valuation there is no frame.
    """
    c = F.col
    yes = lambda e: F.coalesce(e, F.lit(False))
    loss, hot = yes(c("loss_making")), yes(c("ret_10d") >= 15)
    high, low = yes(c("pb_pct_3y") >= 80), yes(c("pb_pct_3y") <= 30)
    alpha = F.coalesce("peer_alpha_10d", "alpha_10d")
    frame = (
        F.when(c("ret_10d").isNull() & c("pb").isNull(), R.NO_FRAME)
        .when(high & loss, "困境反转 / 主题定价")
        .when(hot & (alpha.isNull() | (alpha >= 10)), "板块 beta / 主题驱动")
        .when(low & ~loss, "价值 / 低估修复")
        .when(loss, "困境反转(待盈利拐点)")
        .otherwise("常态基本面定价")
    )
    flags = [F.when(loss, "loss"), F.when(yes(c("vol_ratio") >= 1.3), "volume_up"), F.when(c("range_pct_250") >= 70, "high").when(c("range_pct_250") <= 30, "low").when(c("range_pct_250").isNotNull(), "middle")]
    out = snapshot.withColumn("frame", frame).withColumn("weight", mapped(F.col("frame"), R.FRAME_WEIGHT, "中"))
    return out.withColumn("reasons", F.when(F.col("frame") == R.NO_FRAME, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*flags))))
