"""Price and valuation series (code, ts, close, volume): returns, range, volume ratio, percentiles, excess returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import RuleSet
from ..lineage import checkpoint
from .classify import fact_speed

ORDER = ("ts", "tie")


def _by(*order: str) -> Window:
    return Window.partitionBy("code").orderBy(*order)


def returns(series: DataFrame, n: int, order: tuple[str, ...] = ORDER) -> DataFrame:
    """series with ret: the change in percent over n rows, null before."""
    base = F.lag("close", n).over(_by(*order))
    return series.withColumn("ret", F.when(base != 0, 100 * (F.col("close") / base - 1)))


def range_position(series: DataFrame, rows: int = 250, order: tuple[str, ...] = ORDER) -> DataFrame:
    """series with position: where the close stands between the least and greatest of the last rows, in percent."""
    frame = _by(*order).rowsBetween(-(rows - 1), 0)
    low, high = F.min("close").over(frame), F.max("close").over(frame)
    return series.withColumn("position", F.when(high > low, 100 * (F.col("close") - low) / (high - low)))


def volume_ratio(series: DataFrame, short: int = 5, long: int = 60, order: tuple[str, ...] = ORDER) -> DataFrame:
    """series with ratio of the short to the long mean volume; null while there are fewer than `long` rows."""
    mean = lambda n: F.avg("volume").over(_by(*order).rowsBetween(-(n - 1), 0))
    n = F.count("volume").over(_by(*order).rowsBetween(-(long - 1), 0))
    return series.withColumn("ratio", F.when((n >= long) & (mean(long) != 0), mean(short) / mean(long)))


def latest_percentile(series: DataFrame, least: int = 10, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Per code with more than `least` rows: last value, its percentile (share strictly smaller), share of negative values."""
    last = series.groupBy("code").agg(F.max_by("close", F.struct(*order)).alias("last"), F.count("*").alias("n")).filter(F.col("n") > least)
    return series.join(last, "code").groupBy("code").agg(F.first("last").alias("last"), (100.0 * F.count_if(F.col("close") < F.col("last")) / F.count("*")).alias("percentile"), (100.0 * F.avg((F.col("close") < 0).cast("int"))).alias("loss_share"))


def latest_return(series: DataFrame, n: int, order: tuple[str, ...] = ORDER, earlier: bool = False) -> DataFrame:
    """Per code the return over n rows at its last row, where it has one; with `earlier` at the last row that has one."""
    at = F.struct(*order)
    at = F.when(F.col("ret").isNotNull(), at) if earlier else at
    return returns(series, n, order).groupBy("code").agg(F.max_by("ret", at).alias("ret")).filter("ret is not null")


def peer_alpha(found: DataFrame, peers: DataFrame) -> DataFrame:
    """code, ret, peer_median, alpha against the upper median of its peers (columns code, peer); peers without a return don't count."""
    other = found.select(F.col("code").alias("peer"), F.col("ret").alias("peer_ret"))
    met = peers.filter("code <> peer").join(other, "peer").groupBy("code").agg(F.array_sort(F.collect_list("peer_ret")).alias("r"))
    out = found.join(met, "code").withColumn("peer_median", F.element_at("r", (F.size("r") / 2).cast("int") + 1))
    return out.select("code", "ret", "peer_median", (F.col("ret") - F.col("peer_median")).alias("alpha"))


def group_alpha(found: DataFrame, members: DataFrame) -> DataFrame:
    """peer_alpha() where the peers of a code are the other members of its group (members: code and the group's columns; a null is no group).

    No pairs are made: returns are put in order once a group, and each code reads the median at its place among the others.
    A member that repeats counts as often, as it would in pairs. Codes of several groups have peers in all of them and go by pairs.
    """
    group = [c for c in members.columns if c != "code"]
    own = members.dropna(subset=group).groupBy("code", *group).agg(F.count("*").alias("w")).join(found, "code")
    own = checkpoint(own.withColumn("groups", F.count("*").over(Window.partitionBy("code"))))
    sizes = own.groupBy(*group).agg(F.sum("w").alias("n"))
    up_to = Window.partitionBy(*group).orderBy("ret", "code").rowsBetween(Window.unboundedPreceding, 0)
    placed = checkpoint(own.withColumn("end", F.sum("w").over(up_to)).join(sizes, group).withColumn("before", F.col("end") - F.col("w")))
    # the upper median of the others; what stands at or behind the code moves up by the places that it takes itself
    others = F.floor((F.col("n") - F.col("w")) / 2)
    wanted = placed.filter("groups = 1 and n > w").select("code", "ret", *group, F.when(others < F.col("before"), others).otherwise(others + F.col("w")).alias("at"))
    places = wanted.select(*group, "at").distinct()  # two a group, if no member repeats
    medians = placed.select(*group, "before", "end", F.col("ret").alias("peer_median")).join(places, group).filter("before <= at and at < end").select(*group, "at", "peer_median")
    out = wanted.join(medians, [*group, "at"]).select("code", "ret", "peer_median", (F.col("ret") - F.col("peer_median")).alias("alpha"))
    several = own.filter("groups > 1").select("code", *group, F.col("w").alias("_w"))
    peers = several.join(own.select(F.col("code").alias("peer"), *group, "w"), group).select("code", "peer", F.explode(F.array_repeat(F.lit(0), (F.col("w") * F.col("_w")).cast("int")))).select("code", "peer")
    return out.unionByName(peer_alpha(found, peers))


def index_alpha(found: DataFrame, index: DataFrame) -> DataFrame:
    """found (code, ret) with index_ret and alpha, the return in excess of an index's (one row: ret); null without the index."""
    return found.join(F.broadcast(index.select(F.col("ret").alias("index_ret")).limit(1)), F.lit(True), "left").withColumn("alpha", F.col("ret") - F.col("index_ret"))


def environment(prices: DataFrame, valuations: DataFrame, index: DataFrame, peers: DataFrame | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """Per code the snapshot that pricing_frame() reads, rounded half to even as vendors' figures are.

    prices: code, close, volume and the order; valuations: code, metric (pb, pe_ttm), close and the order; index: prices of
    one code; peers: code, peer. A code with under eleven prices has no returns; under sixty volumes no ratio; up to ten valuations none.
    """
    last = lambda df, c: df.groupBy("code").agg(F.max_by(c, F.struct(*order)).alias(c), F.count("close").alias("n"))
    ten, five = (latest_return(prices, n, order).withColumn("ret", F.bround("ret", 1)) for n in (10, 5))
    spread = last(range_position(prices, order=order), "position").filter("n >= 11").select("code", F.bround("position", 0).alias("range_pct_250"))
    volume = last(volume_ratio(prices, order=order), "ratio").select("code", F.bround("ratio", 2).alias("vol_ratio"))
    base = latest_return(index, 10, order).select(F.bround("ret", 1).alias("ret"))
    beta = index_alpha(ten, base).select("code", F.bround("alpha", 1).alias("alpha_10d"))
    out = prices.select("code").distinct().join(five.withColumnRenamed("ret", "ret_5d"), "code", "left").join(ten.withColumnRenamed("ret", "ret_10d"), "code", "left")
    for part in (spread, volume, beta):
        out = out.join(part, "code", "left")
    if peers is not None:
        out = out.join(peer_alpha(ten, peers).select("code", F.bround("alpha", 1).alias("peer_alpha_10d")), "code", "left")
    else:
        out = out.withColumn("peer_alpha_10d", F.lit(None).cast("double"))
    for name in ("pb", "pe_ttm"):
        own = latest_percentile(valuations.filter(F.col("metric") == name), order=order)
        more = [F.bround("percentile", 0).alias("pb_pct_3y")] if name == "pb" else [(F.col("last") < 0).alias("loss_making"), F.bround("loss_share", 0).alias("loss_frac_3y")]
        out = out.join(own.select("code", F.bround("last", 2).alias(name), *more), "code", "left")
    return out


def reweight(rules: RuleSet, facts: DataFrame, group: str, samples: int = 4) -> DataFrame:
    """Per group: fast and slow facts, and the first fast claims (36 characters) by fact_id."""
    own = facts.withColumn("speed", fact_speed(rules, F.col("claim")))
    first = F.array_sort(F.collect_list(F.when(F.col("speed") == "快变量", F.struct("fact_id", F.substring("claim", 1, 36).alias("claim")))))
    return own.groupBy(group).agg(F.count_if(F.col("speed") == "快变量").alias("fast"), F.count_if(F.col("speed") == "慢变量").alias("slow"), F.transform(F.slice(first, 1, samples), lambda x: x["claim"]).alias("samples"))
