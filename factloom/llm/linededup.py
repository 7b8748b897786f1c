"""Line dedup (operator 2): lines that a large share of a site's pages contain are boilerplate and go.

Native: DataFrame functions only. A site's pages are never gathered; counts are summed on the map side by site and line, and
what comes back to the pages is the short list of each site's boilerplate lines. It is broadcast if it is counted small, and the
texts then never move; else pages and lists meet by site, a large site being spread over as many salts as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free, maybe_broadcast

#: A line goes if it stands on more than RATIO of its site's pages, and on MIN_PAGES pages at least.
RATIO, MIN_PAGES = 0.1, 4
#: Pages of a salt of a site, and hashes of boilerplate lines that are broadcast at most.
SALT_PAGES, BROADCAST_LINES = 10_000, 1_000_000
#: A line of more words is a passage.
PASSAGE_WORDS = 50

_HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
_BLOCK = r"(?i)</?(p|div|li|ul|ol|br|h[1-6]|tr|td|th|table|article|section|nav|header|footer|title|head|body|html)\b[^>]*>"


def html_lines(column: str) -> F.Column:
    """The text between block tags as an array of lines: scripts, styles, comments and other tags taken out, white space squeezed, empty lines left out."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(column), _HIDDEN, " "), r"[\s\x{A0}]+", " "), _BLOCK, "\n"), "<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def text_lines(column: str) -> F.Column:
    return F.split(F.col(column), "\n")


def host(column: str) -> F.Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, bad): for each site that has any the sorted hashes of its boilerplate lines; pages has columns site and lines.

    A line counts once a page, a repeated page counts again. A null site or null lines count for nothing. A site has lines per
    page / ratio of them at most, on average over its pages. An empty table gives an empty result.
    """
    seen = pages.filter("site is not null").select("site", F.explode(F.array_distinct(F.transform("lines", lambda line: F.xxhash64(line)))).alias("line"))
    often = seen.groupBy("site", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = pages.groupBy("site").agg(F.count("*").alias("total")).filter(F.col("total") >= min_pages)
    # per site the lines kept here are few, so its group is bounded whatever the number of its pages
    return often.join(totals, "site").filter(F.col("n") > ratio * F.col("total")).groupBy("site").agg(F.sort_array(F.collect_list("line")).alias("bad"))


def without_boilerplate(docs: DataFrame, site: F.Column, lines: F.Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, keep: list[str] | None = None, text: str = "clean_text", counts: tuple[str, str] | None = None, broadcast_lines: int = BROADCAST_LINES, salt_pages: int = SALT_PAGES) -> DataFrame:
    """The columns `keep` of docs (all, if None) with column `text`: each row's lines without its site's boilerplate, joined by newlines.

    counts, if given, names two more columns: how many lines a row had and how many went. Every row is kept, with an empty
    text if all its lines go; the text is null where `lines` is. A null site is a site of its own. Repeated rows count as pages
    each. Columns of docs with the names of new ones are replaced; any other names pass.
    """
    new = [text, *(counts or ())]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {n.lower() for n in new}]
    s, n, b, k, salt = (free(docs, x) for x in ("_site", "_lines", "_bad", "_kept", "_salt"))
    # with few columns kept, the lines are worked out once and written; with all, that would write the table again
    own = docs.select(*kept, F.coalesce(site.cast("string"), F.lit("\x00")).alias(s), lines.alias(n))
    own = own if keep is None else checkpoint(own)
    pages = own.select(F.col(s).alias("site"), F.coalesce(F.col(n), F.array().cast("array<string>")).alias("lines"))
    bad = checkpoint(boilerplate(pages, ratio, min_pages).select(F.col("site").alias(s), F.col("bad").alias(b)))
    if (bad.agg(F.sum(F.size(b))).first()[0] or 0) <= broadcast_lines:
        out = own.join(F.broadcast(bad), s, "left")
    else:
        # sites of more than salt_pages pages: as many as total / salt_pages at most
        large = checkpoint(own.groupBy(s).agg(F.ceil(F.count("*") / salt_pages).cast("int").alias("salts")).filter("salts > 1"))
        large = maybe_broadcast(large, large.count())
        spread = lambda df, of: df.join(large, s, "left").withColumn(salt, of(F.coalesce("salts", F.lit(1)))).drop("salts")
        dealt = spread(own, lambda salts: F.pmod(F.xxhash64(F.array_join(n, "\n")), salts).cast("int"))
        copies = spread(bad, lambda salts: F.explode(F.sequence(F.lit(0), salts - 1)))
        out = dealt.join(copies, [s, salt], "left")
    out = out.withColumn(k, F.when(F.col(b).isNull(), F.col(n)).otherwise(F.filter(n, lambda line: ~F.array_contains(F.col(b), F.xxhash64(line)))))
    count = lambda column: F.when(F.col(column).isNull(), 0).otherwise(F.size(column)).cast("long")
    made = [count(n).alias(counts[0]), (count(n) - count(k)).alias(counts[1])] if counts else []
    return out.select(*kept, *made, F.array_join(k, "\n").alias(text))


def drop_boilerplate(docs: DataFrame, site: F.Column, lines: F.Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) with n_lines, n_dropped and clean_text, as without_boilerplate() describes."""
    return without_boilerplate(docs, site, lines, ratio, min_pages, keep, counts=("n_lines", "n_dropped"))


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """docs with each line of more than `words` words taken out of all texts but that of the least id which has it; every row stays.

    All documents are one site, and two texts with the line are enough. Equal texts are one, so copies keep what their first
    keeps; rows with a null id come after the others. Near-copies share most of their lines: drop them before.
    """
    k, n, b = free(docs, "_key"), free(docs, "_lines"), free(docs, "_bad")
    own = docs.select("*", F.xxhash64(F.lit(1), text_col).alias(k), text_lines(text_col).alias(n))
    hashed = F.transform(F.filter(n, lambda line: F.size(F.split(F.trim(line), r"\s+")) > words), lambda line: F.xxhash64(line))
    seen = own.select(F.col(id_col).alias("id"), F.col(k).alias("key"), F.explode(F.array_distinct(hashed)).alias("line"))
    first = F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"]
    repeated = seen.groupBy("line").agg(F.min("key").alias("low"), F.max("key").alias("high"), first.alias("first")).filter("low <> high").select("line", "first")
    repeated = checkpoint(repeated)
    bad = seen.join(maybe_broadcast(repeated, repeated.count()), "line").filter(F.col("key") != F.col("first"))
    bad = checkpoint(bad.groupBy(F.col("key").alias(k)).agg(F.collect_set("line").alias(b)))  # lines of one text
    kept = F.array_join(F.filter(n, lambda line: ~F.array_contains(F.col(b), F.xxhash64(line))), "\n")
    out = own.join(maybe_broadcast(bad, bad.count()), k, "left")
    return out.select(*[F.when(F.col(b).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns])
