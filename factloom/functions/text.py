"""Scalar functions as column expressions: normalisation, grams, ids, numbers and dates. No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import DROPPED


def normalize(s: Column) -> Column:
    """Lower case without white space and punctuation; null becomes empty."""
    return F.translate(F.lower(F.coalesce(s, F.lit(""))), DROPPED, "")


def content_grams(s: Column) -> Column:
    """ASCII words of two letters or digits and more, and neighbouring pairs of CJK characters (a lone one by itself), distinct."""
    text = F.coalesce(s, F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{2,})"), 1)
    runs = F.regexp_extract_all(text, F.lit("([一-鿿]+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda x: F.when(F.length(x) == 1, F.array(x)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))))))
    return F.array_distinct(F.concat(words, pairs))


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of the parts joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary")), 1, 16)


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared grams by the smaller set's size; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def coverage(query: Column, found: Column) -> Column:
    return F.size(F.array_intersect(query, found)) / F.greatest(F.size(query), F.lit(1))


def parse_num(s: Column) -> Column:
    """The first number in a text, null without one."""
    return F.regexp_extract(s, r"(-?\d+\.?\d*)", 1).try_cast("double")


def backtest_years(s: Column) -> Column:
    """Years from the first to the second year of a span such as 2010.1-2020; null if there is none or it runs backwards."""
    a, b = (F.regexp_extract(s, r"(20\d{2})[.\-/年]?\d{0,2}[^\d]{0,4}(20\d{2})", k).try_cast("int") for k in (1, 2))
    return F.when(b >= a, (b - a).cast("double"))


def recall_tokens(s: Column, most: int = 24) -> Column:
    """Pieces between spaces and separators, 2 to 40 characters long, then grams; the first `most` distinct ones in order."""
    pieces = F.filter(F.split(F.coalesce(s, F.lit("")), r"[\s,，、;；。]+"), lambda x: F.length(x).between(2, 40))
    return F.slice(F.array_distinct(F.concat(pieces, content_grams(s))), 1, most)


def iso_date(s: Column) -> Column:
    """The date of a text that begins with YYYY-MM-DD, else null."""
    head = F.substring(s, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def recency(valid_at: Column, as_of: Column) -> Column:
    """1 for today and later, falling to 0 over 365 days; 0 without a date."""
    age = F.datediff(as_of, iso_date(valid_at))
    return F.when(age.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / 365)))


def epoch_ms_date(ms: Column) -> Column:
    """UTC date of epoch milliseconds as text, empty without one; years have four digits at least and bear no plus sign."""
    day = F.date_from_unix_date(F.floor(ms / F.lit(86400000).cast("decimal(20,0)")).cast("int"))
    year = F.year(day)
    digits_ = F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    return F.coalesce(F.concat(digits_, F.date_format(day, "-MM-dd")), F.lit(""))


def digits(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"\D", "")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda n, v: n + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def first_json(s: Column) -> Column:
    """The first balanced JSON object in a text, as text, from its first brace; null if there is none.

    Every closing brace is tried until what stands before it parses, so braces inside texts do no harm.
    """
    start = F.instr(s, "{")
    body = F.when(start > 0, F.substring(s, start, F.length(s)))
    ends = F.filter(F.sequence(F.lit(1), F.length(body)), lambda i: F.substring(body, i, F.lit(1)) == "}")
    return F.get(F.filter(F.transform(ends, lambda i: F.substring(body, F.lit(1), i)), lambda x: F.try_parse_json(x).isNotNull()), 0)
