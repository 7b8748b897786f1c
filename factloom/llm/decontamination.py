"""Benchmark decontamination (operator 6): SimHash of item-sized windows, Hamming radius, exact verification.

Native: DataFrame functions only. The corpus is hashed once: its shingles, never stored, probe the items' shingles, and only the
counts of shared places per document and item leave that scan. A window that resembles an item shares a known least number of
places with it, so documents with fewer have no such window; few are left, and only these are hashed again. Their windows are
laid where a shared shingle puts them, fingerprinted, compared with the item within the radius, and verified by the weighted
Jaccard similarity. Each window meets the items that it shares shingles with. An index on blocks of bits would not do: at a
radius of 20 of 64 bits, 21 blocks have three bits each, and nearly all pairs agree on one of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, maybe_broadcast

SHINGLE, SIMILARITY = 5, 0.8
#: Shingle sets as similar as SIMILARITY differ in 10 of 64 bits on average, with a deviation of 3.
RADIUS = 20
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(column: str) -> F.Column:
    """Lower-cased words: runs of digits, letters and non-ASCII characters; none for a null."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), _BETWEEN), "")


def shingles(column: str, width: int) -> F.Column:
    """Hashes of each `width` neighbouring words of an array of words."""
    word = F.col(column)
    places = F.sequence(F.lit(0), F.size(column) - F.lit(width))
    made = F.transform(places, lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(width)]))
    return F.when(F.size(column) >= width, made).otherwise(F.array().cast("array<bigint>"))


def simhash(column: str) -> F.Column:
    """The 64 majority bits of an array of hashes, repeats counted, as a long."""
    ones = f"aggregate({column}, 0, (n, h) -> n + cast(shiftrightunsigned(h, b) & 1 as int))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (bits, b) -> bits | if(2 * {ones} > size({column}), shiftleft(1L, b), 0L))")


def _similarity(a: str, b: str) -> F.Column:
    """Weighted Jaccard similarity of two arrays, each value weighing as often as it occurs."""
    x, y = F.col(a), F.col(b)
    often = lambda array, v: F.size(F.filter(array, lambda other: other == v))
    shared = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda n, v: n + F.least(often(x, v), often(y, v)))
    return shared / (F.size(x) + F.size(y) - shared)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: for each document and item that a window of the document resembles the most similar, first window.

    Windows have as many words as the item (all words of a shorter document). Items shorter than a shingle are one shingle
    of all their words; items without words and null texts resemble nothing. Repeated rows give their leaks once; a null id is an
    id like others. A similarity of `similarity` or more counts. Other columns don't matter.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words(item_text).alias("item_words")).filter(F.size("item_words") > 0).distinct()
    items = items.withColumn("width", F.least(F.size("item_words"), F.lit(shingle))).withColumn("size", F.size("item_words"))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most `shingle` values
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for width in widths:
        part = _leaks_of_width(own, items.filter(F.col("width") == width).select("item_id", "size", shingles("item_words", width).alias("item_shingles")), width, similarity, radius)
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "n int").join(own.select("doc_id", F.lit(0).alias("n")), "n").select("doc_id", F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"))
    best = F.max_by(F.struct("start_word", "n_words", "similarity"), F.struct("similarity", -F.col("start_word")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.start_word", "b.n_words", F.round("b.similarity", 6).alias("similarity"))


def _same(a: DataFrame, b: DataFrame, *columns: str) -> F.Column:
    """Equality of columns, null ids being equal."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def _leaks_of_width(own: DataFrame, items: DataFrame, width: int, similarity: float, radius: int) -> DataFrame:
    # items are numbered: ids may repeat with other texts, and a number is cheaper to carry than an id
    items = checkpoint(items.withColumn("item", F.monotonically_increasing_id()).withColumn("item_print", simhash("item_shingles")))
    # an item's shingle stands for its first place only; each place in a document then gives one offset
    anchors = checkpoint(items.select("item", "size", F.posexplode("item_shingles").alias("place", "hash")).groupBy("item", "size", "hash").agg(F.min("place").alias("place")))
    anchors = maybe_broadcast(anchors, anchors.count())
    # the text's hash is part of the key, since ids may be null or repeated
    keyed = own.withColumn("version", F.xxhash64("text"))
    # hashing behind the explode stays in generated code; the outer form keeps the optimiser from splitting the text twice
    word = keyed.withColumn("words", words("text")).select("doc_id", "version", "words", F.posexplode_outer("words").alias("at", "word"))
    hashed = F.xxhash64("word", *[F.get("words", F.col("at") + k) for k in range(1, width)])
    placed = word.select("doc_id", "version", "at", F.size("words").alias("n"), hashed.alias("hash")).filter(F.col("at") <= F.col("n") - width)
    shared = placed.join(anchors, "hash").groupBy("doc_id", "version", "n", "item", "size").agg(F.count("*").alias("shared"))
    # of a and b shingles with a Jaccard similarity of s, s * (a + b) / (1 + s) are common at least
    need = F.lit(similarity / (1 + similarity)) * (F.least("size", "n") + F.col("size") - 2 * (width - 1))
    candidates = checkpoint(shared.filter(F.col("shared") >= need - 1e-6).select("doc_id", "version", "item"))
    rows = candidates.count()
    ids = candidates.select("doc_id", "version").distinct()
    hit = keyed.join(maybe_broadcast(ids, rows), _same(keyed, ids, "doc_id", "version"), "left_semi").dropDuplicates(["doc_id", "version"])
    hit = checkpoint(hit.withColumn("words", words("text")).withColumn("hashes", shingles("words", width)).select("doc_id", "version", "hashes", F.size("words").alias("n")))
    places = hit.select("doc_id", "version", "n", F.posexplode("hashes").alias("at", "hash")).join(anchors, "hash")
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("place"), F.col("n") - F.col("size"))).alias("start_word")
    starts = places.join(maybe_broadcast(candidates, rows), _same(places, candidates, "doc_id", "version", "item"), "left_semi").select("doc_id", "version", "item", start).distinct()
    met = starts.join(hit, _same(starts, hit, "doc_id", "version")).select(starts["doc_id"], "item", "start_word", "n", "hashes").join(maybe_broadcast(items, items.count()), "item")
    n_words = F.least("size", "n")
    windows = met.select("doc_id", "item_id", "start_word", n_words.alias("n_words"), "item_shingles", "item_print", F.slice("hashes", F.col("start_word") + 1, n_words - width + 1).alias("own"))
    near = windows.filter(F.bit_count(simhash("own").bitwiseXOR(F.col("item_print"))) <= radius)
    return near.withColumn("similarity", _similarity("own", "item_shingles")).filter(F.col("similarity") >= similarity).select("doc_id", "item_id", "start_word", "n_words", "similarity")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with their own columns, without the documents that hold a leak; all rows of such an id go, null ids too."""
    bad = checkpoint(leaks(docs, benchmark, id_col=id_col, text_col=text_col).select("doc_id").distinct())
    bad = maybe_broadcast(bad, bad.count())
    return docs.join(bad, docs[id_col].eqNullSafe(bad["doc_id"]), "left_anti")
