"""SimHash near-dedup (operator 10): 64-bit fingerprints of word shingles, linked within a Hamming radius by vantage-point trees.

Equal fingerprints are one class. A pair within the radius differs in at most `radius` bits, so of radius + k disjoint
groups of bits k at least agree in full: a shard is k groups and their values, that is, the fingerprints at distance 0
from a vantage point on these bits, and no more bits are used than it takes for shards of about SHARD fingerprints. A cut at
a distance of 64 random bits would instead copy most rows to both sides of each boundary. A shard that skew made larger is
cut again into rings of Hamming distance around a vantage point, and each ring is also given the rows beyond its outer boundary
that the radius reaches. In a shard a vantage-point tree finds the pairs, pruned by triangle bounds; a shard gives back who
belongs together, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, checkpoint, free, maybe_broadcast, ship
from .components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a shard, about; one with more than RINGS times as many is cut into rings, so often at most.
SHARD, RINGS, CUTS = 1024, 4, 3
#: Fingerprints of a tree's node that are compared all with all.
LEAF = 96
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = (256 * np.arange(8)).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' XXH64; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, and white space is \\x20 and \\x09-\\x0d
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last, strict=False)], "<u8")
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(seen.ravel() * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with `fingerprint` (16 hex digits) of each whole text; null and wordless texts have fingerprint zero.

    Fewer words than a shingle make one shingle. A column of that name is replaced.
    """

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = batch.column(text_col).cast(pa.large_binary())
            return {"fingerprint": pa.array([f"{fingerprint(t.as_py() or b'', shingle):016x}" for t in texts])}

        return step

    return append_columns(docs, make, "fingerprint string")


class _Sets:
    """Union-find over rows 0..n-1 with the least row as root, fed with arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def find(self, rows: np.ndarray) -> np.ndarray:
        """The roots of some rows, whose paths are shortened."""
        at = self.up[rows]
        while not np.array_equal(above := self.up[at], at):
            at = above
        self.up[rows] = at
        return at

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))

    @property
    def root(self) -> np.ndarray:
        return self.find(np.arange(len(self.up)))


def tree_components(prints: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, tally: dict | None = None) -> np.ndarray:
    """For each of some distinct uint64 fingerprints the least row that chains of pairs within the radius reach.

    tally, if given, counts what was compared: pairs, cuts.
    """
    sets = _Sets(len(prints))
    tally = {} if tally is None else tally
    tally |= {"pairs": 0, "cuts": 0}

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of a and b, in blocks."""
        tally["pairs"] += len(a) * len(b)
        for at in range(0, len(a), 256):
            x = a[at : at + 256]
            for to in range(0, len(b), 2048):
                y = b[to : to + 2048]
                i, j = np.nonzero(np.bitwise_count(prints[x][:, None] ^ prints[y]) <= radius)
                sets.link(x[i], y[j])

    def cut(rows: np.ndarray) -> tuple[np.uint64, int] | None:
        """A vantage point among the rows and the greatest distance to it of the inner half; None if all are equally far."""
        tally["pairs"] += len(rows)
        tally["cuts"] += 1
        vantage = prints[rows[0]]
        far = np.bitwise_count(prints[rows] ^ vantage)
        near = rows[far <= radius]
        sets.link(np.full(len(near), rows[0]), near)
        edge = int(np.median(far[1:]))
        if edge == far[1:].max():
            edge -= 1
        return (vantage, edge) if edge >= far[1:].min() else None

    def one(rows: np.ndarray) -> bool:
        """Whether the rows are known to belong together; what else is among them then changes nothing."""
        found = sets.find(rows)
        return bool((found == found[0]).all())

    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(prints)), None)]
    while todo:
        a, b = todo.pop()
        if b is None:  # pairs among the rows a
            if len(a) < 2 or one(a):
                continue
            found = cut(a) if len(a) > leaf else None
            if found is None:
                compare(a, a)
                continue
            vantage, edge = found
            inside = np.bitwise_count(prints[a] ^ vantage) <= edge
            todo += [(a[inside], None), (a[~inside], None), (a[inside], a[~inside])]
        else:  # pairs between the rows a and the rows b, each within the other's reach
            if not len(a) or not len(b) or one(np.concatenate([a, b])):
                continue
            if len(a) > len(b):
                a, b = b, a
            found = cut(b) if len(b) > leaf else None
            if found is None:
                compare(a, b)
                continue
            vantage, edge = found
            mine, theirs = np.bitwise_count(prints[a] ^ vantage).astype(int), np.bitwise_count(prints[b] ^ vantage)
            # by the triangle bound nothing within the radius of a row lies on the other side of the edge
            todo += [(a[mine <= edge + radius], b[theirs <= edge]), (a[mine > edge - radius], b[theirs > edge])]
    return sets.root


def _masks(n: int, radius: int, shard: int) -> list[int]:
    """Masks of bits such that a pair within the radius agrees on one of them, with values for shards of about `shard` of n fingerprints."""
    need = math.ceil(math.log2(max(n / shard, 1)))
    for agree in (1, 2, 3):
        edges = [round(64 * k / (radius + agree)) for k in range(radius + agree + 1)]
        groups = [range(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        if need <= min(map(len, groups)) * agree:
            break
    chosen = ([bit for group in some for bit in group] for some in combinations(groups, agree))
    return sorted({sum(1 << bit for bit in bits[:need]) for bits in chosen})


def link(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, cuts: int = CUTS) -> DataFrame:
    """(print, root) for distinct longs `print`: root is the least print (as a signed long) reached by links of at most `radius` differing bits.

    Only prints that link with another one appear. A shard still too large after `cuts` cuts is solved by one task; what is
    known to belong together isn't compared again there, so a dense group costs little more than its size.
    """
    prints = checkpoint(prints)
    signed = [m - (1 << 64) if m >> 63 else m for m in _masks(prints.count(), radius, shard)]
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(signed)])
    rows = prints.select("print", F.explode(parts).alias("s")).select("print", F.concat_ws("/", "s.part", "s.value").alias("shard"))
    for _ in range(cuts):
        sizes = checkpoint(rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("print").alias("vantage")).filter(F.col("n") > RINGS * shard).select("shard", "vantage"))
        if sizes.isEmpty():
            break
        far = F.bit_count(F.col("print").bitwiseXOR(F.col("vantage")))
        width = radius + 1
        ring = (far / width).cast("int")
        # a row also goes to the ring below if that ring's rows can be within the radius
        rings = F.when(F.col("vantage").isNull(), F.array(F.lit(None).cast("int"))).when((ring > 0) & (far % width < radius), F.array(ring, ring - 1)).otherwise(F.array(ring))
        rows = rows.join(sizes, "shard", "left").select("print", "shard", F.explode(rings).alias("ring")).select("print", F.concat_ws(":", "shard", F.col("ring").cast("string")).alias("shard"))
        rows = checkpoint(rows)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come ordered by shard; a shard may reach over batches."""
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            names = batch["shard"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            rest = batch.iloc[starts[-1] :]
            yield from solved(batch["print"].to_numpy(), starts)
        if rest is not None and len(rest):
            yield from solved(rest["print"].to_numpy(), np.array([0, len(rest)]))

    def solved(values: np.ndarray, bounds: np.ndarray) -> Iterator[pd.DataFrame]:
        u, v = [], []
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a > 1:
                own = np.unique(values[a:b])
                root = tree_components(own.view(np.uint64), radius)
                moved = np.flatnonzero(root != np.arange(len(own)))
                u.append(own[moved])
                v.append(own[root[moved]])
        if u and sum(map(len, u)):
            yield pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    ship(prints.sparkSession)
    # a task's work is its pairs of rows, not its bytes, by which small partitions would be put together
    tasks = max(1, math.ceil(rows.count() / (16 * shard)))
    edges = rows.repartition(tasks, "shard").sortWithinPartitions("shard").mapInPandas(shards, "u long, v long")
    return components(edges).select(F.col("node").alias("print"), "root")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_key (a hash of the text), fingerprint and group (a fingerprint, as a long) of each row: rows of a group are linked."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = checkpoint(fingerprints(slim, "text", shingle).select("doc_id", "text_key", "fingerprint"))
    printed = found.withColumn("print", _as_long("fingerprint"))
    roots = checkpoint(link(printed.select("print").distinct(), radius))
    out = printed.join(maybe_broadcast(roots, roots.count()), "print", "left")
    return out.select("doc_id", "text_key", "fingerprint", F.coalesce("root", "print").alias("group"))


def with_components(found: DataFrame) -> DataFrame:
    """found (doc_id, group and more) with component_id, the least id of each group."""
    least = found.groupBy("group").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    # a group of one row needs no join: what is joined are the rows of groups, however large, with one row each
    least = checkpoint(least.filter("n > 1").drop("n"))
    out = found.join(maybe_broadcast(least, least.count()), "group", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id: the least id that chains of linked fingerprints reach, the row's own included.

    Repeated rows repeat; rows whose id is null keep a null component unless a linked row has an id. Other columns don't
    pass. An empty table gives an empty result. Equal texts, empty ones too, are linked like any other.
    """
    return with_components(grouped(docs, id_col, text_col, shingle, radius)).select("doc_id", "fingerprint", "component_id")


def _as_long(column: str) -> F.Column:
    """16 hex digits as the signed long with these bits."""
    high = F.conv(F.substring(column, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(column, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[[DataFrame, str, str], DataFrame] = grouped) -> DataFrame:
    """docs without all but one row of each group of near-duplicates, as `find` gives them (doc_id, text_key, group).

    The row with the least id stays; of rows that repeat this id with texts of the same group that with the least hash of the
    text; of rows that repeat the text too any one. An id that is repeated with texts of two groups stands for either. Rows
    with a null id are judged by no one and stay. Columns and their names pass as they are.
    """
    rows = checkpoint(find(docs, id_col, text_col).filter("doc_id is not null").groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("n")))
    several = rows.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("rows")).filter("rows > 1").select("group", "first")
    several = checkpoint(several)
    gone = rows.join(maybe_broadcast(several, several.count()), "group").filter(F.struct("doc_id", "text_key") != F.col("first")).select("doc_id", "text_key")
    again = rows.filter("n > 1").select("doc_id", "text_key")
    gone, again = checkpoint(gone), checkpoint(again)
    key = free(docs, "text_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    same = lambda left, right: (left[id_col] == right["doc_id"]) & (left[key] == right["text_key"])
    gone, n_again = maybe_broadcast(gone, gone.count()), again.count()
    kept = keyed.join(gone, same(keyed, gone), "left_anti")  # rows without an id equal none, so they stay
    if n_again:
        again = maybe_broadcast(again, n_again)
        kept = kept.join(again, same(kept, again), "left_anti").unionByName(kept.join(again, same(kept, again), "left_semi").dropDuplicates([id_col, key]))
    return kept.drop(key)
