"""Embedding near-dedup (operator 7): robust-pruned flat graphs over overlapping cluster shards, searched greedily from medoids.

Equal vectors of a label are one class. Each class goes to the cells of its label's nearest pivots, so cells overlap; a cell with too
many classes is split again around pivots of its own. What is still too large is a dense group, whose members pivots can't part:
it is cut into blocks, and each pair of blocks is a task, one of them searched for the other. Each block builds a graph of its own
members; a class's adjacency lists are then united over its cells. A search starts at the block's medoid, follows the nearest
neighbours, then widens over all that is within the range. What it finds is verified by the exact cosine. A task gives back
how many a query found and whom it belongs with, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship
from .components import components
from .simhash import _Sets

COSINE = 0.93
#: Classes of a graph, about; cells a class goes to; cells of a split cell it goes to; most pivots there are at either level; neighbours of a node; width of the greedy search.
SHARD, CELLS, INNER, PIVOTS, DEGREE, BEAM = 400, 3, 2, 8192, 24, 32
#: Classes of a block of a dense cell, in shards, and numbers that a cell's own cells have.
DENSE, _CELL = 1, 1 << 20
#: Pruning slack, and how far under the range the search still widens.
ALPHA, SLACK = 1.2, 0.06


def apart(vectors: np.ndarray, cosine: float = 0.7) -> np.ndarray:
    """The unit vectors that are no nearer to an earlier one kept: several pivots inside one dense group would part its members."""
    kept: list[int] = []
    for k in range(len(vectors)):
        if not kept or (vectors[kept] @ vectors[k]).max() < cosine:
            kept.append(k)
    return vectors[kept]


def _unit(frame: pd.Series) -> np.ndarray:
    v = np.stack(frame.to_numpy()).astype(np.float64)
    return v / np.linalg.norm(v, axis=1)[:, None]


def prune(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust-pruned out-neighbours of each unit vector: the nearest left, without those that it is alpha times nearer to; all vectors take a step at a time."""
    n = len(vectors)
    apart_ = (1 - vectors @ vectors.T).astype(np.float32)
    left = apart_.copy()
    np.fill_diagonal(left, np.inf)
    chosen = [[] for _ in range(n)]
    live = np.arange(n)
    for _ in range(degree):
        best = left[live].argmin(axis=1)
        there = np.isfinite(left[live, best])
        live, best = live[there], best[there]
        if not len(live):
            break
        for p, q in zip(live.tolist(), best.tolist(), strict=True):
            chosen[p].append(q)
        rows = left[live]
        rows[alpha * apart_[best] <= rows] = np.inf
        rows[np.arange(len(live)), best] = np.inf
        left[live] = rows
    return [np.array(c, np.int64) for c in chosen]


def search(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, starts: np.ndarray, cosine: float = COSINE, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs within the range that the greedy search finds; neighbours is padded with -1, starts has entry nodes per query (-1: none)."""
    n, m = len(queries), len(vectors)
    found = np.full((n, m), -2.0, np.float32)  # cosine of each visited node
    done = np.zeros((n, m), bool)

    def visit(q: np.ndarray, nodes: np.ndarray) -> None:
        flat, at = nodes.ravel(), np.repeat(q, nodes.shape[1])
        real = flat >= 0
        flat, at = flat[real], at[real]
        new = found[at, flat] == -2
        at, flat = at[new], flat[new]
        for k in range(0, len(at), 200_000):
            a, f = at[k : k + 200_000], flat[k : k + 200_000]
            found[a, f] = np.einsum("ij,ij->i", queries[a], vectors[f])

    every = np.arange(n)
    visit(every, starts)
    live = every
    while len(live):
        seen = found[live]
        # the nearest node not yet expanded, if it is among the beam's nearest or in the widened range
        ahead = np.where(done[live], -3, seen)
        best = ahead.argmax(axis=1)
        value = ahead[np.arange(len(live)), best]
        edge = np.partition(seen, m - min(beam, m), axis=1)[:, m - min(beam, m)]
        go = (value > -2) & ((value >= edge) | (value >= cosine - SLACK))
        live, best = live[go], best[go]
        done[live, best] = True
        if len(live):
            visit(live, neighbours[best])
    return np.nonzero(found >= cosine - 1e-4)


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    ids = frame["class"].to_numpy()
    lists = prune(_unit(frame["v"]))
    return pd.DataFrame({"class": ids, "near": [ids[x] for x in lists]})


def _find(cosine: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        member, asks = frame["member"].to_numpy(), np.flatnonzero(frame["query"].to_numpy())
        ids, weight, cell = frame["class"].to_numpy(), frame["n"].to_numpy(), int(frame["cell"].iloc[0])
        vectors = _unit(frame["v"])
        rows = np.flatnonzero(member)
        links = np.zeros(len(ids), np.int64)
        if not len(rows) or len(ids) < 2:
            return pd.DataFrame({"class": ids, "links": links, "root": ids})
        at = {c: k for k, c in enumerate(ids[rows])}
        ends = [(k, at[c]) for k, near in enumerate(frame["near"].to_numpy()[rows]) if near is not None for c in near if c in at]
        # edges count both ways: a node that none of its neighbours chose stays reachable
        ends = np.unique(np.array(ends + [(b, a) for a, b in ends], np.int64).reshape(-1, 2), axis=0)
        degree = np.bincount(ends[:, 0], minlength=len(rows))
        neighbours = np.full((len(rows), max(1, degree.max(initial=0))), -1, np.int64)
        neighbours[ends[:, 0], np.arange(len(ends)) - np.repeat(np.cumsum(degree) - degree, degree)] = ends[:, 1]
        medoid = int((vectors[rows] @ vectors[rows].sum(axis=0)).argmax())
        cells = frame["cells"].to_numpy()
        sets = _Sets(len(ids))
        for first in range(0, len(asks), 1000):
            own = asks[first : first + 1000]
            starts = np.full((len(own), 2), medoid, np.int64)
            starts[:, 1] = [at.get(c, -1) for c in ids[own]]  # a member is an entry to its own surroundings
            q, m = search(vectors[rows], neighbours, vectors[own], starts, cosine)
            a, b = own[q], rows[m]
            sure = (ids[a] != ids[b]) & (np.einsum("ij,ij->i", vectors[a], vectors[b]) >= cosine)  # verified in double precision
            a, b = a[sure], b[sure]
            sets.link(a, b)
            # a pair that shares several cells counts in the least of them
            mine = np.array([min(set(cells[x]) & set(cells[y])) == cell for x, y in zip(a, b, strict=True)], bool) if len(set(map(len, cells))) > 1 or len(cells[0]) > 1 else np.ones(len(a), bool)
            np.add.at(links, a[mine], weight[b[mine]])
        return pd.DataFrame({"class": ids, "links": links, "root": ids[sets.root]})

    return run


_PLACED = "class long, label string, n long, v array<double>, cells array<long>"


def _pivots(rows: DataFrame, share: DataFrame) -> dict[str, np.ndarray]:
    """Unit vectors by key, as many of each key's rows (class, key, v) as its share asks for, picked by the class; those too near to another are left out."""
    picked = rows.join(F.broadcast(share), "key").filter(F.pmod("class", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("key", "class", "v").collect()
    found: dict[str, list] = {}
    for r in sorted(picked, key=lambda r: (r["key"], r["class"])):
        found.setdefault(r["key"], []).append(r["v"])
    out = {}
    for key, v in found.items():
        v = np.array(v)
        out[key] = apart(v / np.linalg.norm(v, axis=1)[:, None])
    return out


def _assign(outer, inner):
    """Rows (class, label, n, v) with the sorted cells of each; pivots by label, and by label and cell for the cells that are split."""

    def nearest(v: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
        return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :most]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, split = outer.value, inner.value if inner else {}
        for batch in batches:
            labels, v = batch.column(1).to_pylist(), batch.column(3)
            found = [[0] for _ in labels]
            rows_of: dict[str, list[int]] = {}
            for k, x in enumerate(labels):
                rows_of.setdefault(x, []).append(k)
            for label, rows in rows_of.items():
                if label in pivots:
                    top = nearest(np.array(v.take(pa.array(rows)).to_pylist()), pivots[label], CELLS)
                    for k, x in zip(rows, top.tolist(), strict=True):
                        found[k] = x
            if split:
                into: dict[str, list[tuple[int, int]]] = {}
                for k, x in enumerate(found):
                    for cell in x:
                        into.setdefault(f"{labels[k]}/{cell}", []).append((k, cell))
                found = [[] for _ in labels]
                for key, rows in into.items():
                    if key in split:
                        top = nearest(np.array(v.take(pa.array([k for k, _ in rows])).to_pylist()), split[key], INNER)
                        for (k, cell), x in zip(rows, top.tolist(), strict=True):
                            found[k] += [(cell + 1) * _CELL + y for y in x]
                    else:
                        for k, cell in rows:
                            found[k].append(cell)
            cells = pa.array([sorted(x) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), v, cells], names=["class", "label", "n", "v", "cells"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row; rows link if their labels are equal and their cosine is at least `cosine`.

    Rows whose label, id or vector is null, or whose vector is empty, zero or holds nulls or non-finite values, link with nothing:
    n_links 0, their own id as component. Vectors of other lengths than their label's most don't mix: lengths are
    compared like labels. Repeated rows are other vectors. Other columns don't pass. Found links are exact; links may be
    missed where linked vectors share none of their CELLS nearest pivots, or a search ends early: audit() measures how many. A pair
    that shares several cells counts in the least of them.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = "vec_id is null or label is null or v is null or size(v) = 0 or exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) or forall(v, x -> x = 0)"
    own = own.withColumn("bad", F.expr(f"coalesce({bad}, true)"))
    rows = own.filter("not bad").withColumn("label", F.concat_ws("/", F.col("label").cast("string"), F.size("v"))).withColumn("class", F.xxhash64("label", "v"))
    classes = checkpoint(rows.groupBy("class").agg(F.first("label").alias("label"), F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v")))
    total = classes.count()
    size = max(shard, math.ceil(CELLS * total / PIVOTS))
    large = {r[0]: r[1] for r in classes.groupBy("label").count().filter(F.col("count") > size).collect()}  # total / size of them at most
    pivots = {}
    if large:
        share = spark.createDataFrame([(k, CELLS / size) for k in large], "key string, share double")
        pivots = _pivots(classes.withColumn("key", F.col("label")), share)
    slim = classes.select("class", "label", "n", "v")
    placed = checkpoint(slim.mapInArrow(_assign(spark.sparkContext.broadcast(pivots), None), _PLACED).select("*", F.explode("cells").alias("cell")))
    # cells that are too large get pivots of their own, PIVOTS in all at most
    crowded = placed.groupBy("label", "cell").count().filter(F.col("count") > 2 * size).select(F.concat_ws("/", "label", "cell").alias("key"), "count")
    crowded = checkpoint(crowded)
    rows_there = crowded.agg(F.sum("count")).first()[0] or 0
    if rows_there:
        share = crowded.select("key", F.least(F.lit(CELLS / size), F.lit(PIVOTS / rows_there)).alias("share"))
        inner = _pivots(placed.withColumn("key", F.concat_ws("/", "label", "cell")), share)
        placed = checkpoint(slim.mapInArrow(_assign(spark.sparkContext.broadcast(pivots), spark.sparkContext.broadcast(inner)), _PLACED).select("*", F.explode("cells").alias("cell")))
    blocks = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / F.lit(DENSE * size)).cast("int").alias("k")).filter("k > 1")
    routed = placed.join(blocks, ["label", "cell"], "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("b", F.pmod("class", F.col("k")).cast("int"))
    # a class is a member in the pairs of its block with each block, and a query in those of each block with its own
    pair = lambda i, j: F.struct((i * F.col("k") + j).alias("part"), (i == F.col("b")).alias("member"), (j == F.col("b")).alias("query"))
    others = F.sequence(F.lit(0), F.col("k") - 1)
    pairs = F.array_distinct(F.concat(F.transform(others, lambda j: pair(F.col("b"), j)), F.transform(others, lambda i: pair(i, F.col("b")))))
    routed = checkpoint(routed.select("class", "label", "n", "v", "cells", "cell", F.explode(pairs).alias("p")).select("class", "label", "n", "v", "cells", "cell", "p.*"))
    built = routed.filter("member and query").groupBy("label", "cell", "part").applyInPandas(_build, "class long, near array<long>")
    united = built.groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # CELLS lists at most
    found = checkpoint(routed.join(united, "class").groupBy("label", "cell", "part").applyInPandas(_find(cosine), "class long, links long, root long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("class").alias("u"), F.col("root").alias("v")).filter("u <> v"))
    known = classes.select("class", "least", "n").join(links, "class").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("class", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "class").join(known, "class").select("vec_id", "n_links", "component_id")
    alone = own.filter("bad").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def audit(vectors: DataFrame, found: DataFrame, queries: int = 500, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> float:
    """Share of the links of `queries` vectors (the first by a hash of the id) that n_links of `found` holds, against all rows by brute force.

    Rows that can't link aren't asked; 1.0 if there are no links. Ids must not repeat.
    """
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null or isnan(x)) and exists(v, x -> x <> 0)")
    picked = own.orderBy(F.xxhash64("vec_id")).limit(queries).collect()
    labels, ids = np.array([r["label"] for r in picked]), np.array([r["vec_id"] for r in picked])
    q = np.array([r["v"] for r in picked])
    q /= np.linalg.norm(q, axis=1)[:, None]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            near = q @ _unit(frame["v"]).T >= cosine
            near &= (labels[:, None] == frame["label"].to_numpy()) & (ids[:, None] != frame["vec_id"].to_numpy())
            yield pd.DataFrame({"vec_id": ids, "want": near.sum(axis=1)})

    want = own.mapInPandas(count, f"vec_id {own.schema['vec_id'].dataType.simpleString()}, want long").groupBy("vec_id").agg(F.sum("want").alias("want"))
    got = want.join(found, "vec_id").agg(F.sum(F.least("want", "n_links")), F.sum("want")).first()
    return got[0] / got[1] if got[1] else 1.0
