"""Best-fit packing (operator 9): tokenised documents into as few fixed-size sequences as possible, by exact-complement hashing.

A plan depends only on how many pieces there are of each length, a table of at most `size` counts, so the plan is made
on the driver whatever the corpus. Pieces then find their place by rank within their length. Ranks are counted in
blocks of equal length and hash, so that a length shared by a third of all pieces is spread over many tasks.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordIds, checkpoint, coded, kept, recoded, ship, slices

SIZE = 2048
#: Pieces that are ranked together, about.
BLOCK_ROWS = 100_000


#: What the shortcuts of ChunkTokens rely on: the rules of a tokenizer, and that its added tokens hold "<|".
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Chunks of these characters are normalized by lower-casing alone, and parted as SPLIT does by PARTS.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: The letters beyond ASCII among them, as BYTE_LEVEL writes their two bytes: bytes 127 to 160 as characters from 289 on, 173 as 323.
BYTE_CHARS = {c: "".join(chr(323 if b == 173 else b if b > 160 else b + 162) for b in chr(c).encode()) for c in range(0xDF, 0x100) if c != 0xF7}
#: Lower-cases ASCII and makes spaces of line ends; then what a byte is: 1 a small letter, 2 a mark, 3 an apostrophe, 0 anything else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 10 else b for b in range(256))
KINDS = bytes(1 if 97 <= b <= 122 else 3 if b == 39 else 2 if 33 <= b <= 126 and not chr(b).isalnum() else 0 for b in range(256))


def parted(texts: pa.Array) -> pa.Array:
    """A large_string column lower-cased (ASCII), line ends as spaces, and with a space between a letter and a mark behind it, and between a mark but an apostrophe and a letter."""
    texts = recoded(texts, LOWER)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not offsets[-1] - offsets[0]:
        return texts
    raw = memoryview(texts.buffers()[2])[int(offsets[0]) : int(offsets[-1])].tobytes()
    kinds, offsets = np.frombuffer(raw.translate(KINDS), np.uint8), offsets - offsets[0]
    left, right = kinds[:-1], kinds[1:]
    borders = np.flatnonzero(((left == 1) & (right > 1)) | ((left == 2) & (right == 1))) + 1
    own = np.ones(len(raw) + len(borders), bool)
    own[borders + np.arange(len(borders))] = False
    data = np.full(len(own), 32, np.uint8)
    data[own] = np.frombuffer(raw, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets + np.searchsorted(borders, offsets)).tobytes()), pa.py_buffer(data))


class ChunkTokens:
    """Token ids of chunks between spaces, worked out once a chunk.

    The tokenizer's rules never join text over white space, nor a letter and a mark behind it, nor a mark but an apostrophe and a
    letter behind it, so a text's ids are those of its chunks in order. Chunks of ASCII and western letters are parted here and only
    their parts meet the tokenizer's model; its own rules take most of its time. Others, and those of a tokenizer with other
    rules, meet the tokenizer whole. The cache is forgotten beyond `most` chunks.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        rules = json.loads(self.tokenizer.to_str())
        self.model = self.tokenizer.model
        self.plain = rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]} and all("<|" in t["content"] for t in rules["added_tokens"])
        self.forget()

    def forget(self) -> None:
        self.known, self.used = WordIds(), 0
        self.pool, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)

    def _plain(self, chunk: str) -> list[int]:
        tokenize, chunk = self.model.tokenize, chunk.lower()
        if chunk.isascii():
            return [t.id for part in PARTS.findall(chunk) for t in tokenize(part)]
        return [t.id for part in PARTS.findall(chunk) for t in tokenize(part.translate(BYTE_CHARS))]

    def _learn(self, fresh: list[str]) -> None:
        """Appends the fresh chunks' ids to the pool, in order."""
        found = [self._plain(c) if self.plain and PLAIN.fullmatch(c) and "<|" not in c else None for c in fresh]
        others = [k for k, ids in enumerate(found) if ids is None]
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([fresh[k] for k in part], add_special_tokens=False), strict=True):
                found[k] = e.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        start = self.ends[self.used]
        while start + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.used + len(fresh) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.pool[start : start + len(flat)] = flat
        self.ends[self.used + 1 : self.used + 1 + len(fresh)] = start + np.cumsum(lengths)
        self.used += len(fresh)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts (large_string, no nulls), without special tokens added, and where each text's ids start (one more at the end)."""
        if len(self.known) > self.most:
            self.forget()
        # more chunks agree; the tokenizer lower-cases and parts anyway, but for its special tokens' own names
        texts = parted(texts) if self.plain and not pc.any(pc.match_substring(texts, "<|")).as_py() else pc.replace_substring(texts, "\n", " ")
        codes, distinct, offsets = coded(pc.split_pattern(texts, " "))
        rows = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        if self.known.fresh:
            self._learn(self.known.fresh)
            self.known.fresh = []
        rows = rows[codes]
        first = self.ends[rows]
        lengths = self.ends[rows + 1] - first
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.pool[np.repeat(first - ends[:-1], lengths) + np.arange(ends[-1])], ends[offsets]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each document's tokens and a closing 0, cut every `size` tokens.

    A null or empty text is one piece holding only the closing 0. Repeated rows give their pieces again. Other columns
    don't pass. Texts are taken whole, however long. tokenizer: path of a `tokenizers` file, readable on executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept(("tokens", tokenizer), lambda: ChunkTokens(tokenizer))
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                rows, starts, lengths, crcs, ids = [], [], [], [], []
                flat, ends = tokens.encode(texts)
                for k in range(len(texts)):
                    whole = np.append(flat[ends[k] : ends[k + 1]], np.uint32(0)).astype("<u4")
                    for start in range(0, len(whole), size):
                        part = whole[start : start + size]
                        rows.append(at + k)
                        starts.append(start)
                        lengths.append(len(part))
                        crcs.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            ids.append(part.astype(np.int64))
                out = {"doc_id": batch.column(0).take(pa.array(rows, pa.int64())), "piece": pa.array([s // size for s in starts], pa.int32()), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())}
                if with_ids:
                    out["ids"] = pa.array(ids, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


class Sums:
    """Index of the sums of one, two and three available lengths; lengths that are used up go from it for good."""

    def __init__(self, lengths: list[int], size: int) -> None:
        self.there = np.zeros(size + 1, bool)
        self.there[lengths] = True
        own = np.flatnonzero(self.there)
        i, j = np.triu_indices(len(own))
        total = own[i] + own[j]
        fit = np.flatnonzero(total <= size)
        fit = fit[np.lexsort((own[j[fit]] - own[i[fit]], total[fit]))]  # within a sum the most even pairs first: they spare the short lengths
        self.long, self.short = own[j[fit]].astype(np.int32), own[i[fit]].astype(np.int32)
        self.first = np.searchsorted(total[fit], np.arange(size + 2))
        self.last = self.first[1:].copy()

    def used_up(self, length: int) -> None:
        self.there[length] = False

    def singles(self, total: int) -> Iterator[tuple[int, ...]]:
        if self.there[total]:
            yield (total,)

    def pairs(self, total: int) -> Iterator[tuple[int, ...]]:
        """Pairs of available lengths with this sum; a pair passed over at the front is not looked at again."""
        a, b = self.first[total], self.last[total]
        live = a + np.flatnonzero(self.there[self.long[a:b]] & self.there[self.short[a:b]])
        self.first[total] = live[0] if len(live) else b
        yield from ((int(self.long[k]), int(self.short[k])) for k in live)

    def triples(self, total: int) -> Iterator[tuple[int, ...]]:
        """Triples, each in falling order, by their longest length."""
        most = np.flatnonzero(self.there[: max(total - 1, 0)])
        most = most[(3 * most >= total) & (self.first[total - most] < self.last[total - most])]
        for n in most.tolist():
            yield from ((n, *rest) for rest in self.pairs(total - n) if rest[0] <= n)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, the lengths that each holds), from how many pieces there are of each length.

    Gaps are filled exactly by single lengths, then by pairs, then by triples. Where short lengths are rare, pairs and triples
    take them from gaps that only they fit; if so, the plan without triples, or without pairs too, needs fewer sequences and is taken.
    """
    return min((_plan(counts, size, parts) for parts in (3, 2, 1)), key=lambda made: sum(times for times, _ in made))


def _plan(counts: dict[int, int], size: int, parts: int) -> list[tuple[int, tuple[int, ...]]]:
    """A plan with exact complements of `parts` lengths at most.

    Longest first: the gap a length leaves is looked up among the sums, and as many sequences are closed at once as the
    counts allow; every such step uses up a length, so the steps don't grow with the corpus. What no combination fills exactly
    is then packed by best fit, again many sequences at once.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n > size or n < 1 for n in left):
        raise ValueError("a length outside 1..size")
    made: list[tuple[int, tuple[int, ...]]] = []
    sums = Sums(list(left), size)

    def take(lengths: tuple[int, ...]) -> bool:
        """Closes as many sequences of these lengths as there are; False if a length that repeats is too rare."""
        need = Counter(lengths)
        times = min(left.get(n, 0) // k for n, k in need.items())
        if times:
            made.append((times, lengths))
            for n, k in need.items():
                left[n] -= times * k
                if not left[n]:
                    del left[n]
                    sums.used_up(n)
        return times > 0

    take((size,))
    for find in (sums.singles, sums.pairs, sums.triples)[:parts]:
        for first in range(size - 1, 0, -1):
            while first in left and any(take((first, *rest)) for rest in find(size - first)):
                pass
    # best fit on what is left: a class of sequences with equal contents is filled as one
    open_: dict[int, list[list]] = {}
    gaps: list[int] = []
    for n in sorted(left, reverse=True):
        more = left[n]
        while more:
            at = bisect_right(gaps, n - 1)
            if at == len(gaps):
                fits = size // n
                full, rest = divmod(more, fits)
                for times, k in ((full, fits), (1, rest)):
                    if times and k:
                        _open(open_, gaps, size - n * k, [times, (n,) * k])
                break
            gap = gaps[at]
            group = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            used = min(group[0], more)
            if group[0] > used:
                _open(open_, gaps, gap, [group[0] - used, group[1]])
            _open(open_, gaps, gap - n, [used, (*group[1], n)])
            more -= used
    return made + [(times, lengths) for groups in open_.values() for times, lengths in groups]


def _open(open_: dict[int, list[list]], gaps: list[int], gap: int, group: list) -> None:
    if gap not in open_:
        open_[gap] = []
        insort(gaps, gap)
    open_[gap].append(group)


def slots(made: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, offset): where the pieces of a length with such ranks go."""
    out, used, base = [], {}, 0
    for times, lengths in made:
        offset = 0
        for n in lengths:
            at = used.get(n, 0)
            out.append((n, at, at + times, base, offset))
            used[n] = at + times
            offset += n
        base += times
    return out


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """found (columns doc_id, piece, length and any more) with sequence_id and offset; found must read the same each time, as a checkpoint does.

    Sequences are gapless from offset 0. An empty table stays empty. Pieces that agree in every ordering column (repeated
    rows) are told apart by nothing, so any of them may take any of their places. Columns named sequence_id, offset or
    starting with `_p_` are replaced.
    """
    spark = found.sparkSession
    found = found.drop("sequence_id", "offset", *[c for c in found.columns if c.startswith("_p_")])
    total = found.count()
    blocks = max(1, math.ceil(total / BLOCK_ROWS)) * 64
    keyed = found.withColumn("_p_block", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(blocks)).cast("int"))
    per_block = checkpoint(keyed.groupBy("length", "_p_block").agg(F.count("*").alias("_p_n")))
    counts = {r[0]: r[1] for r in per_block.groupBy("length").agg(F.sum("_p_n")).collect()}  # at most `size` rows
    places = spark.createDataFrame(slots(plan(counts, size)), "_p_length long, _p_from long, _p_to long, _p_sequence long, _p_offset long")
    before = per_block.withColumn("_p_before", F.coalesce(F.sum("_p_n").over(Window.partitionBy("length").orderBy("_p_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the blocks' first ranks, cut at the borders of the places, so that rows meet few places: (length, block) -> places it reaches
    reach = before.join(F.broadcast(places), (F.col("length") == F.col("_p_length")) & (F.col("_p_from") < F.col("_p_before") + F.col("_p_n")) & (F.col("_p_to") > F.col("_p_before")))
    reach = reach.groupBy("length", "_p_block").agg(F.min("_p_before").alias("_p_before"), F.array_sort(F.collect_list(F.struct("_p_from", "_p_to", "_p_sequence", "_p_offset"))).alias("_p_places"))
    ranked = keyed.withColumn("_p_rank", F.row_number().over(Window.partitionBy("length", "_p_block").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    placed = ranked.join(reach, ["length", "_p_block"]).withColumn("_p_rank", F.col("_p_rank") + F.col("_p_before"))
    placed = placed.withColumn("_p_place", F.expr("filter(_p_places, x -> x._p_from <= _p_rank and x._p_to > _p_rank)[0]"))
    return placed.select(*found.columns, (F.col("_p_place._p_sequence") + F.col("_p_rank") - F.col("_p_place._p_from")).alias("sequence_id"), F.col("_p_place._p_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenises and packs documents: a row per piece, as pieces() and pack() describe; with_ids adds the token ids themselves."""
    return pack(checkpoint(pieces(docs, tokenizer, size, id_col, text_col, with_ids)), size)
