"""LM scoring (operator 3): cross-entropy difference of two matched bigram models over one vocabulary.

Words map to the 2 ** 20 ids of a shared hashed vocabulary, so there are no unknown words and unigram counts are bounded. The
target model counts a target corpus, the background model the documents to be scored, all of them; both are bigram
models smoothed alike towards their unigrams. Bigram counts grow with the corpora and stay spread out: the bigrams of a block
of documents travel, packed and once a document, to the shard of the pair, where both models' counts of it are complete; the
documents' sums of losses travel back. A pair that makes up more than a HOT_SHARE of all entries is no key of the shuffle: its
counts are summed on the map side, and its losses are worked out where the documents are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordRows, checkpoint, coded_words, kept, release, ship, slices

BITS = 20
VOCABULARY = 1 << BITS
#: Weight of the unigram model in each context, and of each word in the unigram model.
KAPPA, ALPHA = 5.0, 0.1
#: Tokens of a shard, about, and characters of a block of documents.
SHARD_TOKENS, BLOCK_CHARS = 4_000_000, 6_000_000
#: A shard is worked through in so many parts of its pairs.
PARTS = 4
#: Share of the entries (a pair in a document) that makes a pair a hot one; there are 2 / HOT_SHARE of them at most.
HOT_SHARE = 1 / 2000
_TOTAL, _PAIR = -1, 1 << 2 * BITS


def word_ids(words: list[str]) -> np.ndarray:
    """The first five hex digits of each word's MD5."""
    return np.fromiter((int(hashlib.md5(w.encode()).hexdigest()[:5], 16) for w in words), np.int64, len(words))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, their word ids and where each row's start, for each block of rows; the text is the last column."""
    cache = kept(("lm",), lambda: WordRows(word_ids))
    for batch in batches:
        for at, part in slices(batch.column(batch.num_columns - 1), BLOCK_CHARS):
            codes, distinct, offsets = coded_words(part)
            yield batch.slice(at, len(part)), cache(distinct)[codes], offsets


def _pairs(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block the pairs of each document, once each, in order of document and pair: document, pair, count."""
    whose = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inner = np.flatnonzero(whose[1:] == whose[:-1])
    # documents of a block are fewer than 2 ** 23: a pair has 40 bits
    own, count = np.unique((whose[inner] << 2 * BITS) | (ids[inner] << BITS) | ids[inner + 1], return_counts=True)
    return own >> 2 * BITS, own & (_PAIR - 1), count


def _counted(hot_share: float):
    """How often each word occurs, and how often with another word behind it; the number of entries (word _TOTAL); pairs that are common in a block, with entries (_PAIR + pair).

    A pair that makes up hot_share of all entries has half of its entries at least in blocks where it makes up half that share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, offsets in _blocks(batches):
            ends = np.zeros(len(ids), bool)
            ends[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
            words, place, count = np.unique(ids, return_inverse=True, return_counts=True)
            pairs, entries = np.unique(_pairs(ids, offsets)[1], return_counts=True)
            common = entries >= hot_share / 2 * entries.sum()
            yield pa.RecordBatch.from_pydict({
                "word": np.concatenate([words, [_TOTAL], _PAIR + pairs[common]]),
                "n": np.concatenate([count, [entries.sum()], entries[common]]),
                "c": np.concatenate([count - np.bincount(place[ends], minlength=len(words)), np.zeros(1 + common.sum(), np.int64)]),
            })

    return run


def _places(pairs: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The place of each pair among the sorted hot ones, -1 for others."""
    if not len(hot):
        return np.full(len(pairs), -1)
    at = np.minimum(np.searchsorted(hot, pairs), len(hot) - 1)
    return np.where(hot[at] == pairs, at, -1)


def _hot_counts(hot: np.ndarray):
    """How often each hot pair occurs in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, offsets in _blocks(batches):
            _, pairs, count = _pairs(ids, offsets)
            at = _places(pairs, hot)
            seen = np.bincount(at[at >= 0], weights=count[at >= 0], minlength=len(hot)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"place": np.flatnonzero(seen), "n": seen[seen > 0]})

    return run


def _packed(pairs: np.ndarray) -> bytes:
    """Five bytes each."""
    return pairs.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<i8").ravel()


def _shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards


def _send(shards: int, is_target: bool, hot: np.ndarray):
    """A row for each block and shard: the block's documents (none for the target), how many pairs each has here, the pairs and counts; hot pairs aren't sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (rows, ids, offsets) in enumerate(_blocks(batches)):
            block = TaskContext.get().partitionId() << 32 | number
            if is_target:  # whose a pair is doesn't matter
                inner = np.ones(max(len(ids) - 1, 0), bool)
                inner[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(ids))] - 1] = False
                pairs, count = np.unique(((ids[:-1] << BITS) | ids[1:])[inner], return_counts=True)
                docs = np.zeros(len(pairs), np.int64)
            else:
                docs, pairs, count = _pairs(ids, offsets)
            cold = _places(pairs, hot) < 0
            docs, pairs, count = docs[cold], pairs[cold], count[cold]
            if not len(pairs):
                continue
            shard = _shard(pairs, shards)
            order = np.argsort(shard, kind="stable")
            pairs, docs, shard, count = pairs[order], docs[order], shard[order], count[order]
            bounds = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
            keys = None if is_target else rows.column(0).to_numpy()
            out = {"shard": [], "block": [], "keys": [], "lengths": [], "pairs": [], "counts": []}
            for a, b in zip(bounds, bounds[1:], strict=False):
                there, lengths = np.unique(docs[a:b], return_counts=True)
                out["shard"].append(int(shard[a]))
                out["block"].append(block)
                out["keys"].append(b"" if is_target else keys[there].astype("<i8").tobytes())
                out["lengths"].append(b"" if is_target else lengths.astype("<u4").tobytes())
                out["pairs"].append(_packed(pairs[a:b]))
                out["counts"].append(count[a:b].astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({name: pa.array(v, {"shard": pa.int32(), "block": pa.int64()}.get(name, pa.binary())) for name, v in out.items()})

    return run


def _loss(seen: np.ndarray, pairs: np.ndarray, unigram: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Nats of the second word of each pair behind the first."""
    return -np.log((seen + KAPPA * unigram[pairs & (VOCABULARY - 1)]) / (contexts[pairs >> BITS] + KAPPA))


def _losses(shared):
    """All rows of a shard -> for each block that sent documents the sums of both models' losses over their pairs here, packed."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        release()
        models = shared.value
        frame = frame.sort_values("block", kind="stable")
        parts = [_unpacked(x) for x in frame["pairs"]]
        target = np.repeat([not x for x in frame["keys"]], [len(x) for x in parts])
        pairs = np.concatenate(parts)
        del parts
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in frame["counts"]])
        lengths = np.concatenate([np.frombuffer(x, "<u4") for x in frame["lengths"]]).astype(np.int64)
        docs = np.full(len(pairs), -1, np.int32)
        docs[~target] = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        sums = {"n": np.zeros(len(lengths)), "t": np.zeros(len(lengths)), "b": np.zeros(len(lengths))}
        for part in range(PARTS):  # a part of the pairs at a time takes less memory
            own = np.flatnonzero((pairs >> 3) % PARTS == part)
            if not len(own):
                continue
            found, place = np.unique(pairs[own], return_inverse=True)
            mine, k = ~target[own], counts[own].astype(float)
            at = docs[own][mine]
            sums["n"] += np.bincount(at, weights=k[mine], minlength=len(lengths))
            for name, mask in (("t", ~mine), ("b", mine)):
                unigram, contexts = models[name]
                seen = np.bincount(place[mask], weights=k[mask], minlength=len(found))
                loss = _loss(seen, found, unigram, contexts)
                sums[name] += np.bincount(at, weights=loss[place[mine]] * k[mine], minlength=len(lengths))
        sizes = [len(x) // 4 for x in frame["lengths"]]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        rows = [(block, keys, *(sums[c][i:j].astype("<f8" if c != "n" else "<u4").tobytes() for c in ("n", "t", "b"))) for block, keys, i, j in zip(frame["block"], frame["keys"], bounds, bounds[1:], strict=False) if j > i]
        return pd.DataFrame(rows, columns=["block", "keys", "n", "t", "b"])

    return run


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    """The packed sums of a block of documents from all shards -> one row per document key."""
    key = np.concatenate([np.frombuffer(x, "<i8") for x in frame["keys"]])
    distinct, at = np.unique(key, return_inverse=True)
    out = {c: np.bincount(at, weights=np.concatenate([np.frombuffer(x, kind) for x in frame[c]]), minlength=len(distinct)) for c, kind in (("n", "<u4"), ("t", "<f8"), ("b", "<f8"))}
    return pd.DataFrame({"key": distinct, "n": out["n"].astype(np.int64), "t": out["t"], "b": out["b"]})


def _model(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Unigram probabilities, context counts and tokens, from at most VOCABULARY rows."""
    rows = counts.filter(F.col("word").between(0, VOCABULARY - 1)).toArrow()
    n, c = np.zeros(VOCABULARY), np.zeros(VOCABULARY)
    word = rows["word"].to_numpy()
    n[word], c[word] = rows["n"].to_numpy(), rows["c"].to_numpy()
    return (n + ALPHA) / (n.sum() + ALPHA * VOCABULARY), c, int(n.sum())


def _hot(counts: DataFrame, hot_share: float) -> np.ndarray:
    """The hot pairs, sorted: 2 / hot_share at most."""
    total = counts.filter(F.col("word") == _TOTAL).agg(F.sum("n")).first()[0] or 0
    rows = counts.filter((F.col("word") >= _PAIR) & (F.col("n") >= hot_share / 2 * total)).select("word").collect()
    return np.array(sorted(r[0] - _PAIR for r in rows), np.int64)


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", hot_share: float = HOT_SHARE) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and score, their difference: lower is more like the target.

    A document's first word is scored by the unigram models. Texts without words, null ones too, have n_tokens 0 and
    null losses and score. Repeated rows count and are scored as often as they stand. Other columns don't pass. An empty
    target gives the uniform model.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text")).select("doc_id", "key", "text")
    wanted = target.select(F.col(target_text).cast("string").alias("text"))
    counts = lambda texts: checkpoint(texts.mapInArrow(_counted(hot_share), "word long, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))
    counted, counted_t = counts(own.select("text")), counts(wanted)
    unigram_b, context_b, tokens = _model(counted)
    unigram_t, context_t, more = _model(counted_t)
    hot = _hot(counted, hot_share)
    hot_losses = {}
    for name, texts, unigram, contexts in (("t", wanted, unigram_t, context_t), ("b", own.select("text"), unigram_b, context_b)):
        seen = np.zeros(len(hot))
        if len(hot):
            for r in texts.mapInArrow(_hot_counts(hot), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
                seen[r["place"]] = r["n"]
        hot_losses[name] = _loss(seen, hot, unigram, contexts)
    shared = spark.sparkContext.broadcast({"t": (unigram_t, context_t), "b": (unigram_b, context_b)})  # 4 * VOCABULARY doubles
    shards = math.ceil((tokens + more + 1) / SHARD_TOKENS)
    fields = "shard int, block long, keys binary, lengths binary, pairs binary, counts binary"
    sent = own.select("key", "text").mapInArrow(_send(shards, False, hot), fields).union(wanted.mapInArrow(_send(shards, True, hot), fields))
    packed = sent.groupBy("shard").applyInPandas(_losses(shared), "block long, keys binary, n binary, t binary, b binary")
    blocks = packed.groupBy("block").applyInPandas(_summed, "key long, n long, t double, b double")  # a block's documents are bounded by an Arrow batch
    sums = blocks.groupBy("key").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number of words and of pairs sent, and losses of the first word and the hot pairs, of each document."""
        models = shared.value
        for rows, ids, offsets in _blocks(batches):
            n = np.diff(offsets)
            first = np.where(n > 0, np.append(ids, 0)[np.minimum(offsets[:-1], len(ids))], 0)
            docs, pairs, count = _pairs(ids, offsets)
            at = _places(pairs, hot)
            docs, at, count = docs[at >= 0], at[at >= 0], count[at >= 0]
            here = {m: np.bincount(docs, weights=count * hot_losses[m][at], minlength=len(n)) for m in "tb"}
            sent = np.maximum(n - 1, 0) - np.bincount(docs, weights=count, minlength=len(n)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "key": rows.column(1), "n_tokens": n, "sent": sent, "ft": here["t"] - np.log(models["t"][0][first]), "fb": here["b"] - np.log(models["b"][0][first])})

    head = own.mapInArrow(heads, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, key long, n_tokens long, sent long, ft double, fb double").join(sums, "key", "left")
    copies = F.greatest(F.col("n") / F.greatest(F.col("sent"), F.lit(1)), F.lit(1.0))  # equal rows have sent their pairs once each
    loss = lambda first, rest: F.when(F.col("n_tokens") > 0, (F.col(first) + F.coalesce(F.col(rest) / copies, F.lit(0.0))) / F.col("n_tokens"))
    out = head.select("doc_id", "n_tokens", loss("ft", "t").alias("target_loss"), loss("fb", "b").alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
