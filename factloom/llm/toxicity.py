"""Toxicity (operator 1): a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of those of its hashed units: the word itself, its beginnings and its ends, so that unseen forms
of known words count. Filters of several widths run over the words, each filter's maximum over the whole text feeds a logistic
unit. A threshold is calibrated for each language on scores that every training row got from a model which hasn't seen it, and
drawn to the overall one where a language has few rows. The language of a text is guessed from its words alone, as the training
rows have taught it.

Every labelled row teaches, with its whole text. The rows are dealt by a hash of their id into parts of about PART_ROWS; in each
epoch every part goes on from the common model with its own rows, in a task, and the parts' models are averaged. A unit's vector
moves by the mean over the parts that moved it. What the driver holds doesn't grow with the rows, as units are hashed to BUCKETS.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, WordRows, append_columns, checkpoint, coded_words, free, kept, labelled_rows, release, ship, slices, sums

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 16, (1, 2, 3), 12
#: Lengths of the beginnings and ends of a word that are units of it.
HEADS, TAILS = (3, 4, 5, 6), (3, 4)
#: Training rows of a part, about, and rows of a table that are summed together over the parts.
PART_ROWS, BLOCK = 6_000, 4096
EPOCHS, BATCH, RATE, E_RATE, DECAY, E_DECAY = 8, 32, 0.03, 0.1, 1e-4, 0.01
#: Rows that many epochs go over: with more rows there are fewer epochs, LEAST_EPOCHS at least; each goes over every row.
SEEN_ROWS, LEAST_EPOCHS = 40_000, 3
#: The score at which a text counts as toxic; the calibrated threshold of each language is moved there.
CUT = 0.7
#: Parts of the training rows for the calibration, and the rows of the rarer label that weigh as much as the overall threshold.
FOLDS, SHRINK = 2, 10
#: Languages that are told apart at most: those with most training rows.
MOST_LANGUAGES, UNKNOWN = 50, "und"
#: Empty places behind each text, so that every filter has a place even in a text without words.
PAD = max(WIDTHS)


def units(words: list[str]) -> np.ndarray:
    """Hashes of each word's units, a column for each kind: the word, its first HEADS bytes, its last TAILS bytes; -1 where a word isn't longer."""
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.full((len(raw), 1 + len(HEADS) + len(TAILS)), -1, np.int64)
    out[:, 0] = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % BUCKETS
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raw) + bytes(max(*HEADS, *TAILS)), np.uint8).astype(np.uint64)
    column = 1
    for kinds, first, way in ((HEADS, ends - sizes, 1), (TAILS, ends - 1, -1)):
        h = np.full(len(raw), 0x9E3779B97F4A7C15 if way > 0 else 0xC2B2AE3D27D4EB4F, np.uint64)
        for k in range(max(kinds)):
            h = (h ^ data[np.maximum(first + way * k, 0)]) * np.uint64(0x100000001B3)
            if k + 1 in kinds:
                mixed = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(34)).astype(np.int64) % BUCKETS
                out[:, column] = np.where(sizes > k + 1, mixed, -1)
                column += 1
    return out


def _lookup(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The place of each value among sorted keys, from 1; 0 for others."""
    if not len(keys):
        return np.zeros(len(found), np.int64)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, at + 1, 0)


def _embedded(vectors: np.ndarray, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of unit vectors for words whose units' places (0: unknown, zero) are places[starts[i]:starts[i + 1]], scaled by the root of the number of units."""
    n = np.diff(starts)
    out = np.zeros((len(n), vectors.shape[1]), np.float32)
    if len(places):
        out[n > 0] = np.add.reduceat(vectors[places], starts[:-1][n > 0], axis=0)
    return out / np.sqrt(np.maximum(n, 1), dtype=np.float32)[:, None]


@dataclass
class Model:
    """Everything that scoring needs; its size is bounded by BUCKETS."""

    buckets: np.ndarray  # sorted units; row k + 1 of vectors belongs to buckets[k], row 0 is zero
    vectors: np.ndarray  # rows x DIM
    filters: list[np.ndarray]  # by width: width x DIM x filters
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    languages: list[str] = field(default_factory=list)
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # sorted hashes of words that tell languages apart
    evidence: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))  # row k + 1: log odds of marks[k] by language
    thresholds: dict[str, float] = field(default_factory=dict)  # by language and for UNKNOWN
    key: int = 0

    @property
    def projections(self) -> list[list[np.ndarray]]:
        """The unit vectors as each place of each filter sees them."""
        return self.tables(self.vectors)

    def tables(self, vectors: np.ndarray) -> list[list[np.ndarray]]:
        return [[vectors @ part for part in f] for f in self.filters]

    def rows_of(self, words: list[str]) -> np.ndarray:
        """The words' embeddings, then their evidence for each language."""
        out = np.zeros((len(words), DIM + len(self.languages)), np.float32)
        for at in range(0, len(words), 20_000):
            found = units(words[at : at + 20_000])
            places = _lookup(self.buckets, found.ravel()).reshape(found.shape)
            out[at : at + len(found), :DIM] = self.vectors[places].sum(axis=1) / np.sqrt((found >= 0).sum(axis=1), dtype=np.float32)[:, None]
            out[at : at + len(found), DIM:] = self.evidence[_lookup(self.marks, found[:, 0])]
        return out

    def probabilities(self, rows: np.ndarray, offsets: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        """P(toxic) of texts given as rows of the tables (of the projections, if None); each text is followed by padding with row 0."""
        n = len(offsets) - 1
        padded = np.zeros(len(rows) + PAD * n, np.int64)
        starts = offsets[:-1] + PAD * np.arange(n)
        padded[np.arange(len(rows)) + PAD * np.repeat(np.arange(n), np.diff(offsets))] = rows
        pooled = []
        for width, parts, bias in zip(WIDTHS, self.projections if tables is None else tables, self.biases, strict=True):
            made = parts[0][padded]
            for k in range(1, width):
                made[:-k] += parts[k][padded[k:]]
            for k in range(1, width):  # these would reach into the next text
                made[np.append(starts[1:], len(padded)) - k] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(made, starts, axis=0) + bias, 0))
        logits = np.concatenate(pooled, axis=1) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def raw(self, texts: pa.Array, cache: WordRows) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) and language (a place in languages, one more: unknown) of each text."""
        codes, distinct, offsets = coded_words(texts)
        rows = cache(distinct)
        p = self.probabilities(codes + 1, offsets, self.tables(np.concatenate([np.zeros((1, DIM), np.float32), rows[:, :DIM]])))
        return p, self.spoken(sums(rows[codes, DIM:], offsets))

    def spoken(self, seen: np.ndarray) -> np.ndarray:
        """The language of texts whose words have these log odds in all: a place in languages, one more: unknown."""
        if not self.languages:
            return np.zeros(len(seen), np.int64)
        return np.where(np.abs(seen).max(axis=1) > 0, seen.argmax(axis=1), len(self.languages))

    def scores(self, texts: pa.Array, cache: WordRows) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated score and language of each text."""
        p, language = self.raw(texts, cache)
        cut = np.array([self.thresholds[x] for x in (*self.languages, UNKNOWN)])[language]
        return np.where(p < cut, CUT * p / cut, CUT + (1 - CUT) * (p - cut) / (1 - cut)), language


@dataclass
class State:
    """A model in training: parameters, their moments (Adam), unit vectors and what was spent on each (Adagrad), steps so far."""

    p: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    e: np.ndarray
    spent: np.ndarray
    step: int = 0

    @classmethod
    def new(cls, rows: int, rng: np.random.Generator) -> State:
        shapes = {"v": (FILTERS * len(WIDTHS),), "c": (1,)} | {f"w{w}": (w, DIM, FILTERS) for w in WIDTHS} | {f"b{w}": (FILTERS,) for w in WIDTHS}
        scale = {"v": 0.3} | {f"w{w}": 0.5 / np.sqrt(w) for w in WIDTHS}
        p = {k: (rng.normal(0, scale[k], s) if k in scale else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        e = rng.normal(0, 0.1, (rows, DIM)).astype(np.float32)
        e[0] = 0
        for w in WIDTHS:
            p[f"b{w}"] += 0.05
        return cls(p, *({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2)), e, np.full(rows, 1e-3, np.float32))

    @property
    def dense(self) -> np.ndarray:
        """All but the unit vectors, flat; the steps last."""
        return np.concatenate([*[x.ravel() for d in (self.p, self.first, self.second) for x in d.values()], [self.step]]).astype(np.float64)

    @dense.setter
    def dense(self, flat: np.ndarray) -> None:
        at = 0
        for d in (self.p, self.first, self.second):
            for k, x in d.items():
                d[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        self.step = round(flat[at])


def _train(texts: list[np.ndarray], labels: np.ndarray, places: np.ndarray, ends: np.ndarray, rows: int, weight: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """EPOCHS passes over the texts as one part."""
    rng = np.random.default_rng(seed)
    state = State.new(rows, rng)
    for _ in range(EPOCHS):
        _epoch(state, texts, labels, places, ends, weight, rng)
        state.e *= 1 - E_DECAY
    return state.p | {"e": state.e}


def _epoch(state: State, texts: list[np.ndarray], labels: np.ndarray, places: np.ndarray, ends: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """One pass: Adam on the weighted log loss, Adagrad on the unit vectors; only the argmax of each filter passes gradients back.

    texts are words from 1 (0 is the padding); the units of word w have the rows places[ends[w - 1]:ends[w]] of the vectors.
    """
    p, first, second, e, spent, step = state.p, state.first, state.second, state.e, state.spent, state.step
    pad = np.zeros(PAD, np.int64)
    bounds = np.concatenate([[0], ends])  # word w: places[bounds[w]:bounds[w + 1]], the padding has none
    order = rng.permutation(len(texts))
    for at in range(0, len(order), BATCH):
        picked = order[at : at + BATCH]
        ids = np.concatenate([x for i in picked for x in (texts[i], pad)])
        starts = np.cumsum([0, *[len(texts[i]) + PAD for i in picked]])
        distinct, place = np.unique(ids, return_inverse=True)
        lengths = bounds[distinct + 1] - bounds[distinct]
        begin = np.concatenate([[0], np.cumsum(lengths)])
        own = _embedded(e, places[np.repeat(bounds[distinct] - begin[:-1], lengths) + np.arange(begin[-1])], begin)
        pools, tops = [], []
        for w in WIDTHS:
            made = (own @ p[f"w{w}"][0])[place]
            for k in range(1, w):
                made[:-k] += (own @ p[f"w{w}"][k])[place[k:]]
            # a filter may start at any word or at the padding, but never reach into the next text
            top = np.stack([a + made[a : b - w + 1].argmax(axis=0) for a, b in zip(starts, starts[1:], strict=False)])
            tops.append(top)
            pools.append(np.take_along_axis(made, top, axis=0) + p[f"b{w}"])
        pool = np.concatenate(pools, axis=1)
        live = np.maximum(pool, 0)
        out = 1 / (1 + np.exp(-np.clip(live @ p["v"] + p["c"], -30, 30)))
        d = ((out - labels[picked]) * weight[picked] / len(picked)).astype(np.float32)
        g = {k: np.zeros_like(x) for k, x in p.items()}
        ge = np.zeros_like(own)
        g["v"], g["c"] = live.T @ d, np.array([d.sum()])
        dpool = (d[:, None] * p["v"]) * (pool > 0)
        for j, w in enumerate(WIDTHS):
            dw = dpool[:, j * FILTERS : (j + 1) * FILTERS]
            g[f"b{w}"] = dw.sum(axis=0)
            for k in range(w):
                words = place[tops[j] + k]  # texts x filters
                g[f"w{w}"][k] = np.einsum("bfd,bf->df", own[words], dw)
                np.add.at(ge, words, dw[:, :, None] * p[f"w{w}"][k].T)
        moved = np.flatnonzero((ge != 0).any(axis=1) & (lengths > 0))
        if len(moved):
            n = lengths[moved]
            begin = np.concatenate([[0], np.cumsum(n)])
            touched, where = np.unique(places[np.repeat(bounds[distinct[moved]] - begin[:-1], n) + np.arange(begin[-1])], return_inverse=True)
            gu = np.zeros((len(touched), DIM), np.float32)
            np.add.at(gu, where, np.repeat(ge[moved] / np.sqrt(n)[:, None], n, axis=0).astype(np.float32))
            gu[touched == 0] = 0
            spent[touched] += (gu**2).mean(axis=1)
            e[touched] -= E_RATE * gu / np.sqrt(spent[touched])[:, None]
        step += 1
        for k in p:
            g[k] += DECAY * p[k] if k != "c" else 0
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.001 * (g[k] ** 2 - second[k])
            p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    state.step = step


def _threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the greatest F0.5, each score standing for as many rows as its weight says, with two false alarms added so that few rows can't vouch for a low one; the middle of the gap there."""
    order = np.argsort(-p, kind="stable")
    hit, miss = np.cumsum((y * weight)[order]), np.cumsum(((1 - y) * weight)[order])
    worth = 1.25 * hit / (hit + miss + 2 + 0.25 * (y * weight).sum())
    at = int(worth.argmax())
    low = p[order[at + 1]] if at + 1 < len(p) else 0.0
    return float(np.clip((p[order[at]] + low) / 2, 0.5, 0.98))


def calibrate(p: np.ndarray, y: np.ndarray, language: np.ndarray, names: list[str], weight: np.ndarray) -> dict[str, float]:
    """A threshold for each language (places in names; one more is UNKNOWN), drawn to the overall one by SHRINK rows on the scale of log odds."""
    overall = _threshold(p, y, weight)
    out = {}
    for k, name in enumerate([*names, UNKNOWN]):
        own = language == k
        n = min((y * weight)[own].sum(), ((1 - y) * weight)[own].sum())
        mine = _threshold(p[own], y[own], weight[own]) if n else overall
        odds = (n * np.log(mine / (1 - mine)) + SHRINK * np.log(overall / (1 - overall))) / (n + SHRINK)
        out[name] = float(1 / (1 + np.exp(-odds)))
    return out


def _part(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as codes of words, where each text's codes start (one more at the end), the distinct words' units, and in how many texts each word stands."""
    known, codes, ends, made, held = WordIds(), [], [np.zeros(1, np.int64)], [], [np.zeros(0, np.int32)]
    for _, some in slices(texts):
        found, distinct, offsets = coded_words(some)
        own = np.fromiter(map(known.__getitem__, distinct), np.int32, len(distinct))
        codes.append(own[found])
        ends.append(ends[-1][-1] + offsets[1:])
        made.append(units(known.fresh).astype(np.int32))
        known.fresh = []
        pairs = np.unique(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) * max(len(distinct), 1) + found) % max(len(distinct), 1)
        held.append(np.bincount(own[pairs], minlength=len(known)).astype(np.int32))
    total = np.zeros(len(known), np.int32)
    for h in held:
        total[: len(h)] += h
    return np.concatenate(codes), np.concatenate(ends), np.concatenate(made), total


def _encoded(table: pa.Table) -> pa.Table:
    """A part's rows (part, id, text, label, lang) as one row (part, data): what training, counts and calibration need of them. Of rows that repeat an id the least text counts, and the least lang."""
    release()
    ids, texts, langs = (table[c].to_pylist() for c in ("id", "text", "lang"))
    labels = table["label"].to_numpy()
    ids = [str(x) for x in ids]
    first, lang = [], {}
    for k in sorted(range(len(ids)), key=lambda k: (ids[k], texts[k].encode())):
        if not first or ids[first[-1]] != ids[k]:
            first.append(k)
        if langs[k] is not None:
            lang[ids[k]] = min(langs[k], lang.get(ids[k], langs[k]))
    codes, offsets, made, held = _part(pa.array([texts[k] for k in first], pa.large_string()))
    folds = np.array([zlib.crc32(ids[k].encode()) // 3 % FOLDS for k in first], np.int8)
    data = pickle.dumps((codes, offsets, made, held, labels[first].astype(np.int8), folds, [lang.get(ids[k]) for k in first]), 5)
    return pa.table({"part": table["part"].slice(0, 1).cast(pa.int32()), "data": pa.array([data], pa.binary())})


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of each fold, label and language the parts have."""
    for batch in batches:
        for data in batch.column(1):
            *_, labels, folds, langs = pickle.loads(data.as_buffer())
            often = Counter(zip(folds.tolist(), labels.tolist(), langs, strict=True))
            yield pa.RecordBatch.from_pydict({"fold": pa.array([k[0] for k in often], pa.int32()), "label": pa.array([k[1] for k in often], pa.int32()), "lang": pa.array([k[2] for k in often], pa.string()), "n": pa.array(often.values(), pa.int64())})


def _summed(parts: DataFrame, work: Callable[[int, tuple], Iterator[tuple[int, np.ndarray]]], mean: bool = False) -> dict[int, np.ndarray]:
    """The sums over all parts of the arrays that work(part, data) gives as (number, array), by number.

    Summed by blocks of rows in tasks, so only the sums reach the driver; with `mean` they are means over the parts whose row isn't zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for number, made in work(part, pickle.loads(data.as_buffer())):
                    for at in range(0, len(made), BLOCK):
                        yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "block": pa.array([at // BLOCK], pa.int32()), "data": pa.array([pickle.dumps(made[at : at + BLOCK], 5)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total, often, kind = None, None, None
        for data in table["data"]:
            x = pickle.loads(data.as_buffer())
            kind, wide = x.dtype, x.astype(np.float64)
            there = (x != 0).any(axis=tuple(range(1, x.ndim))).astype(np.float64) if mean else None
            total, often = (wide, there) if total is None else (total + wide, None if often is None else often + there)
        if mean:
            total /= np.maximum(often, 1).reshape(-1, *[1] * (total.ndim - 1))
        return pa.table({"number": table["number"].slice(0, 1), "block": table["block"].slice(0, 1), "data": pa.array([pickle.dumps(total.astype(kind), 5)], pa.binary())})

    fields = "number int, block int, data binary"
    found = parts.mapInArrow(run, fields).groupBy("number", "block").applyInArrow(add, fields).collect()
    out: dict[int, list] = {}
    found.sort(key=lambda r: (r["number"], r["block"]), reverse=True)
    while found:  # what is read goes at once, so the driver holds the sums about once
        r = found.pop()
        out.setdefault(r["number"], []).append(pickle.loads(r["data"]))
    return {k: np.concatenate(out.pop(k)) for k in list(out)}


def _counts(names: list[str]) -> Callable:
    """Of a part: 0, in how many texts the words of each unit stand; 1, in how many each word; 2, how often in each language."""

    def work(part: int, data: tuple) -> Iterator[tuple[int, np.ndarray]]:
        codes, offsets, made, held, _, _, langs = data
        owner, column = np.nonzero(made >= 0)
        yield 0, np.bincount(made[owner, column], weights=held[owner], minlength=BUCKETS)
        yield 1, np.bincount(made[:, 0], weights=held, minlength=BUCKETS)
        of = np.repeat(np.array([names.index(x) if x in names else -1 for x in langs], np.int8), np.diff(offsets))
        by = [np.bincount(codes[of == k], minlength=len(made)) for k in range(len(names))]
        yield 2, np.stack([np.bincount(made[:, 0], weights=x, minlength=BUCKETS) for x in by], axis=1) if by else np.zeros((BUCKETS, 0))

    return work


def _languages(names: list[str], held: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, hashes of the words that three texts at least hold, and their log odds by language (naive Bayes)."""
    words = np.flatnonzero(held >= 3)
    if len(names) < 2 or not len(words):
        return [], np.zeros(0, np.int64), np.zeros((1, 0), np.float32)
    share = counts[words] + 0.5
    share /= share.sum(axis=0)
    odds = np.log(share / share.mean(axis=1)[:, None])
    return names, words, np.concatenate([np.zeros((1, len(names))), odds]).astype(np.float32)


def _rows(made: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units' places among buckets (from 1; 0: none), word after word, and where each word's end (0 first)."""
    return _lookup(buckets, made[made >= 0]), np.concatenate([[0], np.cumsum((made >= 0).sum(axis=1))])


def _learners(shared, seed: int) -> Callable:
    """Of a part: for each model, 2k, how far its unit vectors and what was spent on them moved in one epoch; 2k + 1, its other parameters."""

    def work(part: int, data: tuple) -> Iterator[tuple[int, np.ndarray]]:
        buckets, weight, uses, epoch, states = shared.value
        codes, offsets, made, _, labels, folds, _ = data
        places, ends = _rows(made, buckets)
        for k, (dense, table) in enumerate(states):
            picked = np.flatnonzero(folds != k) if uses[k] else np.arange(len(labels))
            if not len(picked):
                continue
            state = State.new(1, np.random.default_rng(0))
            state.dense = dense
            state.e, state.spent = table[:, :DIM].astype(np.float32), table[:, DIM].astype(np.float32)
            texts = [codes[offsets[i] : offsets[i + 1]] + 1 for i in picked]
            _epoch(state, texts, labels[picked].astype(float), places, ends, weight[labels[picked]], np.random.default_rng([seed, epoch, part]))
            state.e -= table[:, :DIM]
            moved = np.empty(table.shape, np.float16)
            moved[:, :DIM], moved[:, DIM] = state.e, state.spent - table[:, DIM]
            yield 2 * k, moved
            yield 2 * k + 1, np.append(state.dense, 1.0)[None]

    return work


def _judged(shared) -> Callable:
    """Of the parts: how many rows of each label and language have each score, by the model that hasn't seen them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        models = shared.value
        for batch in batches:
            for data in batch.column(1):
                codes, offsets, made, _, labels, folds, _ = pickle.loads(data.as_buffer())
                for k, model in enumerate(models):
                    places, ends = _rows(made, model.buckets)
                    some = range(0, len(made), 10_000)
                    rows = np.concatenate([np.zeros((1, DIM), np.float32), *[_embedded(model.vectors, places[ends[at] : ends[min(at + 10_000, len(made))]], ends[at : at + 10_001] - ends[at]) for at in some]])
                    tables, marks = model.tables(rows), _lookup(model.marks, made[:, 0])
                    mine = np.flatnonzero(folds == k)
                    for at in range(0, len(mine), 256):
                        some = mine[at : at + 256]
                        own = [codes[offsets[i] : offsets[i + 1]] for i in some]
                        bounds, flat = np.cumsum([0, *map(len, own)]), np.concatenate(own)
                        p = np.round(model.probabilities(flat + 1, bounds, tables).astype(float), 5)
                        language = model.spoken(sums(model.evidence[marks[flat]], bounds))
                        seen, often = np.unique(np.stack([labels[some], language, p]), axis=1, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(seen[0].astype(np.int32)), pa.array(seen[1].astype(np.int32)), pa.array(seen[2]), pa.array(often)], names=["label", "language", "p", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", part_rows: int = PART_ROWS) -> Model:
    """A model from all labelled texts, whole.

    Languages are learned from column lang_col of these texts, if docs have it; scoring never reads it. Of rows that repeat an id
    the least text counts. With no rows of one of the labels the model gives every text the same score, below CUT if no row is labelled 1.
    """
    spark = docs.sparkSession
    rows, most = labelled_rows(docs, labels, label, id_col, text_col, lang_col if lang_col in docs.columns else None)
    ship(spark)
    parts = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-most // part_rows)))).cast("int")).groupBy("part").applyInArrow(_encoded, "part int, data binary")
    parts = checkpoint(parts)
    tally = checkpoint(parts.mapInArrow(_tallied, "fold int, label int, lang string, n long").groupBy("fold", "label", "lang").agg(F.sum("n").alias("n")))
    sizes = {(r[0], r[1]): r[2] for r in tally.groupBy("fold", "label").agg(F.sum("n")).collect()}  # four rows at most
    n0, n1 = (sum(n for (_, y), n in sizes.items() if y == k) for k in (0, 1))
    if not n0 or not n1:
        return Model(np.zeros(0, np.int64), np.zeros((1, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), 3.0 if n1 else -3.0, thresholds={UNKNOWN: 0.5})
    spoken = tally.filter("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    found = _summed(parts, _counts(names := sorted(r[0] for r in spoken)))
    # a unit that stands in one text only can't tell anything about others
    buckets = np.flatnonzero(found[0] >= 2)
    names, marks, evidence = _languages(names, found[1], found[2])
    del found
    weight = np.array([1.0, min(10.0, max(1.0, n0 / n1))])
    # a model without each of the folds, where the rest has both labels, and one of all rows
    uses = [all(sum(sizes.get((k, y), 0) for k in range(FOLDS) if k != fold) for y in (0, 1)) for fold in range(FOLDS)] + [False]
    states = [State.new(len(buckets) + 1, np.random.default_rng(seed)) for _ in uses]
    for epoch in range(max(LEAST_EPOCHS, min(EPOCHS, SEEN_ROWS // (n0 + n1)))):
        shared = spark.sparkContext.broadcast((buckets, weight, uses, epoch, [(s.dense, np.concatenate([s.e, s.spent[:, None]], axis=1).astype(np.float16)) for s in states]))
        moved = _summed(parts, _learners(shared, seed), mean=True)
        for k, s in enumerate(states):
            if 2 * k in moved:
                s.dense = moved[2 * k + 1][0][:-1]
                s.e += moved[2 * k][:, :DIM]
                s.spent += moved[2 * k][:, DIM]
            s.e *= 1 - E_DECAY
        del moved
        shared.destroy()
        spark.sparkContext._jvm.System.gc()  # the epoch's shuffle files go

    def made(s: State) -> Model:
        return Model(buckets, s.e, [s.p[f"w{w}"] for w in WIDTHS], [s.p[f"b{w}"] for w in WIDTHS], s.p["v"], float(s.p["c"][0]), names, marks, evidence, key=zlib.crc32(s.e.tobytes()))

    shared = spark.sparkContext.broadcast([made(s) for s in states[:-1]])
    fields = "label int, language int, p double, n long"
    seen = parts.mapInArrow(_judged(shared), fields).groupBy("label", "language", "p").agg(F.sum("n").alias("n")).collect()  # scores have five decimals
    model = made(states[-1])
    y, language, p, often = (np.array([r[c] for r in seen]) for c in ("label", "language", "p", "n"))
    order = np.lexsort((language, y, p))
    model.thresholds = calibrate(p[order], y[order].astype(float), language[order], names, often[order].astype(float))
    shared.destroy()
    del states, seen
    release()  # the driver's own, as what follows needs little of it
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) with score (0 to 1; CUT or more: toxic), predicted (1 or 0) and language (as guessed).

    Null and empty texts are scored like a text without words. Columns with these names are replaced. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS

    def make():
        own = shared.value
        cache = kept(("toxicity", own.key), lambda: WordRows(own.rows_of))

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found, language = (np.concatenate(x) for x in zip(*[own.scores(part, cache) for _, part in slices(batch.column(text_col))], strict=True))
            return {"score": pa.array(found, pa.float64()), "predicted": pa.array((found >= CUT).astype(np.int32)), "language": pa.array([(*own.languages, UNKNOWN)[k] for k in language])}

        return step

    return append_columns(docs, make, "score double, predicted int, language string", keep)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, with their own columns of any names, without the rows that the model finds toxic; null and empty texts are scored like a text without words."""
    name = free(docs, "is_toxic")
    found = append_columns(docs, _decider(docs.sparkSession.sparkContext.broadcast(model), text_col, name), f"{name} boolean")
    return found.filter(~F.col(name)).drop(name)


def _decider(shared, text_col: str, name: str):
    def make():
        own = shared.value
        cache = kept(("toxicity", own.key), lambda: WordRows(own.rows_of))

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            return {name: pa.array(np.concatenate([own.scores(part, cache)[0] >= CUT for _, part in slices(batch.column(text_col))]))}

        return step

    return make
