"""Quality classifier (operator 5): logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features are a token's word, its shape (case, digits and the marks around it), pairs of neighbouring words and of shapes, and
whether a word repeats the one before; all are hashed into one weight vector. A text's score is a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import WordRows, append_columns, coded, kept, labelled_sample, slices, sums

SLOTS = 1 << 20
#: Training rows per label and their greatest length; the fit uses no more, however large the input.
PER_LABEL, MOST_CHARS = 2500, 8000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.05, 0.1, 3
CUT = 0.5
_PARTS = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
_REPEAT = np.int64(zlib.crc32(b"repeat") % SLOTS)


def _rows(tokens: list[str]) -> np.ndarray:
    """Hashes of each token's word and of its shape."""
    out = np.zeros((len(tokens), 2), np.int64)
    for k, token in enumerate(tokens):
        before, word, after = _PARTS.match(token).groups()
        kind = "-" if not word else "9" if word.isdigit() else "U" if len(word) > 1 and word.isupper() else "T" if word[0].isupper() else "l" if word.islower() else "m"
        out[k] = zlib.crc32(b"w" + word.lower().encode()), zlib.crc32(f"s{before[:3]}{kind}{after[:3]}".encode())
    return out


def features(codes: np.ndarray, rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of some texts, ordered by text, and where each text's start."""
    words, shapes = rows[codes, 0], rows[codes, 1]
    n = len(codes)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    made = np.empty((n, 5), np.int64)
    made[:, 0], made[:, 1] = words, shapes
    made[:, 2:] = -1
    if n > 1:
        pair = text[1:] == text[:-1]
        made[1:, 2] = np.where(pair, words[:-1] * 0x9E3779B1 + words[1:], -1)
        made[1:, 3] = np.where(pair, shapes[:-1] * 0x85EBCA6B + shapes[1:] + 1, -1)
        made[1:, 4] = np.where(pair & (words[1:] == words[:-1]), _REPEAT, -1)
    there = made.ravel() != -1
    mixed = made.ravel()[there].view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    starts = np.concatenate([[0], np.cumsum(there.reshape(n, 5).sum(axis=1))])[offsets]
    return (mixed >> np.uint64(44)).astype(np.int64), starts


@dataclass
class Model:
    weights: np.ndarray  # SLOTS of them
    bias: float
    key: int = 0

    def scores(self, texts: pa.Array, cache: WordRows) -> np.ndarray:
        codes, distinct, offsets = coded(pc.ascii_split_whitespace(texts))
        slots, starts = features(codes, cache(distinct), offsets)
        dot = sums(self.weights[slots], starts) / np.sqrt(np.maximum(np.diff(starts), 1))
        return 1 / (1 + np.exp(-np.clip(dot + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, most_chars: int = MOST_CHARS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from up to per_label labelled texts a label, of at most most_chars characters each.

    The bias is moved so that the labels are as frequent as among all labelled rows, but for a half of the log ratio. With
    rows of one label only, every text scores 0.95 or 0.05; without any, 0.5. Of rows that repeat an id the least text counts, and
    an id with both labels counts as 1.
    """
    sample, totals = labelled_sample(docs, labels, label, per_label, most_chars, id_col, text_col)
    y = np.array([s[2] for s in sample], float)
    if len(set(y)) < 2:
        return Model(np.zeros(SLOTS, np.float32), 0.0 if not len(y) else 3.0 if y[0] else -3.0)
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)  # the last is the bias
    texts = []
    for _, part in slices(pa.array([s[1] for s in sample], pa.large_string()), 2_000_000):
        codes, distinct, offsets = coded(pc.ascii_split_whitespace(part))
        slots, starts = features(codes, _rows(distinct), offsets)
        for a, b in zip(starts, starts[1:], strict=False):
            own, seen = np.unique(slots[a:b], return_counts=True)
            texts.append((np.append(own, SLOTS).astype(np.int32), np.append(seen / np.sqrt(max(b - a, 1)), 1.0).astype(np.float32)))
    weight = len(y) / 2 / np.array([(1 - y).sum(), y.sum()])

    def weights(at: np.ndarray) -> np.ndarray:
        flat = np.abs(z[at]) <= L1
        return np.where(flat, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            at, x = texts[i]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y[i]) * weight[int(y[i])] * x
            more = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - more * w
            n[at] += g * g
    found = weights(np.arange(SLOTS + 1))
    prior = 0.5 * np.log(max(totals.get(1, 0), 1) / max(totals.get(0, 0), 1))
    return Model(found[:-1].astype(np.float32), float(found[-1] + prior), zlib.crc32(found.tobytes()))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) with score (0 to 1) and predicted (1 from CUT on).

    Null and empty texts get the score of a text without features. Columns with these names are replaced. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights

    def make():
        own = shared.value
        cache = kept(("quality",), lambda: WordRows(_rows))

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = np.concatenate([own.scores(part, cache) for _, part in slices(batch.column(text_col))])
            return {"score": pa.array(found, pa.float64()), "predicted": pa.array((found >= CUT).astype(np.int32))}

        return step

    return append_columns(docs, make, "score double, predicted int", keep)
