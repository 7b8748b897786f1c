"""Language ID (operator 4): prediction by partial matching, one variable-order byte context tree for each language.

A tree counts which byte follows each context of up to ORDER bytes. A byte's code length is that of its share in the
longest context the tree knows, after the escapes (method C) from the longer ones; below the empty context all bytes are equally
likely. Statistics are frozen after training. Contexts don't reach over the space in front of a word, so a text's code
length is the exact sum of those of its words, each worked out once. The shortest code wins.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordRows, append_columns, coded_words, kept, slices, sums

ORDER = 4
#: Training texts per language, their greatest length, and languages; the fit uses no more, however large the input.
PER_LANGUAGE, MOST_CHARS, MOST_LANGUAGES = 400, 4000, 64
UNKNOWN = "und"
#: ASCII upper case to lower case; what is neither an ASCII letter nor non-ASCII becomes a space.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Tree:
    """Frozen counts of one language: context -> (Counter of next bytes, their sum)."""

    def __init__(self, words: Counter) -> None:
        tree: dict[bytes, Counter] = {}
        for word, n in words.items():
            line = b" " + word + b" "
            for at in range(1, len(line)):
                for k in range(min(ORDER, at) + 1):
                    tree.setdefault(line[at - k : at], Counter())[line[at]] += n
        self.tree = {c: (seen, seen.total()) for c, seen in tree.items()}

    def bits(self, context: bytes, byte: int) -> float:
        """Code length of a byte behind a context of at most ORDER bytes."""
        out = 0.0
        for k in range(len(context) + 1):
            found = self.tree.get(context[k:])
            if found:
                seen, total = found
                if n := seen.get(byte):
                    return out - np.log2(n / (total + len(seen)))
                out -= np.log2(len(seen) / (total + len(seen)))
        return out + 8.0

    def word_bits(self, word: bytes) -> float:
        line = b" " + word + b" "
        return sum(self.bits(line[max(0, at - ORDER) : at], line[at]) for at in range(1, len(line)))


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]
    key: int = 0

    def __post_init__(self) -> None:
        self.steps: dict[bytes, tuple[float, ...]] = {}

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Code length of each word in each language, then its bytes."""
        out = np.zeros((len(words), len(self.languages) + 1), np.float64)
        if len(self.steps) > 500_000:
            self.steps = {}
        steps = self.steps
        for k, word in enumerate(words):
            line = b" " + word.encode() + b" "
            row = out[k]
            found = []
            for at in range(1, len(line)):
                gram = line[max(0, at - ORDER) : at + 1]
                if (step := steps.get(gram)) is None:
                    step = steps[gram] = tuple(t.bits(gram[:-1], gram[-1]) for t in self.trees)
                found.append(step)
            row[:-1] = [sum(x) for x in zip(*found, strict=True)]
            row[-1] = len(line) - 1
        return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_chars: int = MOST_CHARS, most_languages: int = MOST_LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trees from up to per_language texts of each non-null language, of at most most_chars characters each, picked by a hash of id and text.

    Texts without a letter teach nothing, rows that repeat id and text count once. Of more than most_languages languages those
    with most texts are learned, ties by name. From an empty table nothing is learned.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.filter(F.col("lang").isNotNull() & (F.char_length("text") <= most_chars) & F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("id", "text"))
    often = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not often:
        return Model([], [])
    # so many texts are looked at that per_language are surely among them, whatever the size of the language; only these are shuffled
    enough = per_language + 8 * math.sqrt(per_language) + 8
    share = F.create_map(*[F.lit(x) for r in often for x in (r["lang"], min(1.0, enough / r["count"]))])
    own = own.filter(F.pmod("hash", F.lit(1 << 30)) <= F.element_at(share, F.col("lang")) * (1 << 30)).dropDuplicates(["lang", "hash"])
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 30)), "hash"))).filter(F.col("n") <= per_language)
    found = own.select("lang", "text").collect()
    texts: dict[str, list[str]] = {}
    for lang, text in sorted(found):
        texts.setdefault(lang, []).append(text)
    trees = [Tree(Counter(w for t in texts[x] for w in t.encode().translate(LETTER_BYTES).split())) for x in sorted(texts)]
    return Model(sorted(texts), trees, zlib.crc32(repr(sorted(found)).encode()))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) with lang_pred, score and code_bits (bits per byte in the language found).

    The score is the language's share when each is weighted by 2 ** -bits; the bits of texts over 64 bytes are scaled to 64 bytes.
    `und`, score 0 and no code_bits if the text is null or has no letter, or if nothing was learned. Of languages with
    equal codes the first by name wins. Columns with these names are replaced. Texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training texts

    def make():
        own = shared.value
        cache = kept(("langid", own.key), lambda: WordRows(own.rows_of))

        def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            langs, scores, bits = [], [], []
            for _, part in slices(batch.column(text_col)):
                codes, distinct, offsets = coded_words(part, LETTER_BYTES)
                cost = sums(cache(distinct)[codes], offsets)
                letter = lettered(codes, distinct, offsets)
                if not own.languages:
                    langs += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    bits += [None] * len(part)
                    continue
                best = cost[:, :-1].argmin(axis=1)
                length = np.maximum(cost[:, -1], 1)
                # evidence of long texts is tempered to that of 64 bytes, else every score would be 1
                lead = (cost[:, :-1] - cost[:, :-1].min(axis=1)[:, None]) * (np.minimum(length, 64) / length)[:, None]
                share = 1 / np.exp2(-lead).sum(axis=1)
                for k in range(len(part)):
                    langs.append(own.languages[best[k]] if letter[k] else UNKNOWN)
                    scores.append(float(share[k]) if letter[k] else 0.0)
                    bits.append(float(cost[k, best[k]] / length[k]) if letter[k] else None)
            return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "code_bits": pa.array(bits, pa.float64())}

        return step

    return append_columns(docs, make, "lang_pred string, score double, code_bits double", keep)


def lettered(codes: np.ndarray, distinct: list[str], offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter (Unicode category L)."""
    own = np.array([any(c.isalpha() for c in w) for w in distinct], float)
    return sums(own[codes], offsets) > 0
