"""Helpers that the operators share: checkpoints, word splitting on bytes, appended columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import checkpoint, maybe_broadcast, shared_dir

__all__ = ["WordIds", "WordRows", "append_columns", "blobs", "checkpoint", "coded", "coded_words", "fold_of", "free", "kept", "labelled_rows", "labelled_sample", "maybe_broadcast", "recoded", "release", "remove", "shared_dir", "ship", "slices", "sums", "table"]

#: Upper-case ASCII becomes lower case; every byte that is neither a digit, a letter nor non-ASCII becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Spark's setting of the rows in an Arrow batch, and how many there are at most.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate data, wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df bears."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if n not in taken)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session: its functions are pickled by name."""
    context = spark.sparkContext
    if not getattr(context, "_factloom_shipped", False):
        root = Path(__file__).resolve().parent.parent.parent
        archive = Path(tempfile.mkdtemp(prefix="factloom-code-")) / "factloom_code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((root / "factloom").rglob("*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(str(archive))
        context._factloom_shipped = True
    # a batch of whole texts is held by the JVM and by the worker; a smaller setting of the session's own stays
    if int(spark.conf.get(BATCH_ROWS[0])) > BATCH_ROWS[1]:
        spark.conf.set(*map(str, BATCH_ROWS))


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as UTF-8 bytes, null as None."""
    return column.cast(pa.large_binary()).to_pylist()


def append_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, pa.Array]]], fields: str, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all, if None), then those of fields (DDL), computed for each Arrow batch.

    make() is called once in each task and returns the function from a batch to the new columns.
    A column of df that bears the name of a new one is replaced by it.
    """
    ship(df.sparkSession)
    new = T._parse_datatype_string(fields)
    taken = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    out = T.StructType([df.schema[c] for c in kept] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                made = step(batch)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [made[f.name] for f in new], names=kept + [f.name for f in new])

    return df.mapInArrow(run, out)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, most_chars: int, id_col: str = "doc_id", text_col: str = "text", more: str | None = None) -> tuple[list[tuple], dict[int, int]]:
    """Up to per_label documents of each label (0, 1) that have at most most_chars characters, as (id, text, label) and, if asked for, the least value of column `more`; and how many rows each label has.

    Which ones is decided by a hash of the id, so it doesn't hang on the order of rows. Only rows of `labels` whose label is
    not null count; an id with both labels counts as 1. At most 2 * per_label texts reach the driver.
    """
    own = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    totals = {r[0]: r[1] for r in own.groupBy("_label").count().collect()}
    order = (F.xxhash64("_id"), "_id")
    picked = own.filter("_label = 0").orderBy(*order).limit(per_label).union(own.filter("_label = 1").orderBy(*order).limit(per_label))
    extra = F.lit(None) if more is None else F.col(more)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), extra.cast("string").alias("_more")).filter(F.col("_text").isNotNull() & (F.char_length("_text") <= most_chars))
    found = texts.join(F.broadcast(picked), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_label").alias("_label"), F.min("_more").alias("_more"))
    rows = [(r["_id"], r["_text"], r["_label"]) + ((r["_more"],) if more else ()) for r in found.collect()]
    return sorted(rows, key=lambda r: r[:3]), totals


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", more: str | None = None) -> tuple[DataFrame, int]:
    """(id, text, label, lang) of every document with a label (0, 1) and a text, all and whole, rows that repeat an id included; and how many ids are labelled. lang is column `more`."""
    own = checkpoint(labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label")))
    n = own.count()
    extra = F.lit(None) if more is None else F.col(more)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), extra.cast("string").alias("lang")).filter("text is not null")
    return texts.join(maybe_broadcast(own, n), "id").select("id", "text", "label", "lang"), n


def fold_of(column: str, folds: int) -> F.Column:
    """crc32 of an id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string")) % folds


def slices(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of a large_string column, nulls as empty texts, about `most` bytes a part; a longer text is a part by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        # copied by part, so that no second batch is held; a cast alone would leave offsets that don't begin at 0
        yield at, pa.concat_arrays([column.slice(at, to - at)]).cast(pa.large_string()).fill_null("")
        at = to


def recoded(column: pa.Array, table: bytes) -> pa.Array:
    """A large_string column with each byte replaced by the table's; non-ASCII bytes must stay as they are."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not offsets[-1] - offsets[0]:
        return column
    data = memoryview(column.buffers()[2])[int(offsets[0]) : int(offsets[-1])].tobytes().translate(table)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data))


def coded(lists: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lists of words as codes into the distinct words, those words, and where each list starts (one more at the end); empty words are left out."""
    values = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    codes, distinct = values.indices.to_numpy(zero_copy_only=False).astype(np.int64), values.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in distinct:
        real = codes != distinct.index("")
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, distinct, offsets


def coded_words(column: pa.Array, table: bytes = WORD_BYTES) -> tuple[np.ndarray, list[str], np.ndarray]:
    """coded() of the words of a large_string column: the table maps what stands between words to spaces."""
    return coded(pc.ascii_split_whitespace(recoded(column, table)))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]] along the first axis, 0 for empty parts."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=np.float64)
    return out


class WordIds(dict):
    """Word -> dense id, in order of first sight; `fresh` holds the words not yet turned into rows of a model."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        self.fresh.append(word)
        return found


class WordRows:
    """A value row for each distinct word, worked out once; forgotten as a whole beyond `most` words, so memory is bounded."""

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray], most: int = 300_000) -> None:
        self.rows_of, self.most = rows_of, most
        self.rows = rows_of([])
        self.forget()

    def forget(self) -> None:
        self.ids, self.used = WordIds(), 0

    def __call__(self, words: list[str]) -> np.ndarray:
        """The words' rows, in their order."""
        if len(self.ids) > self.most:
            self.forget()
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if self.ids.fresh:
            made = self.rows_of(self.ids.fresh)
            need = self.used + len(made)
            if need > len(self.rows):
                grown = np.zeros((max(2 * need, 4096), *made.shape[1:]), made.dtype)
                grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : need] = made
            self.used, self.ids.fresh = need, []
        return self.rows[at]


_KEPT: list = []


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What make() gave for the last key in this Python worker: workers outlive tasks. Another operator's key replaces it, so only one cache takes memory."""
    if not _KEPT or _KEPT[0] != key:
        release()
        _KEPT[:] = [key, make()]
    return _KEPT[1]


def release() -> None:
    """Forgets what kept() keeps, before work that needs the memory, and gives free memory back to the system where that can be asked for."""
    _KEPT[:] = []
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
