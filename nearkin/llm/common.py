"""Small helpers that several of the operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.operators.bloom import KeyFilter
from nearkin.sources.storage import MAX_BROADCAST_KEYS, durable, settled

# Fixed value: the option of the C library for the size above which it maps memory.
_MMAP_THRESHOLD = -3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_lower(text: Column) -> Column:
    """Lower case of A-Z only, whatever the locale."""
    return F.translate(text, _UPPER, _UPPER.lower())


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """The remainder that splits documents into folds by their id alone."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def unused(df: DataFrame, name: str) -> str:
    """A name for a further column that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id isn't in ``gone`` (one column of different ids); null is an id.

    Few ids are sent to the rows. Of many a Bloom filter is, and only rows that it
    doesn't clear are joined, so that most rows don't move.
    """
    name = unused(docs, "gone")
    gone = durable(gone.toDF(name), "gone")
    few, sent = settled(gone, MAX_BROADCAST_KEYS)
    same = docs[id_col].eqNullSafe(F.col(name))
    if sent:
        return docs.join(F.broadcast(few), same, "left_anti")
    held = KeyFilter(gone, [name], gone.count())
    asked = docs.withColumn(name, F.col(id_col).cast(gone.schema[name].dataType))
    may_go = unused(asked, "may_go")
    asked = asked.withColumn(may_go, held.may_hold())
    clear = asked.where(~F.col(may_go)).select(docs.columns)
    unclear = asked.where(F.col(may_go)).select(docs.columns)
    same = unclear[id_col].eqNullSafe(gone[name])
    return clear.union(unclear.join(gone, same, "left_anti"))


def fetch_rows(rows: DataFrame, wanted: DataFrame, id_col: str, hash_col: str, text_col: str) -> DataFrame:
    """``wanted`` with the row of ``rows`` that has its id and the hash of its text.

    Few wanted rows are sent out; of many a Bloom filter is, so that texts that nobody
    wants don't move. Column names of the two must differ but for the id's.
    """
    few, sent = settled(wanted, MAX_BROADCAST_KEYS)
    own = rows.withColumns({"_i": F.col(id_col), "_h": F.xxhash64(text_col)}).drop(id_col)
    same = F.col("_i").eqNullSafe(F.col(id_col)) & (F.col("_h") == F.col(hash_col))
    if sent:
        return own.join(F.broadcast(few), same).drop("_i", "_h")
    keys = wanted.select(F.col(id_col).alias("_i"), F.col(hash_col).alias("_h"))
    held = KeyFilter(keys, ["_i", "_h"], keys.count())
    return own.where(held.may_hold()).join(wanted, same).drop("_i", "_h")


def batches_of(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """Arrow batches that have rows."""
    return (b for b in batches if b.num_rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, a missing one as an empty one, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b or b"" for b in column.cast(kind).to_pylist()]


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have at most ``max_bytes``, or are one long text."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    lo = 0
    while lo < len(sizes):
        before = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, before + max_bytes, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def release_memory() -> None:
    """Give freed memory back, so that workers hold little of it between tasks.

    Arrow takes its memory from the system like others, and larger pieces are
    mapped one by one, so freeing them returns them at once.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim"):
        libc.mallopt(_MMAP_THRESHOLD, 1 << 18)
        libc.malloc_trim(0)


def task_cache() -> dict:
    """What a worker process keeps from one task to the next.

    Code of this package travels with each task, so its own globals don't last.
    """
    return sys.modules.setdefault("_nearkin_tasks", ModuleType("_nearkin_tasks")).__dict__


class IdStore:
    """Sequences of ids by the string they stand for, in flat arrays.

    The first ``limit`` strings stay; later ones go at the next ``trim``.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.code: dict[str, int] = {}
        self._late: list[str] = []
        self._flat, self._used = np.empty(1 << 16, np.uint32), 0
        self._starts, self._sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def unknown(self, strings: set[str]) -> list[str]:
        """Those not stored yet."""
        return [s for s in strings if s not in self.code]

    def add(self, strings: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, used = len(self.code), self._used + len(flat)
        if used > len(self._flat):
            self._flat = np.resize(self._flat, 2 * used)
        if n + len(strings) > len(self._starts):
            self._starts = np.resize(self._starts, 2 * (n + len(strings)))
            self._sizes = np.resize(self._sizes, 2 * (n + len(strings)))
        self._flat[self._used : used] = flat
        self._sizes[n : n + len(strings)] = sizes
        self._starts[n : n + len(strings)] = self._used + np.cumsum(sizes) - sizes
        self._used = used
        self.code.update(zip(strings, range(n, n + len(strings)), strict=True))
        self._late.extend(strings[max(0, self.limit - n) :])

    def gather(self, codes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a row of stored strings, and how many each text has of them.

        ``per_text`` tells how many strings belong to each text.
        """
        each = self._sizes[codes]
        ends = np.cumsum(each)
        at = np.repeat(self._starts[codes] - (ends - each), each)
        at += np.arange(len(at))
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        return self._flat[at], np.diff(bounds)

    def trim(self) -> None:
        """Forgets the strings beyond the limit."""
        if self._late:
            self._used = int(self._starts[self.code[self._late[0]]])
            for s in self._late:
                del self.code[s]
            self._late = []
