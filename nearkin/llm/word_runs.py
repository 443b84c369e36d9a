"""Runs in texts: stretches of words that repeat with a period, by synchronising sets.

A synchronising set of scale t marks about one in t positions by what follows them
alone: of the t + 1 stretches of t words that start from a position on, the one with
the least hash is its first or its last. Equal surroundings so mark equal positions,
and within a run of period q every mark comes again q words later, with the same 2 t
words behind it. For q from 3 t to 6 t - 1, marks that far apart with equal contexts
propose the period; the scales 1, 2, 4, ... cover all q from 3 on, and periods 1 and 2
are read off directly.

Stretches that themselves have a period of t / 3 or less are left out of the choice, or
every word of them would be marked. They are runs found at smaller scales. Where two
such regions of the same content meet out of step, longer squares lie across the seam
without a mark in them; their periods follow from the offset and are proposed as well.

Every proposal is extended to both sides as far as its period holds, by hashes of
stretches of 2^k words, so only true runs remain. Texts of a batch are one array with a
word of its own between any two, so each step is one pass over all of them. Stretches
are compared by 64-bit hashes, single words exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm.common import as_bytes, batches_of, read, release_memory, text_slices
from nearkin.sources.storage import spread

#: Words that a run has at least.
MIN_WORDS = 12
#: Texts that are worked on at a time; a longer text is alone.
PART_BYTES = 2 << 20
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_BLANKS = r"[\x20\x09-\x0D]+"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Stretches:
    """Hashes of all stretches of 2^k words, made as far as they are asked for."""

    def __init__(self, first: np.ndarray):
        self.of = [first]

    def scale(self, k: int) -> np.ndarray:
        while len(self.of) <= k:
            h, step = self.of[-1], 1 << (len(self.of) - 1)
            again = np.uint64(0x9E3779B97F4A7C15) * _mix(h[step:] + np.uint64(len(self.of)))
            self.of.append(_mix(h[: max(0, len(h) - step)] ^ again))
        return self.of[k]

    def only(self, keep: np.ndarray) -> None:
        """Leaves some of the positions, whole texts with the word behind each."""
        n = len(self.of[0])
        filled = (np.concatenate([h, np.zeros(n - len(h), np.uint64)])[keep] for h in self.of)
        left = int(keep.sum())
        self.of = [h[: max(0, left - (1 << k) + 1)] for k, h in enumerate(filled)]

    def extended(self, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where to where the period q holds around i, for arrays of both."""
        lo, hi = i.copy(), i.copy()
        top = len(self.of) - 1
        for k, h in reversed(list(enumerate(self.of))):
            step = 1 << k
            while True:
                ok = np.flatnonzero(hi + q < len(h))
                ok = ok[h[hi[ok]] == h[hi[ok] + q[ok]]]
                hi[ok] += step
                if k < top or not len(ok):
                    break
            while True:
                ok = np.flatnonzero((lo >= step) & (lo - step + q < len(h)))
                ok = ok[h[lo[ok] - step] == h[lo[ok] - step + q[ok]]]
                lo[ok] -= step
                if k < top or not len(ok):
                    break
        return lo, hi + q


def _marks(h: np.ndarray, k: int, left_out: np.ndarray) -> np.ndarray:
    """The synchronising set of scale 2^k, from hashes of stretches of that length."""
    size = 1 << k
    if len(h) <= size:
        return np.empty(0, np.int64)
    h = np.where(left_out[: len(h)], _NEVER, h)
    least = h
    for j in range(k):
        least = np.minimum(least[: -(1 << j)], least[1 << j :])
    last = h[size:]
    least = np.minimum(least[: len(last)], last)
    return np.flatnonzero((least != _NEVER) & ((least == h[: len(last)]) | (least == last)))


def _equal_marks(marks: np.ndarray, context: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(i, q)``: marks i and i + q have equal contexts and 3 size <= q < 6 size."""
    marks = marks[marks < len(context)]
    order = np.argsort(context[marks], kind="stable")
    at, same = marks[order], context[marks[order]]
    found_i, found_q = [], []
    for r in range(1, len(at)):
        q = at[r:] - at[:-r]
        near = (same[r:] == same[:-r]) & (q < 6 * size)
        if not near.any():
            break
        near &= q >= 3 * size
        found_i.append(at[:-r][near])
        found_q.append(q[near])
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, q = np.concatenate(found_i), np.concatenate(found_q)
    order = np.lexsort((i, q))
    i, q = i[order], q[order]
    # neighbours whose contexts overlap belong to one stretch
    new = np.ones(len(i), bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] > i[:-1] + 2 * size)
    return i[new], q[new]


def _seams(words: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(i, q)``: periods across places where two periodic regions meet out of step."""
    long = runs[runs[:, 1] - runs[:, 0] >= 9 * runs[:, 2]]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    a, b = long[:-1], long[1:]
    meet = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1]) & (b[:, 0] > a[:, 0])
    found_i, found_q = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for (s1, e1, p), (s2, e2, _) in zip(a[meet].tolist(), b[meet].tolist(), strict=True):
        root, other = words[s1 : s1 + p].tobytes(), words[s2 : s2 + p].tobytes() * 2
        at = other.find(root)
        while at >= 0 and at % 8:
            at = other.find(root, at + 1)
        if at < 0:
            continue
        most = min(e1 - s1, e2 - s2)
        q = np.arange(9 * p + (s2 - s1 + at // 8 - 9 * p) % p, most + 1, p)
        found_i.append(np.maximum(s1, s2 - q))
        found_q.append(q)
    return np.concatenate(found_i), np.concatenate(found_q)


def _short_periods(words: np.ndarray, q: int) -> np.ndarray:
    same = np.concatenate([[False], words[:-q] == words[q:], [False]]) if len(words) > q else np.zeros(2, bool)
    turns = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    turns = turns[turns[:, 1] - turns[:, 0] >= q]
    return np.stack([turns[:, 0], turns[:, 1] + q, np.full(len(turns), q)], axis=1)


def _squares(i: np.ndarray, q: np.ndarray, stretches: _Stretches) -> np.ndarray:
    """The proposals that are runs, as ``(start, end, period)``."""
    lo, hi = stretches.extended(i, q)
    runs = np.stack([lo, hi, q], axis=1)[hi - lo >= 2 * q]
    return np.unique(runs, axis=0)


def find_runs(words: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS) -> np.ndarray:
    """``(start, end, period)`` of all runs of some texts, by start and period.

    ``words`` has a number for each word, text after text, ``sizes`` words a text;
    starts and ends count along ``words``. A run has its smallest period q, at least
    twice q and ``min_words`` words, and can't be extended.
    """
    total = len(words)
    if not total:
        return np.empty((0, 3), np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    # a word of its own after each text
    place = np.arange(total) + text
    line = np.empty(total + len(sizes), np.int64)
    line[np.cumsum(sizes + 1) - 1] = int(words.max()) + 1 + np.arange(len(sizes))
    line[place] = words
    stretches = _Stretches(_mix(line.astype(np.uint64)))
    found = [_short_periods(line, 1), _short_periods(line, 2)]
    length = np.repeat(sizes + 1, sizes + 1)
    where = np.arange(len(line))
    k = 0
    while True:
        size = 1 << k
        fits = length > 6 * size
        if not fits.any():
            break
        if 2 * fits.sum() < len(fits):
            stretches.only(fits)
            where, length = where[fits], length[fits]
        to_here = np.full(len(line), -1)
        to_here[where] = np.arange(len(where))
        known = np.concatenate(found)
        periodic = known[(3 * known[:, 2] <= size) & (known[:, 1] - known[:, 0] >= size)]
        start = to_here[periodic[:, 0]]
        there = start >= 0
        left_out = np.zeros(len(where) + 1, np.int64)
        np.add.at(left_out, start[there], 1)
        np.add.at(left_out, start[there] + (periodic[there, 1] - periodic[there, 0]) - size + 1, -1)
        marks = _marks(stretches.scale(k), k, np.cumsum(left_out)[:-1] > 0)
        i, q = _equal_marks(marks, stretches.scale(k + 1), size)
        if len(i):
            runs = _squares(i, q, stretches)
            shift = where[runs[:, 0]] - runs[:, 0]
            found.append(np.stack([runs[:, 0] + shift, runs[:, 1] + shift, runs[:, 2]], axis=1))
        k += 1
    i, q = _seams(line, _primitive(np.concatenate(found)))
    if len(i):
        whole = _Stretches(_mix(line.astype(np.uint64)))
        whole.scale(max(0, int(sizes.max()).bit_length() - 1))
        found.append(_squares(i, q, whole))
    runs = _primitive(np.concatenate(found))
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(min_words, 2 * runs[:, 2])]
    before = np.searchsorted(np.cumsum(sizes + 1), runs[:, 0], "right")
    runs[:, :2] -= before[:, None]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _primitive(runs: np.ndarray) -> np.ndarray:
    """Of runs over the same words the one with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _lists(flat: list[pa.Array], names: list[str], offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, names)
    )


def word_runs(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``(<id>, n_words, runs, collapsed)``, one row for each row of ``docs``.

    ``runs`` are all ``(start, length, period)`` in words from 0, by start and period;
    ``collapsed`` has the words that no run holds beyond its first period, joined by
    one space. Words are what blanks of ASCII separate; they are compared byte by byte.
    A null or blank text has no words, no runs and an empty ``collapsed``. Rows are
    independent, so repeated ids and texts give repeated rows. A text's words are held
    by one task, about 150 bytes for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches_of(batches):
            for batch in text_slices(whole, "t", PART_BYTES):
                yield _of_part(batch, min_words)
            release_memory()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (
        "id " + id_type + ", n_words long,"
        " runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
    return spread(rows).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _of_part(batch: pa.RecordBatch, min_words: int) -> pa.RecordBatch:
    texts = [t.split() for t in as_bytes(batch["t"])]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = [w for t in texts for w in t]
    codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices
    runs = find_runs(codes.to_numpy().astype(np.int64), sizes, min_words)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.searchsorted(ends, runs[:, 0], "right")
    dropped = np.zeros(len(flat) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    gone = np.cumsum(dropped)[:-1] > 0
    collapsed = []
    any_gone = set(owner.tolist())
    for i, t in enumerate(texts):
        if i in any_gone:
            t = [w for w, g in zip(t, gone[starts[i] : ends[i]].tolist(), strict=True) if not g]
        collapsed.append(b" ".join(t))
    columns = [runs[:, 0] - starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]]
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    listed = _lists([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"], offsets)
    return pa.RecordBatch.from_arrays(
        [batch["id"], pa.array(sizes), listed, pa.array(collapsed, pa.binary()).view(pa.string())],
        names=["id", "n_words", "runs", "collapsed"],
    )


def looped_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, <text>)`` with a loop in one text of ten, chosen by crc32 of its id.

    Of such a text's n words, from 0, word i >= a becomes word a + (i - a) % p, where
    g = crc32 // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(F.col(text_col), _BLANKS), lambda w: w != "")
    looped = docs.select(F.col(id_col), F.col(text_col), h.alias("h"))
    looped = looped.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    looped = looped.withColumn("a", F.when(n > 0, g % n))
    looped = looped.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    at = F.sequence(F.lit(0), n - 1)
    new = F.transform(
        at,
        lambda i: F.get(
            "words",
            F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"),
        ),
    )
    text = F.when(n > 0, F.array_join(new, " ")).otherwise(F.col(text_col))
    return looped.select(id_col, text.alias(text_col))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of each text, digests of all, and of the text without them."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = word_runs(looped_texts(docs))
    first = F.array_sort(
        F.transform(
            "runs",
            lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")),
        )
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listing = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    best = found.withColumn("best", F.get(first, F.lit(0)))
    length, period = -F.col("best.l"), F.col("best.p")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.s").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(-best.l * 1000) div best.p").alias("exponent_milli"),
        F.sha2(listing, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
