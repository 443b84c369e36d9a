"""Language-model scores of texts by context-tree weighting over bytes.

A byte is eight binary decisions, each with its own tree of contexts: the bytes
before it, up to five of them. A node counts the decisions made there in training
and estimates the next one as Krichevsky and Trofimov do; the tree mixes the
estimates of all depths, each node weighed by how well it alone, and how well its
children, code what was counted. The model is the table of all strings of six
bytes with their counts; nothing is cut from it.

Texts are dealt into blocks of bounded size. A block lists its different strings
once, these are counted over all blocks, and the probability of the last byte of
each is worked out by subtrees: nodes below three bytes of context in tasks that
hold whole subtrees, which three bytes bound, the few levels above as aggregates.
Probabilities come back to each block that listed the string, where its texts add
them up. Words are counted and come back the same way for the base score.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise
from math import ceil, log, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearkin.llm.common import as_bytes, batches_of, fold_of, read, release_memory
from nearkin.sources.storage import durable

#: Bytes of context; a string of these and the next byte fits 48 bits.
DEPTH = 5
#: Contexts of so many bytes are the roots of what one task works out.
SUBTREE_DEPTH = 3
BLOCK_BYTES = 36 << 20
SUBTREE_STRINGS = 100_000

_START, _END = 0xFE, 0xFF  # bytes that UTF-8 never has
_PIECE = 1 << 19
# Texts of a block that are held as Python objects at a time, and rows that are told.
_TEXTS = 500
_ROWS = 1 << 16
_LOG_HALF = log(0.5)

_LISTED = "block int, key long, word binary, n long"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TOP = "ctx long, node int, n0 double, n1 double, lw double"


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) for counts, by Stirling's series after seven steps up."""
    x = n + 0.5
    shift = np.zeros_like(x)
    for _ in range(7):
        low = x < 8
        shift += np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    return _stirling(x) - shift


def _stirling(x: np.ndarray) -> np.ndarray:
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + series


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    shift = np.zeros_like(x)
    for _ in range(7):
        low = x < 8
        shift += np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    return _stirling(x) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives to n0 zeros and n1 ones."""
    found = log_gamma_half(n0) + log_gamma_half(n1) - log(np.pi) - _log_factorial(n0 + n1)
    return np.where(n0 + n1 == 0, 0.0, found)


def _weighted(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(_LOG_HALF + kt, _LOG_HALF + children)


# -- strings of texts ---------------------------------------------------------


def _pieces(texts: list[bytes], size: int = _PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strings of six bytes around every byte of the texts, and which text each is of.

    The nearest byte of context is the highest in a string's number, the byte
    that follows the context the lowest. A text's end is a byte to predict too.
    """
    parts, owners, held = [], [], 0
    lead = bytes([_START]) * DEPTH
    for i, text in enumerate(texts):
        padded = lead + text + bytes([_END])
        for at in range(0, len(text) + 1, size):
            part = padded[at : at + size + DEPTH]
            parts.append(part)
            owners.append(i)
            held += len(part)
            if held >= size:
                yield _strings(parts, owners)
                parts, owners, held = [], [], 0
    if parts:
        yield _strings(parts, owners)


def _strings(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    key = x[DEPTH:].astype(np.uint64)
    for i in range(1, DEPTH + 1):
        key |= x[DEPTH - i : len(x) - i].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - i))
    lead = np.zeros(len(x), bool)
    starts = np.cumsum(sizes) - sizes
    for i in range(DEPTH):
        lead[starts + i] = True
    owner = np.repeat(np.array(owners, np.int64), sizes - DEPTH)
    return key[~lead[DEPTH:]], owner


def _counted(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    weights = np.concatenate(counts)
    return key, np.bincount(inverse, weights=weights, minlength=len(key)).astype(np.int64)


def _lower(texts: pa.ChunkedArray) -> pa.Array:
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    return lower.combine_chunks() if isinstance(lower, pa.ChunkedArray) else lower


def _words(lower: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts in a row, and how many each text has."""
    split = pc.ascii_split_whitespace(lower)
    words, sizes = split.flatten(), pc.list_value_length(split).to_numpy()
    real = pc.not_equal(words, "")
    owner = np.repeat(np.arange(len(sizes)), sizes)[real.to_numpy(zero_copy_only=False)]
    return words.filter(real), np.bincount(owner, minlength=len(sizes))


def _parts(block: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Array]]:
    """Lower-case texts of a block, a part at a time, those to learn from apart."""
    for batch in block:
        for lo in range(0, batch.num_rows, _TEXTS):
            part = batch.slice(lo, _TEXTS)
            for learn in (True, False):
                some = part.filter(pc.equal(part["train"], learn))
                if some.num_rows:
                    yield learn, _lower(some["t"])


def _list_block(
    key: tuple[pa.Scalar, ...], block: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Different strings and words of a block with their counts in training texts.

    Texts are let go once they are counted, and what was counted is told in parts.
    """
    release_memory()
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    empty = {"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())}
    words = [pa.table(empty)]
    for learn, some in _parts(block):
        for strings, _ in _pieces(as_bytes(some)):
            strings.sort()
            first = np.flatnonzero(np.concatenate([[True], strings[1:] != strings[:-1]]))
            keys.append(strings[first])
            n = np.diff(np.concatenate([first, [len(strings)]]))
            counts.append(n if learn else np.zeros(len(first), np.int64))
            if len(keys) > 8:
                key_, n_ = _counted(keys, counts)
                keys, counts = [key_], [n_]
        found = _words(some)[0].value_counts()
        n = found.field(1) if learn else pa.array(np.zeros(len(found), np.int64))
        words.append(pa.table({"word": found.field(0), "n": n}))
        if len(words) > 8:
            words = [_summed(words)]
    strings, n = _counted(keys, counts)
    counted = _summed(words)
    del keys, counts, words
    release_memory()

    def told(string: pa.Array, word: pa.Array, n: pa.Array) -> pa.RecordBatch:
        block = pa.array(np.full(len(n), key[0].as_py(), np.int32))
        return pa.RecordBatch.from_arrays([block, string, word, n], names=["block", "key", "word", "n"])

    for lo in range(0, len(strings), _ROWS):
        some = pa.array(strings[lo : lo + _ROWS].view(np.int64))
        yield told(some, pa.nulls(len(some), pa.binary()), pa.array(n[lo : lo + _ROWS]))
    for some in counted.to_batches(_ROWS):
        yield told(pa.nulls(len(some), pa.int64()), some["word"].cast(pa.binary()), some["n"])


def _summed(words: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(words).group_by("word").aggregate([("n", "sum")])
    return summed.rename_columns({"n_sum": "n"})


# -- trees ------------------------------------------------------------------------


class _Subtree:
    """Nodes of the trees below contexts of ``SUBTREE_DEPTH`` bytes.

    Level i holds the nodes of depth ``DEPTH - i``, a node being a context with
    the bits of the next byte decided so far. ``up[i]`` maps nodes of level i to
    their parents in level i + 1.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, n = keys[order], counts[order].astype(float)
        byte = (self.keys & np.uint64(255)).astype(np.int64)
        ctx = (self.keys >> np.uint64(8)).astype(np.int64)
        depth = np.arange(8)
        node = (1 << depth)[None, :] | (byte[:, None] >> (8 - depth)[None, :])
        self.bit = (byte[:, None] >> (7 - depth)[None, :]) & 1
        code = (ctx[:, None] << 8) | node
        self.codes, inverse = np.unique(code.ravel(), return_inverse=True)
        self.leaf = inverse.reshape(code.shape)
        weights = np.repeat(n, 8)
        ones = self.bit.ravel().astype(float)
        size = len(self.codes)
        n1 = np.bincount(inverse.ravel(), weights=weights * ones, minlength=size)
        n0 = np.bincount(inverse.ravel(), weights=weights * (1 - ones), minlength=size)
        self.up, self.n0, self.n1, self.kt = [], [n0], [n1], [log_kt(n0, n1)]
        self.lw, codes = [self.kt[0]], self.codes
        for _ in range(DEPTH - SUBTREE_DEPTH):
            codes, up = np.unique(((codes >> 16) << 8) | (codes & 255), return_inverse=True)
            size = len(codes)
            self.up.append(up)
            self.n0.append(np.bincount(up, weights=self.n0[-1], minlength=size))
            self.n1.append(np.bincount(up, weights=self.n1[-1], minlength=size))
            children = np.bincount(up, weights=self.lw[-1], minlength=size)
            self.kt.append(log_kt(self.n0[-1], self.n1[-1]))
            self.lw.append(_weighted(self.kt[-1], children))
        self.roots = codes

    def log10_bytes(self, above: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Log probability of each key's byte, given what lies above each root.

        ``above`` is the part of a one's probability that shorter contexts give,
        ``share`` what is left for the root and below.
        """
        ones = [(b + 0.5) / (a + b + 1) for a, b in zip(self.n0, self.n1, strict=True)]
        p, at = ones[0], np.arange(len(self.codes))
        for i, up in enumerate(self.up, 1):
            at = up[at]
            stop = np.exp(_LOG_HALF + self.kt[i] - self.lw[i])[at]
            p = stop * ones[i][at] + (1 - stop) * p
        p = above[at] + share[at] * p
        each = p[self.leaf]
        return np.log10(np.where(self.bit == 1, each, 1 - each)).sum(axis=1)


def _tops(key: tuple, strings: pa.Table) -> pa.Table:
    keys = strings["key"].to_numpy().astype(np.uint64)
    tree = _Subtree(keys, strings["n"].to_numpy())
    return pa.table(
        {
            "ctx": pa.array(tree.roots >> 8),
            "node": pa.array((tree.roots & 255).astype(np.int32)),
            "n0": tree.n0[-1],
            "n1": tree.n1[-1],
            "lw": tree.lw[-1],
        }
    )


def _probabilities(strings: pa.Table, tops: pa.Table) -> pa.Table:
    keys = strings["key"].to_numpy().astype(np.uint64)
    if not len(keys):
        return pa.table({"key": pa.array([], pa.int64()), "lp": pa.array([], pa.float64())})
    release_memory()
    tree = _Subtree(keys, strings["n"].to_numpy())
    code = (tops["ctx"].to_numpy() << 8) | tops["node"].to_numpy().astype(np.int64)
    order = np.argsort(code)
    at = order[np.searchsorted(code[order], tree.roots)]
    lp = tree.log10_bytes(tops["above"].to_numpy()[at], tops["share"].to_numpy()[at])
    return pa.table({"key": pa.array(tree.keys.astype(np.int64)), "lp": lp})


@F.arrow_udf(T.DoubleType())
def _kt(n0: pa.Array, n1: pa.Array) -> pa.Array:
    return pa.array(log_kt(n0.to_numpy(), n1.to_numpy()))


def _above(tops: DataFrame) -> DataFrame:
    """``ctx, node, above, share`` for the roots of subtrees, from the levels above."""
    levels = [durable(tops, "level")]
    for _ in range(SUBTREE_DEPTH):
        up = levels[-1].groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("lw").alias("children")
        )
        kt = up.withColumn("kt", _kt("n0", "n1"))
        a, b = _LOG_HALF + F.col("kt"), _LOG_HALF + F.col("children")
        high = F.greatest(a, b)
        lw = high + F.log1p(F.exp(F.least(a, b) - high))
        stop = F.exp(_LOG_HALF + F.col("kt") - F.col("lw"))
        kt = kt.withColumn("lw", lw).withColumn("stop", stop)
        levels.append(durable(kt.select("ctx", "node", "n0", "n1", "lw", "stop"), "level"))
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    top = levels[-1].select(
        "ctx", "node", (F.col("stop") * one).alias("above"), (1 - F.col("stop")).alias("share")
    )
    for level in reversed(levels[1:-1]):
        parent = top.select(
            F.col("ctx").alias("pctx"), F.col("node").alias("pnode"), "above", F.col("share").alias("left")
        )
        met = level.join(
            parent, (F.shiftright("ctx", 8) == F.col("pctx")) & (F.col("node") == F.col("pnode"))
        )
        here = F.col("left") * F.col("stop")
        top = met.select(
            "ctx", "node", (F.col("above") + here * one).alias("above"),
            (F.col("left") - here).alias("share"),
        )
    parent = top.select(
        F.col("ctx").alias("pctx"), F.col("node").alias("pnode"), "above", "share"
    )
    met = levels[0].join(
        parent, (F.shiftright("ctx", 8) == F.col("pctx")) & (F.col("node") == F.col("pnode"))
    )
    return met.select("ctx", "node", "above", "share")


def string_probabilities(counts: DataFrame) -> DataFrame:
    """``(key, lp)``: log10 probability of each string's last byte after the others.

    ``counts`` has every string once, as ``key``, with its training count ``n``,
    which may be zero.
    """
    strings = durable(counts, "strings")
    buckets = max(1, ceil(strings.count() / SUBTREE_STRINGS))
    root = F.shiftright("key", 8 * (DEPTH + 1 - SUBTREE_DEPTH))
    bucket = F.pmod(F.xxhash64(root), F.lit(buckets)).cast("int")
    held = strings.withColumn("bucket", bucket)
    tops = held.groupBy("bucket").applyInArrow(_tops, _TOP)
    above = durable(_above(tops), "above")
    above = above.withColumn("bucket", F.pmod(F.xxhash64("ctx"), F.lit(buckets)).cast("int"))
    pairs = held.groupBy("bucket").cogroup(above.groupBy("bucket"))
    return pairs.applyInArrow(_probabilities, "key long, lp double")


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Groups are handed to Python in batches of so many rows meanwhile.

    A block in one batch takes its size several times over in buffers.
    """
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, before)


# -- scores -----------------------------------------------------------------------


class _Listed:
    """What a block has listed, from batches that are let go: words and their counts,
    and strings with their logs in the order of the strings.
    """

    def __init__(self):
        self.words, self.counts = [pa.array([], pa.binary())], [np.empty(0)]
        self.keys, self.lps = [np.empty(0, np.int64)], [np.empty(0)]

    def add(self, found: pa.RecordBatch) -> None:
        is_string = found["key"].is_valid().to_numpy(zero_copy_only=False)
        lp = found["lp"].to_numpy(zero_copy_only=False)
        self.keys.append(found["key"].drop_null().to_numpy().copy())
        self.lps.append(lp[is_string])
        if not is_string.all():
            self.words.append(found["word"].filter(pa.array(~is_string)).cast(pa.binary()))
            self.counts.append(lp[~is_string])

    def sides(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        keys, lps = np.concatenate(self.keys), np.concatenate(self.lps)
        words, counts = pa.concat_arrays(self.words).cast(pa.string()), np.concatenate(self.counts)
        self.__init__()
        order = np.argsort(keys)
        keys = keys[order]
        return words, counts, keys, lps[order]


def score_texts(
    docs: DataFrame,
    train: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Scores of all texts by a model of those for which the SQL condition ``train`` holds.

    Returns ``<id>, n_tokens, n_known, train_tokens, base_score, score, n_bytes`` for
    each row. A-Z counts as a-z; a null text counts as an empty one; ``train`` that
    is null doesn't hold. ``score`` is the log10 probability of the bytes and the
    end, ``base_score`` that of the words and an end, each by its frequency. Without
    training texts each bit has probability one half.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.expr(train), F.lit(False)).alias("train"),
        F.col(text_col).cast("string").alias("t"),
    )
    sums = rows.agg(
        F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 64).alias("bytes"),
        F.count_if(F.col("train")).alias("n"),
    ).first()
    blocks = max(1, ceil((sums.bytes or 0) / block_bytes))
    block = F.pmod(F.xxhash64("id", "t"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("block", block)
    with _small_batches(docs.sparkSession):
        listed = durable(rows.groupBy("block").applyInArrow(_list_block, _LISTED), "listed")
    strings = listed.where("key IS NOT NULL").select("block", "key", "n")
    words = listed.where("word IS NOT NULL").select("block", "word", "n")
    word_counts = durable(words.groupBy("word").agg(F.sum("n").alias("c")), "words")
    totals = word_counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")
    ).first()
    n_train, n_words = totals.n + sums.n, totals.v + (sums.n > 0)
    lp = durable(string_probabilities(strings.groupBy("key").agg(F.sum("n").alias("n"))), "lp")
    none = F.lit(None)
    back = strings.join(lp, "key").select("block", "key", none.cast("binary").alias("word"), "lp")
    known = words.join(word_counts, "word").select(
        "block", none.cast("long").alias("key"), "word", F.col("c").cast("double").alias("lp")
    )
    id_field = docs.schema[id_col].dataType
    listed = back.union(known).select(
        "block", F.lit(False).alias("is_text"), none.cast(id_field).alias("id"),
        none.cast("string").alias("t"), "key", "word", "lp",
    )
    texts = rows.select(
        "block", F.lit(True).alias("is_text"), "id", "t", none.cast("long").alias("key"),
        none.cast("binary").alias("word"), none.cast("double").alias("lp"),
    )
    unit = n_train + 0.5 * (n_words + 1)
    end = log10((sums.n + 0.5) / unit)
    id_type = id_field.simpleString()

    def scored(ids: pa.Array, texts: pa.Array, sides: tuple) -> pa.RecordBatch:
        listed, count, keys, lps = sides
        lower = _lower(texts)
        t = as_bytes(lower)
        total = np.zeros(len(t))
        for strings_, owner in _pieces(t):
            packed = (strings_ << np.uint64(16)) | owner.astype(np.uint64)
            packed.sort()
            own, place = packed & np.uint64(65535), (packed >> np.uint64(16)).astype(np.int64)
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            each = lps[np.searchsorted(keys, place[starts])]
            each = np.repeat(each, np.diff(np.concatenate([starts, [len(place)]])))
            total += np.bincount(own.astype(np.int64), weights=each, minlength=len(t))
        words_, per_text = _words(lower)
        c = count[pc.index_in(words_, value_set=listed).to_numpy(zero_copy_only=False)]
        owner = np.repeat(np.arange(len(t)), per_text)
        logs = np.log10((c + 0.5) / unit)
        known_ = np.bincount(owner, weights=c > 0, minlength=len(t)) + (sums.n > 0)
        return pa.RecordBatch.from_pydict(
            {
                id_col: ids,
                "n_tokens": (per_text + 1).astype(np.int64),
                "n_known": known_.astype(np.int64),
                "train_tokens": np.full(len(t), n_train, np.int64),
                "base_score": np.bincount(owner, weights=logs, minlength=len(t)) + end,
                "score": total,
                "n_bytes": np.array([len(x) for x in t], np.int64),
            }
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by block, what it has listed first
        release_memory()
        block, found, sides = None, _Listed(), None
        for batch in batches_of(batches):
            now, is_text = batch["block"].to_numpy(), batch["is_text"].to_numpy(zero_copy_only=False)
            new = (now[1:] != now[:-1]) | (is_text[1:] != is_text[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for lo, hi in pairwise(cuts):
                if now[lo] != block:
                    block, found, sides = now[lo], _Listed(), None
                    release_memory()
                if not is_text[lo]:
                    found.add(batch.slice(lo, hi - lo))
                    continue
                if sides is None:
                    sides = found.sides()
                for at in range(lo, hi, _TEXTS):
                    part = batch.slice(at, min(_TEXTS, hi - at))
                    yield scored(part["id"], part["t"], sides)
        del found, sides
        release_memory()

    schema = (
        f"`{id_col}` {id_type}, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double, n_bytes long"
    )
    both = listed.union(texts).repartition("block").sortWithinPartitions("block", "is_text")
    with _small_batches(docs.sparkSession):
        return durable(both.mapInArrow(score, schema), "scores")


def op8_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the code length per byte, learning from four of five folds."""
    fold = "pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5)"
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, f"{fold} != 1")
    bits = -F.col("score") / log10(2) / (F.col("n_bytes") + 1)
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == 1).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        bits.alias("bits_per_byte"),
    )
