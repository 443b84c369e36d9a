"""Suffix-array dedup: passages of 200 bytes that occur more than once.

The index is a logarithmic family of suffix arrays. Entries come in batches; a
batch gets a suffix array, is scanned together with every level there is for
suffixes that agree in 200 bytes, and becomes a level itself; levels of equal size
merge into one of twice the size. The family is dealt over shards, so that what can
match is in the same shard.

Arrays of every suffix of a large corpus would take many times its size, so the
index holds just the suffixes that can match. Each stretch of 200 bytes has an
anchor, the place inside it whose next 64 bytes hash lowest; equal stretches have
equal anchors, at the same distance. A stretch whose anchor's 64 bytes occur
nowhere else occurs nowhere else itself, which clears most of a corpus by a count
of hashes. The others enter the index: neighbouring stretches with one anchor as
one entry, and entries of the same bytes as one with a count, so that large groups
of copies stay small. Where an anchor has more different entries than a shard should
hold, entries are cut into sixteen stretches each, which share 185 bytes that tell
them apart further, and if that is not enough into single stretches. Two of these
differ only if their text does, so counting copies settles them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm.common import as_bytes, batches_of, read
from nearkin.sources.storage import durable

LENGTH = 200
ANCHOR_BYTES = 64
#: Anchors with more different entries have their stretches counted one by one.
HOT_ENTRIES = 256
SHARD_ENTRIES = 3_000
BATCH_ENTRIES = 512
#: Stretches of a cut of hot entries.
FINE = 16

_PIECE = 2 << 20
_PLACE_BITS = 24  # places within a piece, below the hash that is compared
_BASE = 0x9E3779B97F4A7C15
_ANCHOR = "doc long, dh int, first int, run int, lead int, k1 long, k2 long"
_OPEN, _SETTLED, _PATTERN = 0, 1, 2


# -- the index --------------------------------------------------------------------


class SuffixFamily:
    """Levels of suffix arrays over batches of texts, for matches of ``length`` bytes.

    An array has the first ``length`` bytes of its suffixes in order, and the number
    of the owner of each. Bytes of equal width compare as they are.
    """

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self._matched: list[np.ndarray] = [np.empty(0, np.int64)]

    @property
    def matched(self) -> np.ndarray:
        """Owners of the suffixes that occur more than once, in order."""
        return np.unique(np.concatenate(self._matched))

    def add(self, suffixes: np.ndarray, owners: np.ndarray) -> None:
        """A new batch: its own array, scans against all levels, merges."""
        new, own = self._merged(suffixes, owners)
        for _, level, level_own in self.levels:
            self._merged(np.concatenate([level, new]), np.concatenate([level_own, own]))
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, level, level_own = self.levels.pop()
            new, own = self._merged(
                np.concatenate([level, new]), np.concatenate([level_own, own])
            )
            rank += 1
        self.levels.append((rank, new, own))

    def _merged(self, suffixes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order, each text once; notes owners of equal ones."""
        order = np.argsort(suffixes, kind="stable")
        suffixes, owners = suffixes[order], owners[order]
        same = suffixes[1:] == suffixes[:-1]
        self._matched += [owners[1:][same], owners[:-1][same]]
        first = np.concatenate([[True], ~same]) if len(suffixes) else np.empty(0, bool)
        return suffixes[first], owners[first]


# -- anchors ------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Anchors:
    """Finds the anchor of every stretch of ``length`` bytes."""

    def __init__(self, length: int = LENGTH, width: int = ANCHOR_BYTES, piece: int = _PIECE):
        self.length, self.width, self.piece = length, width, piece
        n = piece + 2 * length
        steps = np.full(n + 1, _BASE, np.uint64)
        steps[0] = 1
        back = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        self._power = np.cumprod(steps, dtype=np.uint64)
        self._root = np.cumprod(back, dtype=np.uint64)
        self._byte = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """``(text, first, run, lead, k1, k2)`` in parts: runs of stretches with one anchor.

        ``first`` is where a run's first stretch starts, ``run`` how many there are
        and ``lead`` how far the anchor is from there; ``k1`` hashes the anchor's
        bytes, ``k2`` all bytes of the run.
        """
        held, owners, offsets, size = [], [], [], 0
        for i, text in enumerate(texts):
            stretches = len(text) - self.length + 1
            for at in range(0, stretches, self.piece):
                part = text[at : at + self.piece + self.length - 1]
                if held and size + len(part) > self.piece + self.length:
                    yield self._runs(held, owners, offsets)
                    held, owners, offsets, size = [], [], [], 0
                held.append(part)
                owners.append(i)
                offsets.append(at)
                size += len(part)
        if held:
            yield self._runs(held, owners, offsets)

    def _runs(self, parts: list[bytes], owners: list[int], offsets: list[int]):
        x = np.frombuffer(b"".join(parts), np.uint8)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(self._byte[x] * self._power[: len(x)], out=sums[1:])
        k, w = self.width, self.length - self.width + 1
        grams = len(x) - k + 1
        h = _mix((sums[k:] - sums[:-k]) * self._root[:grams])
        place = np.arange(grams, dtype=np.uint64)
        ranked = ((h >> np.uint64(_PLACE_BITS)) << np.uint64(_PLACE_BITS)) | place
        lowest = _sliding_min(ranked, w)
        anchor = (lowest & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
        at = np.arange(len(anchor))
        inside = at - starts[part] + self.length <= sizes[part]
        at, part, anchor = at[inside], part[inside], anchor[inside]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
        begin = np.flatnonzero(new)
        run = np.diff(np.concatenate([begin, [len(at)]]))
        first, part, anchor = at[begin], part[begin], anchor[begin]
        end = first + run - 1 + self.length
        whole = (sums[end] - sums[first]) * self._root[first]
        h2 = _mix(whole + run.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        text = np.array(owners, np.int64)[part]
        offset = first - starts[part] + np.array(offsets, np.int64)[part]
        lead = anchor - first
        return text, offset, run, lead, h[anchor].view(np.int64), h2.view(np.int64)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w values in a row, from running minima of blocks of w."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(blocks, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors()
        for batch in batches_of(batches):
            ids, hashes = batch["doc"], batch["dh"]
            for text, first, n, lead, k1, k2 in finder.of(as_bytes(batch["t"])):
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(at),
                        hashes.take(at),
                        pa.array(first.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(lead.astype(np.int32)),
                        pa.array(k1),
                        pa.array(k2),
                    ],
                    names=["doc", "dh", "first", "run", "lead", "k1", "k2"],
                )

    return docs.mapInArrow(run, _ANCHOR)


def _sorted_out(rows: DataFrame) -> DataFrame:
    """Rows of which something occurs elsewhere, with ``kind`` and ``hot``.

    Stretches of two rows can only be equal if ``k1`` is; rows equal in ``k1`` and
    ``k2`` are copies. Settled rows have copies. Open ones are to be matched, with
    patterns: one copy of each settled row that shares ``k1`` with an open one,
    which weighs two. ``hot`` rows have very many different ones with their ``k1``.
    """
    entries = durable(rows.groupBy("k1", "k2").agg(F.sum("weight").alias("n")), "entries")
    per_key = entries.groupBy("k1").agg(
        F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("open")
    )
    about = entries.join(durable(per_key, "per_key"), "k1").where("m > 1 OR n > 1")
    found = rows.join(durable(about, "about"), ["k1", "k2"]).select(
        *rows.columns,
        F.when(F.col("n") == 1, _OPEN).otherwise(_SETTLED).alias("kind"),
        (F.col("m") > HOT_ENTRIES).alias("hot"),
        (F.col("open") > 0).alias("wanted"),
    )
    found = durable(found, "found")
    copies = found.where((F.col("kind") == _SETTLED) & F.col("wanted"))
    one = F.min(F.struct(*(c for c in found.columns if c not in ("k1", "k2")))).alias("s")
    patterns = copies.groupBy("k1", "k2").agg(one).select("s.*", "k1", "k2")
    patterns = patterns.withColumns({"kind": F.lit(_PATTERN), "weight": F.lit(2)})
    columns = [*rows.columns, "kind", "hot"]
    return durable(found.select(columns).union(patterns.select(columns)), "sorted_out")


def _by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of a document as one; there are no more than it has bytes."""
    held = F.collect_list(F.struct(*columns)).alias("runs")
    return rows.groupBy(F.col("doc").alias("_doc"), F.col("dh").alias("_dh")).agg(held)


_SAME = "doc <=> _doc AND dh = _dh"
_ENTRY = (
    "fine boolean, doc long, dh int, first int, run int, k1 long, k2 long, weight int, bytes binary"
)


def _fine(text: bytes, r: dict) -> Iterator[tuple[int, int, int, int]]:
    """``(first, run, k1, k2)`` of up to sixteen stretches each, cut by the anchor."""
    anchor, at, end = r["first"] + r["lead"], r["first"], r["first"] + r["run"]
    while at < end:
        block = (anchor - at) // FINE
        stop = min(end, anchor - block * FINE + 1)
        # what every stretch of the block holds, whichever of them are in this run
        low, high = anchor - block * FINE, anchor - block * FINE - FINE + 1 + LENGTH
        shared = blake2b(text[low:high], digest_size=8, salt=block.to_bytes(8, "big", signed=True))
        own = blake2b(text[at : stop - 1 + LENGTH], digest_size=8)
        own.update((anchor - at).to_bytes(8, "big", signed=True))
        k1, k2 = (int.from_bytes(x.digest(), "big", signed=True) for x in (shared, own))
        yield at, stop - at, k1, k2
        at = stop


def _entries(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Bytes of the runs to be matched; hot runs are cut into ``fine`` ones."""
    wanted = runs.where(F.col("kind") != _SETTLED)
    held = _by_document(wanted, "first", "run", "lead", "k1", "k2", "hot", "weight")
    met = docs.join(held, F.expr(_SAME)).select("doc", "dh", "t", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            rows = []
            ids, hashes = batch["doc"].to_pylist(), batch["dh"].to_pylist()
            for doc, dh, text, held in zip(
                ids, hashes, as_bytes(batch["t"]), batch["runs"].to_pylist(), strict=True
            ):
                for r in held:
                    parts = [(r["first"], r["run"], r["k1"], r["k2"])]
                    for first, n, k1, k2 in _fine(text, r) if r["hot"] else parts:
                        data = text[first : first + n - 1 + LENGTH]
                        rows.append((r["hot"], doc, dh, first, n, k1, k2, r["weight"], data))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return met.mapInArrow(run, _ENTRY)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    long, int_ = pa.int64(), pa.int32()
    kinds = (pa.bool_(), long, int_, int_, int_, long, long, int_, pa.binary())
    names = ["fine", "doc", "dh", "first", "run", "k1", "k2", "weight", "bytes"]
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _match_shard(key: tuple, shard: pa.Table) -> pa.Table:
    """Runs of matched stretches among the entries of a shard."""
    family = SuffixFamily()
    first, run, weight = (shard[c].to_numpy() for c in ("first", "run", "weight"))
    data = shard["bytes"].to_pylist()
    for lo in range(0, shard.num_rows, BATCH_ENTRIES):
        hi = min(lo + BATCH_ENTRIES, shard.num_rows)
        x = np.frombuffer(b"".join(data[lo:hi]), np.uint8)
        sizes = np.array([len(b) for b in data[lo:hi]], np.int64)
        n = run[lo:hi].astype(np.int64)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(np.cumsum(sizes) - sizes, n) + place
        stretches = np.lib.stride_tricks.sliding_window_view(x, LENGTH)[at]
        # an owner is a row and a stretch of it
        owners = (np.repeat(np.arange(lo, hi), n) << 20) | place
        family.add(stretches.view(f"S{LENGTH}").ravel(), owners)
    owner = family.matched
    owner = owner[weight[owner >> 20] == 1]
    begin = np.flatnonzero(np.diff(owner, prepend=-2) != 1)
    length = np.diff(np.concatenate([begin, [len(owner)]]))
    row = owner[begin] >> 20
    start = first[row] + (owner[begin] & ((1 << 20) - 1))
    at = pa.array(row, pa.int64())
    return pa.table(
        {
            "doc": shard["doc"].take(at),
            "dh": shard["dh"].take(at),
            "first": pa.array(start, pa.int32()),
            "run": pa.array(length, pa.int32()),
        }
    )


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``(doc, dh, first, run)``: starts of stretches that occur elsewhere, in runs.

    ``docs`` has ``doc, dh, t``, an id, a hash of the text and its bytes.
    """
    anchors = durable(_anchors(docs), "anchors")
    again = anchors.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1").select("k1")
    near = durable(anchors.join(durable(again, "again"), "k1"), "near")
    runs = _sorted_out(near.withColumn("weight", F.lit(1)))
    entries = durable(_entries(docs, runs), "entries")
    fine = _sorted_out(entries.where("fine"))
    single = fine.where((F.col("kind") != _SETTLED) & F.col("hot"))
    open_ = fine.where((F.col("kind") != _SETTLED) & ~F.col("hot"))
    columns = ["doc", "dh", "first", "run"]
    held = [*columns, "k1", "weight", "bytes"]
    indexed = durable(entries.where("NOT fine").select(held).union(open_.select(held)), "indexed")
    shards = max(1, ceil(indexed.count() / SHARD_ENTRIES))
    shard = F.pmod(F.xxhash64("k1"), F.lit(shards)).cast("int")
    matched = (
        indexed.withColumn("shard", shard)
        .groupBy("shard")
        .applyInArrow(_match_shard, "doc long, dh int, first int, run int")
    )
    settled = [x.where((F.col("kind") == _SETTLED) & (F.col("weight") == 1)) for x in (runs, fine)]
    result = matched.union(_repeated_singles(single))
    for rows in settled:
        result = result.union(rows.select(columns))
    return result


def _repeated_singles(rows: DataFrame) -> DataFrame:
    """Stretches of hot rows one by one, those that have copies."""
    places = F.explode(F.sequence(F.lit(0), F.col("run") - 1)).alias("k")
    each = rows.select("doc", "dh", "first", "weight", "bytes", places)
    each = each.select(
        "doc",
        "dh",
        (F.col("first") + F.col("k")).alias("first"),
        F.lit(1).alias("run"),
        "weight",
        F.unhex(F.md5(F.substring("bytes", F.col("k") + 1, F.lit(LENGTH)))).alias("digest"),
    )
    each = durable(each, "singles")
    common = each.groupBy("digest").agg(F.sum("weight").alias("n")).where("n > 1").select("digest")
    found = each.where("weight = 1").join(durable(common, "common"), "digest")
    return found.select("doc", "dh", "first", "run")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, n_bytes, spans, kept)``, one row for each row of ``docs``.

    ``spans`` are the maximal runs of bytes, ``start`` to before ``end``, that lie in
    some stretch of 200 bytes that also starts anywhere else; ``kept`` is the rest.
    Every stretch counts as it is in the input, in whichever row, so rows that are
    repeated lose all they have from 200 bytes on. A null text is an empty one, and
    ids may be null or repeat. Texts are bytes and may be cut inside a character.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("t"))
    rows = rows.select("doc", F.hash("t").alias("dh"), "t")
    found = durable(_by_document(repeated_runs(rows), "first", "run"), "found")
    met = rows.join(found, F.expr(_SAME), "left").select("doc", "t", "runs")
    schema = "doc long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches_of(batches):
            texts, spans, kept = as_bytes(batch["t"]), [], []
            for t, held in zip(texts, batch["runs"].to_pylist(), strict=True):
                cut = _spans(held or [])
                spans.append([{"start": a, "end": b} for a, b in cut])
                edges = [0, *(e for s in cut for e in s), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], sizes, pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=["doc", "n_bytes", "spans", "kept"],
            )

    return met.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def _spans(runs: list[dict]) -> list[tuple[int, int]]:
    """Bytes covered by runs of stretches, as maximal spans."""
    spans: list[list[int]] = []
    for a, n in sorted((r["first"], r["run"]) for r in runs):
        end = a + n - 1 + LENGTH
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([a, end])
    return [(a, b) for a, b in spans]


def op7_suffix_array_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long")
    )
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
