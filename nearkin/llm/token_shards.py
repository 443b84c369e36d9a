"""Token ids in binary shards with a minimal perfect hash index over their keys.

Documents are put in ascending order of their key by a range shuffle, encoded in
their tasks, and packed into shards: a shard is a raw payload of little-endian ids
and an index that maps its keys to offsets in it. The index is a minimal perfect
hash of the kind that marks, level by level, the bits no two keys share; a key's
slot is the number of bits marked before its own. A slot holds a fingerprint, the
offset and the length, so a lookup takes a few steps whatever the size, and a key
that was never stored is told by its fingerprint. Shards are rows of a Parquet
table, which Spark writes and commits: a task that is run again leaves no half
shard behind, and any file system Spark can reach will do.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, chain
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm.common import IdStore, batches_of, read, task_cache, text_slices
from nearkin.sources.storage import scratch_path

END_ID = 2
#: A shard is closed once it holds so many ids.
SHARD_IDS = 1 << 20
_GAMMA = 2.0
_MAX_LEVELS = 48
_MEMO = 250_000
_SLICE_BYTES = 4 << 20
# Words that go to the library at a time.
_WORDS = 5_000

_SHARD = (
    "part int, shard int, first_key long, last_key long, start_in_part long, n_ids long,"
    " width int, payload binary, keys array<long>, turns array<int>,"
    " levels array<binary>, rest array<long>, prints binary, offsets binary, lengths binary"
)


# -- minimal perfect hash -----------------------------------------------------


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves half the output's."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Hash of a key and of how many rows with that key came before."""
    return _mix(_mix(keys.astype(np.int64).view(np.uint64), 1) + turns.astype(np.uint64), 2)


@dataclass
class PerfectHash:
    """Maps each of n known hashes to its own slot below n."""

    levels: list[np.ndarray] = field(default_factory=list)  # bits as bytes 0 or 1
    rest: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))

    def __post_init__(self) -> None:
        sizes = [int(bits.sum()) for bits in self.levels]
        self._before = [0, *accumulate(sizes)]
        self._ranks = [np.cumsum(bits, dtype=np.int64) for bits in self.levels]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        """From different hashes; what no level separates is listed in ``rest``."""
        levels, left = [], hashes
        while len(left) and len(levels) < _MAX_LEVELS:
            size = max(64, int(len(left) * _GAMMA))
            at = (_mix(left, len(levels) + 3) % np.uint64(size)).astype(np.int64)
            bits = (np.bincount(at, minlength=size) == 1).astype(np.uint8)
            levels.append(bits)
            left = left[bits[at] == 0]
        return cls(levels, np.sort(left))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; -1 or any slot for a hash that isn't known."""
        found = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for n, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (_mix(hashes[open_], n + 3) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            found[open_[hit]] = self._before[n] + self._ranks[n][at[hit]] - 1
            open_ = open_[~hit]
        if len(open_) and len(self.rest):
            at = np.searchsorted(self.rest, hashes[open_])
            at = np.minimum(at, len(self.rest) - 1)
            same = self.rest[at] == hashes[open_]
            found[open_[same]] = self._before[-1] + at[same]
        return found


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (_mix(hashes, 0xF1) >> np.uint64(32)).astype("<u4")


# -- encoding -------------------------------------------------------------------


class Encoder(Protocol):
    vocab_size: int

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""


class WordEncoder:
    """A byte-level tokenizer file whose pre-tokenizer parts at white space and
    between letters and stops, and which puts capitals in lower case.

    Each distinct word is encoded once by the library and its ids are put in place
    of it, which gives the ids of the whole text, as no token reaches over such a
    border. Words of Latin small letters are one pre-token, so they go to the
    library's model at once; all others pass through the whole tokenizer.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self._tokenizer = tokenizers.Tokenizer.from_str(f.read())
        self.vocab_size = max(self._tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        bytes_as_text = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        accented = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
        self._spelling = str.maketrans(
            {c: bytes_as_text.pre_tokenize_str(c)[0][0] for c in accented}
        )
        self._latin = re.compile(f"[a-z{''.join(accented)}]+")
        self._store = IdStore(_MEMO)

    def _add(self, words: list[str]) -> None:
        model, latin = self._tokenizer.model, self._latin
        ids: list[list[int]] = []
        others = [w for w in words if not latin.fullmatch(w)]
        for i in range(0, len(others), _WORDS):
            some = others[i : i + _WORDS]
            found = self._tokenizer.encode_batch_fast(some, add_special_tokens=False)
            ids.extend(e.ids for e in found)
        plain = set(words).difference(others)
        for w in plain:
            spelled = w if w.isascii() else w.translate(self._spelling)
            ids.append([t.id for t in model.tokenize(spelled)])
        flat = np.fromiter(chain.from_iterable(ids), np.uint32)
        sizes = np.array([len(x) for x in ids], np.int64)
        self._store.add([*others, *plain], flat, sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.ascii_lower(texts.fill_null(""))
        texts = pc.replace_substring_regex(texts, r"([a-z])([.,])", r"\1 \2")
        parts = pc.ascii_split_whitespace(texts)
        per_text = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._add(self._store.unknown(set(words)))
        code = np.array([self._store.code[w] for w in words], np.int64)
        found = self._store.gather(code[coded.indices.to_numpy()], per_text)
        self._store.trim()
        return found


def public_encoder(name: str = "word_bpe_49k.json") -> Callable[[], WordEncoder]:
    """A way to get an encoder of the installed public tokenizers inside a task."""

    def get() -> WordEncoder:
        import public_tokenizers

        # one thread: Spark already runs a task for each core
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept = task_cache()
        if name not in kept:
            kept[name] = WordEncoder(public_tokenizers.path(name))
        return kept[name]

    return get


# -- files ------------------------------------------------------------------------


def _pack(
    part: int, shard: int, start: int, held: list[tuple], width: int
) -> dict[str, object]:
    keys = np.concatenate([h[0] for h in held])
    turns = np.concatenate([h[1] for h in held])
    named = keys[turns >= 0]
    lengths = np.concatenate([h[3] for h in held])
    ids = np.concatenate([h[2] for h in held])
    offsets = np.cumsum(lengths) - lengths
    hashes = key_hash(keys, turns)
    index = PerfectHash.build(hashes)
    slots = index.slots(hashes)
    by_slot = np.empty(len(keys), np.int64)
    by_slot[slots] = np.arange(len(keys))
    return {
        "part": part,
        "shard": shard,
        "first_key": int(named[0]) if len(named) else None,
        "last_key": int(named[-1]) if len(named) else None,
        "start_in_part": start,
        "n_ids": len(ids),
        "width": width,
        "payload": ids.astype(f"<u{width}").tobytes(),
        "keys": keys,
        "turns": turns,
        "levels": [np.packbits(b).tobytes() + (-len(b) % 8).to_bytes(1) for b in index.levels],
        "rest": index.rest.view(np.int64),
        "prints": _fingerprint(hashes)[by_slot].tobytes(),
        "offsets": offsets[by_slot].astype("<u8").tobytes(),
        "lengths": lengths[by_slot].astype("<u8").tobytes(),
    }


def _unpack_levels(levels: list[bytes]) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(x[:-1], np.uint8))[: 8 * (len(x) - 1) - x[-1]] for x in levels]


def _arrow_schema() -> pa.Schema:
    long, int_, binary = pa.int64(), pa.int32(), pa.binary()
    return pa.schema(
        [("part", int_), ("shard", int_), ("first_key", long), ("last_key", long)]
        + [("start_in_part", long), ("n_ids", long), ("width", int_), ("payload", binary)]
        + [("keys", pa.list_(long)), ("turns", pa.list_(int_)), ("levels", pa.list_(binary))]
        + [("rest", pa.list_(long)), ("prints", binary), ("offsets", binary), ("lengths", binary)]
    )


def write_shards(
    docs: DataFrame,
    path: str,
    encoder: Callable[[], Encoder],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    shard_ids: int = SHARD_IDS,
) -> None:
    """Encode the texts and write them to ``path`` in ascending order of their id.

    Each text's ids are followed by ``end_id``; a null or empty text has that
    only. Ids need two bytes where the vocabulary allows. Rows with equal ids
    follow each other in the order of their texts' hashes and are told apart by
    their turn. Rows with a null id come first; they are read back like others, but
    no key asks for them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("t"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("t"))
    schema = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(), TaskContext.get().partitionId()
        width = 2 if max(coder.vocab_size - 1, end_id) < 1 << 16 else 4
        shard, start, held, size = 0, 0, [], 0
        last, turn = (None, None), 0
        for batch in (s for b in batches_of(batches) for s in text_slices(b, "t", _SLICE_BYTES)):
            nameless = batch["key"].is_null().to_numpy(zero_copy_only=False)
            keys = batch["key"].fill_null(0).to_numpy()
            fresh = (keys[1:] != keys[:-1]) | (nameless[1:] != nameless[:-1])
            fresh = np.concatenate([[(keys[0], nameless[0]) != last], fresh])
            place = np.arange(len(keys))
            since = np.maximum.accumulate(np.where(fresh, place, 0))
            turns = place - since
            if not fresh[0]:
                turns[since == 0] += turn + 1
            last, turn = (keys[-1], nameless[-1]), int(turns[-1])
            # turns below zero are those of rows without a key
            turns = np.where(nameless, -1 - turns, turns)
            ids, sizes = coder.encode(batch["t"])
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            # cut where a shard is full, between documents
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(keys):
                room = ends[lo] - sizes[lo] + shard_ids - size
                hi = max(lo + 1, int(np.searchsorted(ends, room, "right")))
                a, b = ends[lo] - sizes[lo], ends[hi - 1]
                held.append((keys[lo:hi], turns[lo:hi].astype(np.int32), ids[a:b], sizes[lo:hi]))
                size += int(b - a)
                if size >= shard_ids or hi < len(keys):
                    row = _pack(part, shard, start, held, width)
                    yield pa.RecordBatch.from_pylist([row], schema)
                    shard, start, held, size = shard + 1, start + size, [], 0
                lo = hi
        if held:
            yield pa.RecordBatch.from_pylist([_pack(part, shard, start, held, width)], schema)

    rows.mapInArrow(run, _SHARD).write.mode("overwrite").parquet(path)


def _part_starts(shards: DataFrame) -> DataFrame:
    """Ids in all parts before each part; there are as many rows as tasks wrote."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    starts = accumulate((r.n for r in totals), initial=0)
    rows = [(r.part, s) for r, s in zip(totals, starts, strict=False)]
    return shards.sparkSession.createDataFrame(rows, "part int, part_start long")


@dataclass
class _Open:
    """A shard's index, ready for lookups."""

    index: PerfectHash
    prints: np.ndarray
    offsets: np.ndarray
    lengths: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, row: dict) -> _Open:
        rest = np.array(row["rest"], np.int64).view(np.uint64)
        return cls(
            PerfectHash(_unpack_levels(row["levels"]), rest),
            np.frombuffer(row["prints"], "<u4"),
            np.frombuffer(row["offsets"], "<u8").astype(np.int64),
            np.frombuffer(row["lengths"], "<u8").astype(np.int64),
            np.frombuffer(row["payload"], f"<u{row['width']}"),
        )

    def places(self, keys: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each key, -1 for one that isn't here."""
        hashes = key_hash(keys, turns)
        slots = self.index.slots(hashes)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == _fingerprint(hashes)[known]
        offset, length = np.full(len(keys), -1), np.full(len(keys), -1)
        offset[known], length[known] = self.offsets[slots[known]], self.lengths[slots[known]]
        return offset, length


_READ = "key long, turn int, start long, n_ids long, ids_crc32 long"


def read_documents(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """Every stored document, its place found through the index.

    ``key, turn, start, n_ids, ids_crc32`` and, on request, ``ids``. ``start`` counts
    the ids of all documents before, over all shards.
    """
    shards = spark.read.schema(_SHARD).parquet(path)
    starts = _part_starts(shards)
    placed = shards.join(F.broadcast(starts), "part")
    schema = _READ + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for row in batch.to_pylist():
                shard = _Open.of(row)
                keys, turns = np.array(row["keys"], np.int64), np.array(row["turns"], np.int32)
                offset, length = shard.places(keys, turns)
                parts = [shard.ids[o : o + n] for o, n in zip(offset, length, strict=True)]
                crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
                start = row["part_start"] + row["start_in_part"] + offset
                shown = pa.array(keys, mask=turns < 0)
                turns = np.where(turns < 0, -1 - turns, turns).astype(np.int32)
                columns = [turns, start, length, np.array(crc, np.int64)]
                arrays = [shown, *(pa.array(c) for c in columns)]
                if with_ids:
                    arrays.append(pa.array([p.astype(np.int32) for p in parts]))
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return placed.mapInArrow(run, schema)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """``key, turn, ids`` of the first document of each asked key that is stored.

    Keys find their part by the parts' bounds, of which there are as many as
    tasks wrote, their shard by its own bounds, and their place by the index; a
    key that was never stored gives no row. Each asked key gives one row for each
    time it is asked.
    """
    shards = spark.read.schema(_SHARD).parquet(path)
    bounds = shards.groupBy("part").agg(F.min("first_key").alias("low"))
    bounds = bounds.where("low IS NOT NULL").orderBy("low").collect()
    lows = np.array([r.low for r in bounds], np.int64)
    parts = np.array([-1, *(r.part for r in bounds)], np.int32)

    @F.arrow_udf("int")
    def part_of(key: pa.Array) -> pa.Array:
        return pa.array(parts[np.searchsorted(lows, key.to_numpy(), "right")])

    asked = keys.select(F.col(key_col).cast("long").alias("key")).where("key IS NOT NULL")
    asked = asked.withColumn("part", part_of("key"))
    ranges = shards.select("part", "shard", "first_key", "last_key")
    met = asked.join(ranges, "part").where("key BETWEEN first_key AND last_key")
    wanted = met.groupBy("part", "shard", "key").agg(F.count("*").alias("times"))
    near = wanted.join(shards, ["part", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches_of(batches):
            for row in batch.to_pylist():
                if at != (row["part"], row["shard"]):
                    at, shard = (row["part"], row["shard"]), _Open.of(row)
                key = np.array([row["key"]], np.int64)
                offset, length = shard.places(key, np.zeros(1, np.int32))
                if offset[0] >= 0:
                    ids = shard.ids[offset[0] : offset[0] + length[0]].astype(np.int32)
                    n = row["times"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["key"]] * n), pa.array([0] * n, pa.int32()), pa.array([ids] * n)],
                        names=["key", "turn", "ids"],
                    )

    return near.mapInArrow(run, "key long, turn int, ids array<int>")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token_shards")
    write_shards(read(spark, sf_dir, "documents"), path, public_encoder("word_bpe_49k.json"))
    stored = read_documents(spark, path)
    return stored.select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32"
    )
