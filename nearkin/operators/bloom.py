"""Telling two large sets of keys apart within a table, without moving its rows.

A Bloom filter is built by an aggregate in the JVM: every key sets a few bits, and words
of 64 bits are combined in the tasks before they meet, so what is merged never exceeds
the filter. It is sent out once as a bitmap of bounded size, and asking it takes one
number a row, so wide columns stay where they are.

Where both sets are known, a cascade of filters is exact: the keys that a filter lets
through by mistake are found on the keys alone and make up the next one, until those left
are few enough to be sent as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.sources.storage import durable

BITS_PER_KEY = 10
#: A bitmap has 2^16 bits (8 KB) at least and 2^29 bits (64 MB) at most. With more keys
#: than that many bits serve, more others pass; no key is ever lost.
LEAST_LOG2, MOST_LOG2 = 16, 29
#: A filter has to keep out this share of the other keys, or there is no use in one more.
LEAST_KEPT_OUT = 0.1
_MOST_HASHES = 7
_WORD = 6
_HALF = 31


def _shape(keys: int) -> tuple[int, int]:
    """Power of two of the number of bits, and bits that a key sets."""
    wanted = ceil(log2(max(1, keys) * BITS_PER_KEY))
    bits = min(MOST_LOG2, max(LEAST_LOG2, wanted))
    hashes = round((1 << bits) / max(1, keys) * log(2))
    return bits, min(_MOST_HASHES, max(1, hashes))


def _code(on: Sequence[str], bits: int, seed: int) -> Column:
    """Where a key's bits start and how far apart they are, in one number."""
    size = F.lit(1 << bits)
    start = F.pmod(F.xxhash64(F.lit(2 * seed), *on), size)
    step = F.pmod(F.xxhash64(F.lit(2 * seed + 1), *on), size).bitwiseOR(F.lit(1))
    return F.shiftleft(start, _HALF).bitwiseOR(step)


class KeyFilter:
    """A Bloom filter that tasks can ask."""

    def __init__(self, keys: DataFrame, on: Sequence[str], count: int, seed: int = 0):
        """``count`` is how many keys there are, which only sets the size."""
        self.on, self.seed = list(on), seed
        self.bits, self.hashes = _shape(count)
        mask = F.lit((1 << self.bits) - 1)
        start = F.shiftright("code", _HALF)
        step = F.col("code").bitwiseAND(F.lit((1 << _HALF) - 1))
        turns = F.sequence(F.lit(0).cast("long"), F.lit(self.hashes - 1).cast("long"))
        places = F.transform(turns, lambda i: (start + i * step).bitwiseAND(mask))
        set_bits = keys.select(_code(self.on, self.bits, self.seed).alias("code")).select(
            F.explode(places).alias("place")
        )
        one = F.expr(f"shiftleft(1L, CAST(place & {(1 << _WORD) - 1} AS int))")
        words = set_bits.groupBy(F.shiftright("place", _WORD).alias("word")).agg(
            F.bit_or(one).alias("bits")
        )
        # at most one row for each word of the bitmap
        rows = words.toArrow()
        bitmap = np.zeros(1 << (self.bits - _WORD), np.int64)
        bitmap[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        self.bitmap: Broadcast = keys.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def may_hold(self) -> Column:
        """Whether a row's key may be one of the keys; false is certain."""
        bitmap, bits, hashes = self.bitmap, self.bits, self.hashes

        @F.arrow_udf("boolean")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            words, mask = bitmap.value, (1 << bits) - 1
            for batch in batches:
                code = batch.to_numpy(zero_copy_only=False)
                place, step = code >> _HALF, code & ((1 << _HALF) - 1)
                found = np.ones(len(code), bool)
                for _ in range(hashes):
                    bit = (place & 63).astype(np.uint64)
                    found &= (words[place >> _WORD] >> bit) & np.uint64(1) == 1
                    place = (place + step) & mask
                yield pa.array(found)

        return run(_code(self.on, bits, self.seed))


def select_by_cascade(
    rows: DataFrame, keys: DataFrame, others: DataFrame, on: Sequence[str], most: int
) -> DataFrame:
    """The rows with one of ``keys``, where ``others`` are the keys of all other rows.

    Both are distinct, without nulls in ``on``, and may be large; the rows are read once
    and stay where they are. ``most`` is the number of keys that may be sent as they are.
    Where so many keys meet that filters of bounded size can't tell them apart, the rows
    are joined, and move.
    """
    sides = [keys.select(*on), others.select(*on)]
    counts = [s.count() for s in sides]
    # a filter of the smaller side comes first
    turn = int(counts[1] < counts[0])
    hold, ask = sides[turn], sides[1 - turn]
    n_hold, n_ask = counts[turn], counts[1 - turn]
    filters: list[KeyFilter] = []
    while n_hold > most:
        filters.append(KeyFilter(hold, on, n_hold, len(filters)))
        through = durable(ask.where(filters[-1].may_hold()), "let-through")
        n_through = through.count()
        if n_through > most and n_through > (1 - LEAST_KEPT_OUT) * n_ask:
            return rows.join(keys.select(*on), list(on), "left_semi")
        ask, n_ask, hold, n_hold = hold, n_hold, through, n_through
    # what passes all filters is told by the last few keys
    held_last = (len(filters) + turn) % 2 == 0
    told = hold.withColumn("_last", F.lit(True))
    marked = rows.join(F.broadcast(told), list(on), "left") if n_hold else rows
    in_last = F.col("_last").isNotNull() if n_hold else F.lit(False)
    wanted = in_last if held_last else ~in_last
    for i in range(len(filters) - 1, -1, -1):
        # who doesn't pass is on the other side than the keys that the filter holds
        other = F.lit((i + turn) % 2 == 1)
        wanted = F.when(filters[i].may_hold(), wanted).otherwise(other)
    return marked.where(wanted).select(*rows.columns)
