"""The widest pair of unit vectors by branch and bound over balls of directions.

Vectors are dealt to the nearest of some centres, and each such ball has a radius, the
largest angle to its centre. No pair from two balls is wider than the angle between their
centres and both radii. Pairs of balls are visited by that bound, widest first, some more
in every round, until none that is left could hold a pair wider than the widest found.
Nothing wider is missed; on vectors without structure the bounds help little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.operators.neighbors import matrix, unit_rows
from nearkin.sources.storage import durable

MAX_BALLS = 1_024
#: Balls for each block of vectors, so that bounds are finer than blocks.
BALLS_PER_BLOCK = 8
#: Cells of the first round for each core, and how many times more in each next one.
FIRST_CELLS, GROWTH = 2, 4
MAX_ROUND_CELLS = 200_000
ANGLE_SLACK = 1e-6
_CELLS = 4_000_000


@dataclass
class Work:
    """The smallest cosine, and how many of all cells were looked at for it."""

    lowest: float
    visited: int = 0
    cells: int = 0
    rounds: int = 0


def lowest_product(x: np.ndarray, y: np.ndarray) -> float:
    step = max(1, _CELLS // max(1, len(y)))
    return min(float((x[i : i + step] @ y.T).min()) for i in range(0, len(x), step))


def _dealt(units: DataFrame, centres: np.ndarray) -> DataFrame:
    """``ball, angle, u``: each vector with its ball and its angle to the centre."""
    shared = units.sparkSession.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch["u"], c.shape[1])
                near = x @ c.T
                ball = near.argmax(axis=1)
                # the angle to a zero vector bounds nothing, so such a ball is as wide as can be
                angle = np.arccos(np.clip(near[np.arange(len(x)), ball], -1, 1))
                angle = np.where(x.any(axis=1) & c[ball].any(axis=1), angle, np.pi)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ball.astype(np.int32)), pa.array(angle), batch["u"]],
                    names=["ball", "angle", "u"],
                )

    return units.select("u").mapInArrow(deal, "ball int, angle double, u array<double>")


def _pairs(radius: np.ndarray, parts: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, ...]:
    """All pairs of balls ``(left, right, bound, cells)``, widest bound first."""
    apart = np.arccos(np.clip(centres @ centres.T, -1, 1))
    wide = np.minimum(np.pi, apart + radius[:, None] + radius[None, :])
    left, right = np.triu_indices(len(radius))
    cells = np.where(left == right, parts[left] * (parts[left] + 1) // 2, parts[left] * parts[right])
    bound = wide[left, right]
    order = np.argsort(-bound, kind="stable")
    return left[order], right[order], bound[order], cells[order]


def _sides(left: np.ndarray, right: np.ndarray, first: np.ndarray, parts: np.ndarray) -> pa.Table:
    """Which blocks meet in the cells of some pairs of balls, one row for each side."""
    i, j = [], []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        if a == b:
            x, y = np.triu_indices(parts[a])
        else:
            x, y = (g.ravel() for g in np.indices((parts[a], parts[b])))
        i.append(first[a] + x)
        j.append(first[b] + y)
    i, j = np.concatenate(i), np.concatenate(j)
    two = i != j
    return pa.table({
        "block": np.concatenate([i, j[two]]).astype(np.int32),
        "i": np.concatenate([i, i[two]]).astype(np.int32),
        "j": np.concatenate([j, j[two]]).astype(np.int32),
        "right": np.concatenate([np.zeros(len(i), bool), np.ones(int(two.sum()), bool)]),
    })


def lowest_by_balls(units: DataFrame, dim: int, lowest: float, block_bytes: int) -> Work:
    """The smallest cosine of any two rows of ``units`` (column ``u``, written), or ``lowest``.

    ``units`` are of unit length or zero. The driver sees pairs of balls, whose number is
    bounded, and the blocks of those pairs that a round looks at.
    """
    spark = units.sparkSession
    rows = units.count()
    work = Work(lowest)
    if not rows:
        return work
    per_block = max(1, block_bytes // (8 * dim))
    wanted = min(MAX_BALLS, max(1, BALLS_PER_BLOCK * ceil(rows / per_block)))
    sample = units.orderBy(F.xxhash64("u")).limit(wanted).toArrow()
    centres = unit_rows(matrix(sample["u"], dim))
    dealt = durable(_dealt(units, centres), "balls")
    # one row for each ball
    told = dealt.groupBy("ball").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    told = told.orderBy("ball").toArrow()
    ball, n, radius = (told[c].to_numpy() for c in ("ball", "n", "radius"))
    parts = -(-n // per_block)
    first = np.cumsum(parts) - parts
    left, right, bound, cells = _pairs(radius, parts, centres[ball])
    work.cells = int(cells.sum())
    starts = pa.table({"ball": ball, "first": first, "parts": parts})
    starts = spark.createDataFrame(starts, "ball int, first long, parts long")
    part = F.pmod(F.xxhash64("u"), F.col("parts"))
    blocks = dealt.join(F.broadcast(starts), "ball").select(
        (F.col("first") + part).cast("int").alias("block"), "u"
    )
    blocks = durable(blocks, "blocks")

    def lowest_of(key: tuple, cell: pa.Table) -> pa.Table:
        x, side = matrix(cell["u"], dim), cell["right"].to_numpy()
        same = key[0].as_py() == key[1].as_py()
        one, other = (x, x) if same else (x[~side], x[side])
        found = [lowest_product(one, other)] if len(one) and len(other) else []
        return pa.table({"low": pa.array(found, pa.float64())})

    size = FIRST_CELLS * spark.sparkContext.defaultParallelism
    lo, through = 0, np.cumsum(cells)
    while lo < len(left):
        widest = np.arccos(np.clip(work.lowest, -1, 1))
        still_open = int(np.searchsorted(-bound, -(widest - ANGLE_SLACK), "right"))
        hi = min(still_open, max(lo + 1, int(np.searchsorted(through, work.visited + size, "right"))))
        if hi <= lo:
            break
        sides = _sides(left[lo:hi], right[lo:hi], first, parts)
        sides = spark.createDataFrame(sides, "block int, i int, j int, right boolean")
        met = blocks.join(F.broadcast(sides), "block").select("i", "j", "right", "u")
        low = met.groupBy("i", "j").applyInArrow(lowest_of, "low double").agg(F.min("low")).first()[0]
        if low is not None:
            work.lowest = min(work.lowest, low)
        lo, work.visited, work.rounds = hi, int(through[hi - 1]), work.rounds + 1
        size = min(MAX_ROUND_CELLS, GROWTH * size)
    return work
