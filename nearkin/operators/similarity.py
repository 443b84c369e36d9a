"""How similar each document is to all others, and similarity over all pairs.

No pair matrix is built. With ``u`` the unit vectors and ``S`` their sum, the
average of a document to the others is ``(u.S - u.u) / (N - 1)``, the mean over
the full matrix is ``S.S / N^2``, and its maximum is one as soon as any vector is
not zero, since the diagonal is part of it. Only the minimum has no closed form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.functions import vectors as V
from nearkin.operators.balls import lowest_by_balls, lowest_product
from nearkin.operators.neighbors import matrix, unit_rows
from nearkin.sources.storage import bounded_rows, durable

_START_PIVOTS = 16
_ROUNDS = 3
_ANGLE_SLACK = 1e-6
_LIST = pa.list_(pa.float64())
MAX_BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 64 << 20
# Averages that differ by less are equal but for rounding errors.
DIGITS = 12


def sum_vector(documents: DataFrame, vector_col: str = "v") -> DataFrame:
    """One row ``(total, n, longest)``: sum of unit vectors, number, largest norm.

    Every task adds up its own vectors and hands on a single row, so what is
    shuffled does not depend on the number of documents.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, longest = None, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch[0], None if total is None else len(total))
            part = unit_rows(x).sum(axis=0)
            total = part if total is None else total + part
            n += len(x)
            longest = max(longest, float(np.sqrt((x * x).sum(axis=1)).max()))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([total], _LIST), pa.array([n]), pa.array([longest])],
                names=["total", "n", "longest"],
            )

    schema = "total array<double>, n long, longest double"
    parts = documents.select(vector_col).mapInArrow(add_up, schema)
    per_position = (
        parts.select(F.posexplode_outer("total").alias("pos", "x"), "n", "longest")
        .groupBy("pos")
        .agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.max("longest").alias("longest"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return per_position.agg(
        F.transform(ordered, lambda s: s["x"]).alias("total"),
        F.max("n").alias("n"),
        F.max("longest").alias("longest"),
    )


def average_similarity(
    documents: DataFrame, vector_col: str = "v", *, sums: DataFrame | None = None
) -> DataFrame:
    """Add ``avg_sim``: mean cosine to every other document, NULL if alone.

    Two reads of the vectors and no shuffle of documents. The first gives one
    vector, which the second takes along; with ``sums`` as from ``sum_vector``,
    which ``documents`` are part of, there is no first.
    """
    sums = (sum_vector(documents, vector_col) if sums is None else sums).first()
    total, n = np.asarray(sums.total, float), sums.n or 0

    @F.arrow_udf("double")
    def average(vectors: pa.Array) -> pa.Array:
        if n < 2 or not len(vectors):
            return pa.nulls(len(vectors), pa.float64())
        u = unit_rows(matrix(vectors, len(total)))
        # row by row, so that equal vectors have equal averages wherever they lie
        return pa.array(((u * total).sum(axis=1) - (u * u).sum(axis=1)) / (n - 1))

    return documents.withColumn("avg_sim", average(F.col(vector_col)))


def rank_universal(scored: DataFrame) -> DataFrame:
    """Most universal first; ties by filename, then text, all descending."""
    similar = F.desc(F.round("avg_sim", DIGITS))
    return scored.orderBy(similar, F.desc("filename"), F.desc("text"))


def top_universal(scored: DataFrame, n: int, id_col: str = "row_id") -> DataFrame:
    """The n documents closest to everything; ties go to the higher id."""
    return scored.orderBy(F.desc(F.round("avg_sim", DIGITS)), F.desc(id_col)).limit(n)


def similarity_stats(
    documents: DataFrame,
    vector_col: str = "v",
    *,
    minimum: bool = True,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Mean, minimum and maximum cosine over the full matrix, diagonal included.

    Mean and maximum take one read of the vectors. The exact minimum is the costly
    part and can be left out, which leaves it NULL.
    """
    low = None
    if minimum:
        v = V.as_double(F.col(vector_col))
        units = documents.select(V.normalize(v).alias("u"))
        low = min_cosine(
            units, max_broadcast_bytes=max_broadcast_bytes, block_bytes=block_bytes
        )
    return stats_of_sums(sum_vector(documents, vector_col), low)


def stats_of_sums(sums: DataFrame, low: float | None) -> DataFrame:
    total, n = F.col("total"), F.col("n").cast("double")
    return sums.select(
        (V.dot(total, total) / n / n).alias("mean_sim"),
        F.lit(low).cast("double").alias("min_sim"),
        F.when(F.col("longest") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("max_sim"),
    )


def min_cosine(
    units: DataFrame,
    u: str = "u",
    *,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
) -> float | None:
    """The smallest cosine between any two vectors, exactly.

    A few passes look for a wide pair: the vectors farthest from some pivots
    become the next pivots. Each pivot p also gives its largest angle ``R(p)``,
    and by the triangle inequality no pair of ``x`` is wider than
    ``angle(x, p) + R(p)``. Vectors for which some pivot keeps that below the
    widest pair found cannot take part and are dropped. The rest, if they are many,
    are dealt to balls, and pairs of balls are visited by how wide a pair they may
    hold (``balls``). On vectors without structure little is dropped and the last
    step stays quadratic, as exactness demands.
    """
    units = units.select(F.col(u).alias("u")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _min_cosine(units, max_broadcast_bytes, block_bytes)
    finally:
        units.unpersist()


def _min_cosine(units: DataFrame, max_broadcast_bytes: int, block_bytes: int) -> float | None:
    u = "u"
    start = units.limit(_START_PIVOTS).toArrow()
    if not start.num_rows:
        return None
    pivots = unit_rows(matrix(start["u"]))
    everything, reach, lowest = [], [], 1.0
    if not pivots.any(axis=1).all():
        lowest = 0.0  # a zero vector has cosine 0 to all
    for _ in range(_ROUNDS):
        far = _farthest(units, u, pivots)
        everything.append(pivots)
        reach.append(far["low"].to_numpy())
        before, lowest = lowest, min(lowest, float(reach[-1].min()))
        if lowest == before and len(reach) > 1:
            break
        pivots = matrix(far["u"])
    pivots, reach = np.concatenate(everything), np.concatenate(reach)
    rest = _contenders(units, u, pivots, reach, lowest).distinct()
    rest = durable(rest, "contenders")
    bound = max(1, max_broadcast_bytes // (8 * pivots.shape[1]))
    small = bounded_rows(rest, bound)
    if small is None:
        return lowest_by_balls(rest, pivots.shape[1], lowest, block_bytes).lowest
    spread = rest.repartition(rest.sparkSession.sparkContext.defaultParallelism)
    found = _min_against(spread, matrix(small["u"], pivots.shape[1]))
    rest_low = found.agg(F.min("low")).first()[0]
    return lowest if rest_low is None else min(lowest, rest_low)


def _farthest(units: DataFrame, u: str, pivots: np.ndarray) -> pa.Table:
    """Per pivot the smallest cosine to it and the vector that has it."""
    shared = units.sparkSession.sparkContext.broadcast(pivots)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        low, who = np.full(len(p), np.inf), np.zeros_like(p)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch[0], p.shape[1])
            near = x @ p.T
            at = near.argmin(axis=0)
            best = near[at, np.arange(len(p))]
            better = best < low
            low[better], who[better] = best[better], x[at[better]]
        seen = np.flatnonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(low[seen]), pa.array(list(who[seen]), _LIST)],
            names=["pivot", "low", "u"],
        )

    partial = units.select(u).mapInArrow(scan, "pivot long, low double, u array<double>")
    best = F.min_by(F.struct("low", "u"), "low").alias("b")
    return partial.groupBy("pivot").agg(best).orderBy("pivot").select("b.*").toArrow()


def _contenders(units, u, pivots, reach, lowest) -> DataFrame:
    """Vectors that might still belong to a pair wider than the widest known."""
    spark = units.sparkSession
    widest = np.arccos(np.clip(lowest, -1, 1))
    radius = np.arccos(np.clip(reach, -1, 1))
    # angles to a zero vector mean nothing, so such pivots must not prune
    usable = pivots.any(axis=1)
    shared = spark.sparkContext.broadcast((pivots[usable], radius[usable]))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, r = shared.value
        for batch in batches:
            x = matrix(batch[0], p.shape[1]) if batch.num_rows else None
            if x is None or not len(p):
                yield batch
                continue
            angle = np.arccos(np.clip(x @ p.T, -1, 1))
            wide = (angle + r).min(axis=1) >= widest - _ANGLE_SLACK
            yield batch.filter(pa.array(wide))

    return units.select(F.col(u).alias("u")).mapInArrow(keep, "u array<double>")


def _min_against(rest: DataFrame, others: np.ndarray) -> DataFrame:
    shared = rest.sparkSession.sparkContext.broadcast(others)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = shared.value
        for batch in batches:
            if batch.num_rows and len(y):
                low = lowest_product(matrix(batch[0], y.shape[1]), y)
                yield pa.RecordBatch.from_arrays([pa.array([low])], names=["low"])

    return rest.mapInArrow(lowest, "low double")
