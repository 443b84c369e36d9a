"""Approximate nearest neighbours by an inverted multi-index.

A vector is cut into two halves and each is quantised by centroids of its own, so few
centroids make many cells: one for each pair. A query's inner product with a cell is
the sum of two numbers, one for each half, and its pairs are visited in the order of
that sum with a heap. The vectors of the first cells are reranked by exact products;
the k-th best of them is a bound, and the visit goes on over all cells that may hold
better ones: a cell's vectors scatter around its product by what quantisation leaves
over, and cells are visited until those left out are expected to hold ``MISSED`` of
all the hits. So queries in dense regions see few cells and others more.

Centroids are fitted on a bounded sample; every vector is indexed. At most
``MAX_CENTROIDS`` squared cells are told to all tasks. Cells next to each other make up
blocks of bounded size, larger cells several. Queries are sent to the blocks they
visit and stream past them, so neither side of a block has to fit as a whole. Of equal
vectors only the k + 1 with the smallest ids can be hits; the others are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearkin.llm.common import batches_of, read
from nearkin.llm.pivots import usable
from nearkin.operators.neighbors import matrix
from nearkin.sources.storage import durable, settled

#: Centroids of a half: half the root of the number of vectors, with this limit.
MAX_CENTROIDS = 512
#: Vectors that centroids are fitted on, for each centroid.
SAMPLE_PER_CENTROID = 64
#: Vectors that a query's first cells have, for each neighbour wanted.
FIRST = 40
#: Share of the expected hits that cells left out may hold.
MISSED = 0.02
MAX_BLOCK_ROWS = 8_192
_LEAST_BLOCK_ROWS = 256
_MOST_SALT_QUERIES = 1 << 20
_ROUNDS = 8
_STEP = 256
_SHARES = 8
_BINS = 1_024

_MESSAGE = "block int, salt int, query boolean, id long, v array<double>, cell int, bound double, spread double, first double"
_HITS = "query_id long, vec_id long, score double"


class Cells:
    """Centroids of both halves and the cells that have vectors."""

    def __init__(self, left: np.ndarray, right: np.ndarray, *filled: np.ndarray):
        self.left, self.right, self.cut = left, right, left.shape[1]
        if filled:
            self.cell, self.n, self.rest, self.block, self.parts = filled

    def arrays(self) -> tuple[np.ndarray, ...]:
        """What a task needs to make the same cells."""
        return self.left, self.right, self.cell, self.n, self.rest, self.block, self.parts

    def name(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and what quantisation leaves over in both halves."""
        i, r1 = _nearest(x[:, : self.cut], self.left)
        j, r2 = _nearest(x[:, self.cut :], self.right)
        return i * len(self.right) + j, np.stack([r1, r2], axis=1)

    def fill(self, cell: np.ndarray, n: np.ndarray, rest: np.ndarray, block_rows: int) -> None:
        """Tells the cells, by number, their sizes and largest leftovers; deals blocks."""
        self.cell, self.n, self.rest = cell, n, rest
        self.parts = np.maximum(1, -(-n // block_rows))
        # a large cell has blocks of its own, others share theirs in order
        large = self.parts > 1
        block, held = np.empty(len(n), np.int64), 0
        now = 0
        for c, (size, parts) in enumerate(zip(n.tolist(), self.parts.tolist(), strict=True)):
            if held and (large[c] or held + size > block_rows):
                now, held = now + 1, 0
            block[c] = now
            if large[c]:
                now += parts
            else:
                held += size
        self.block = block

    def products(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of queries with the centroids of the left and the right half."""
        return q[:, : self.cut] @ self.left.T, q[:, self.cut :] @ self.right.T

    def means(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The products of a query with all filled cells."""
        i, j = np.divmod(self.cell, len(self.right))
        return a[i] + b[j]

    def scatter(self, q: np.ndarray) -> np.ndarray:
        """How far the products of a cell's vectors stray from the cell's own."""
        halves = [q[: self.cut], q[self.cut :]]
        weights = [(h * h).sum() / max(1, len(h)) for h in halves]
        return np.sqrt(weights[0] * self.rest[:, 0] + weights[1] * self.rest[:, 1])


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    far = (centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)
    c = np.argmin(far, axis=1)
    return c, ((x - centroids[c]) ** 2).sum(axis=1)


def fit_centroids(x: np.ndarray, n: int, rounds: int = _ROUNDS) -> np.ndarray:
    """Up to n centroids of the rows, by Lloyd's rounds from different rows."""
    x_different = np.unique(x, axis=0)
    start = np.random.default_rng(len(x)).permutation(len(x_different))[:n]
    centroids = x_different[start]
    for _ in range(rounds):
        c, _ = _nearest(x, centroids)
        size = np.bincount(c, minlength=len(centroids))
        total = np.zeros_like(centroids)
        np.add.at(total, c, x)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


def by_sum(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs (i, j) by a[i] + b[j], greatest first, one after the other."""
    left, right = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b = a[left].tolist(), b[right].tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(left[i]), int(right[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


def _tail(x: np.ndarray) -> np.ndarray:
    """The share of a normal distribution beyond x, within about one percent."""
    t = np.abs(x)
    beyond = np.exp(-t * t / 2) / (1.64 * t + np.sqrt(0.76 * t * t + 4))
    return np.where(x > 0, beyond, 1 - beyond)


def spread_of(n: np.ndarray, away: np.ndarray, missed: float) -> float:
    """How many deviations below the bound a cell may lie so that few hits are missed.

    ``n`` are sizes of cells, ``away`` how many of their deviations they lie below.
    """
    hits = n * _tail(away)
    at = np.clip((away + 16) * (_BINS / 32), 0, _BINS - 1).astype(np.int64)
    found = np.cumsum(np.bincount(at, weights=hits, minlength=_BINS))
    if not found[-1] > 0:
        return float("inf")
    enough = int(np.searchsorted(found, (1 - missed) * found[-1]))
    return (enough + 1) * (32 / _BINS) - 16


def _visits(m: np.ndarray, scatter: np.ndarray, bound: float, spread: float, first: float) -> np.ndarray:
    """The cells that a query visits; what isn't a number is visited."""
    return ~(bound - m > spread * scatter) | (m >= first)


def _different(vectors: DataFrame, k: int) -> DataFrame:
    """``(id, v)`` without those equal to more than k vectors of smaller ids."""
    named = vectors.select(
        "id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), F.col("v")).alias("k2")
    )
    common = named.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    common, few = settled(durable(common.select("k1", "k2"), "common_vectors"), 200_000)
    sent: DataFrame = F.broadcast(common) if few else common
    copies = named.select("id", "k1", "k2").join(sent, ["k1", "k2"])
    copies = copies.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["k1", "k2", "part"], ["k1", "k2"]):
        place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("id"))
        copies = copies.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    last = copies.groupBy("k1", "k2").agg(F.max("id").alias("last"))
    last, few = settled(durable(last, "common_vectors"), 200_000)
    kept = named.join(F.broadcast(last) if few else last, ["k1", "k2"], "left")
    return kept.where("last IS NULL OR id <= last").select("id", "v")


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    k: int,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    missed: float = MISSED,
    block_rows: int | None = None,
    max_centroids: int = MAX_CENTROIDS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for rows with ``queries`` the k nearest others.

    ``score`` is the inner product in double precision, greatest first, ties to the
    smaller id. Rows whose vector is null, empty, zero or holds null, NaN or infinite
    components take no part, nor do rows without an id; a query meets vectors of its
    own length only and has fewer than k rows where there are no more. A row given
    twice counts once; an id with several vectors is near by the best of them. The
    neighbours are found by cells, so recall is measured, not certain; if there are at
    most 40 k vectors all are looked at.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    )
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = durable(rows.withColumn("dim", F.size("v")), "usable_vectors")
    hits = rows.sparkSession.createDataFrame([], _HITS)
    # one index for each length of vectors, of which a table has very few
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"))
    for row in sizes.orderBy("dim").collect():
        if row.asked:
            same = rows.where(F.col("dim") == row.dim)
            per_block = block_rows or min(MAX_BLOCK_ROWS, max(_LEAST_BLOCK_ROWS, row.n // 64))
            index = _index(_different(same, k), row.n, row.dim, per_block, max_centroids)
            asking = same.where("asks").select("id", "v")
            hits = hits.union(_search(index, asking, row.n, row.asked, k, missed))
    return _best(hits, k).select("query_id", "rank", "vec_id", "score")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query with their rank, a vector found twice once."""
    # k of each share first, as queries in dense regions have many
    shared = hits.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(_SHARES)))
    shared = shared.repartition("query_id", "share")
    best = shared.groupBy("query_id", "share", "vec_id").agg(F.max("score").alias("score"))
    for keys in (["query_id", "share"], ["query_id"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.drop("share")


def _index(
    vectors: DataFrame, n: int, dim: int, block_rows: int, max_centroids: int
) -> tuple[DataFrame, Broadcast]:
    """The vectors with their cells, and the cells for all tasks to know."""
    spark = vectors.sparkSession
    wanted = min(max_centroids, max(1, ceil(sqrt(n) / 2)))
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_PER_CENTROID * wanted)
    x = matrix(sample.select("v").toArrow()["v"], dim)
    cut = (dim + 1) // 2
    halves = fit_centroids(x[:, :cut], wanted), fit_centroids(x[:, cut:], wanted)
    sent = spark.sparkContext.broadcast(halves)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(*sent.value)
        for batch in batches_of(batches):
            cell, rest = cells.name(matrix(batch["v"]))
            numbers = [pa.array(cell.astype(np.int32)), pa.array(rest[:, 0]), pa.array(rest[:, 1])]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["v"], *numbers], names=["id", "v", "cell", "r1", "r2"]
            )

    schema = "id long, v array<double>, cell int, r1 double, r2 double"
    listed = durable(vectors.mapInArrow(describe, schema), "cells")
    # a row for each cell, of which there are at most max_centroids squared
    about = listed.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")
    )
    table = about.orderBy("cell").toArrow()
    rest = np.stack([table["r1"].to_numpy(), table["r2"].to_numpy()], axis=1)
    cells = Cells(*halves)
    cells.fill(table["cell"].to_numpy().astype(np.int64), table["n"].to_numpy(), rest, block_rows)
    return listed.select("id", "v", "cell"), spark.sparkContext.broadcast(cells.arrays())


def _search(
    index: tuple[DataFrame, Broadcast], asking: DataFrame, n: int, asked: int, k: int, missed: float
) -> DataFrame:
    listed, sent = index
    salts = ceil(asked / _MOST_SALT_QUERIES)
    none = F.lit(None).cast("double")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(*sent.value)
        for batch in batches_of(batches):
            at = np.searchsorted(cells.cell, batch["cell"].to_numpy())
            part = batch["part"].to_numpy() % cells.parts[at]
            block = pa.array((cells.block[at] + part).astype(np.int32))
            place = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [block, batch["id"], batch["v"], place], names=["block", "id", "v", "cell"]
            )

    part = F.pmod(F.xxhash64("id"), F.lit(1 << 20)).alias("part")
    dealt = listed.select("*", part).mapInArrow(deal, "block int, id long, v array<double>, cell int")
    each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    stored = dealt.select(
        "block", each.alias("salt"), F.lit(False).alias("query"), "id", "v", "cell",
        none.alias("bound"), none.alias("spread"), none.alias("first"),
    )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(*sent.value)
        size = dict(zip(cells.cell.tolist(), cells.n.tolist(), strict=True))
        width = len(cells.right)
        for batch in batches_of(batches):
            q = matrix(batch["v"])
            a, b = cells.products(q)
            bounds = batch["bound"].to_pylist() if "bound" in batch.schema.names else None
            firsts = batch["first"].to_pylist() if bounds else None
            for lo in range(0, len(q), _STEP):
                rows, blocks, told = [], [], []
                for r in range(lo, min(lo + _STEP, len(q))):
                    m, scatter = cells.means(a[r], b[r]), cells.scatter(q[r])
                    if bounds is None:
                        seen, first = 0, float("-inf")
                        for i, j in by_sum(a[r], b[r]):
                            seen += size.get(i * width + j, 0)
                            if seen >= FIRST * k:
                                first = float(a[r][i] + b[r][j])
                                break
                        bound, spread = float("inf"), 0.0
                    else:
                        bound, first = bounds[r], firsts[r]
                        with np.errstate(all="ignore"):
                            away = np.nan_to_num((bound - m) / np.maximum(scatter, 1e-300))
                        spread = spread_of(cells.n, away, missed)
                    wanted = _visits(m, scatter, bound, spread, first)
                    near, parts = cells.block[wanted], cells.parts[wanted]
                    # the blocks of each cell, once
                    shift = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    near = np.unique(np.repeat(near, parts) + shift)
                    rows.append(np.full(len(near), r))
                    blocks.append(near)
                    told.append(np.tile([bound, spread, first], (len(near), 1)))
                row = pa.array(np.concatenate(rows))
                numbers = np.concatenate(told)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(blocks).astype(np.int32)),
                        batch["salt"].take(row),
                        pa.array(np.ones(len(row), bool)),
                        batch["id"].take(row),
                        batch["v"].take(row),
                        pa.nulls(len(row), pa.int32()),
                        *(pa.array(numbers[:, c]) for c in range(3)),
                    ],
                    names=[c.split()[0] for c in _MESSAGE.split(", ")],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _met(batches, Cells(*sent.value), k)

    def hits(questions: DataFrame) -> DataFrame:
        messages = stored.union(questions.mapInArrow(ask, _MESSAGE))
        dealt_out = messages.repartition("block", "salt").sortWithinPartitions("block", "salt", "query")
        return dealt_out.mapInArrow(meet, _HITS)

    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt")
    questions = asking.select("id", "v", salt)
    found = durable(hits(questions), "first_hits")
    if n <= FIRST * k:
        return found
    # the k-th best of the first cells, or none if there are fewer
    ranked = durable(_best(found, k).drop("rank"), "first_ranked")
    kth = F.when(F.count("*") == k, F.min("score")).otherwise(float("-inf"))
    bounds = ranked.groupBy("query_id").agg(kth.alias("bound"))
    again = questions.join(bounds, F.col("id") == F.col("query_id"), "left").select(
        "id", "v", "salt", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"),
        F.lit(float("inf")).alias("first"),
    )
    return ranked.union(durable(hits(again), "hits"))


def _met(batches: Iterator[pa.RecordBatch], cells: Cells, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each block for each query, from rows sorted by block, vectors first."""
    now: tuple | None = None
    held: list[pa.RecordBatch] = []
    block: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for batch in batches_of(batches):
        key = np.stack([batch["block"].to_numpy(), batch["salt"].to_numpy()], axis=1)
        query = batch["query"].to_numpy(zero_copy_only=False)
        new = (key[1:] != key[:-1]).any(axis=1) | (query[1:] != query[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            mine = tuple(key[lo].tolist())
            if mine != now:
                now, held, block = mine, [], None
            piece = batch.slice(lo, hi - lo)
            if not query[lo]:
                held.append(piece)
                continue
            if block is None:
                block = _block(held)
                held = []
            if len(block[0]):
                for at in range(0, piece.num_rows, _STEP):
                    yield _ranked(piece.slice(at, _STEP), block, cells, k)


def _block(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and cells of a block, a row given twice once."""
    if not held:
        return np.empty(0, np.int64), np.empty((0, 0)), np.empty(0, np.int64)
    table = pa.Table.from_batches(held)
    ids, cell = table["id"].to_numpy(), table["cell"].to_numpy()
    x = matrix(table["v"])
    order = np.lexsort((cell, ids))
    ids, x, cell = ids[order], x[order], cell[order]
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(axis=1)
    return ids[~again], x[~again], cell[~again]


def _ranked(
    queries: pa.RecordBatch, block: tuple[np.ndarray, np.ndarray, np.ndarray], cells: Cells, k: int
) -> pa.RecordBatch:
    ids, x, cell = block
    q, own = matrix(queries["v"]), queries["id"].to_numpy()
    told = [queries[c].to_numpy() for c in ("bound", "spread", "first")]
    a, b = cells.products(q)
    near = q @ x.T
    used, place = np.unique(cell, return_inverse=True)
    i, j = np.divmod(cells.cell[used], len(cells.right))
    m = a[:, i] + b[:, j]
    rest = cells.rest[used]
    sides = [q[:, : cells.cut], q[:, cells.cut :]]
    weights = [(s * s).sum(axis=1) / max(1, s.shape[1]) for s in sides]
    scatter = np.sqrt(weights[0][:, None] * rest[:, 0] + weights[1][:, None] * rest[:, 1])
    bound, spread, first = (t[:, None] for t in told)
    with np.errstate(all="ignore"):
        wanted = _visits(m, scatter, bound, spread, first)[:, place]
    wanted &= own[:, None] != ids
    near = np.where(wanted, near, -np.inf)
    # below what was found before, or k here; ties and what rounding may have mixed up stay in
    least = np.where(bound[:, 0] < np.inf, bound[:, 0], -np.inf)
    if len(ids) > k:
        least = np.maximum(least, np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k])
    size = np.abs(q).max(axis=1) * np.abs(x).max() * q.shape[1]
    wanted &= ~(near < (least - 1e-12 * size)[:, None])
    r, c = np.nonzero(wanted)
    score = np.empty(len(r))
    for lo in range(0, len(r), 65_536):
        part = slice(lo, lo + 65_536)
        score[part] = (q[r[part]] * x[c[part]]).sum(axis=1)
    order = np.lexsort((ids[c], -score, r))
    r, c, score = r[order], c[order], score[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    r, c, score = r[rank < k], c[rank < k], score[rank < k]
    return pa.RecordBatch.from_arrays(
        [pa.array(own[r], pa.int64()), pa.array(ids[c], pa.int64()), pa.array(score)],
        names=["query_id", "vec_id", "score"],
    )


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, 20)
