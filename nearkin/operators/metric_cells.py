"""Exact nearest neighbours of many queries in a large table, by cells around pivots.

Every vector belongs to the nearest of some pivots. A query looks at the nearest cells
first, until they have k vectors; the k-th best of these is a distance to beat. By the
triangle inequality no vector of a cell is nearer than the query's distance to the pivot
less the cell's radius, nor, as the cell's vectors are nearer to its pivot than to the
query's own, nearer than the plane between the two. Only cells that these bounds leave
open are looked at for the second, whole answer.

Queries are never gathered: they are sent to the cells they have to visit and stream past
their vectors. Cells that lie together share a block of bounded size, a large one has
several, and a task holds one block, so a query is sent out as often as there are blocks
at most, however many cells are open. The driver sees the pivots and a few numbers for each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearkin.functions.vectors import COSINE
from nearkin.sources.storage import durable, settled

MAX_PIVOTS = 1_024
BLOCK_VALUES = 1 << 20
#: Distances are sums of squares that may cancel; bounds give way by this share of them.
SLACK = 1e-7
_MOST_SALT_QUERIES = 1 << 20
#: Groups of a block and a share of the queries for each core, so that all have work.
_GROUPS = 8
_STEP = 256
_QUERY_STEP = 1_024
_ZERO_CELL = -1


def few_copies(rows: DataFrame, vector_col: str, id_col: str, k: int) -> DataFrame:
    """``rows`` without those that equal k others with smaller ids, which can't be hits.

    Only vectors given more than k times are looked at, by hash and id alone.
    """
    key = F.struct(F.xxhash64(vector_col).alias("a"), F.xxhash64(F.lit(1), F.col(vector_col)).alias("b"))
    named = rows.withColumn("_key", key)
    counts = named.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > k)
    common, few = settled(durable(counts.select("_key"), "common"), 200_000)
    if few and common.isEmpty():
        return rows
    sent = F.broadcast(common) if few else common
    copies = named.select("_key", F.col(id_col).alias("_id")).join(sent, "_key", "left_semi")
    # k of each share first, so that no task has all copies
    copies = copies.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(64)))
    for keys in (["_key", "_part"], ["_key"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("_id"))
        copies = copies.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")
    last = copies.groupBy("_key").agg(F.max("_id").alias("_last"))
    last, few = settled(durable(last, "common"), 200_000)
    kept = named.join(F.broadcast(last) if few else last, "_key", "left")
    return kept.where(F.col("_last").isNull() | (F.col(id_col) <= F.col("_last"))).select(*rows.columns)


class Cells:
    """Pivots, and of their cells the number of vectors, radius and blocks.

    ``zeros`` is the number of zero vectors, which have a block of their own where
    nearness is an angle; there are none otherwise.
    """

    def __init__(self, pivots: np.ndarray, zeros: int = 0, *filled: np.ndarray):
        self.pivots, self.zeros = pivots, zeros
        self.sizes = np.sqrt((pivots * pivots).sum(axis=1))
        apart = self.to_pivots(pivots)
        np.fill_diagonal(apart, np.inf)
        self.apart = apart
        if filled:
            self.n, self.low, self.high, self.block, self.parts = filled

    def arrays(self) -> tuple:
        return self.pivots, self.zeros, self.n, self.low, self.high, self.block, self.parts

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to all pivots, good to ``SLACK`` of their sizes."""
        square = (x * x).sum(axis=1)[:, None] + self.sizes**2 - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(square, 0))

    def own(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and its distance to the pivot."""
        cell = np.argmin(self.sizes**2 - 2 * (x @ self.pivots.T), axis=1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))

    def fill(self, cell: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, rows: int) -> None:
        p = len(self.pivots)
        self.n, self.low, self.high = np.zeros(p, np.int64), np.zeros(p), np.full(p, -np.inf)
        self.n[cell], self.low[cell], self.high[cell] = n, low, high
        self.parts = np.maximum(1, -(-self.n // rows))
        self.block, at = np.zeros(p, np.int64), 0
        for group in together(self.pivots, self.n, rows):
            self.block[group] = at
            at += int(self.parts[group].max())

    def blocks_of(self, cells: np.ndarray) -> np.ndarray:
        """The blocks of some cells, each once."""
        parts = self.parts[cells]
        shift = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return np.unique(np.repeat(self.block[cells], parts) + shift)

    @property
    def zero_block(self) -> int:
        """The last block, which is that of the zero vectors."""
        return int((self.block + self.parts).max())

    def first(self, away: np.ndarray, k: int) -> np.ndarray:
        """The nearest cells that have k vectors, from distances to the pivots."""
        order = np.argsort(away, kind="stable")
        order = order[self.n[order] > 0]
        enough = int(np.searchsorted(np.cumsum(self.n[order]), k)) + 1
        return order[:enough]

    def open(self, away: np.ndarray, reach: float, size: float) -> np.ndarray:
        """The cells that may hold a vector within ``reach`` of a query."""
        filled = self.n > 0
        if not np.isfinite(reach):
            return np.flatnonzero(filled)
        slack = SLACK * (size + self.sizes + np.where(filled, self.high, 0))
        ball = np.maximum(away - self.high, self.low - away)
        near = int(np.argmin(away))
        plane = (away**2 - away[near] ** 2) / (2 * np.maximum(self.apart[near], 1e-300))
        plane[near] = 0
        # the plane's error grows as pivots get close to each other
        planar = SLACK * (size + self.sizes[near]) * (1 + (size + self.sizes) / np.maximum(self.apart[near], 1e-300))
        return np.flatnonzero(filled & (ball <= reach + slack) & (plane <= reach + slack + planar))


def together(pivots: np.ndarray, n: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """Groups of neighbouring cells of at most ``rows`` vectors; larger cells are alone."""
    left = [np.arange(len(n))]
    while left:
        group = left.pop()
        if len(group) == 1 or n[group].sum() <= rows:
            yield group
            continue
        at = pivots[group]
        group = group[np.argsort(at[:, int(np.argmax(at.var(axis=0)))], kind="stable")]
        half = int(np.searchsorted(np.cumsum(n[group]), n[group].sum() / 2)) + 1
        half = min(half, len(group) - 1)
        left += [group[half:], group[:half]]


def reach_of(near: np.ndarray, metric: str) -> np.ndarray:
    """The distance that goes with the closeness of a k-th neighbour."""
    square = 2 - 2 * (near - 1e-11) if metric == COSINE else -near * (1 + 1e-11)
    return np.sqrt(np.maximum(square, 0))


def pivots_of(left: DataFrame, n: int, prepare: Callable, matrix: Callable) -> np.ndarray | None:
    """Different vectors of a bounded sample, none of them zero if others are there."""
    sample = left.orderBy(F.xxhash64("_v")).limit(2 * n).select("_v").toArrow()
    if not sample.num_rows:
        return None
    x = prepare(matrix(sample["_v"]))
    x = np.unique(x[np.isfinite(x).all(axis=1)], axis=0)
    x = x[x.any(axis=1)] if x.any() else x[:1]
    return x[np.random.default_rng(n).permutation(len(x))[:n]]


class Search:
    """A table laid out by cells, and what finds the nearest of many queries in it.

    ``tools`` are ``prepare`` and ``matrix`` for vectors, ``top`` that makes a keeper of
    the k best, and ``hits`` that tells what it kept.
    """

    def __init__(self, left: DataFrame, id_col: str, carry: Sequence[str], metric: str, k: int, tools: dict):
        self.metric, self.k, self.tools = metric, k, tools
        self.carried = [id_col, *carry]
        self.id_col, self.carry = id_col, list(carry)
        left = left.withColumn("_v", F.col("_v").cast("array<double>"))
        finite = F.forall("_v", lambda c: c.isNull() | (~F.isnan(c) & (F.abs(c) < float("inf"))))
        left = durable(few_copies(left.where(F.col("_v").isNull() | finite), "_v", id_col, k), "searched")
        rows = left.count()
        prepare, matrix = tools["prepare"], tools["matrix"]
        pivots = pivots_of(left, min(MAX_PIVOTS, max(1, ceil(sqrt(rows)))), prepare, matrix)
        self.cells: Cells | None = None
        if pivots is None:
            return
        spark = left.sparkSession
        sent = spark.sparkContext.broadcast(pivots)
        angles = metric == COSINE

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = Cells(sent.value)
            for batch in batches:
                if batch.num_rows:
                    x = prepare(matrix(batch["_v"], cells.pivots.shape[1]))
                    cell, far = cells.own(x)
                    if angles:
                        cell = np.where(x.any(axis=1), cell, _ZERO_CELL)
                    batch = batch.append_column("_cell", pa.array(cell.astype(np.int32)))
                    yield batch.append_column("_far", pa.array(far))

        schema = T.StructType([*left.schema, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())])
        self.stored = durable(left.mapInArrow(assign, schema), "cells")
        # a row for each pivot
        about = self.stored.groupBy("_cell").agg(
            F.count("*").alias("n"), F.min("_far").alias("low"), F.max("_far").alias("high")
        )
        table = about.orderBy("_cell").toArrow()
        cell, n, low, high = (table[c].to_numpy() for c in ("_cell", "n", "low", "high"))
        some = cell >= 0
        cells = Cells(pivots, int(n[~some].sum()))
        per_block = max(64, BLOCK_VALUES // max(1, pivots.shape[1]))
        # small tables are shared out too: by blocks and, as much, by shares of the queries
        self.groups = _GROUPS * spark.sparkContext.defaultParallelism
        per_block = min(per_block, max(64, ceil(rows / sqrt(self.groups))))
        cells.fill(cell[some].astype(np.int64), n[some], low[some], high[some], per_block)
        self.cells = cells
        self.sent: Broadcast = spark.sparkContext.broadcast(cells.arrays())

    def salts(self, queries: int) -> int:
        """Into how many shares queries are dealt, so that there are enough groups."""
        wanted = min(ceil(self.groups / (self.cells.zero_block + 1)), ceil(queries / _QUERY_STEP))
        return max(1, wanted, ceil(queries / _MOST_SALT_QUERIES))

    def messages(self, queries: DataFrame, floors: DataFrame | None) -> DataFrame:
        """``_block, query_id, _q, _floor``: each query for each block it visits."""
        routes = self.routes(queries, floors)
        return routes.select(F.explode("_blocks").alias("_block"), "query_id", "_q", "_floor")

    def routes(self, queries: DataFrame, floors: DataFrame | None) -> DataFrame:
        """``_blocks, query_id, _q, _floor``: each query with the blocks it visits.

        ``floors`` has the closeness of the k-th found, by query; without them the
        nearest cells are visited that have k vectors.
        """
        sent, k, metric = self.sent, self.k, self.metric
        prepare, matrix = self.tools["prepare"], self.tools["matrix"]
        asked = queries.select("query_id", F.col("v").cast("array<double>").alias("_q"))
        none = F.lit(None).cast("double").alias("_floor")
        asked = asked.select("*", none) if floors is None else asked.join(floors, "query_id", "left")
        second = floors is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = Cells(*sent.value)
            every = np.flatnonzero(cells.n > 0)
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = prepare(matrix(batch["_q"], cells.pivots.shape[1]))
                near = batch["_floor"].to_numpy(zero_copy_only=False).astype(float)
                reach = np.where(np.isnan(near), np.inf, reach_of(np.nan_to_num(near), metric))
                size = np.sqrt((q * q).sum(axis=1))
                turned = metric == COSINE
                for lo in range(0, len(q), _STEP):
                    away = cells.to_pivots(q[lo : lo + _STEP])
                    rows, blocks, sizes = [], [], []
                    for r in range(lo, min(lo + _STEP, len(q))):
                        if not np.isfinite(q[r]).all():
                            continue  # never near to anything
                        if turned and not q[r].any():
                            # a zero vector is as near to all
                            visited = every if second else cells.first(away[r - lo], k)
                        elif second:
                            visited = cells.open(away[r - lo], reach[r], size[r])
                        else:
                            visited = cells.first(away[r - lo], k)
                        found = cells.blocks_of(visited)
                        # zero vectors have cosine 0 to all
                        if cells.zeros and (not second or np.isnan(near[r]) or near[r] <= 1e-11):
                            found = np.append(found, cells.zero_block)
                        rows.append(r)
                        blocks.append(found)
                        sizes.append(len(found))
                    if rows:
                        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                        block = pa.array(np.concatenate(blocks).astype(np.int32))
                        block = pa.ListArray.from_arrays(ends, block)
                        taken = batch.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([block, *taken.columns], names=["_blocks", *batch.schema.names])

        schema = T.StructType([T.StructField("_blocks", T.ArrayType(T.IntegerType())), *asked.schema])
        return asked.mapInArrow(run, schema)

    def found(self, queries: DataFrame, floors: DataFrame | None, salts: int, schema: T.StructType) -> DataFrame:
        """The k best of each block for each query that visits it."""
        sent = self.sent
        stored = self.stored.withColumn("_part", F.pmod(F.xxhash64(self.id_col), F.lit(1 << 20)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = Cells(*sent.value)
            for batch in batches:
                cell = batch["_cell"].to_numpy().astype(np.int64)
                part = batch["_part"].to_numpy()
                block = cells.block[cell] + part % cells.parts[cell]
                block = np.where(cell == _ZERO_CELL, cells.zero_block, block)
                yield batch.select([*names, "_v"]).append_column("_block", pa.array(block.astype(np.int32)))

        names = self.carried
        fields = [*(stored.schema[c] for c in (*names, "_v")), T.StructField("_block", T.IntegerType())]
        dealt = stored.mapInArrow(deal, T.StructType(fields))
        salt = F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int").alias("_salt")
        each = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
        asked = durable(self.routes(queries, floors), "routes")
        asked = asked.select(F.explode("_blocks").alias("_block"), "query_id", "_q", "_floor")
        # rows that no query visits stay where they are; blocks are few beside rows
        visited = asked.select("_block").distinct()
        dealt = dealt.join(F.broadcast(visited), "_block", "left_semi")

        def null(df: DataFrame, c: str) -> object:
            return F.lit(None).cast(df.schema[c].dataType).alias(c)

        rows = dealt.select(
            "_block", each, F.lit(False).alias("_asks"), *names, "_v",
            *(null(asked, c) for c in ("query_id", "_q", "_floor")),
        )
        asked = asked.select(
            "_block", salt, F.lit(True).alias("_asks"),
            *(null(dealt, c) for c in (*names, "_v")), "query_id", "_q", "_floor",
        )
        # by number, as small groups may take long: partitions aren't merged by their bytes
        groups = salts * (self.cells.zero_block + 1)
        both = rows.union(asked).repartition(groups, "_block", "_salt")
        tools, carry, id_col, k, metric = self.tools, self.carry, self.id_col, self.k, self.metric

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, asking in _streams(batches):
                table = held.select([id_col, *carry])
                x = tools["prepare"](tools["matrix"](held["_v"]))
                ids = asking["query_id"]
                q = tools["prepare"](tools["matrix"](asking["_q"], x.shape[1]))
                floor = np.nan_to_num(asking["_floor"].to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                top = tools["top"](q, k, metric, id_col, floor)
                top.add(table, x)
                hits = tools["hits"](top, ids, carry)
                if hits is not None:
                    yield from hits.combine_chunks().to_batches()

        return both.sortWithinPartitions("_block", "_salt", "_asks").mapInArrow(meet, schema)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """A block's rows with some of its queries, from rows sorted by block, rows first."""
    now: tuple | None = None
    held: list[pa.RecordBatch] = []
    block: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch["_block"].to_numpy(), batch["_salt"].to_numpy()], axis=1)
        asks = batch["_asks"].to_numpy(zero_copy_only=False)
        new = (key[1:] != key[:-1]).any(axis=1) | (asks[1:] != asks[:-1])
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            mine = tuple(key[lo].tolist())
            if mine != now:
                now, held, block = mine, [], None
            piece = batch.slice(lo, hi - lo)
            if not asks[lo]:
                held.append(piece)
                continue
            if block is None and held:
                block, held = pa.Table.from_batches(held), []
            if block is not None:
                for at in range(0, piece.num_rows, _QUERY_STEP):
                    yield block, piece.slice(at, _QUERY_STEP)


def search_cells(
    left: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str,
    id_col: str,
    carry: Sequence[str],
    schema: T.StructType,
    tools: dict,
) -> DataFrame:
    """Partial hits in which the k nearest of each query are; ``queries`` are written."""
    search = Search(left, id_col, carry, metric, k, tools)
    if search.cells is None:
        return left.sparkSession.createDataFrame([], schema)
    salts = search.salts(queries.count())
    first = durable(search.found(queries, None, salts, schema), "first-hits")
    order = Window.partitionBy("query_id").orderBy(F.desc("_near"), id_col)
    ranked = first.select("query_id", "_near", id_col).withColumn("_rank", F.row_number().over(order))
    kth = ranked.where(F.col("_rank") == k).select("query_id", F.col("_near").alias("_floor"))
    return search.found(queries, durable(kth, "floors"), salts, schema)
