"""Exact nearest neighbours: every query against every vector, whole result.

The work is a block matrix product inside Arrow batches, and every task keeps
only its k best rows per query, so what is shuffled is ``tasks * queries * k``
small rows and never the pairs. As long as they have a bounded size, the queries
are sent to the tasks, and the vector table is read in place and never shuffled.
Large tables are read in part beforehand, which gives each query a distance that
later rows have to beat, so that most tasks have little to hand on. More queries
than that are joined to the table by cells (``metric_cells``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearkin.functions import vectors as V
from nearkin.functions.vectors import COSINE, L2
from nearkin.operators.metric_cells import search_cells
from nearkin.sources.storage import durable, planned_bytes, restrict, settled

MAX_BROADCAST_HITS = 200_000
# Queries that are sent to the tasks; more are joined to the table.
BLOCK_BYTES = 32 << 20
# Larger tables are worth a look at some of their rows beforehand.
SEED_ABOVE_BYTES = 16 << 30
SEED_ROWS = 50_000

# Scores that differ by less may be equal but for rounding errors; they tie, and
# the id decides. Squared distances are good to that many significant digits,
# products of unit vectors to that many decimals.
DIGITS = 12

# How many times more hits a query is asked for that is short of them.
DEEPER = 4

# Cells of one score block, and bytes of one exact re-evaluation.
_CELLS = 4_000_000
# Rows that are evaluated for a query without a look at the k-th.
_FEW = 32
_EXACT_BYTES = 32 << 20


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """An Arrow list column as an n x dim matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunks at all
            column = pa.array([], column.type)
    if column.null_count:
        raise ValueError("a vector is missing")
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("a vector has a missing component")
    sizes = np.diff(column.offsets.to_numpy())
    width = dim if dim is not None else (int(sizes[0]) if len(sizes) else 0)
    if len(sizes) and (sizes != width).any():
        raise ValueError(f"a vector does not have {width} dimensions")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length, zero rows unchanged."""
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norms > 0, norms, 1.0)


def _closeness(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """n x m closeness (higher is nearer) as one matrix product."""
    if metric == L2:
        near = (2 * x) @ q.T
        near -= (x * x).sum(1)[:, None]
        near -= (q * q).sum(1)[None, :]
    else:
        near = x @ q.T
    return near if np.isfinite(near.sum()) else np.nan_to_num(near, nan=-np.inf)


def _exact(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Row-by-row closeness, independent of where a row sits in a block."""
    return (x * q).sum(1) if metric == COSINE else -((x - q) ** 2).sum(1)


def _rank(exact: np.ndarray, metric: str) -> np.ndarray:
    """Closeness without the digits that rounding errors reach."""
    if metric == COSINE:
        return np.round(exact, DIGITS)
    size = np.abs(exact)
    unit = 10.0 ** np.floor(np.log10(np.where(size > 0, size, 1.0)))
    return np.where(size > 0, np.round(exact / unit, DIGITS - 1) * unit, 0.0)


def _rounding_slack(x: np.ndarray, q: np.ndarray, metric: str) -> float:
    """Bound on the errors of ``_closeness`` and of what ``_rank`` leaves out."""
    if not len(x):
        return 0.0
    xn = np.nanmax((x * x).sum(1)) ** 0.5
    qn = np.nanmax((q * q).sum(1)) ** 0.5
    size = xn * qn if metric == COSINE else (xn + qn) ** 2
    return (8 * (x.shape[1] + 4) * np.finfo(float).eps + 10.0 ** (1 - DIGITS)) * max(size, 1e-300)


def _few_copies(x: np.ndarray, ids: pa.ChunkedArray, k: int) -> np.ndarray | None:
    """The rows left if each vector has at most k copies, those of the lowest ids.

    Of equal vectors no more can be among the k nearest to anything.
    """
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    weights = np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        mixed = (bits ^ (bits >> np.uint64(29))) * weights
        key = (mixed ^ (mixed >> np.uint64(32))).sum(axis=1, dtype=np.uint64)
    if len(x) <= k or len(np.unique(key)) == len(x):
        return None
    table = pa.table({"key": key, "id": ids, "at": np.arange(len(x))})
    order = table.sort_by([("key", "ascending"), ("id", "ascending")])["at"].to_numpy()
    sorted_key = key[order]
    first = np.searchsorted(sorted_key, sorted_key, side="left")
    extra = np.arange(len(x)) - first >= k
    # equal hashes alone are no proof
    extra &= (x[order] == x[order[first]]).all(axis=1)
    return np.sort(order[~extra]) if extra.any() else None


class _TopK:
    """The k nearest rows per query among the blocks seen so far."""

    def __init__(
        self,
        queries: np.ndarray,
        k: int,
        metric: str,
        id_col: str,
        floor: np.ndarray | None = None,
    ):
        self.q = queries
        self.k = k
        self.metric = metric
        self.id_col = id_col
        self.best: pa.Table | None = None
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.copy()

    def add(self, rows: pa.Table, x: np.ndarray) -> None:
        few = _few_copies(x, rows[self.id_col], self.k)
        if few is not None:
            rows, x = rows.take(pa.array(few)), x[few]
        step = max(1, _CELLS // max(1, len(x)))
        for start in range(0, len(self.q), step):
            self._add_queries(rows, x, start, min(start + step, len(self.q)))

    def _add_queries(self, rows: pa.Table, x: np.ndarray, lo: int, hi: int) -> None:
        q = self.q[lo:hi]
        near = _closeness(q, x, self.metric)
        slack = 2 * _rounding_slack(x, q, self.metric)
        floor = self.floor[lo:hi]
        found = near >= (floor - slack)[:, None]
        # where a floor leaves many the k-th of these rows is one, which takes longer to find
        many = np.flatnonzero(np.count_nonzero(found, axis=1) > max(self.k, _FEW))
        if len(many):
            some = near[many]
            if len(x) > self.k:
                kth = np.partition(some, len(x) - self.k, axis=1)[:, len(x) - self.k]
                floor = np.maximum(floor[many], kth)
            else:
                floor = floor[many]
            found[many] = some >= (floor - slack)[:, None]
        query, row = np.divmod(np.flatnonzero(found), len(x))
        real = near[query, row] > -np.inf
        row, query = row[real], query[real]
        step = max(1, _EXACT_BYTES // (8 * max(1, x.shape[1])))
        for i in range(0, len(row), step):
            r, c = row[i : i + step], query[i : i + step]
            exact = _exact(x[r], q[c], self.metric)
            hit = rows.take(pa.array(r)).append_column("_exact", pa.array(exact))
            hit = hit.append_column("_near", pa.array(_rank(exact, self.metric)))
            self._merge(hit.append_column("_query", pa.array(c + lo)))

    def _merge(self, found: pa.Table) -> None:
        rest = None
        if self.best is not None:
            touched = np.zeros(len(self.q), bool)
            touched[found["_query"].to_numpy()] = True
            again = touched[self.best["_query"].to_numpy()]
            rest = self.best.filter(pa.array(~again))
            found = pa.concat_tables([self.best.filter(pa.array(again)), found])
        order = pc.sort_indices(
            found,
            sort_keys=[
                ("_query", "ascending"),
                ("_near", "descending"),
                (self.id_col, "ascending"),
            ],
        )
        query = found["_query"].to_numpy()[order]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        kept = place < self.k
        best = found.take(order.filter(pa.array(kept)))
        near = best["_near"].to_numpy()
        last = place[kept] == self.k - 1
        self.floor[query[kept][last]] = np.maximum(self.floor[query[kept][last]], near[last])
        self.best = best if rest is None else pa.concat_tables([rest, best])


def _signed(near: np.ndarray, metric: str) -> np.ndarray:
    return near + 0.0 if metric == COSINE else 0.0 - near


def _hits(top: _TopK, query_ids: pa.Array, carry: Sequence[str]) -> pa.Table | None:
    if top.best is None:
        return None
    best = top.best
    names = ["query_id", top.id_col, *carry, "raw_score", "_near"]
    raw = _signed(best["_exact"].to_numpy(), top.metric)
    columns = [query_ids.take(best["_query"].combine_chunks())]
    columns += [best[c] for c in (top.id_col, *carry)]
    return pa.Table.from_arrays([*columns, pa.array(raw), best["_near"]], names=names)


def _partial_schema(
    table: DataFrame, queries: DataFrame, id_col: str, carry: Sequence[str]
) -> T.StructType:
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType)]
    fields += [T.StructField(c, table.schema[c].dataType) for c in (id_col, *carry)]
    fields += [T.StructField(c, T.DoubleType()) for c in ("raw_score", "_near")]
    return T.StructType(fields)


def knn(
    table: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = COSINE,
    *,
    id_col: str = "row_id",
    vector_col: str = "v",
    carry: Sequence[str] = (),
    block_bytes: int = BLOCK_BYTES,
    seed_above_bytes: int = SEED_ABOVE_BYTES,
) -> DataFrame:
    """The min(k, N) nearest rows of ``table`` for each row of ``queries``.

    ``queries`` has ``query_id``, unique, and ``v``; a repeated ``query_id`` is an
    error. Row ids must be unique. Under ``cosine`` both sides are scaled to unit
    length and higher is nearer; under ``l2`` the raw score is the squared distance
    and lower is nearer. Rows are ranked by their exact scores; those that differ
    by rounding errors only (see ``DIGITS``) tie, and ties go to the lower id.
    ``carry`` columns ride along from the table, which saves a join back to it. A
    vector with a NaN component is never near anything.

    Returns ``query_id, rank, <id_col>, <carry...>, raw_score, score``.
    """
    V.check_metric(metric)
    if k < 1:
        raise ValueError("k must be at least 1")
    left = table.select(id_col, *carry, F.col(vector_col).alias("_v"))
    schema = _partial_schema(table, queries, id_col, carry)
    # written first, so whatever makes the queries runs once, and measured
    asked = durable(queries.select("query_id", "v"), "queries")
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("values")).first()
    if 8 * (size.values or 0) <= block_bytes:
        block = asked.toArrow()
        _check_once(pc.count_distinct(block["query_id"], mode="all").as_py(), size.n)
        seed = planned_bytes(left) > seed_above_bytes
        partial = _nearest(left, block, k, metric, id_col, carry, schema, seed)
    else:
        _check_once(asked.select("query_id").distinct().count(), size.n)
        partial = search_cells(left, asked, k, metric, id_col, carry, schema, _tools(metric))
    order = Window.partitionBy("query_id").orderBy(F.desc("_near"), F.asc(id_col))
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", id_col, *carry, "raw_score")
        .withColumn("score", V.score(F.col("raw_score"), metric))
    )


def _check_once(different: int, n: int) -> None:
    if different < n:
        raise ValueError("a query_id is given more than once")


def _tools(metric: str) -> dict:
    """What a search by cells compares vectors with."""

    def prepare(x: np.ndarray) -> np.ndarray:
        return _prepare(x, metric)

    return {"prepare": prepare, "matrix": matrix, "top": _TopK, "hits": _hits}


def _prepare(x: np.ndarray, metric: str) -> np.ndarray:
    return unit_rows(x) if metric == COSINE else x


def _nearest(left, block, k, metric, id_col, carry, schema, seed) -> DataFrame:
    """What each task finds for a block of queries."""
    spark = left.sparkSession
    q = _prepare(matrix(block["v"]), metric)
    query_ids = block["query_id"].combine_chunks()
    floor = None
    if seed:
        found = _nearest(left.limit(SEED_ROWS), block, k, metric, id_col, carry, schema, False)
        # k rows for each query at most
        known = found.select("query_id", "_near").toArrow().group_by("query_id")
        known = known.aggregate([("_near", "min"), ("_near", "count")])
        known = known.filter(pc.equal(known["_near_count"], k))
        floor = np.full(len(q), -np.inf)
        at = pc.index_in(known["query_id"], query_ids).to_numpy()
        floor[at] = known["_near_min"].to_numpy()
    shared = spark.sparkContext.broadcast((query_ids, q, floor))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, low = shared.value
        top = _TopK(wanted, k, metric, id_col, low)
        for batch in batches:
            if len(wanted) and batch.num_rows:
                x = _prepare(matrix(batch["_v"], wanted.shape[1]), metric)
                top.add(pa.Table.from_batches([batch]).drop_columns("_v"), x)
        hits = _hits(top, ids, carry)
        if hits is not None:
            yield from hits.combine_chunks().to_batches()

    return left.mapInArrow(nearest, schema)


def knn_overfetch(
    table: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = COSINE,
    *,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    id_col: str = "row_id",
    **options,
) -> DataFrame:
    """The first k hits per query that ``keep`` leaves, or all it leaves of the table.

    Twice as many are fetched at first. Queries that are then short of k, though the
    table has more, are asked again for ``DEEPER`` times as many, until none is; so a
    filter that removes most hits costs a few searches for the queries that need them.
    ``keep`` sees the hits by rank and may drop any, but not add to them.
    """
    if keep is None:
        return knn(table, queries, k, metric, id_col=id_col, **options)
    asked = durable(queries.select("query_id", "v"), "queries")
    fetch, filled = 2 * k, None
    while True:
        wide = durable(knn(table, asked, fetch, metric, id_col=id_col, **options), "fetched")
        left = durable(keep(wide), "left")
        fetched = wide.groupBy("query_id").agg(F.count("*").alias("fetched"))
        some = left.groupBy("query_id").agg(F.count("*").alias("left"))
        short = fetched.where(F.col("fetched") == fetch).join(some, "query_id", "left")
        short = short.where(F.coalesce("left", F.lit(0)) < k).select("query_id")
        short, _ = settled(durable(short, "short"), MAX_BROADCAST_HITS)
        done = left.join(short, "query_id", "left_anti")
        filled = done if filled is None else filled.union(done)
        if short.isEmpty():
            break
        asked = durable(asked.join(short, "query_id", "left_semi"), "queries")
        fetch *= DEEPER
    again = Window.partitionBy("query_id").orderBy("rank")
    return filled.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def with_metadata(
    hits: DataFrame,
    id_map: DataFrame,
    *,
    id_col: str = "row_id",
    default: str | None = "unknown",
) -> DataFrame:
    """Add ``filename`` to hits by row id.

    A hit without an entry gets ``default``; with ``default=None`` it fails the
    job instead. Hits are few beside the map, so as long as their number is
    within bounds they are sent to the map, which is then not shuffled.
    """
    hits, few = settled(hits, MAX_BROADCAST_HITS)
    keys = hits.select(id_col).distinct() if few else None
    names = restrict(id_map.select(id_col, "filename"), keys, id_col)
    joined = hits.join(names, id_col, "left")
    if default is not None:
        missing = F.lit(default)
    else:
        text = F.concat(F.lit("no metadata for row "), F.col(id_col).cast("string"))
        missing = F.raise_error(text)
    return joined.withColumn("filename", F.coalesce("filename", missing))


def hit_list(hits: DataFrame) -> DataFrame:
    """Hits as shown to a reader: rank, filename, score to three decimals."""
    return hits.select("query_id", "rank", "filename", F.round("score", 3).alias("score"))
