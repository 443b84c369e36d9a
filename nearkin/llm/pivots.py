"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points in order. The inverted
list of a pivot holds the vectors that name it; vectors of a list that name at
least two pivots in common are candidates, and the cosine of each candidate pair
is computed. A pair is looked at in the list of its first common pivot only. The
pivots are a bounded sample of the vectors, four times the square root of their
number, so that lists stay short as tables grow; every vector is indexed. They are
kept apart: pivots from within a dense group would crowd its members' nearest ones,
each member would name others, and links among them would be lost.

Equal vectors are one row with a count. Lists are cut into blocks, any two blocks
of a list meet in a task of their own, and a task hands on the number of links of
each vector and edges that span what it linked, never the pairs.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm.common import batches_of, read
from nearkin.llm.components import connected_components, spanning_edges
from nearkin.operators.neighbors import matrix, unit_rows
from nearkin.sources.storage import durable

MIN_COSINE = 0.9
#: Pivots each vector names, and how many of them candidates have in common.
PREFIX = 12
SHARED = 2
#: Pivots are sampled from the vectors; more are not taken, however many there are.
MAX_PIVOTS = 65_536
PIVOTS_PER_ROOT = 4.0
#: No two pivots have this cosine. Twice the pivots wanted are sampled for that.
PIVOTS_APART = 0.8
BLOCK_ROWS = 1_024
_PAIRS = 65_536
_PIVOT_STEP = 256


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no null, NaN, infinity, and not all zero."""
    finite = F.forall(
        v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def kept_apart(sample: np.ndarray, n: int, most: float = PIVOTS_APART) -> np.ndarray:
    """The first n unit rows, without those too near to one already taken."""
    kept = sample[:0]
    for i in range(0, len(sample), _PIVOT_STEP):
        part = sample[i : i + _PIVOT_STEP]
        if len(kept):
            part = part[(part @ kept.T).max(axis=1) < most]
        near, free = part @ part.T >= most, np.ones(len(part), bool)
        for k in range(1, len(part)):
            free[k] = not (near[k, :k] & free[:k]).any()
        kept = np.concatenate([kept, part[free]])
        if len(kept) >= n:
            break
    return kept[:n]


def pivot_prefixes(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each unit row by cosine, nearest first."""
    near = x @ pivots.T
    first = np.argpartition(-near, n - 1, axis=1)[:, :n]
    order = np.argsort(-np.take_along_axis(near, first, axis=1), axis=1, kind="stable")
    return np.take_along_axis(first, order, axis=1)


def _bits(prefixes: np.ndarray, rank: dict[int, int]) -> np.ndarray:
    """Each row's pivots as a set of bits, 64 to a word."""
    words = max(1, (len(rank) + 63) // 64)
    bits = np.zeros((len(prefixes), words), np.uint64)
    places = np.vectorize(rank.__getitem__, otypes=[np.int64])(prefixes)
    rows = np.arange(len(prefixes))
    for at in places.T:
        bits[rows, at >> 6] |= np.uint64(1) << (at & 63).astype(np.uint64)
    return bits


def candidates(
    left: np.ndarray, right: np.ndarray, pivot: int, shared: int
) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose prefixes share enough pivots, ``pivot`` the first of them."""
    own = np.unique(np.concatenate([left.ravel(), right.ravel()]))
    rank = {int(p): i for i, p in enumerate(own)}
    a, b = _bits(left, rank), _bits(right, rank)
    at = rank[pivot]
    count = np.zeros((len(a), len(b)), np.uint8)
    earlier = np.zeros((len(a), len(b)), bool)
    for w in range(a.shape[1]):
        both = a[:, w, None] & b[None, :, w]
        count += np.bitwise_count(both)
        if w < at >> 6:
            earlier |= both != 0
        elif w == at >> 6:
            earlier |= (both & np.uint64((1 << (at & 63)) - 1)) != 0
    return np.nonzero((count >= shared) & ~earlier)


def _linked(
    x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: float
) -> np.ndarray:
    """Which of the pairs have at least that cosine, in double precision."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    found = np.empty(len(i), bool)
    for k in range(0, len(i), _PAIRS):
        a, b = i[k : k + _PAIRS], j[k : k + _PAIRS]
        found[k : k + _PAIRS] = (x[a] * y[b]).sum(1) / (nx[a] * ny[b]) >= least
    return found


def _unit_scaled(x: np.ndarray) -> np.ndarray:
    """Rows over their largest component, so that no square over- or underflows."""
    return x / np.abs(x).max(axis=1, keepdims=True)


def vector_links(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    min_cosine: float = MIN_COSINE,
    prefix: int = PREFIX,
    shared: int = SHARED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(<id>, n_links, component_id, kept)``, one row for each row of ``vectors``.

    ``n_links`` is the number of other rows linked directly, copies included,
    ``component_id`` the smallest id reachable. Rows whose vector is null, empty,
    zero or holds null, NaN or infinite components link with nothing, nor do
    vectors of different lengths with each other. Ids should be unique and not
    null; rows that share one are vectors of their own under that name. Pairs
    are found by shared pivots, so recall is measured, not certain.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = rows.where(usable(F.col("v"))).withColumns(
        {"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(1), F.col("v"))}
    )
    classes = good.groupBy("v", "k1", "k2").agg(F.min("id").alias("node"), F.count("*").alias("n"))
    classes = durable(classes, "vectors")
    partial = durable(_list_links(classes, min_cosine, prefix, shared, block_rows), "links")
    edges = partial.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    roots = connected_components(edges)
    counts = partial.groupBy("node").agg(F.sum("links").alias("links"))
    about = classes.select("k1", "k2", "node", "n").join(counts, "node", "left")
    about = durable(about.join(roots, "node", "left"), "vector_classes").select(
        "k1",
        "k2",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"),
    )
    linked = good.select("id", "k1", "k2").join(about, ["k1", "k2"], "left")
    alone = rows.where(~usable(F.col("v")))
    alone = alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.select("id", "n_links", "component_id").union(alone)
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


def _list_links(
    classes: DataFrame, min_cosine: float, prefix: int, shared: int, block_rows: int
) -> DataFrame:
    """Links of each node by block, ``(node, other, links)``; ``other`` spans them."""
    spark = classes.sparkSession
    sized = classes.withColumn("dim", F.size("v"))
    parts = []
    # one index for each length of vectors, of which a table has very few
    for row in sized.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():
        wanted = min(MAX_PIVOTS, max(prefix, ceil(PIVOTS_PER_ROOT * sqrt(row.n))))
        same = sized.where(F.col("dim") == row.dim)
        sample = same.orderBy(F.xxhash64("node"), "node").limit(min(MAX_PIVOTS, 2 * wanted))
        sample = unit_rows(_unit_scaled(matrix(sample.select("v").toArrow()["v"])))
        pivots = kept_apart(sample, wanted)
        parts.append(_index_links(same, pivots, min_cosine, prefix, shared, block_rows))
    schema = "node long, other long, links long"
    result = spark.createDataFrame([], schema)
    for part in parts:
        result = result.union(part)
    return result


def _index_links(
    vectors: DataFrame,
    pivots: np.ndarray,
    min_cosine: float,
    prefix: int,
    shared: int,
    block_rows: int,
) -> DataFrame:
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(pivots)
    named, common = min(prefix, len(pivots)), min(shared, len(pivots))

    def describe(batches):
        for batch in batches_of(batches):
            x = unit_rows(_unit_scaled(matrix(batch["v"])))
            p = pivot_prefixes(x, sent.value, named).astype(np.int32)
            nodes, counts = batch["node"], batch["n"]
            yield pa.RecordBatch.from_arrays(
                [nodes, counts, batch["v"], pa.array(list(p), pa.list_(pa.int32()))],
                names=["node", "n", "v", "prefix"],
            )

    kept = vectors.select("node", "n", "v")
    schema = kept.withColumn("prefix", F.array(F.lit(0))).schema
    described = durable(kept.mapInArrow(describe, schema), "prefixes")
    # at most as many rows as there are pivots
    lists = described.select(F.explode("prefix").alias("pivot")).groupBy("pivot")
    blocks = F.ceil(F.count("*") / block_rows).cast("int")
    sizes = lists.agg(blocks.alias("blocks"))
    listed = described.select("*", F.explode("prefix").alias("pivot")).join(
        F.broadcast(sizes), "pivot"
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    cells = listed.withColumn("own", own).withColumn("with", F.explode(others)).select(
        "pivot",
        F.least("own", "with").alias("i"),
        F.greatest("own", "with").alias("j"),
        (F.col("own") > F.col("with")).alias("right"),
        "node",
        "n",
        "v",
        "prefix",
    )

    def compare(key: tuple, cell: pa.Table) -> pa.Table:
        pivot, same = key[0].as_py(), key[1].as_py() == key[2].as_py()
        side = cell["right"].to_numpy()
        left = cell if same else cell.filter(pa.array(~side))
        right = cell if same else cell.filter(pa.array(side))
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("node", "other", "links")})
        if not left.num_rows or not right.num_rows:
            return empty
        px, py = (matrix(t["prefix"]).astype(np.int64) for t in (left, right))
        i, j = candidates(px, py, pivot, common)
        if same:
            once = i < j
            i, j = i[once], j[once]
        x, y = (_unit_scaled(matrix(t["v"])) for t in (left, right))
        linked = _linked(x, y, i, j, min_cosine)
        i, j = i[linked], j[linked]
        a, b = left["node"].to_numpy(), right["node"].to_numpy()
        na, nb = left["n"].to_numpy(), right["n"].to_numpy()
        links_a = np.bincount(i, weights=nb[j], minlength=len(a)).astype(np.int64)
        links_b = np.bincount(j, weights=na[i], minlength=len(b)).astype(np.int64)
        u, v = spanning_edges(a[i], b[j])
        nodes = np.concatenate([a[links_a > 0], b[links_b > 0]])
        links = np.concatenate([links_a[links_a > 0], links_b[links_b > 0]])
        other = pa.concat_arrays([pa.nulls(len(nodes), pa.int64()), pa.array(v, pa.int64())])
        zeros = np.zeros(len(u), np.int64)
        return pa.table(
            {
                "node": pa.array(np.concatenate([nodes, u]), pa.int64()),
                "other": other,
                "links": pa.array(np.concatenate([links, zeros]), pa.int64()),
            }
        )

    grouped = cells.groupBy("pivot", "i", "j")
    return grouped.applyInArrow(compare, "node long, other long, links long")


def op4_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read(spark, sf_dir, "embeddings"))


# All pairs and what can be reached over them; small tables only.
OP4_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), components AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts USING (vec_id)
"""
