"""Connected components of a graph held as a table of edges.

Alternating star contraction: every round hangs the neighbours of a node on its
smallest neighbour, first the larger ones and then the rest, until each component
is a star around its smallest node. Before each round every task contracts the
edges it holds, which takes the length out of chains. A node is never gathered
with all its neighbours: their minimum is aggregated, and the edges are joined
to it, so the many edges of a hub can be split. Rounds are written to the shared
folder, and the number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.sources.storage import durable, forget

# Edges that a task contracts at a time.
_HELD_EDGES = 500_000


def _roots(a: list[int], b: list[int]) -> dict[int, int]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as the given ones, one for each node at most."""
    roots = _roots(a.tolist(), b.tolist())
    node = np.fromiter(roots.keys(), np.int64, len(roots))
    root = np.fromiter(roots.values(), np.int64, len(roots))
    hung = node != root
    return node[hung], root[hung]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        u, v = spanning_edges(table["u"].to_numpy(), table["v"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _HELD_EDGES:
            yield flush(held)
            held, rows = [], 0
    if rows:
        yield flush(held)


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = durable(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "stars")
    hung = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung, low


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = durable(down.groupBy("u").agg(F.min("v").alias("m")), "stars")
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))), low


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    ).first()
    return row.n, row.x or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node with an edge to another one.

    ``root`` is the smallest node of the component, for that node too. Nodes are
    longs; edges may repeat, point to themselves or hold nulls, which join
    nothing.
    """
    named = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    now = durable(named.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    state = _state(now)
    while state[0]:
        large, low = _large_star(now)
        step = durable(large.mapInArrow(_contract, "u long, v long"), "edges")
        forget(now, low)
        small, low = _small_star(step)
        now = durable(small.distinct(), "edges")
        forget(step, low)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
