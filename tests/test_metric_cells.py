import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.functions import vectors as V
from nearkin.operators import metric_cells, neighbors

SMALL = {"block_bytes": 8}


def table(spark, x, first=0):
    rows = [(first + i, [float(c) for c in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, v array<double>")


def asked(spark, q):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(q)]
    return spark.createDataFrame(rows, "query_id long, v array<double>")


def plain(hits):
    return sorted((r.query_id, r["rank"], r.row_id, r.raw_score, r.score) for r in hits.collect())


def clustered(rng, groups, each, dim, width):
    centres = rng.normal(size=(groups, dim)) * 10
    return np.concatenate([c + width * rng.normal(size=(each, dim)) for c in centres])


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("kind", ["scattered", "clustered", "copies", "lattice"])
def test_rows_are_those_of_the_broadcast_search(spark, metric, kind):
    rng = np.random.default_rng(5)
    if kind == "scattered":
        x = rng.normal(size=(700, 6)) * rng.exponential(3, (700, 1))
    elif kind == "clustered":
        x = clustered(rng, 9, 80, 5, 0.05)
    elif kind == "copies":
        x = rng.normal(size=(600, 4))
        x[rng.permutation(600)[:250]] = x[1]
    else:  # ties everywhere, some zero vectors
        x = rng.integers(-1, 2, size=(500, 3))
    q = np.concatenate([x[:30], rng.normal(size=(20, x.shape[1])), np.zeros((2, x.shape[1]))])
    rows, queries = table(spark, x), asked(spark, q)
    for k in (1, 7):
        by_cells = neighbors.knn(rows, queries, k, metric, **SMALL)
        assert plain(by_cells) == plain(neighbors.knn(rows, queries, k, metric))


@pytest.mark.parametrize("metric", V.METRICS)
def test_most_cells_are_skipped(spark, metric):
    rng = np.random.default_rng(6)
    x = clustered(rng, 30, 60, 8, 0.01)
    left = table(spark, x).select("row_id", F.col("v").alias("_v"))
    search = metric_cells.Search(left, "row_id", [], metric, 5, neighbors._tools(metric))
    queries = asked(spark, x[::50])
    schema = "query_id long, row_id long, raw_score double, _near double"
    first = search.found(queries, None, 1, neighbors.T.StructType.fromDDL(schema))
    floors = first.groupBy("query_id").agg(F.sort_array(F.collect_list("_near"), False)[4].alias("_floor"))
    visited = search.messages(queries, floors).count()
    cells = int((search.cells.n > 0).sum())
    assert visited < 0.2 * cells * queries.count()
    assert search.messages(queries, floors.where("1 = 0")).count() == search.cells.blocks_of(
        np.arange(len(search.cells.n))
    ).size * queries.count()


def test_queries_stay_on_the_tasks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows, queries = table(spark, rng.normal(size=(200, 4))), asked(spark, rng.normal(size=(150, 4)))
    largest = []
    fetched = type(rows).toArrow

    def watched(df):
        got = fetched(df)
        largest.append(("query_id" in df.columns, got.num_rows))
        return got

    monkeypatch.setattr(type(rows), "toArrow", watched)
    assert neighbors.knn(rows, queries, 3, V.L2, **SMALL).count() == 450
    assert not any(is_query for is_query, _ in largest)


def test_odd_vectors(spark):
    x = [[np.nan, 1], [0, 0], [1, 1], [1, 1], [1, 1], [-1, -1], [np.inf, 0]]
    rows = table(spark, x)
    queries = asked(spark, [[1, 1], [np.nan, 0], [0, 0]])
    for metric in V.METRICS:
        for k in (2, 20):
            got = plain(neighbors.knn(rows, queries, k, metric, **SMALL))
            assert [g[:3] for g in got] == [g[:3] for g in plain(neighbors.knn(rows, queries, k, metric))]
    assert neighbors.knn(table(spark, np.zeros((4, 2))), queries, 2, V.COSINE, **SMALL).count() == 4
    assert neighbors.knn(rows.where("1 = 0"), queries, 2, V.L2, **SMALL).count() == 0
    with pytest.raises(ValueError, match="more than once"):
        neighbors.knn(rows, queries.union(queries), 2, V.L2, **SMALL)


def test_few_copies_leaves_the_smallest_ids(spark):
    x = [[i % 3, 0] for i in range(90)] + [[9, i] for i in range(5)]
    kept = metric_cells.few_copies(table(spark, x), "v", "row_id", 4)
    assert sorted(r.row_id for r in kept.collect()) == [*range(12), *range(90, 95)]


def test_queries_go_to_blocks_and_not_to_each_open_cell(spark):
    """Without structure all cells are open; the cells of a block take one message."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 24))
    left = table(spark, x).select("row_id", F.col("v").alias("_v"))
    search = metric_cells.Search(left, "row_id", [], V.L2, 5, neighbors._tools(V.L2))
    queries = asked(spark, x[::100])
    floors = queries.select("query_id", F.lit(-1000.0).alias("_floor"))
    cells = int((search.cells.n > 0).sum())
    sent = search.messages(queries, floors)
    assert sent.count() == sent.distinct().count()
    assert sent.count() < 0.5 * cells * 40
    assert search.salts(100_000) > 1


@pytest.mark.parametrize("rows", [1, 30, 1000])
def test_cells_that_lie_together_share_blocks(rows):
    rng = np.random.default_rng(10)
    n = rng.integers(1, 60, 50)
    groups = list(metric_cells.together(rng.normal(size=(50, 3)), n, rows))
    assert sorted(np.concatenate(groups)) == list(range(50))
    assert all(len(g) == 1 or n[g].sum() <= rows for g in groups)
    cells = metric_cells.Cells(rng.normal(size=(50, 3)))
    cells.fill(np.arange(50), n, np.zeros(50), np.ones(50), rows)
    assert len(cells.blocks_of(np.arange(50))) == cells.zero_block
