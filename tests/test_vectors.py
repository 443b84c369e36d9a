import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearkin.functions import vectors as V
from nearkin.operators import neighbors, pooling, similarity

NON_UNIT = [(1, [1.0, 0.0]), (2, [10.0, 0.1]), (3, [0.5, 0.5]), (4, [0.0, 0.0]), (5, [-1.0, 0.0])]


def table(spark, rows):
    return spark.createDataFrame(rows, "row_id long, v array<double>")


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, v array<double>")


def brute(rows, asked, k, metric):
    out = []
    for qid, q in asked:
        q = np.array(q)
        scored = []
        for rid, v in rows:
            v = np.array(v)
            if metric == "l2":
                scored.append((round(float(((v - q) ** 2).sum()), 9), rid))
            else:
                n = np.linalg.norm(v) * np.linalg.norm(q)
                scored.append((-round(float(v @ q / n) if n else 0.0, 9), rid))
        for rank, (s, rid) in enumerate(sorted(scored)[:k], start=1):
            out.append((qid, rank, rid, s if metric == "l2" else -s))
    return sorted(out)


def plain(hits):
    rows = [(r.query_id, r.rank, r.row_id, r.raw_score) for r in hits.collect()]
    return sorted(rows)


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-8)


BLOCKS = {"block_bytes": 40, "seed_above_bytes": 0}


@pytest.mark.parametrize("options", [{}, BLOCKS], ids=["broadcast", "blocks"])
@pytest.mark.parametrize("metric", V.METRICS)
def test_knn_on_vectors_of_many_lengths(spark, metric, options):
    asked = [(7, [1.0, 0.2]), (8, [-2.0, 0.0]), (9, [0.0, 0.0])]
    got = neighbors.knn(table(spark, NON_UNIT), queries(spark, asked), 3, metric, **options)
    same(plain(got), brute(NON_UNIT, asked, 3, metric))


def test_metrics_order_differently(spark):
    asked = queries(spark, [(0, [1.0, 0.2])])
    first = {
        m: plain(neighbors.knn(table(spark, NON_UNIT), asked, 5, m)) for m in V.METRICS
    }
    assert [r[2] for r in first["l2"]] != [r[2] for r in first["cosine"]]


@pytest.mark.parametrize("options", [{}, BLOCKS], ids=["broadcast", "blocks"])
@pytest.mark.parametrize("metric", V.METRICS)
def test_knn_random_with_many_copies(spark, metric, options):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8)) * rng.uniform(0.1, 5, size=(300, 1))
    base[::3] = base[0]  # a third of all rows are one vector
    rows = [(i, base[i].tolist()) for i in range(300)]
    asked = [(i, rng.normal(size=8).tolist()) for i in range(20)] + [(99, base[0].tolist())]
    t = table(spark, rows).repartition(5)
    got = neighbors.knn(t, queries(spark, asked), 7, metric, **options)
    same(plain(got), brute(rows, asked, 7, metric))


def test_knn_in_small_batches_keeps_ties_by_id(spark):
    rows = [(i, [1.0, 1.0]) for i in range(50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        asked = queries(spark, [(0, [2.0, 2.0])])
        got = plain(neighbors.knn(table(spark, rows).repartition(3), asked, 4))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r[2] for r in got] == [0, 1, 2, 3]


def test_near_rows_are_told_apart(spark):
    """Distances far below the ninth decimal, and near-copies by angle."""
    rows = [(i, [1.0 + (10 - i) * 1e-5, 0.0]) for i in range(10)]
    got = plain(neighbors.knn(table(spark, rows), queries(spark, [(0, [1.0, 0.0])]), 3, "l2"))
    assert [r[2] for r in got] == [9, 8, 7]
    turned = [(i, [float(np.cos((10 - i) * 1e-5)), float(np.sin((10 - i) * 1e-5))]) for i in range(10)]
    got = plain(neighbors.knn(table(spark, turned), queries(spark, [(0, [1.0, 0.0])]), 3, "cosine"))
    assert [r[2] for r in got] == [9, 8, 7]
    tiny = [(i, [1e-9 * (1 + i), 0.0]) for i in range(10)]
    got = plain(neighbors.knn(table(spark, tiny), queries(spark, [(0, [5.2e-9, 0.0])]), 3, "l2"))
    assert [r[2] for r in got] == [4, 5, 3]


def test_equal_up_to_rounding_ties_by_id(spark):
    rows = [(i, [x * (i + 1) / 3 for x in (0.1, 0.2, 0.3)]) for i in range(9, -1, -1)]
    got = plain(neighbors.knn(table(spark, rows), queries(spark, [(0, [0.1, 0.2, 0.3])]), 4, "cosine"))
    assert [r[2] for r in got] == [0, 1, 2, 3]


def test_copies_are_cut_before_they_are_compared():
    x = np.repeat(np.array([[1.0, 2.0], [3.0, 4.0]]), [500, 2], axis=0)
    ids = pa.chunked_array([np.arange(502)[::-1]])
    few = neighbors._few_copies(x, ids, 3)
    assert sorted(ids.take(pa.array(few)).to_pylist()) == [0, 1, 2, 3, 4]
    assert neighbors._few_copies(x[[0, 501]], pa.chunked_array([[1, 2]]), 1) is None


def test_a_query_id_given_twice_fails(spark):
    asked = queries(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0])])
    for options in ({}, BLOCKS):
        with pytest.raises(ValueError, match="more than once"):
            neighbors.knn(table(spark, NON_UNIT), asked, 3, **options)


def test_the_table_is_only_shuffled_for_many_queries(spark):
    asked = queries(spark, [(i, [1.0, float(i)]) for i in range(50)])
    hits = neighbors.knn(table(spark, NON_UNIT), asked, 2)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Join" not in plan
    # more than can be sent out meet the rows of the blocks they visit, and no others
    hits = neighbors.knn(table(spark, NON_UNIT), asked, 2, **BLOCKS)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_k_beyond_the_table(spark):
    hits = neighbors.knn(table(spark, NON_UNIT[:1]), queries(spark, [(0, [1.0, 0.0])]), 20)
    assert hits.count() == 1


def test_no_queries_and_no_rows(spark):
    none = queries(spark, [])
    assert neighbors.knn(table(spark, NON_UNIT), none, 3).count() == 0
    asked = queries(spark, [(0, [1.0, 0.0])])
    assert neighbors.knn(table(spark, []), asked, 3).count() == 0
    assert neighbors.knn(table(spark, []), asked, 3, **BLOCKS).count() == 0


def test_string_ids_and_carried_columns(spark):
    rows = [("b", "x.pdf", [1.0, 0.0]), ("a", None, [1.0, 0.0])]
    t = spark.createDataFrame(rows, "id string, filename string, v array<float>")
    for options in ({}, BLOCKS):
        hits = neighbors.knn(
            t, queries(spark, [(0, [1.0, 0.0])]), 2, id_col="id", carry=("filename",), **options
        )
        got = [(r.rank, r.id, r.filename) for r in hits.orderBy("rank").collect()]
        assert got == [(1, "a", None), (2, "b", "x.pdf")]


def test_nan_is_never_near(spark):
    rows = [(1, [float("nan"), 1.0]), (2, [1.0, 0.0])]
    for metric in V.METRICS:
        got = plain(neighbors.knn(table(spark, rows), queries(spark, [(0, [1.0, 0.0])]), 5, metric))
        assert [r[2] for r in got] == [2]


def test_dimension_mismatch_fails(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])]
    with pytest.raises(PySparkException, match="does not have 2 dimensions"):
        neighbors.knn(table(spark, rows), queries(spark, [(0, [1.0, 0.0])]), 2).collect()


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        neighbors.knn(table(spark, NON_UNIT), queries(spark, []), 3, "dot")
    with pytest.raises(ValueError):
        neighbors.knn(table(spark, NON_UNIT), queries(spark, []), 0)


def test_scores(spark):
    asked = queries(spark, [(0, [1.0, 0.0])])
    l2 = neighbors.knn(table(spark, NON_UNIT), asked, 5, "l2")
    cosine = neighbors.knn(table(spark, NON_UNIT), asked, 5, "cosine")
    assert all(r.score == 1 / (1 + r.raw_score) for r in l2.collect())
    by_id = {r.row_id: r.score for r in cosine.collect()}
    assert by_id[1] == 1.0 and by_id[5] == 0.0 and by_id[4] == 0.5


def test_overfetch_filters_and_ranks_again(spark):
    asked = queries(spark, [(0, [1.0, 0.0])])
    plain_hits = neighbors.knn(table(spark, NON_UNIT), asked, 2)
    same(plain(neighbors.knn_overfetch(table(spark, NON_UNIT), asked, 2)), plain(plain_hits))
    hits = neighbors.knn_overfetch(
        table(spark, NON_UNIT), asked, 2, keep=lambda h: h.where("row_id <> 1")
    )
    assert [(r[1], r[2]) for r in plain(hits)] == [(1, 2), (2, 3)]


def test_metadata_default_and_strict(spark):
    hits = neighbors.knn(table(spark, NON_UNIT), queries(spark, [(0, [1.0, 0.0])]), 3)
    names = spark.createDataFrame([(1, "one.pdf"), (2, "two.pdf")], "row_id long, filename string")
    got = {r.row_id: r.filename for r in neighbors.with_metadata(hits, names).collect()}
    assert got == {1: "one.pdf", 2: "two.pdf", 3: "unknown"}
    with pytest.raises(PySparkException, match="no metadata for row 3"):
        neighbors.with_metadata(hits, names, default=None).collect()
    shown = neighbors.hit_list(neighbors.with_metadata(hits, names)).orderBy("rank").first()
    assert (shown.rank, shown.filename, shown.score) == (1, "one.pdf", 1.0)


def test_expressions_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(20)] + [(20, [0.0] * 6)]
    q = rng.normal(size=6)
    ql = F.array(*map(F.lit, q.tolist()))
    v = F.col("v")
    got = table(spark, rows).select(
        "row_id", V.dot(v, ql), V.squared_l2(v, ql), V.l2_norm(v), V.normalize(v)
    )
    for r in got.collect():
        x = np.array(rows[r[0]][1])
        n = np.linalg.norm(x)
        assert np.allclose([r[1], r[2], r[3]], [x @ q, ((x - q) ** 2).sum(), n])
        assert np.allclose(r[4], x / n if n else x)


def test_required_vectors_name_the_record(spark):
    df = spark.createDataFrame([("r7", None)], "id string, v array<double>")
    with pytest.raises(PySparkException, match="no vector given for id r7"):
        df.select(V.require_vector(F.col("v"), F.col("id"))).collect()
    df = spark.createDataFrame([("r8", [1.0])], "id string, v array<double>")
    with pytest.raises(PySparkException, match="vector of id r8 does not have 2 dimensions"):
        df.select(V.require_vector(F.col("v"), F.col("id"), 2)).collect()


def pairwise(rows):
    x = np.array([v for _, v in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n > 0, n, 1)
    return u @ u.T


def test_average_similarity_equals_pairwise(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=5) * (i + 1)).tolist()) for i in range(30)] + [(30, [0.0] * 5)]
    s = pairwise(rows)
    want = (s.sum(1) - np.diag(s)) / (len(rows) - 1)
    got = similarity.average_similarity(table(spark, rows)).orderBy("row_id").collect()
    assert np.allclose([r.avg_sim for r in got], want)


def test_average_similarity_of_a_single_document(spark):
    assert similarity.average_similarity(table(spark, NON_UNIT[:1])).first().avg_sim is None


def test_universal_ties_go_by_name_then_text(spark):
    rows = [(1, "a", "x", [1.0, 0.0]), (2, "b", "x", [1.0, 0.0]), (3, "b", "y", [2.0, 0.0])]
    df = spark.createDataFrame(rows, "row_id long, filename string, text string, v array<double>")
    scored = similarity.average_similarity(df)
    assert [r.row_id for r in similarity.rank_universal(scored).collect()] == [3, 2, 1]
    assert [r.row_id for r in similarity.top_universal(scored, 2).collect()] == [3, 2]


def test_copies_have_one_average_wherever_they_lie(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(7, 33))
    rows = [(i, base[i % 7].tolist()) for i in range(210)]
    scored = similarity.average_similarity(table(spark, rows).repartition(9)).collect()
    for b in range(7):
        assert len({r.avg_sim for r in scored if r.row_id % 7 == b}) == 1


def test_very_many_vectors_do_not_overflow(spark):
    sums = spark.createDataFrame([([3e9, 0.0], 4_000_000_000, 1.0)], "total array<double>, n long, longest double")
    assert similarity.stats_of_sums(sums, None).first().mean_sim == pytest.approx(0.5625)


def test_the_minimum_can_be_left_out(spark):
    got = similarity.similarity_stats(table(spark, NON_UNIT), minimum=False).first()
    assert got.min_sim is None and got.max_sim == 1.0


@pytest.mark.parametrize(
    "options",
    [{}, {"max_broadcast_bytes": 1, "block_bytes": 512}],
    ids=["broadcast", "blocks"],
)
@pytest.mark.parametrize("shape", ["cone", "ball", "clusters", "zero", "one"])
def test_similarity_stats_equal_the_full_matrix(spark, shape, options):
    rng = np.random.default_rng(5)
    if shape == "cone":
        x = rng.normal(size=(200, 6)) * 0.2 + 1
    elif shape == "clusters":
        x = np.repeat(rng.normal(size=(4, 6)), 50, axis=0) + rng.normal(size=(200, 6)) * 0.05
        x[:70] = x[0]
    elif shape == "one":
        x = np.ones((1, 6))
    else:
        x = rng.normal(size=(200, 6))
    if shape == "zero":
        x = np.abs(x)
        x[11] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    s = pairwise(rows)
    got = similarity.similarity_stats(table(spark, rows).repartition(3), **options).first()
    assert np.allclose([got.mean_sim, got.min_sim, got.max_sim], [s.mean(), s.min(), s.max()])


def test_pooling_is_a_plain_mean(spark):
    rows = [("d1", [1.0, 1.0]), ("d1", [3.0, 5.0]), ("d2", [2.0, 2.0])]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    got = {r.id: list(r.v) for r in pooling.average_pool(df, "id").collect()}
    assert got == {"d1": [2.0, 3.0], "d2": [2.0, 2.0]}
    bad = spark.createDataFrame([("d", [1.0]), ("d", [1.0, 2.0])], "id string, v array<double>")
    with pytest.raises(Exception):
        pooling.average_pool(bad, "id").collect()


def test_embedding_stats(spark):
    r = pooling.embedding_stats(table(spark, NON_UNIT)).first()
    n = np.linalg.norm([v for _, v in NON_UNIT], axis=1)
    assert (r.n, r.dim) == (5, 2)
    assert np.allclose([r.mean_norm, r.std_norm], [n.mean(), n.std()])


def test_metrics_agree_on_unit_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = queries(spark, [(0, rng.normal(size=5).tolist())])
    order = [
        [r[2] for r in plain(neighbors.knn(table(spark, rows), asked, 60, m))]
        for m in V.METRICS
    ]
    assert order[0] == order[1]


def test_a_filter_that_leaves_few_is_filled_up(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    asked = [(i, rng.normal(size=4).tolist()) for i in range(6)]
    every = plain(neighbors.knn(table(spark, rows), queries(spark, asked), 400))
    for rest in (10, 150):
        hits = neighbors.knn_overfetch(
            table(spark, rows), queries(spark, asked), 3, keep=lambda h: h.where(F.col("row_id") % rest == 7)  # noqa: B023
        )
        wanted = []
        for q in range(6):
            mine = [r for r in every if r[0] == q and r[2] % rest == 7][:3]
            wanted += [(q, place, r[2]) for place, r in enumerate(mine, start=1)]
        assert [r[:3] for r in plain(hits)] == wanted
    none = neighbors.knn_overfetch(table(spark, rows), queries(spark, asked), 3, keep=lambda h: h.where("1 = 0"))
    assert none.count() == 0
