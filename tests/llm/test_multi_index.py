import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.llm.common import read
from nearkin.llm.multi_index import by_sum, fit_centroids, nearest_neighbours, op11_multi_index

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], SCHEMA)


def by_hand(x, asks, k):
    out = {}
    for i in asks:
        score = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((np.arange(len(x)), -score)) if j != i]
        out[i] = [(int(j), float(score[j])) for j in order[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, wanted):
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in wanted[q]}) for q in wanted)
    return hits / sum(len(w) for w in wanted.values())


def check(spark, x, k=10, least=0.9, **settings):
    asks = range(0, len(x), 20)
    got = found(nearest_neighbours(table(spark, x), F.col("vec_id") % 20 == 0, k, **settings))
    wanted = by_hand(x, asks, k)
    assert got.keys() == wanted.keys()
    for q, hits in got.items():
        assert q not in {v for v, _ in hits} and len(hits) == len(wanted[q])
        for v, score in hits:
            assert score == float((x[q] * x[v]).sum())
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))
    assert recall(got, wanted) >= least


def test_pairs_come_by_their_sum():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=9), rng.normal(size=7)
    pairs = list(by_sum(a, b))
    assert sorted(pairs) == [(i, j) for i in range(9) for j in range(7)]
    sums = [a[i] + b[j] for i, j in pairs]
    assert sums == sorted(sums, reverse=True)


def test_centroids_of_copies_and_of_nothing_left():
    assert len(fit_centroids(np.zeros((5, 3)), 4)) == 1
    assert fit_centroids(np.zeros((5, 0)), 4).shape == (1, 0)


@pytest.mark.parametrize("settings", [{}, {"block_rows": 64}, {"max_centroids": 3}])
def test_recall_without_structure(spark, settings):
    check(spark, np.random.default_rng(1).normal(size=(2_000, 24)), **settings)


def test_recall_with_a_dense_group_and_long_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    near = centre + 0.05 * rng.normal(size=(700, 16))
    far = rng.normal(size=(1_400, 16)) * rng.exponential(2, (1_400, 1))
    check(spark, rng.permutation(np.concatenate([near, far])), block_rows=100)


def test_many_copies_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1_500, 8))
    x[rng.permutation(1_500)[:500]] = x[0]
    check(spark, x, k=5, least=0.95)
    asked = nearest_neighbours(table(spark, x), F.col("vec_id") == 0, 5)
    copies = [i for i in range(1, 1_500) if (x[i] == x[0]).all()]
    better = [v for v, s in found(asked)[0] if s > float((x[0] * x[0]).sum())]
    assert [v for v, _ in found(asked)[0] if v not in better] == copies[: 5 - len(better)]


def test_unusual_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]),
        (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
        (7, [float("inf"), 1.0]), (8, []), (40, None), (60, [1.0]), (80, [1.0, 2.0, 3.0]),
        (None, [5.0, 5.0]), (9, [3.0]), (100, [-1.0, 0.0]),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "v", "dim", "n", "asks", "cell", "block", "rank", "score", "query_id", "bound"):
        docs = docs.withColumn(name, F.lit(7))
    got = found(nearest_neighbours(docs, F.col("vec_id") % 20 == 0, 3))
    assert got == {
        0: [(1, 1.0), (2, 1.0), (20, 0.0)],
        20: [(1, 2.0), (2, 2.0), (0, 0.0)],
        60: [(9, 3.0)],
        100: [(20, 0.0), (0, -1.0), (1, -1.0)],
    }
    empty = nearest_neighbours(docs.where("1 = 0"), F.col("vec_id") % 20 == 0, 3)
    assert empty.collect() == []
    assert nearest_neighbours(docs, F.lit(None).cast("boolean"), 3).collect() == []


def test_query_equals_brute_force(spark):
    rows = read(spark, SF, "embeddings").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    ids = [r.vec_id for r in rows]
    got = found(op11_multi_index(spark, SF))
    wanted = by_hand(x, [i for i, v in enumerate(ids) if v % 20 == 0], 20)
    wanted = {ids[q]: [(ids[j], s) for j, s in hits] for q, hits in wanted.items()}
    assert got == wanted
