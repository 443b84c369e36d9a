import numpy as np
import pytest

from nearkin.llm.pivots import vector_links


def brute(rows):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            return None
        x = np.array(v, float)
        return None if not x.any() else x / np.abs(x).max()

    units = [unit(v) for _, v in rows]
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(n):
            a, b = units[i], units[j]
            if i != j and a is not None and b is not None and len(a) == len(b):
                if (a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()) >= 0.9:
                    links[i].add(j)
    low = [i for i, _ in rows]
    for _ in range(n):
        for i in range(n):
            for j in links[i]:
                low[i] = min(low[i], low[j])
    return sorted((rows[i][0], len(links[i]), low[i], rows[i][0] == low[i]) for i in range(n))


def result(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in vector_links(df, **options).collect())


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_groups_copies_and_unusable_vectors(spark, block_rows):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    for i in range(150, 230):
        near = np.array(rows[i % 5][1]) + 0.05 * rng.normal(size=16)
        rows.append((i, near.tolist()))
    rows += [(i, rows[3][1]) for i in range(230, 260)]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16)]
    rows += [(304, [None] * 16), (305, [float("inf")] + [0.0] * 15), (306, [1.0, 2.0]), (307, [2.0, 4.0])]
    rows += [(308, [1e-30] * 16), (309, [1e30] * 16)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert result(spark, rows, block_rows=block_rows) == brute(rows)


def test_empty_and_single(spark):
    assert result(spark, []) == []
    assert result(spark, [(5, [1.0, 0.0])]) == [(5, 0, 5, True)]


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold among unrelated vectors: nine tenths at least."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(500, 64))
    z -= (z * x[:500]).sum(1, keepdims=True) * x[:500]
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.905 * x[:500] + np.sqrt(1 - 0.905**2) * z
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in vector_links(df).collect()) / 2
    assert 0.9 * 500 <= found <= 500


def test_recall_in_a_dense_group(spark):
    """A third of the vectors near each other, not equal: pivots must not crowd there."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:1000] = x[0] + 0.3 * x[:1000]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in vector_links(df).collect())
    links = (x @ x.T >= 0.9).sum() - len(x)
    assert links > 500_000
    assert 0.99 * links <= found <= links + 2
