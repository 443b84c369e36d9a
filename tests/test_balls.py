import numpy as np
import pytest

from nearkin.operators import balls, similarity
from nearkin.operators.neighbors import unit_rows


def units(spark, x):
    return spark.createDataFrame([(v.tolist(),) for v in x], "u array<double>").repartition(3)


def clusters(rng, groups, each, dim, width):
    centres = unit_rows(rng.normal(size=(groups, dim)))
    return unit_rows(np.repeat(centres, each, axis=0) + width * rng.normal(size=(groups * each, dim)))


@pytest.mark.parametrize("block_rows", [5, 60, 10_000])
@pytest.mark.parametrize("kind", ["clusters", "scattered", "narrow", "zero"])
def test_the_widest_pair_is_found(spark, kind, block_rows):
    rng = np.random.default_rng(4)
    x = {
        "clusters": lambda: clusters(rng, 12, 30, 5, 0.02),
        "scattered": lambda: unit_rows(rng.normal(size=(200, 4))),
        "narrow": lambda: unit_rows(1 + 0.1 * rng.normal(size=(200, 6))),
        "zero": lambda: np.concatenate([unit_rows(1 + 0.1 * rng.normal(size=(50, 3))), np.zeros((1, 3))]),
    }[kind]()
    work = balls.lowest_by_balls(units(spark, x), x.shape[1], 1.0, 8 * x.shape[1] * block_rows)
    assert work.lowest == pytest.approx((x @ x.T).min(), abs=1e-12)
    assert 0 < work.visited <= work.cells


def test_most_cells_are_skipped(spark):
    rng = np.random.default_rng(9)
    x = clusters(rng, 40, 25, 6, 0.01)
    work = balls.lowest_by_balls(units(spark, x), 6, 1.0, 8 * 6 * 20)
    assert work.lowest == pytest.approx((x @ x.T).min(), abs=1e-12)
    assert work.cells > 1_000
    assert work.visited < 0.1 * work.cells
    # a pair known beforehand as wide as any leaves less to look at
    again = balls.lowest_by_balls(units(spark, x), 6, work.lowest, 8 * 6 * 20)
    assert again.lowest == work.lowest and again.visited <= work.visited
    known = balls.lowest_by_balls(units(spark, x), 6, -1.0, 8 * 6 * 20)
    assert (known.lowest, known.visited) == (-1.0, 0)


def test_no_vectors(spark):
    assert balls.lowest_by_balls(units(spark, np.ones((1, 2))).limit(0), 2, 0.5, 64).lowest == 0.5
    assert similarity.min_cosine(units(spark, np.ones((1, 2))).limit(0)) is None
