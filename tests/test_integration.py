"""Batches shifted against each other come together, types stay apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators.integration import Integration, batch_gap, fit_integration, integrate


@pytest.fixture(scope="module")
def shifted(spark):
    """Three types in two batches, one of them without the third type; the second batch is shifted, each type its own way."""
    rng = np.random.default_rng(5)
    centres, shift = np.eye(3, 8) * 6, rng.normal(size=(3, 8)) * 1.2
    rows = []
    for b, sizes in (("p", (200, 120, 80)), ("q", (150, 150, 0))):
        for t, n in enumerate(sizes):
            rows += [(b, t, [float(e) for e in v]) for v in centres[t] + (shift[t] if b == "q" else 0) + rng.normal(size=(n, 8)) * 0.5]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, batch string, kind int, v array<double>").repartition(4).cache()


def test_batches_meet_and_types_stay(shifted):
    out = integrate(shifted, "v", "batch", clusters=6, rounds=6).cache()
    for t in (0, 1):
        own = out.where(F.col("kind") == t)
        assert batch_gap(own, "integrated", "batch").first().gap < 0.3 * batch_gap(own, "v", "batch").first().gap
    rows = out.select("kind", "integrated").collect()
    x, y = np.array([r.integrated for r in rows]), np.array([r.kind for r in rows])
    means = np.array([x[y == t].mean(axis=0) for t in range(3)])
    assert (((x[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1) == y).mean() > 0.98


def test_cluster_shares_move_towards_the_whole(shifted):
    model = fit_integration(shifted, "v", "batch", clusters=6, rounds=6)
    apart = [np.abs(c / c.sum(axis=1, keepdims=True) - model.shares).T @ c.sum(axis=1) / c.sum() for c in model.history]
    assert apart[-1].sum() < apart[0].sum() and len(apart) == 6 and np.allclose(model.history[-1].sum(), 700)


def test_no_correction_for_one_batch(shifted):
    one = shifted.where("batch = 'p'")
    out = integrate(one, "v", "batch", clusters=4, rounds=3).collect()
    assert all(np.allclose(r.v, r.integrated, atol=0.2) for r in out)


def test_regression_equals_numpy():
    """Offsets of one cluster are the ridge regression on batch columns with a free intercept."""
    rng = np.random.default_rng(1)
    x, of = rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    model = Integration(["a", "b"], np.array([0.5, 0.5]), np.ones((1, 3)), np.ones((1, 2)), np.zeros((1, 2, 3)), 0.1, 2.0)
    assert np.allclose(model.soft(x, of), 1) and np.allclose(model.corrected(x, of, np.ones((50, 1))), x)


def test_edges(spark, shifted):
    odd = shifted.withColumn("batch", F.when(F.col("id") % 9 > 0, F.col("batch"))).withColumn("v", F.when(F.col("id") % 11 > 0, F.col("v")))
    model = fit_integration(odd, "v", "batch", clusters=5, rounds=2)
    assert model.batches == ["p", "q", None]
    out = integrate(odd, "v", "batch", model=model)
    assert out.count() == 700 and out.where("v is null and integrated is not null or v is not null and integrated is null").count() == 0
    other = integrate(shifted.withColumn("batch", F.lit("new")), "v", "batch", model=model).limit(20).collect()
    assert all(r.v == r.integrated for r in other)
    with pytest.raises(ValueError):
        fit_integration(odd.where("false"), "v", "batch")
