"""The marker mixture: its objective, its sums against numpy, planted types and merged rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators.mixture import fit_marker_mixture

MATRIX = {"A": {"a": 1.0, "b": -1.0, "c": -1.0}, "B": {"b": 1.0, "a": -1.0, "c": -1.0}, "C": {"c": 1.0, "a": -1.0, "gone": 1.0}, "Others": {"a": -1.0}}
HIGH = {"A": (3, 0, 0), "B": (0, 3, 0), "C": (0, 0, 3)}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(6)
    rows = []
    for t, n in (("A", 400), ("B", 150), ("C", 80)):
        rows += [(t, *map(float, rng.normal(HIGH[t], 0.4))) for _ in range(n)]
    rows += [("A+B", *map(float, rng.normal((1.5, 1.5, 0), 0.3))) for _ in range(60)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, y string, a double, b double, c double").repartition(4).cache()


def test_objective_never_falls(planted):
    model = fit_marker_mixture(planted, MATRIX, rounds=12)
    assert len(model.objective) == 13 and all(b >= a - 1e-7 * abs(a) for a, b in zip(model.objective, model.objective[1:]))
    assert model.objective[-1] > model.objective[0] and model.types == ["A", "B", "C"] and model.markers == ["a", "b", "c"]


def test_one_round_equals_numpy(planted):
    start, after = fit_marker_mixture(planted, MATRIX, rounds=0), fit_marker_mixture(planted, MATRIX, rounds=1)
    x = np.array([r[:] for r in planted.select("a", "b", "c").collect()])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    r, log = start.responsibilities(x)
    assert start.objective[0] == pytest.approx(log.sum())  # prior means: no penalty
    centre = start.parts @ start.means
    assert np.allclose(np.log(start.shares)[None] - 0.5 * (((x[:, None] - centre[None]) ** 2).sum(axis=2) + 3 * np.log(2 * np.pi)), start.logs(x))
    assert np.allclose(after.shares, r.sum(axis=0) / len(x))
    means = np.linalg.solve(start.parts.T @ (r.sum(axis=0)[:, None] * start.parts) + 10 * np.eye(3), start.parts.T @ (r.T @ x) + 10 * start.prior)
    assert np.allclose(after.means, means)
    centre = start.parts @ means
    assert np.allclose(after.variance, (r[:, :, None] * (x[:, None] - centre[None]) ** 2).sum(axis=(0, 1)) / len(x))


def test_types_and_merged_rows(planted):
    out = fit_marker_mixture(planted, MATRIX).predict(planted).cache()
    right = {r.y: r.s for r in out.groupBy("y").agg(F.avg((F.col("y") == F.col("predicted_phenotype")).cast("double")).alias("s")).collect()}
    assert all(right[t] > 0.95 for t in "ABC")
    merged = out.groupBy((F.col("y") == "A+B").alias("m")).agg(F.avg("doublet").alias("d")).collect()
    assert {r.m: r.d > 0.8 for r in merged} == {True: True, False: False}
    assert out.where("abs(aggregate(responsibilities, 0D, (s, v) -> s + v) - 1) > 1e-9").count() == 0


def test_missing_markers_and_edges(spark, planted):
    odd = planted.withColumn("b", F.when(F.col("id") % 5 > 0, F.col("b"))).withColumn("c", F.when(F.col("id") % 7 > 0, F.col("c")))
    model = fit_marker_mixture(odd, MATRIX, rounds=8)
    assert all(b >= a - 1e-7 * abs(a) for a, b in zip(model.objective, model.objective[1:]))
    out = model.predict(odd)
    assert out.count() == 690 and out.where("predicted_phenotype is null").count() == 0
    with pytest.raises(ValueError):
        fit_marker_mixture(planted.where("false"), MATRIX)
    assert len(fit_marker_mixture(planted, MATRIX, rounds=2, doublets=False).parts) == 3
