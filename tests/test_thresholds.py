"""Segmented lines against all cuts, and thresholds between absent and present types."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators.thresholds import break_points, find_thresholds, line_costs, score_by_found_thresholds


def residual(y):
    x = np.arange(len(y))
    return float(((y - np.polyval(np.polyfit(x, y, 1), x)) ** 2).sum()) if len(y) > 1 else 0.0


@pytest.mark.parametrize("parts,least", [(1, 2), (2, 3), (3, 2)])
def test_break_points_equal_all_cuts(parts, least):
    rng = np.random.default_rng(parts)
    for n in (parts * least, 11, 17):
        y = np.sort(rng.normal(size=n).cumsum())
        cost = line_costs(y)
        assert all(cost[i, j] == pytest.approx(residual(y[i:j]), abs=1e-8) for i in range(n) for j in range(i + 1, n + 1))
        best = min(sum(residual(y[a:b]) for a, b in zip((0, *cuts), (*cuts, n))) for cuts in itertools.combinations(range(1, n), parts - 1)
                   if all(b - a >= least for a, b in zip((0, *cuts), (*cuts, n))))
        cuts, total = break_points(y, parts, least)
        assert total == pytest.approx(best, abs=1e-7) and len(cuts) == parts - 1
        assert sum(residual(y[a:b]) for a, b in zip((0, *cuts), (*cuts, n))) == pytest.approx(best, abs=1e-7)
    assert break_points(np.arange(5.0), 2, 3) is None


def test_thresholds_part_absent_from_present(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for g in range(40):  # a quarter of the groups holds the type
        for v in rng.normal(5.0 + 0.05 * g if g >= 30 else 0.02 * g, 0.2, 50):
            rows.append((i, g, float(v), float(rng.normal())))
            i += 1
    df = spark.createDataFrame(rows, "id bigint, grp int, a double, b double")
    out, found = score_by_found_thresholds(df, {"A": {"a": 1.0}, "B": {"missing": 1.0}}, "grp", standardise=False)
    row = found.collect()
    assert [(r.type, r.below, r.groups) for r in row] == [("A", 30, 40)] and 1.0 < row[0].threshold < 6.0
    wrong = out.where((F.col("predicted_phenotype") == "A") != (F.col("grp") >= 30)).count()
    assert wrong == 0


def test_edges(spark):
    df = spark.createDataFrame([(i, "g", None if i % 2 else 1.0) for i in range(10)], "id bigint, grp string, a double")
    out, found = score_by_found_thresholds(df, {"A": {"a": 1.0}}, "grp")
    assert found.count() == 0 and {r.predicted_phenotype for r in out.collect()} == {"undefined"}
    points = spark.createDataFrame([("t", str(i), None if i == 3 else float(i > 6) * 5 + i / 100) for i in range(14)], "type string, group string, score double")
    assert [(r.below, r.groups) for r in find_thresholds(points).collect()] == [(6, 13)]
