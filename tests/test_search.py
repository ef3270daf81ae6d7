"""Successive halving: nested shares, survivors by rank, and a parameter that matters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import models as ML
from cellgauge.operators.search import halving_search, log_uniform, rungs


def test_draws_and_rungs():
    drawn = log_uniform({"a": (1e-6, 1e2), "b": (1, 10)}, 500, 3)
    logs = np.log10([d["a"] for d in drawn])
    assert logs.min() < -5 and logs.max() > 1 and abs(logs.mean() + 2) < 0.5 and all(1 <= d["b"] <= 10 for d in drawn)
    assert drawn == log_uniform({"a": (1e-6, 1e2), "b": (1, 10)}, 500, 3)
    assert [n for n, _ in rungs(9, 1 / 3, 1 / 9)] == [9, 3, 1] and rungs(9, 1 / 3, 1 / 9)[-1][1] == 1.0
    assert rungs(4, 0.5, 1.0) == [(4, 1.0)]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "abc"[i % 3], *map(float, rng.normal(np.eye(3)[i % 3] * 2, 1.0))) for i in range(900)]
    return ML.with_features(spark.createDataFrame(rows, "id bigint, cls string, m1 double, m2 double, m3 double"), ["m1", "m2", "m3"])


def test_survivors_follow_from_the_scores(blobs):
    best, table = halving_search(
        blobs.where("id % 4 > 0"), blobs.where("id % 4 = 0"), "cls", ["id"], lambda t, p: ML.logistic_regression(maxIter=20, **p).fit(t), {"regParam": (1e-4, 1e3)}, trials=6, keep=0.5, share=0.25)
    rows = table.orderBy("rung", "place").collect()
    assert [sum(r.rung == i for r in rows) for i in range(3)] == [6, 3, 2]
    for i in range(3):
        own = [r for r in rows if r.rung == i]
        assert [r.trial for r in own] == [r.trial for r in sorted(own, key=lambda r: (-r.score, r.trial))]
        assert {r.trial for r in own if r.survives} == ({r.trial for r in rows if r.rung == i + 1} if i < 2 else {own[0].trial})
    trained = [next(r.trained for r in rows if r.rung == i) for i in range(3)]
    assert trained[0] < trained[1] < trained[2] == 675 and abs(trained[0] - 169) < 40
    assert rows[-1].rung == 2 and best["regParam"] == next(r.regParam for r in rows if r.rung == 2 and r.survives)
    assert max(r.score for r in rows) > 0.75 and not math.isnan(min(r.score for r in rows))
