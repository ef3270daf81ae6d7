"""Softmax boosting: its sums and splits against plain numpy, its losses, and classes that need more than one cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import models as ML
from cellgauge.operators.boosting import SoftmaxTrees, Tree, _softmax


@pytest.fixture(scope="module")
def rings(spark):
    """Four classes: in three of them distance decides, so no single cut does; the last is rare."""
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (900, 3))
    r = np.hypot(x[:, 0], x[:, 1])
    y = np.where(r < 0.4, "a", np.where(r < 0.8, "b", "c")).astype(object)
    y[(x[:, 2] > 0.9) & (r > 0.5)] = "d"
    df = spark.createDataFrame([(i, str(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))], "id bigint, cls string, m1 double, m2 double, m3 double")
    return ML.with_features(df.withColumn("fold", F.col("id") % 4), ["m1", "m2", "m3"]).cache()


def macro(df):
    return df.groupBy("cls").agg(F.avg((F.col("cls") == F.col("predicted_phenotype")).cast("double")).alias("r")).agg(F.avg("r")).first()[0]


def test_losses_fall_and_beat_one_model_per_class(rings):
    train, codes = ML.prepare(rings.where("fold <> 0"), "cls")
    model = SoftmaxTrees(rounds=6, depth=3).fit(train.withColumn("val", F.col("fold") == 1), "val")
    losses = [a for a, _ in model.losses]
    assert losses[0] == pytest.approx(np.log(4)) and all(b < a for a, b in zip(losses, losses[1:]))
    assert all(b is not None for _, b in model.losses)
    out = ML.predict(model, rings.where("fold = 0"), codes)
    each = ML.BoostedClasses(maxIter=6, maxDepth=3).fit(train.withColumn("val", F.col("fold") == 1), "val")
    assert macro(out) >= macro(ML.predict(each, rings.where("fold = 0"), codes)) - 0.02 and macro(out) > 0.75
    p = model.transform(rings.limit(50)).select("probability").collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in p)


def test_first_round_equals_numpy(rings):
    """One round of depth 1: the best of all cuts, by brute force over rows."""
    train, codes = ML.prepare(rings, "cls", balanced=False)
    model = SoftmaxTrees(rounds=1, depth=1, bins=8, ridge=1.0, rate=1.0).fit(train)
    rows = train.select("code", "m1", "m2", "m3").collect()
    y, x = np.array([int(r.code) for r in rows]), np.array([r[1:] for r in rows])
    for c, tree in enumerate(model.trees[0]):
        g, h = 0.25 - (y == c), np.full(len(y), 0.25 * 0.75)
        best = max((sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (x[:, f] <= e, x[:, f] > e)), f, i, e) for f, edges in enumerate(model.edges) for i, e in enumerate(edges))
        left = x[:, best[1]] <= best[3]
        assert (tree.feature[0], tree.cut[0]) == best[1:3]
        assert tree.value[1:] == pytest.approx([-g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])
    scores = np.stack([np.where(x[:, t.feature[0]] <= model.edges[t.feature[0]][t.cut[0]], t.value[1], t.value[2]) for t in model.trees[0]], axis=1)
    assert model.losses[1][0] == pytest.approx(-np.log(_softmax(scores)[np.arange(len(y)), y]).mean())


def test_early_stop_and_few_rows(spark, rings):
    train, _ = ML.prepare(rings, "cls")
    noise = train.withColumn("val", F.col("fold") == 1).withColumn("code", F.pmod(F.xxhash64("id"), F.lit(3)).cast("double"))
    model = SoftmaxTrees(rounds=30, depth=3, patience=2).fit(noise, "val")
    held = [b for _, b in model.losses]
    assert len(model.trees) == int(np.argmin(held)) < 30  # nothing can be learnt: held-out rows end the fit
    one = SoftmaxTrees(rounds=3).fit(train.where("code = 0"))
    assert one.trees == [] and one.transform(train.limit(3)).where("prediction = 0").count() == 3
    with pytest.raises(ValueError):
        SoftmaxTrees().fit(train.where("false"))


def test_tree_walk():
    t = Tree()
    left = t.split(0, 1, 3, (1.0, 2.0))
    t.split(left + 1, 0, 0, (5.0, 6.0))
    assert np.array(t.value)[t.leaf(np.array([[0, 3], [0, 4], [1, 4]], np.uint8))].tolist() == [1.0, 5.0, 6.0]
