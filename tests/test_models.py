"""Fitted labellers on separable classes, and labels from clusters and prior knowledge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import models as ML
from cellgauge.operators import signatures as G
from cellgauge.operators.cleaning import check_features, split_columns
from cellgauge.operators.joins import average_runs
from cellgauge.operators.transforms import batch_correct


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c, (n, centre) in {"a": (300, (0, 0, 0)), "b": (60, (6, 0, 2)), "c": (40, (0, 7, -3))}.items():
        for x in rng.normal(centre, 1.0, (n, 3)):
            rows.append((len(rows), c, *map(float, x)))
    df = spark.createDataFrame(rows, "id bigint, cls string, m1 double, m2 double, m3 double")
    return ML.with_features(df.withColumn("fold", F.col("id") % 4), ["m1", "m2", "m3"]).cache()


def accuracy(df):
    return df.select(F.avg((F.col("cls") == F.col("predicted_phenotype")).cast("double"))).first()[0]


FITTERS = {
    "logistic": lambda t: ML.logistic_regression(maxIter=20).fit(t),
    "forest": lambda t: ML.random_forest(numTrees=10, maxDepth=4).fit(t),
    "network": lambda t: ML.neural_network(3, 3, (8,), maxIter=60).fit(t),
    "boosted": lambda t: ML.BoostedClasses(maxIter=5, maxDepth=3).fit(t.withColumn("val", F.col("fold") == 1), "val"),
}


@pytest.mark.parametrize("name", FITTERS)
def test_classifiers(blobs, name):
    train, codes = ML.prepare(blobs.where("fold <> 0"), "cls")
    out = ML.predict(FITTERS[name](train), blobs.where("fold = 0"), codes)
    assert accuracy(out) > 0.9
    lo, hi = out.select(F.min("confidence"), F.max("confidence")).first()
    assert 1 / 3 - 1e-9 <= lo and hi <= 1 + 1e-9


def test_balanced_weights(blobs):
    train, _ = ML.prepare(blobs, "cls")
    w = {r.cls: r.w for r in train.groupBy("cls").agg(F.first("weight").alias("w")).collect()}
    assert w["a"] == pytest.approx(400 / (3 * 300)) and w["c"] == pytest.approx(400 / (3 * 40))


def test_fold_runner(blobs):
    preds, times = ML.run_folds(blobs, "cls", "fold", lambda t, s: ML.logistic_regression(maxIter=10).fit(t), n_runs=2)
    assert preds.count() == 800 and preds.select("run", "id").distinct().count() == 800
    assert accuracy(preds) > 0.9
    assert times.where("event = 'training_time'").count() == 8


def test_grid_search(blobs):
    train, _ = ML.prepare(blobs.withColumn("fold", F.col("fold").cast("int")), "cls")
    cv = ML.grid_search(train, ML.logistic_regression(maxIter=10), {"regParam": [0.0, 50.0], "elasticNetParam": [1.0]})
    assert cv.avgMetrics[0] > cv.avgMetrics[1]


@pytest.mark.parametrize("cluster", ["kmeans", "mixture", "meta"])
def test_clusters_to_labels(blobs, cluster):
    df = {
        "kmeans": lambda: ML.kmeans_clusters(blobs, 3),
        "mixture": lambda: ML.mixture_clusters(blobs, 3),
        "meta": lambda: ML.meta_clusters(blobs, 20, 3),
    }[cluster]()
    assert accuracy(G.assign_majority(df, "cluster", "cls")) > 0.85


def test_components(blobs):
    assert ML.principal_components(blobs, 2).select(F.size("components")).first()[0] == 2


def test_learning_curve(blobs):
    df = blobs.withColumn("image", F.col("id") % 20)
    out = ML.learning_curve(df.where("fold <> 0"), "cls", "image", [0.2, 1.0], lambda t, s: ML.logistic_regression(maxIter=10).fit(t), df.where("fold = 0"))
    assert [r.share for r in out.orderBy("share").collect()] == [0.2, 1.0]


def test_cluster_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "a")], "cluster int, lb string")
    first = {r.cluster: r.mapped for r in G.majority_mapping(df, "cluster", "lb").collect()}
    assert first == {1: "a", 2: "c"}
    assert {r.mapped for r in G.majority_mapping(df, "cluster", "lb", "random").where("cluster = 1").collect()} <= {"a", "b"}
    with pytest.raises(Exception, match="tie in cluster 1"):
        G.majority_mapping(df, "cluster", "lb", "raise").collect()
    with pytest.raises(ValueError):
        G.majority_mapping(df, "cluster", "lb", "other")


def test_signatures_without_markers(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, None), (3, -2.0, 5.0)], "id int, m1 double, m2 double")
    out = {r.id: r.predicted_phenotype for r in G.score_signatures(df, {"p": {"m1": 1.0}, "q": {"m2": 1.0, "absent": 1.0}}, 0.5, standardise=False).collect()}
    assert out == {1: "p", 2: "undefined", 3: "q"}


def test_stratified_baseline_shares(spark):
    df = spark.range(8000).select("id", (F.col("id") % 4).alias("fold"), F.when(F.col("id") % 10 < 7, "x").otherwise("y").alias("lb"))
    out = G.stratified_baseline(df, "lb", "fold", ["id"])
    share = out.select(F.avg((F.col("predicted_phenotype") == "x").cast("double"))).first()[0]
    assert out.count() == 8000 and share == pytest.approx(0.7, abs=0.03)


def test_average_runs_with_and_without_size(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.25, 0.75])], "id int, v array<double>")
    for size in (None, 2):
        assert {r.id: r.v for r in average_runs(df, ["id"], "v", size).collect()} == {1: [0.5, 0.5], 2: [0.25, 0.75]}


def test_batch_correction_removes_shift(spark):
    rng = np.random.default_rng(3)
    rows = [(b, float(v)) for b, shift in (("p", 0.0), ("q", 5.0), ("r", -3.0)) for v in rng.normal(10 + shift, 1, 200)]
    df = spark.createDataFrame(rows, "batch string, m double")
    means = [r.m for r in batch_correct(df, ["m"], "batch").groupBy("batch").agg(F.avg("m").alias("m")).collect()]
    assert max(means) - min(means) < 0.2
    assert np.mean(means) == pytest.approx(np.mean([v for _, v in rows]), abs=0.1)


def test_feature_checks(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b")], "m double, s string")
    with pytest.raises(TypeError):
        check_features(df, ["s"])
    with pytest.raises(Exception, match="null in feature m"):
        check_features(df, ["m"]).collect()
    assert split_columns(df, "s") == (["m"], ["s"]) and split_columns(df, "s", inclusive=True) == (["m", "s"], [])


def test_train_and_evaluate(blobs):
    from cellgauge.plans.labelling import fold_report, make_folds, train_and_evaluate

    df = blobs.select("id", "cls", "m1", "m2", "m3", (F.col("id") % 30).alias("grp"))
    folds = make_folds(df, "cls", ["id"], "grp", 3)
    parts = {(r.fold, r.split): r["count"] for r in folds.groupBy("fold", "split").count().collect()}
    assert len(parts) == 9 and sum(v for (f, s), v in parts.items() if s == "test") == 400
    leaks = folds.where("split = 'test'").select("fold", "grp").intersect(folds.where("split <> 'test'").select("fold", "grp"))
    assert leaks.count() == 0
    preds, metrics = train_and_evaluate(folds, "cls", ["m1", "m2", "m3"], lambda t, s: ML.logistic_regression(maxIter=10).fit(t))
    assert preds.count() == 400 and accuracy(preds) > 0.9
    assert fold_report(metrics).first().accuracy_mean > 0.9


def test_cluster_and_transfer(blobs):
    from cellgauge.plans.labelling import cluster_and_transfer

    df = blobs.select("id", "cls", F.array("m1", "m2", "m3").alias("v"))
    out = cluster_and_transfer(df, "id", "v", "cls", rows=250, k=10)
    assert out.count() == 400 and accuracy(out) > 0.85


def test_matrix_from_table(spark):
    df = spark.createDataFrame([("t", "m1", 1.0), ("t", "m2", -1.0)], "cell_type string, marker string, weight double")
    assert G.matrix_from_table(df) == {"t": {"m1": 1.0, "m2": -1.0}}
