"""Fitted labellers on MLlib: classifiers, clusterings and their fold runner."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.functions.exprs import argmax
from cellgauge.operators.aggregates import class_weights
from cellgauge.operators.cleaning import label_dictionary
from cellgauge.session import even, stage

FEATURES = "features"


def with_features(df: DataFrame, markers: Sequence[str] | None = None, vec: str | None = None) -> DataFrame:
    """Add the feature vector from marker columns or an array column."""
    if vec is not None:
        return df.withColumn(FEATURES, array_to_vector(F.transform(vec, lambda v: v.cast("double"))))
    return VectorAssembler(inputCols=list(markers), outputCol=FEATURES).transform(df)


def prepare(train: DataFrame, label: str, balanced: bool = True) -> tuple[DataFrame, DataFrame]:
    """Training rows with ``code`` and ``weight``, and the label dictionary."""
    codes = stage(label_dictionary(train, label), "codes")
    out = train.join(codes.select(F.col("phenotype").alias(label), F.col("label").cast("double").alias("code")), label)
    if balanced:
        weights = stage(class_weights(train, label).select(label, "weight"), "weights")
        out = out.join(weights, label)
    else:
        out = out.withColumn("weight", F.lit(1.0))
    return out, codes


def code_with(rows: DataFrame, label: str, codes: DataFrame) -> DataFrame:
    """Rows with the ``code`` that the training labels gave their label, and weight 1; unseen labels go."""
    known = codes.select(F.col("phenotype").alias(label), F.col("label").cast("double").alias("code"))
    return rows.join(known, label).withColumn("weight", F.lit(1.0))


def predict(model: Model, rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Add ``predicted_phenotype`` and ``confidence`` (highest probability)."""
    scored = model.transform(rows)
    probs = vector_to_array("probability")
    names = codes.agg(F.map_from_entries(F.collect_list(F.struct("label", "phenotype"))).alias("m")).select("m").scalar()
    return scored.select(
        *rows.columns,
        names[F.col("prediction").cast("int")].alias("predicted_phenotype"),
        F.array_max(probs).alias("confidence"),
    )


# -- classifiers -----------------------------------------------------------


def logistic_regression(**params) -> LogisticRegression:
    return LogisticRegression(
        featuresCol=FEATURES, labelCol="code", weightCol="weight", family="multinomial", **({"maxIter": 100} | params)
    )


def random_forest(**params) -> RandomForestClassifier:
    """200 balanced trees with at least 2 rows per leaf unless told otherwise."""
    defaults = {"numTrees": 200, "minInstancesPerNode": 2, "maxDepth": 10, "seed": 42, "impurity": "entropy"}
    return RandomForestClassifier(featuresCol=FEATURES, labelCol="code", weightCol="weight", **(defaults | params))


def neural_network(n_features: int, n_classes: int, hidden: Sequence[int] = (64, 32), **params) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(
        featuresCol=FEATURES, labelCol="code", layers=[n_features, *hidden, n_classes], **({"seed": 42, "maxIter": 100} | params)
    )


class BoostedClasses:
    """One boosted binary model per class; the highest margin wins.

    With a validation flag each model stops early on those rows.
    """

    def __init__(self, parallelism: int = 4, **params):
        self.parallelism = parallelism
        self.params = {"maxIter": 20, "maxDepth": 5, "seed": 42} | params

    def fit(self, train: DataFrame, validation: str | None = None) -> BoostedClassesModel:
        train = train.persist()
        n = int(train.agg(F.max("code")).first()[0]) + 1
        extra = {"validationIndicatorCol": validation} if validation else {}

        def one(c: int):
            gbt = GBTClassifier(featuresCol=FEATURES, labelCol="_is", weightCol="weight", **self.params, **extra)
            return gbt.fit(train.withColumn("_is", (F.col("code") == c).cast("double")))

        try:
            # threads only start jobs, as a cross-validator's do
            with ThreadPool(min(n, self.parallelism)) as pool:
                return BoostedClassesModel(pool.map(inheritable_thread_target(train.sparkSession)(one), range(n)))
        finally:
            train.unpersist()


class BoostedClassesModel:
    def __init__(self, models: Sequence):
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.models):
            m = m.copy()
            m.setPredictionCol(f"_p{i}").setProbabilityCol(f"_q{i}").setRawPredictionCol(f"_r{i}")
            out = m.transform(out).withColumn(f"_s{i}", vector_to_array(f"_q{i}")[1]).drop(f"_p{i}", f"_q{i}", f"_r{i}")
        scores = F.array(*[F.col(f"_s{i}") for i in range(len(self.models))])
        total = F.aggregate("_scores", F.lit(1e-300), lambda a, v: a + v)
        out = out.withColumn("_scores", scores)
        return out.select(
            *df.columns, argmax("_scores").cast("double").alias("prediction"),
            array_to_vector(F.transform("_scores", lambda v: v / total)).alias("probability"),
        )


def grid_search(
    train: DataFrame, estimator, grid: Mapping[str, Sequence], fold: str = "fold", metric: str = "f1", parallelism: int = 2
):
    """Best model over a parameter grid on the given folds; returns the fitted cross-validator."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    folds = train.select(fold).distinct().count()
    ev = MulticlassClassificationEvaluator(labelCol="code", metricName=metric)
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=builder.build(), evaluator=ev, numFolds=folds, foldCol=fold, parallelism=parallelism
    )
    # once in memory and on all cores; every fit goes over its folds many times
    rows = even(train).persist()
    try:
        return cv.fit(rows)
    finally:
        rows.unpersist()


# -- clusters --------------------------------------------------------------


def kmeans_clusters(df: DataFrame, k: int, seed: int = 42, out: str = "cluster", **params) -> DataFrame:
    model = KMeans(k=k, seed=seed, featuresCol=FEATURES, predictionCol=out, **params).fit(df)
    return model.transform(df)


def mixture_clusters(df: DataFrame, k: int, seed: int = 42, out: str = "cluster", **params) -> DataFrame:
    model = GaussianMixture(k=k, seed=seed, featuresCol=FEATURES, predictionCol=out, probabilityCol="_mix", **params).fit(even(df.select(FEATURES)))
    return model.transform(df).drop("_mix")


def meta_clusters(df: DataFrame, fine: int, k: int, seed: int = 42, out: str = "cluster") -> DataFrame:
    """Many fine clusters, then ``k`` clusters of their weighted centres."""
    spark = df.sparkSession
    first = KMeans(k=fine, seed=seed, featuresCol=FEATURES, predictionCol="fine_cluster").fit(df)
    sized = first.transform(df)
    sizes = sized.groupBy("fine_cluster").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    centres = spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(first.clusterCenters())], "fine_cluster int, centre array<double>"
    )
    points = centres.join(sizes, "fine_cluster").withColumn(FEATURES, array_to_vector("centre"))
    second = BisectingKMeans(k=k, seed=seed, featuresCol=FEATURES, predictionCol=out, weightCol="weight").fit(points)
    mapping = stage(second.transform(points).select("fine_cluster", out), "meta")
    return sized.join(mapping, "fine_cluster")


def principal_components(df: DataFrame, k: int, out: str = "components") -> DataFrame:
    model = PCA(k=k, inputCol=FEATURES, outputCol="_pca").fit(df)
    return model.transform(df).withColumn(out, vector_to_array("_pca")).drop("_pca")


# -- folds and runs --------------------------------------------------------

Fitter = Callable[[DataFrame, int], Model]


def run_folds(
    df: DataFrame, label: str, fold: str, fitter: Fitter, n_runs: int = 1, seed: int = 42, balanced: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Train on all other folds, predict each fold: predictions and timings.

    ``df`` has the feature vector. Runs beyond the first use ``seed + run``. The
    loop only starts Spark jobs; predictions of a fold are written before the
    next one starts.
    """
    spark = df.sparkSession
    data = stage(df, "features")
    folds = [r[0] for r in data.select(fold).distinct().orderBy(fold).collect()]
    times, parts = [], None
    for run in range(n_runs):
        for f in folds:
            start = time.perf_counter()
            train, codes = prepare(data.where(F.col(fold) != f), label, balanced)
            model = fitter(train, seed + run)
            trained = time.perf_counter()
            predicted = predict(model, data.where(F.col(fold) == f), codes).drop(FEATURES)
            predicted = stage(predicted.withColumn("run", F.lit(run)), "predictions")
            times += [(run, f, "training_time", trained - start), (run, f, "prediction_time", time.perf_counter() - trained)]
            parts = predicted if parts is None else parts.unionByName(predicted)
    kind = df.schema[fold].dataType.simpleString()
    return parts, spark.createDataFrame(times, f"run int, fold {kind}, event string, seconds double")


def learning_curve(
    df: DataFrame, label: str, image: str, shares: Sequence[float], fitter: Fitter, test: DataFrame, seed: int = 42
) -> DataFrame:
    """Macro F1 on ``test`` after training on growing shares of the images."""
    from cellgauge.operators.metrics import confusion_counts, label_metrics
    from cellgauge.operators.splits import sample_groups

    out = None
    for share in shares:
        part = sample_groups(df, image, share, seed)
        train, codes = prepare(part, label)
        predicted = predict(fitter(train, seed), test, codes).withColumn("share", F.lit(float(share)))
        counts = confusion_counts(predicted, ["share"], true_col=label)
        scored = label_metrics(counts, ["share"]).select("share", "n_rows", "macro_f1", "f1_weighted")
        scored = stage(scored, "curve")
        out = scored if out is None else out.unionByName(scored)
    return out


def learning_curve_rows(
    df: DataFrame, label: str, key: Sequence[str], sizes: Sequence[int], fitter: Fitter, test: DataFrame, seed: int = 42
) -> DataFrame:
    """Scores on ``test`` after training on growing numbers of rows, each sample holding the ones before."""
    from cellgauge.operators.metrics import confusion_counts, label_metrics
    from cellgauge.operators.splits import sample_n

    out = None
    for size in sizes:
        part = stage(sample_n(df, size, key, seed), "curve_rows")
        train, codes = prepare(part, label)
        predicted = predict(fitter(train, seed), test, codes).withColumn("size", F.lit(int(size)))
        scored = label_metrics(confusion_counts(predicted, ["size"], true_col=label), ["size"]).select("size", "n_rows", "macro_f1", "f1_weighted")
        scored = stage(scored.withColumn("trained", F.lit(part.count())), "curve")
        out = scored if out is None else out.unionByName(scored)
    return out
