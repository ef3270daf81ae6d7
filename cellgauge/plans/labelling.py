"""Workflows that label a table: train and evaluate, cluster and assign."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.cleaning import drop_unknown
from cellgauge.operators.metrics import confusion_counts, label_metrics, mean_std
from cellgauge.operators.models import Fitter, code_with, prepare, predict, with_features
from cellgauge.operators.signatures import majority_mapping
from cellgauge.operators.spatial import transfer_labels
from cellgauge.operators.splits import sample_n, stratified_group_kfold, stratified_kfold, validation_split
from cellgauge.operators.transforms import standard_scale
from cellgauge.operators.vectors import communities, knn_vectors
from cellgauge.session import stage

def make_folds(
    df: DataFrame, label: str, key: Sequence[str], group: str | None = None, k: int = 5, seed: int = 42, validation: float = 0.15
) -> DataFrame:
    """Each row once per fold with its part: ``fold`` and ``split`` (train, validation, test)."""
    known = drop_unknown(df, label)
    if group is not None:
        placed = stratified_group_kfold(known, label, group, key, k, seed, "_home")
    else:
        placed = stratified_kfold(known, label, key, k, seed, "_home")
    every = stage(placed, "folds").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    split = F.when(F.col("_home") == F.col("fold"), "test").otherwise("train")
    return validation_split(every.withColumn("split", split).drop("_home"), label, key, ["fold"], validation, seed)


def train_and_evaluate(
    folds: DataFrame, label: str, markers: Sequence[str], fitter: Fitter, seed: int = 42, balanced: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Scale by the training rows, fit, predict and score each fold: predictions, metrics.

    ``fitter`` is called with the training rows and the seed; one with
    ``validated = True`` also gets the validation rows, for early stopping. No
    model is fitted on them.
    """
    scaled = stage(standard_scale(folds, markers, by=["fold"]), "scaled")
    out = None
    for f in [r[0] for r in scaled.select("fold").distinct().orderBy("fold").collect()]:
        rows = with_features(scaled.where(F.col("fold") == f), markers)
        train, codes = prepare(rows.where("split = 'train'"), label, balanced)
        held = (code_with(rows.where("split = 'validation'"), label, codes),) if getattr(fitter, "validated", False) else ()
        predicted = predict(fitter(train, seed, *held), rows.where("split = 'test'"), codes).drop("features", "split")
        predicted = stage(predicted, "predictions")
        out = predicted if out is None else out.unionByName(predicted)
    metrics = label_metrics(confusion_counts(out, ["fold"], true_col=label), ["fold"])
    return out, metrics


def fold_report(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds."""
    names = ["accuracy", "macro_f1", "f1_weighted", "macro_precision", "macro_recall"]
    return mean_std(metrics, [], names, population=True)


def cluster_and_transfer(
    df: DataFrame, key: str, vec: str, label: str, rows: int | None = None, k: int = 15, votes: int = 5, rounds: int = 8, seed: int = 42
) -> DataFrame:
    """Label rows by the majority label of their community.

    All rows are clustered, unless the caller names a number of ``rows``: then
    communities are found on that sample, and every row outside it takes the
    majority label of its ``votes`` nearest sampled rows.
    """
    table = stage(df.select(key, vec, label), "vectors")
    sample = table if rows is None else stage(sample_n(table, rows, [key], seed), "sample")
    found = communities(sample, key, vec, k, rounds).withColumnRenamed("id", key)
    clustered = stage(sample.join(found, key), "clustered")
    names = stage(majority_mapping(clustered, "community", label), "names")
    mapped = clustered.join(names, "community").select(key, vec, F.col("mapped").alias("predicted_phenotype"))
    if rows is None:
        return table.select(key, label).join(mapped.select(key, "predicted_phenotype"), key)
    rest = table.join(mapped.select(key), key, "left_anti")
    near = knn_vectors(rest, mapped.select(key, vec), key, vec, votes, same_table=False)
    moved = transfer_labels(near, mapped, key, "predicted_phenotype")
    predicted = mapped.select(key, "predicted_phenotype").unionByName(moved)
    return table.select(key, label).join(predicted, key)
