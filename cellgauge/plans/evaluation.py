"""From a prediction table to a leaderboard in one pass over the predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.metrics import METRICS, confusion_counts, label_metrics, map_levels, mean_std
from cellgauge.plans.leaderboard import OVERALL_WEIGHTS, add_scalability, mean_times, rank_methods, stability, weighted_sum

#: level name -> label column of the hierarchy table (None: the finest label)
LEVELS: Mapping[str, str | None] = {
    "level_1": "level_1_cell_type", "level_2": "level_2_cell_type", "level_3": None,
}


def fold_metrics(
    preds: DataFrame,
    label_dim: DataFrame,
    ancestors: DataFrame | None = None,
    keys: Sequence[str] = ("method", "fold"),
    true_cols: Mapping[str, str] | None = None,
) -> DataFrame:
    """Every metric per method, fold and level."""
    counts = confusion_counts(preds, keys, extra=list((true_cols or {}).values()))
    levelled = map_levels(counts, LEVELS, label_dim, keys, true_cols)
    return label_metrics(levelled, [*keys, "level"], ancestors, F.col("level") == "level_3")


def finest_level(preds: DataFrame, folder: str = "level") -> DataFrame:
    """Of the folders of several levels only the finest (the last by name) of each dataset and method.

    Coarser levels follow from it through the hierarchy.
    """
    finest = preds.groupBy("dataset", "method").agg(F.max(folder).alias(folder))
    return preds.join(finest, ["dataset", "method", folder], "left_semi")


def summarise_folds(metrics: DataFrame, by: Sequence[str] = ("method", "level"), threshold: float = 0.2) -> DataFrame:
    """Mean and deviation over folds with the stability score."""
    summary = mean_std(metrics, by, METRICS)
    return summary.withColumn("stability", stability("f1_weighted_std", threshold))


def leaderboard(
    preds: DataFrame, label_dim: DataFrame, ancestors: DataFrame | None = None, threshold: float = 0.2,
    times: DataFrame | None = None, automation: DataFrame | None = None,
) -> DataFrame:
    """Methods per dataset (if ``preds`` names it) and level with their scores, best first.

    With ``times`` (``[dataset,] method, event, seconds``) and ``automation``
    (``method, automation``) there is a scalability score; it is null for a
    method that either lacks. A folder column ``level`` in ``preds`` is reduced
    to the finest one.
    """
    by = ["dataset"] if "dataset" in preds.columns else []
    if by and "level" in preds.columns:
        preds = finest_level(preds).drop("level")
    metrics = fold_metrics(preds, label_dim, ancestors, keys=(*by, "method", "fold"))
    summary = summarise_folds(metrics, [*by, "method", "level"], threshold)
    shown = [f"{m}_mean" for m in ("f1_weighted", "hierarchical_f1", "macro_f1", "mcc", "ari", "jsd_scaled")]
    scored = summary.withColumn("overall", weighted_sum(OVERALL_WEIGHTS, "_mean"))
    extra = ["stability"]
    if times is not None and automation is not None:
        keys = [c for c in (*by, "method") if c in times.columns]
        scored = add_scalability(scored.join(mean_times(times, keys).drop("train_time"), keys, "left"), automation).drop("inference_time")
        extra.append("scalability")
    ranked = rank_methods(scored, [*shown, "overall", *extra], [*by, "level"])
    return ranked.select(*by, "level", "rank", "method", *shown, "overall", *extra, "average")
