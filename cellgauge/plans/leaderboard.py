"""Scores and rankings of methods from fold-level metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# fixed values: published weights of the overall score (they sum to 0.76)
OVERALL_WEIGHTS = {"f1_weighted": 0.16, "macro_f1": 0.20, "mcc": 0.20, "ari": 0.08, "jsd_scaled": 0.12}

# fixed values: metrics of the plain mean scores
NINE_METRICS = ("f1_weighted", "accuracy", "macro_f1", "mcc", "kappa", "r2", "pearson_corr", "ari")
TEN_METRICS = ("f1_weighted", "accuracy", "macro_f1", "mcc", "kappa", "r2", "pearson_corr", "ari", "nmi")

# fixed values: category weights of the weighted score
CATEGORY_WEIGHTS = {
    "Classification Performance": {
        "macro_f1_mean": 0.10, "mcc_mean": 0.10, "kappa_mean": 0.10, "f1_weighted_mean": 0.06, "accuracy_mean": 0.04,
    },
    "Cell Type Composition": {"r2_mean": 0.06, "pearson_corr_mean": 0.06, "ari_mean": 0.09, "nmi_mean": 0.09},
    "Stability": {"stability": 0.20},
    "Scalability": {"runtime": 0.10},
}

SECONDS_PER_DAY = 86400.0


def stability(std: str | Column, threshold: float = 0.2, clip: bool = True) -> Column:
    """1 minus the deviation in units of ``threshold``, not below 0 when clipped."""
    std = F.col(std) if isinstance(std, str) else std
    score = 1 - std / threshold
    return F.when(score < 0, F.lit(0.0)).otherwise(score) if clip else score


def mean_times(times: DataFrame, by: Sequence[str], strict: bool = False) -> DataFrame:
    """Mean training and inference seconds.

    By default the inference mean covers every event, as the published numbers
    do; ``strict`` leaves the training events out.
    """
    is_train = F.col("event").isin("train_time", "training_time")
    rest = F.avg(F.when(~is_train, F.col("seconds"))) if strict else F.avg("seconds")
    return times.groupBy(*by).agg(F.avg(F.when(is_train, F.col("seconds"))).alias("train_time"), rest.alias("inference_time"))


def scalability(automation: str | Column, seconds: str | Column) -> Column:
    automation = F.col(automation) if isinstance(automation, str) else automation
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return 0.5 * automation + 0.5 * F.greatest(F.lit(0.0), 1 - seconds / SECONDS_PER_DAY)


def add_scalability(
    summary: DataFrame, automation: DataFrame, seconds: str = "inference_time", name: str = "method", out: str = "scalability"
) -> DataFrame:
    """Scalability from a table ``method, automation``; null for a method without an entry."""
    scores = automation.select(name, F.col("automation").alias("_automation"))
    return summary.join(scores, name, "left").withColumn(out, scalability("_automation", seconds)).drop("_automation")


def weighted_sum(weights: Mapping[str, float], suffix: str = "") -> Column:
    terms = [F.col(f"{m}{suffix}") * w for m, w in weights.items()]
    return sum(terms[1:], terms[0])


def mean_score(metrics: Sequence[str], suffix: str = "_mean", extra: Sequence[str] = ("stability",)) -> Column:
    terms = [F.col(f"{m}{suffix}") for m in metrics] + [F.col(e) for e in extra]
    return sum(terms[1:], terms[0]) / len(terms)


def category_score(df: DataFrame, weights: Mapping[str, Mapping[str, float]] | None = None, out: str = "weighted_score") -> DataFrame:
    """Weighted score over the metrics that exist as columns; a null metric makes it null."""
    flat = {m: w for group in (weights or CATEGORY_WEIGHTS).values() for m, w in group.items() if m in df.columns}
    return df.withColumn(out, weighted_sum(flat) if flat else F.lit(0.0))


def row_average(metrics: Sequence[str]) -> Column:
    """Mean of the metrics that are not null, 0 when none is."""
    values = F.filter(F.array(*[F.col(m).cast("double") for m in metrics]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))


def rank_methods(df: DataFrame, metrics: Sequence[str], by: Sequence[str], name: str = "method") -> DataFrame:
    """Rank by the average of the available metrics within ``by``; ties by name."""
    averaged = df.withColumn("average", row_average(metrics))
    order = W.partitionBy(*by).orderBy(F.desc(F.round("average", 12)), name)
    return averaged.withColumn("rank", F.row_number().over(order))


def group_order(groups: Mapping[str, Sequence[str]], name: str = "method") -> tuple[Column, Column]:
    """Position of a method's group and of the method in it; unknown ones come last."""
    far = F.lit(2**31 - 1)
    group_at = {m: i for i, ms in enumerate(groups.values()) for m in ms}
    place_at = {m: j for ms in groups.values() for j, m in enumerate(ms)}

    def look(positions: Mapping[str, int]) -> Column:
        pairs = [F.lit(v) for kv in positions.items() for v in kv]
        return F.coalesce(F.create_map(*pairs)[F.col(name)], far)

    return look(group_at), look(place_at)


def sort_by_groups(df: DataFrame, groups: Mapping[str, Sequence[str]], name: str = "method") -> DataFrame:
    """Add ``position``: the display order by method group, place in the group and name."""
    g, p = group_order(groups, name)
    return df.withColumn("position", F.row_number().over(W.orderBy(g, p, name)))


def sort_by_score(df: DataFrame, score: str, level: str = "level", name: str = "method") -> DataFrame:
    return df.orderBy(level, F.desc(score), name)


def select_rows(
    df: DataFrame,
    dataset: str | None = None,
    level: str | None = None,
    groups: Mapping[str, Sequence[str]] | None = None,
    chosen: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of a dataset, a level and the chosen method groups."""
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if level is not None:
        df = df.where(F.col("level") == level)
    if chosen:
        df = df.where(F.col("method").isin([m for g in chosen for m in (groups or {}).get(g, ())]))
    return df


def per_class_table(
    per_class: DataFrame, classes: Sequence[str], name: str = "method", label: str = "label"
) -> DataFrame:
    """One row per method: mean F1 of each class, and the average over the classes it has.

    Classes without support anywhere are null.
    """
    supported = per_class.groupBy(label).agg(F.max("support").alias("max_support")).where(F.col("max_support") > 0)
    kept = per_class.join(supported.select(label), label, "left_semi")
    wide = kept.groupBy(name).pivot(label, list(classes)).agg(F.avg("f1"))
    return wide.withColumn("average", row_average(list(classes)))


def class_support(per_class: DataFrame, label: str = "label") -> DataFrame:
    return per_class.groupBy(label).agg(F.max("support").alias("max_support")).where(F.col("max_support") > 0)


def normalise_visible(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """All visible metrics to [0, 1] by their common smallest and largest value."""
    lo, hi = F.least(*metrics), F.greatest(*metrics)
    s = df.select(F.struct(F.min(lo).alias("lo"), F.max(hi).alias("hi"))).scalar()
    top = F.when(s["hi"] > s["lo"], s["hi"]).otherwise(s["lo"] + 1)
    return df.withColumns({m: F.greatest(F.least((F.col(m) - s["lo"]) / (top - s["lo"]), F.lit(1.0)), F.lit(0.0)) for m in metrics})


def average_over_datasets(df: DataFrame, metrics: Sequence[str], name: str = "method", digits: int = 3) -> DataFrame:
    return df.groupBy(name).agg(*[F.round(F.avg(m), digits).alias(m) for m in metrics])


def metric_range(df: DataFrame, metric: str, name: str = "method", out: str = "range") -> DataFrame:
    """Spread of a metric of each method across levels."""
    return df.groupBy(name).agg((F.max(metric) - F.min(metric)).alias(out))
