"""Joins of label, prediction and feature tables.

No join here carries a broadcast hint: a side is broadcast only when the
planner's size statistics or the adaptive run-time size allow it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.cleaning import dedup_keep_first

CELL_KEY = ("sample_id", "cell_id")


def attach_labels(quant: DataFrame, labels: DataFrame, on: Sequence[str] = CELL_KEY) -> DataFrame:
    """Rows with a label only."""
    return quant.join(labels, list(on), "inner")


def attach_predictions(quant: DataFrame, preds: DataFrame, on: Sequence[str] = CELL_KEY) -> DataFrame:
    """All rows; null where no prediction exists."""
    return quant.join(preds, list(on), "left")


def keep_annotated(features: DataFrame, labels: DataFrame, on: Sequence[str] = CELL_KEY) -> DataFrame:
    return features.join(labels, list(on), "left_semi")


def labels_with_features(features: DataFrame, labels: DataFrame, on: Sequence[str] = CELL_KEY) -> DataFrame:
    """All labels; null features where the row is missing."""
    return features.join(labels, list(on), "right")


def outer_fill(left: DataFrame, right: DataFrame, on: Sequence[str], fill: float = 0) -> DataFrame:
    """Full join of two distributions, missing entries filled."""
    out = left.join(right, list(on), "full")
    values = [c for c in out.columns if c not in on]
    return out.na.fill(fill, subset=values)


def positional_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Row-by-row join of two tables that share an explicit row key."""
    return left.join(right, key, "inner")


def decode(df: DataFrame, code: str, dictionary: DataFrame, out: str, on: str = "label", name: str = "phenotype") -> DataFrame:
    """Class names for codes from a label dictionary."""
    return df.join(dictionary.select(F.col(on).alias(code), F.col(name).alias(out)), code, "left").select(*df.columns, out)


def attach_metadata(df: DataFrame, meta: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(meta, list(on), "left")


def attach_clusters(
    preds: DataFrame, clusters: DataFrame, on: Sequence[str], order: Sequence[str], rename: Mapping[str, str] | None = None
) -> DataFrame:
    """Cluster id and embedding for every prediction, first entry per key, null if none."""
    one = dedup_keep_first(clusters, list(on), list(order))
    return preds.join(one.withColumnsRenamed(dict(rename or {})), list(on), "left")


def average_runs(runs: DataFrame, key: Sequence[str], vec: str, size: int | None = None) -> DataFrame:
    """Element-wise mean of the vectors of repeated runs, one row per key.

    With a known vector ``size`` this is one aggregation with map-side combine.
    """
    if size is not None:
        elements = [F.avg(F.get(F.col(vec), F.lit(i)).cast("double")).alias(f"e{i}") for i in range(size)]
        means = runs.groupBy(*key).agg(*elements)
        return means.select(*key, F.array(*[f"e{i}" for i in range(size)]).alias(vec))
    long = runs.select(*key, F.posexplode(vec).alias("_pos", "_v"))
    means = long.groupBy(*key, "_pos").agg(F.avg("_v").alias("_v"))
    pairs = F.array_sort(F.collect_list(F.struct("_pos", "_v")))
    return means.groupBy(*key).agg(F.transform(pairs, lambda p: p["_v"]).alias(vec))
