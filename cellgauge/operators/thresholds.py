"""Signature labels with thresholds found from the data.

The mean scores of fine groups of rows, in order, form a curve: flat where a
type is absent, rising where it is present. Straight lines are fitted to its
parts, and where they part best lies the threshold. Rows only enter by the
group means, one aggregate; the curves have as many points as there are groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.signatures import UNDEFINED, Matrix, signature_scores
from cellgauge.operators.transforms import zscore
from cellgauge.session import stage

DIGITS = 9


def line_costs(y: np.ndarray) -> np.ndarray:
    """Entry (i, j): sum of squares around the best line through points i to j - 1, numbered 1, 2, ..."""
    n = len(y)
    x = np.arange(1, n + 1, dtype=float)
    c = y - y.mean()  # less cancellation in the sums
    s = {k: np.concatenate(([0.0], np.cumsum(v))) for k, v in {"x": x, "y": c, "xx": x * x, "xy": x * c, "yy": c * c}.items()}
    d = {k: v[None, :] - v[:, None] for k, v in s.items()}
    m = np.maximum(np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None], 1)
    sxx, sxy, syy = d["xx"] - d["x"] ** 2 / m, d["xy"] - d["x"] * d["y"] / m, d["yy"] - d["y"] ** 2 / m
    slope = np.where(sxx > 1e-12, sxy / np.where(sxx > 1e-12, sxx, 1), 0)
    return np.maximum(syy - slope * sxy, 0)


def break_points(y: np.ndarray, parts: int, least: int) -> tuple[list[int], float] | None:
    """Where the ordered points ``y`` are cut into ``parts`` of ``least`` points or more with the least squares around their lines.

    Exact, by dynamic programming over the number of points and parts; among
    equal sums the earliest cuts. None if there are too few points.
    """
    n = len(y)
    if n < parts * least:
        return None
    cost = np.round(line_costs(y), DIGITS)
    best, back = cost[0].copy(), []
    best[:least] = np.inf
    for _ in range(parts - 1):
        total = best[:, None] + cost
        total[np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None] < least] = np.inf
        total = np.round(total, DIGITS)
        back.append(total.argmin(axis=0))
        best = total.min(axis=0)
    cuts, at = [], n
    for b in reversed(back):
        at = int(b[at])
        cuts.append(at)
    return cuts[::-1], float(best[n])


def find_thresholds(points: DataFrame, parts: int = 2, least: int = 3) -> DataFrame:
    """``type, threshold, below, groups`` from group means (type, group, score): the middle of the gap at the last break.

    Types with fewer than ``parts * least`` groups get no row. Groups without a
    score take no part; equal scores stand in the order of their groups.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "group"])
        y = pdf["score"].to_numpy(float)
        found = break_points(y, parts, least)
        rows = [] if found is None else [(pdf["type"].iloc[0], float((y[found[0][-1] - 1] + y[found[0][-1]]) / 2), found[0][-1], len(y))]
        return pd.DataFrame(rows, columns=["type", "threshold", "below", "groups"])

    return points.where("score is not null").groupBy("type").applyInPandas(one, "type string, threshold double, below int, groups int")


def score_by_found_thresholds(
    df: DataFrame, matrix: Matrix, group: str, parts: int = 2, least: int = 3, standardise: bool = True, out: str = "predicted_phenotype"
) -> tuple[DataFrame, DataFrame]:
    """Rows labelled by signatures above their own thresholds, and the thresholds.

    ``group`` names fine groups of rows, such as many small clusters. A row
    takes the type with the highest score among those whose score exceeds the
    type's threshold, the first in order on ties; ``undefined`` if there is
    none, or if it is called ``Others``. Types without a threshold can't be taken.
    """
    markers = sorted({m for w in matrix.values() for m in w if m in df.columns})
    zdf = zscore(df, markers, suffix="_z") if standardise else df.withColumns({f"{m}_z": F.col(m) for m in markers})
    scores = signature_scores(matrix, {m: F.col(f"{m}_z") for m in markers})
    types: Sequence[str] = sorted(scores)
    names = {t: f"_score{i}" for i, t in enumerate(types)}
    zdf = zdf.withColumns({names[t]: scores[t] for t in types})
    listed = F.array(*(F.struct(F.lit(t).alias("type"), F.col(names[t]).alias("score")) for t in types))
    means = zdf.select(F.col(group).alias("group"), F.explode(listed).alias("_s")).groupBy("_s.type", "group").agg(F.round(F.avg("_s.score"), DIGITS).alias("score"))
    found = stage(find_thresholds(means.select("type", "group", "score"), parts, least), "thresholds")
    limits = found.agg(F.map_from_entries(F.collect_list(F.struct("type", "threshold"))).alias("m")).select("m").scalar()
    zdf = zdf.withColumn("_limits", limits)
    above = F.filter(listed, lambda s: s["score"] > F.col("_limits")[s["type"]])
    top = F.aggregate(above, F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("type")),
                      lambda a, s: F.when(a["score"].isNull() | (s["score"] > a["score"]), F.struct(s["score"].alias("score"), s["type"].alias("type"))).otherwise(a))
    label = F.coalesce(F.when(~top["type"].isin("Others", "Other"), top["type"]), F.lit(UNDEFINED))
    return zdf.withColumn(out, label).select(*df.columns, out), found
