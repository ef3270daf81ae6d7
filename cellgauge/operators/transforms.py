"""Numeric transforms of marker columns.

Global moments are scalar subqueries: the statistics are one aggregation, and
the transform itself stays a projection inside the scan's code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.ranks import exact_quantiles
from cellgauge.session import stage


def arcsinh(df: DataFrame, markers: Sequence[str], cofactor: float = 1.0) -> DataFrame:
    return df.withColumns({m: F.asinh(F.col(m) / cofactor) for m in markers})


def scale_log(df: DataFrame, markers: Sequence[str], factor: float = 1.0, log_first: bool = False) -> DataFrame:
    """``log1p(x * factor)``, or ``log1p(x) * factor`` with ``log_first``."""
    if log_first:
        return df.withColumns({m: F.log1p(F.col(m)) * factor for m in markers})
    return df.withColumns({m: F.log1p(F.col(m) * factor) for m in markers})


def _moments(df: DataFrame, markers: Sequence[str], std) -> Column:
    fields = [F.avg(m).alias(f"{m}_mean") for m in markers] + [std(m).alias(f"{m}_std") for m in markers]
    return df.select(F.struct(*fields)).scalar()


def zscore(df: DataFrame, markers: Sequence[str], eps: float = 0.0, suffix: str = "") -> DataFrame:
    """Subtract the mean and divide by the population deviation (null when that is 0)."""
    s = _moments(df, markers, F.stddev_pop)
    return df.withColumns({
        m + suffix: (F.col(m) - s[f"{m}_mean"]) / F.nullif(s[f"{m}_std"] + eps, F.lit(0.0)) for m in markers
    })


def log_zscore(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    return zscore(scale_log(df, markers), markers)


def fit_scaler(train: DataFrame, markers: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per marker (and per ``by``); a constant column gets scale 1."""
    aggs = []
    for m in markers:
        std = F.stddev_pop(m)
        aggs += [F.avg(m).alias(f"{m}_mean"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"{m}_scale")]
    return train.groupBy(*by).agg(*aggs)


def _join_null_safe(df: DataFrame, side: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row of ``df`` with its group's row of ``side``; rows without a key are a group too."""
    same = [df[c].eqNullSafe(side[c]) for c in by]
    return df.join(side, same, "left").drop(*[side[c] for c in by])


def standard_scale(
    df: DataFrame, markers: Sequence[str], split: str = "split", train: str = "train", by: Sequence[str] = ()
) -> DataFrame:
    """Scale all rows of each fold with the moments of its training rows."""
    scaler = fit_scaler(df.where(F.col(split) == train), markers, by)
    if by:
        joined = _join_null_safe(df, stage(scaler, "scaler"), by)
        out = joined.withColumns({m: (F.col(m) - F.col(f"{m}_mean")) / F.col(f"{m}_scale") for m in markers})
        return out.select(*df.columns)
    s = scaler.select(F.struct("*")).scalar()
    return df.withColumns({m: (F.col(m) - s[f"{m}_mean"]) / s[f"{m}_scale"] for m in markers})


def row_normalise(df: DataFrame, markers: Sequence[str], keep_zero_rows: bool = True) -> DataFrame:
    """Divide by the row sum; an all-zero row stays zero or becomes null."""
    total = sum((F.col(m) for m in markers[1:]), F.col(markers[0]))
    scaled = {}
    for m in markers:
        share = F.try_divide(F.col(m), total)
        scaled[m] = F.when(total == 0, F.col(m)).otherwise(share) if keep_zero_rows else share
    return df.withColumns(scaled)


def minmax(df: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Each marker to [0, 1] over the rows of ``df`` (usually one row per group)."""
    s = df.select(F.struct(*[F.min(m).alias(f"{m}_lo") for m in markers],
                           *[F.max(m).alias(f"{m}_hi") for m in markers])).scalar()
    return df.withColumns({
        m: F.try_divide(F.col(m) - s[f"{m}_lo"], s[f"{m}_hi"] - s[f"{m}_lo"]) for m in markers
    })


def clip_log_standardise(
    df: DataFrame, by: Sequence[str], value: str, q: float = 0.99, out: str = "scaled", eps: float = 1e-9
) -> DataFrame:
    """Clamp to [0, quantile], log1p, then standardise with the sample deviation, per group."""
    limits = stage(exact_quantiles(df, by, value, {"_cap": q}), "caps")
    clipped = df.join(limits, list(by), "left").withColumn(
        "_v", F.log1p(F.least(F.greatest(F.col(value), F.lit(0.0)), F.col("_cap")))
    )
    stats = clipped.groupBy(*by).agg(F.avg("_v").alias("_mean"), F.stddev_samp("_v").alias("_std"))
    return (
        clipped.join(stage(stats, "moments"), list(by), "left")
        .withColumn(out, (F.col("_v") - F.col("_mean")) / (F.col("_std") + eps))
        .select(*df.columns, out)
    )


def external_scale(
    long: DataFrame,
    stats: DataFrame,
    marker: str = "marker",
    value: str = "value",
    mapping: Mapping[str, str] | None = None,
    out: str = "scaled",
) -> DataFrame:
    """Standardise with a given table ``marker_name, marker_mean, marker_std``.

    Names match in any case after the optional mapping; an unknown marker is left
    as it is, and a deviation that is not positive counts as 1.
    """
    from cellgauge.functions.exprs import replace_exact

    dim = stats.select(
        F.upper("marker_name").alias("_key"),
        F.col("marker_mean").alias("_mean"),
        F.when(F.col("marker_std") > 0, F.col("marker_std")).otherwise(F.lit(1.0)).alias("_std"),
    )
    keyed = long.withColumn("_key", F.upper(replace_exact(marker, mapping or {})))
    scaled = (F.col(value) - F.coalesce("_mean", F.lit(0.0))) / F.coalesce("_std", F.lit(1.0))
    return keyed.join(dim, "_key", "left").withColumn(out, scaled).select(*long.columns, out)


def scale_by_group_max(df: DataFrame, by: Sequence[str], markers: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """Divide by the largest value of the group (over all markers)."""
    top = df.groupBy(*by).agg(F.max(F.greatest(*markers) if len(markers) > 1 else F.col(markers[0])).alias("_top"))
    out = _join_null_safe(df, stage(top, "maxima"), by).withColumns({m: F.col(m) / (F.col("_top") + eps) for m in markers})
    return out.select(*df.columns)


def scale_by_constant(df: DataFrame, markers: Sequence[str], constant: float = 65535.0) -> DataFrame:
    return df.withColumns({m: F.col(m) / constant for m in markers})


# -- batch correction ------------------------------------------------------


def batch_correct(
    df: DataFrame, markers: Sequence[str], batch: str, tol: float = 1e-4, max_rounds: int = 100
) -> DataFrame:
    """Empirical-Bayes location and scale correction per batch.

    Rows are only aggregated to moments and adjusted by a join. The priors of a
    batch are taken over its markers, so the iteration sees one row per marker
    of a batch. Rows without a batch are a batch.
    """
    import numpy as np
    import pandas as pd

    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).cast("double").alias("v")) for m in markers]))
    moments = (
        df.select(F.col(batch).alias("batch"), pairs.alias("r"))
        .groupBy("r.marker", "batch")
        .agg(F.count("r.v").alias("n"), F.avg("r.v").alias("mean"), F.var_pop("r.v").alias("var_pop"))
    )
    moments = stage(moments, "moments")
    rows, var = F.sum("n"), F.sum(F.col("n") * F.col("var_pop")) / F.sum("n")
    overall = moments.groupBy("marker").agg(
        (F.sum(F.col("n") * F.col("mean")) / rows).alias("grand"), F.when(var > 0, F.sqrt(var)).otherwise(F.lit(1.0)).alias("sd")
    )

    def shrink(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, var, grand, sd = (pdf[c].to_numpy(dtype=float) for c in ("n", "mean", "var_pop", "grand", "sd"))
        gamma = (mean - grand) / sd
        spread = n * var / sd**2
        delta = np.where(n > 1, spread / np.maximum(n - 1, 1), 1.0)
        prior_mean, d_mean = gamma.mean(), delta.mean()
        prior_var, d_var = (v.var(ddof=1) if len(v) > 1 else 0.0 for v in (gamma, delta))
        g_new, d_new = gamma.copy(), np.maximum(delta, 1e-12)
        if prior_var > 0 and d_var > 0:
            a = (2 * d_var + d_mean**2) / d_var
            b = (d_mean * d_var + d_mean**3) / d_var
            for _ in range(max_rounds):
                g_old, d_old = g_new, d_new
                g_new = (n * prior_var * gamma + d_old * prior_mean) / (n * prior_var + d_old)
                d_new = (0.5 * (spread + n * (gamma - g_new) ** 2) + b) / (n / 2.0 + a - 1.0)
                step = max(np.max(np.abs(g_new - g_old) / np.maximum(np.abs(g_old), 1e-12)),
                           np.max(np.abs(d_new - d_old) / d_old))
                if step < tol:
                    break
        return pd.DataFrame({
            "marker": pdf["marker"], "batch": pdf["batch"], "grand": grand, "sd": sd, "gamma": g_new, "delta": d_new,
        })

    schema = f"marker string, batch {df.schema[batch].dataType.simpleString()}, grand double, sd double, gamma double, delta double"
    fitted = moments.join(overall, "marker").where("n > 0").groupBy("batch").applyInPandas(shrink, schema)
    wide = fitted.groupBy(F.col("batch").alias(batch)).agg(
        F.map_from_entries(F.collect_list(F.struct("marker", F.struct("grand", "sd", "gamma", "delta")))).alias("_fit")
    )
    out = _join_null_safe(df, stage(wide, "batches"), [batch])
    adjusted = {}
    for m in markers:
        f = F.col("_fit")[m]
        z = (F.col(m) - f["grand"]) / f["sd"]
        adjusted[m] = (z - f["gamma"]) / F.sqrt(f["delta"]) * f["sd"] + f["grand"]
    return out.withColumns(adjusted).select(*df.columns)
