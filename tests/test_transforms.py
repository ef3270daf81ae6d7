"""Batch correction against a plain statement of it; rows without a group; quantile buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators.ranks import _bucketed
from cellgauge.operators.transforms import batch_correct, scale_by_group_max, standard_scale

MARKERS = ["a", "b", "c", "d"]


def corrected(x, batch):
    """Location and scale of each batch, shrunk towards priors over the markers of the batch."""
    grand, out = x.mean(axis=0), np.empty_like(x)
    pooled = np.sqrt(sum(((x[batch == k] - x[batch == k].mean(axis=0)) ** 2).sum(axis=0) for k in np.unique(batch)) / len(x))
    z = (x - grand) / pooled
    for k in np.unique(batch):
        part = z[batch == k]
        n, gamma, delta = len(part), part.mean(axis=0), part.var(axis=0, ddof=1)
        g, d = gamma.copy(), delta.copy()
        a = (2 * delta.var(ddof=1) + delta.mean() ** 2) / delta.var(ddof=1)
        b = (delta.mean() * delta.var(ddof=1) + delta.mean() ** 3) / delta.var(ddof=1)
        for _ in range(500):
            g = (n * gamma.var(ddof=1) * gamma + d * gamma.mean()) / (n * gamma.var(ddof=1) + d)
            d = (0.5 * ((part - g) ** 2).sum(axis=0) + b) / (n / 2 + a - 1)
        out[batch == k] = (part - g) / np.sqrt(d) * pooled + grand
    return out


def test_batch_correction(spark):
    rng = np.random.default_rng(1)
    batch = rng.integers(0, 4, 300)
    x = rng.normal(size=(300, 4)) * [1, 2, 3, 4] * (1 + batch[:, None]) + rng.normal(size=(4, 4))[batch] * 3
    df = spark.createDataFrame([(i, int(b), *map(float, r)) for i, (b, r) in enumerate(zip(batch, x))], ["id", "batch", *MARKERS])
    got = np.array([[r[m] for m in MARKERS] for r in batch_correct(df, MARKERS, "batch", tol=1e-10).orderBy("id").collect()])
    assert got == pytest.approx(corrected(x, batch), abs=1e-5)


def test_rows_without_a_group_stay(spark):
    df = spark.createDataFrame([(1, None, 2.0, "train"), (2, None, 4.0, "train"), (3, "g", 5.0, "train"), (4, "g", 7.0, "test")], "id int, g string, a double, split string")
    assert {r.id: r.a for r in scale_by_group_max(df, ["g"], ["a"], eps=0.0).collect()} == {1: 0.5, 2: 1.0, 3: 5 / 7, 4: 1.0}
    assert {r.id: r.a for r in standard_scale(df, ["a"], by=["g"]).collect()} == {1: -1.0, 2: 1.0, 3: 0.0, 4: 2.0}
    assert batch_correct(df.withColumn("b", F.col("a") * 2), ["a", "b"], "g").count() == 4


def test_one_outlier_leaves_the_buckets_small(spark):
    values = spark.range(50_000).select((F.col("id") / 50_000).alias("value")).union(spark.sql("SELECT -1e9D"))
    largest = _bucketed(values, [], "value").groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert largest < 500
