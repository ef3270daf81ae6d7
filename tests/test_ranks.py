"""Bucketed ranks and quantiles against plain ones, on skewed data."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.functions.exprs import order_hash
from cellgauge.operators.ranks import average_ranks, exact_quantiles, hash_rank


@pytest.fixture(scope="module")
def skewed(spark):
    # one group holds most rows; one is null
    g = F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7))
    return spark.range(5000).select("id", g.alias("g")).cache()


def test_hash_rank_equals_window(spark, skewed):
    plain = skewed.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(order_hash(1, "id"), "id")))
    for digits in (1, 3):
        ours = hash_rank(skewed, ["g"], 1, ["id"], rank="r", digits=digits).select("id", "g", "r")
        assert ours.exceptAll(plain).count() == 0 and ours.count() == 5000


def test_hash_rank_limit(spark, skewed):
    full = hash_rank(skewed, ["g"], 1, ["id"], rank="r", size="n")
    cut = hash_rank(skewed, ["g"], 1, ["id"], rank="r", size="n", first=F.round(F.col("n") * 0.1))
    assert cut.exceptAll(full.where(F.col("r") <= F.round(F.col("n") * 0.1))).count() == 0
    assert cut.count() == full.where(F.col("r") <= F.round(F.col("n") * 0.1)).count()


VALUES = {
    "ties": [1.0] * 500 + [2.0] * 3 + [7.5],
    "narrow": list(100 + np.random.default_rng(1).random(700) * 1e-6),
    "tailed": list(np.exp(np.random.default_rng(2).normal(0, 8, 900))),
    "signed": list(np.random.default_rng(3).normal(0, 5, 800)) + [0.0, -0.0],
    "single": [3.25],
}


@pytest.fixture(scope="module")
def values(spark):
    rows = [(k, float(v)) for k, vs in VALUES.items() for v in vs]
    return spark.createDataFrame(rows, "k string, v double").cache()


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 0.999, 1.0])
def test_quantiles(spark, values, q):
    got = {r.k: r.q for r in exact_quantiles(values, ["k"], "v", {"q": q}).collect()}
    for k, vs in VALUES.items():
        assert got[k] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-300), k


def test_quantile_without_group(spark, values):
    every = [v for vs in VALUES.values() for v in vs]
    row = exact_quantiles(values, [], "v", {"a": 0.5, "b": 0.9}).first()
    assert row.a == pytest.approx(np.quantile(every, 0.5)) and row.b == pytest.approx(np.quantile(every, 0.9))


def test_average_ranks(spark, values):
    counts = values.groupBy("k", F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    got = {(r.k, r.value): r.avg_rank for r in average_ranks(counts, ["k"]).collect()}
    for k, vs in VALUES.items():
        vs = np.array(vs)
        for v in set(vs.tolist()):
            assert got[(k, v)] == (vs < v).sum() + ((vs == v).sum() + 1) / 2


def test_few_first_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(0, 3000, 1, 6).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("g"), "id")
    few = hash_rank(df, ["g"], 5, ["id"], rank="r", first=3)
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()
    every = hash_rank(df, ["g"], 5, ["id"], rank="r")
    assert few.schema == every.schema
    assert sorted(map(str, few.collect())) == sorted(map(str, every.where("r <= 3").collect()))
