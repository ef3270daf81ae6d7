"""Numeric transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog.fixtures import r6, rounded, with_ctes
from cellgauge.catalog.registry import query
from cellgauge.operators import transforms as T
from cellgauge.operators.aggregates import to_long

MS = fx.MARKERS


def each(template: str, markers=MS) -> str:
    """``template`` for every marker, rounded; ``{m}`` is the marker."""
    return ", ".join(f"{r6(template.replace('{m}', m))} AS {m}" for m in markers)


def sql(body: str, *ctes: str) -> str:
    return with_ctes(body, *(ctes or ("cells",)))


def base(spark, sf, *more):
    return fx.cells(spark, sf).select("cell_id", *more, *MS)


@query("n01_arcsinh", sql(f"SELECT cell_id, {each('asinh({m} / 150)')} FROM cells"))
def arcsinh(spark, sf):
    return rounded(T.arcsinh(base(spark, sf), MS, 150.0))


@query("n02_scale_then_log", sql(f"SELECT cell_id, {each('ln(1 + {m} * 10)')} FROM cells"))
def scale_log(spark, sf):
    return rounded(T.scale_log(base(spark, sf), MS, 10.0))


@query("n02_log_then_scale", sql(f"SELECT cell_id, {each('ln(1 + {m}) * 10')} FROM cells"))
def log_scale(spark, sf):
    return rounded(T.scale_log(base(spark, sf), MS, 10.0, log_first=True))


@query("n03_zscore", sql(f"SELECT cell_id, {each('({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER ()')} FROM cells"))
def zscore(spark, sf):
    return rounded(T.zscore(base(spark, sf), MS))


FOLDED = "f AS (SELECT k.*, fold, CASE WHEN cell_id % 5 = fold THEN 'test' ELSE 'train' END AS split FROM cells k, range(5) r(fold))"


def folded(spark, sf):
    df = base(spark, sf).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    return df.withColumn("split", F.when(F.col("cell_id") % 5 == F.col("fold"), "test").otherwise("train"))


@query("n04_standard_scale", sql(f"""WITH {FOLDED}, s AS (SELECT fold, {', '.join(f'avg({m}) AS a_{m}, stddev_pop({m}) AS s_{m}' for m in MS)}
    FROM f WHERE split = 'train' GROUP BY fold)
  SELECT cell_id, fold, split, {each('({m} - a_{m}) / s_{m}')} FROM f JOIN s USING (fold)"""))
def standard_scale(spark, sf):
    return rounded(T.standard_scale(folded(spark, sf), MS, by=["fold"]))


@query("n05_log_zscore", sql(f"SELECT cell_id, {each('(ln(1 + {m}) - avg(ln(1 + {m})) OVER ()) / stddev_pop(ln(1 + {m})) OVER ()')} FROM cells"))
def log_zscore(spark, sf):
    return rounded(T.log_zscore(base(spark, sf), MS))


@query("n06_row_normalise", sql(f"SELECT cell_id, {each('CASE WHEN m1 + m2 + m3 = 0 THEN {m} ELSE {m} / (m1 + m2 + m3) END')} FROM cells"))
def row_normalise(spark, sf):
    return rounded(T.row_normalise(base(spark, sf), MS))


@query("n06_row_normalise_null", sql(f"""SELECT cell_id, {each('{m} / nullif(m1 + m2 + m3, 0)')}
  FROM (SELECT cell_id, CASE WHEN cell_id % 10 = 0 THEN 0 ELSE m1 END AS m1, CASE WHEN cell_id % 10 = 0 THEN 0 ELSE m2 END AS m2,
        CASE WHEN cell_id % 10 = 0 THEN 0 ELSE m3 END AS m3 FROM cells)"""))
def row_normalise_null(spark, sf):
    zeroed = base(spark, sf).withColumns({m: F.when(F.col("cell_id") % 10 == 0, 0.0).otherwise(F.col(m)) for m in MS})
    return rounded(T.row_normalise(zeroed, MS, keep_zero_rows=False))


@query("n07_minmax_group_means", sql(f"""WITH g AS (SELECT cell_type, avg(m1) AS m1, avg(m2) AS m2, avg(m3) AS m3 FROM cells GROUP BY 1)
  SELECT cell_type, {each('({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ())')} FROM g"""))
def minmax(spark, sf):
    means = fx.cells(spark, sf).groupBy("cell_type").agg(*[F.avg(m).alias(m) for m in MS])
    return rounded(T.minmax(means, MS))


@query("n08_clip_quantile", sql(f"""WITH q AS (SELECT sample_id, marker, quantile_cont(value, 0.99) AS cap FROM cellslong GROUP BY 1, 2),
  v AS (SELECT cell_id, c.sample_id, c.marker, ln(1 + least(greatest(value, 0), cap)) AS v FROM cellslong c JOIN q USING (sample_id, marker))
  SELECT cell_id, sample_id, marker, {r6('(v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-9)')} AS scaled FROM v WINDOW w AS (PARTITION BY sample_id, marker)""",
  "cellslong"))
def clip_quantile(spark, sf):
    long = to_long(fx.cells(spark, sf), ["cell_id", "sample_id"], MS)
    return rounded(T.clip_log_standardise(long, ["sample_id", "marker"], "value").drop("value"))


@query("n09_external_scale", sql(f"""SELECT cell_id, marker, {r6("CASE marker WHEN 'm1' THEN (value - 20.5) / 4 WHEN 'm2' THEN value - 50 ELSE value END")} AS scaled
  FROM cellslong""", "cellslong"))
def external(spark, sf):
    stats = spark.createDataFrame([("M1", 20.5, 4.0), ("Mark2", 50.0, 0.0)], "marker_name string, marker_mean double, marker_std double")
    long = to_long(fx.cells(spark, sf), ["cell_id"], MS)
    return rounded(T.external_scale(long, stats, mapping={"m2": "mark2"}).drop("value"))


@query("n10_batch_correct")
def batch_correct(spark, sf):
    return rounded(T.batch_correct(base(spark, sf, "sample_id"), MS, "sample_id"))


@query("n11_scale_group_max", sql(f"""SELECT cell_id, sample_id, {each('{m} / (max(greatest(m1, m2, m3)) OVER (PARTITION BY sample_id) + 1e-8)')} FROM cells"""))
def group_max(spark, sf):
    return rounded(T.scale_by_group_max(base(spark, sf, "sample_id"), ["sample_id"], MS))


@query("n11_scale_constant", sql(f"SELECT cell_id, {each('{m} / 65535.0')} FROM cells"))
def constant(spark, sf):
    return rounded(T.scale_by_constant(base(spark, sf), MS))
