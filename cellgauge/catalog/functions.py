"""Set operations, sorted reports and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog.fixtures import r6, rounded, with_ctes
from cellgauge.catalog.registry import query
from cellgauge.operators import sets as ST


@query("x01_stack_tables", "SELECT c_custkey AS id, c_acctbal AS balance, NULL AS owner FROM customer UNION ALL SELECT o_orderkey, NULL, o_custkey FROM orders")
def stacked(spark, sf):
    a = fx.table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance")
    b = fx.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS owner")
    return ST.stack(a, b)


@query("x02_training_images", with_ctes("""SELECT DISTINCT sample_id FROM cells
  EXCEPT SELECT DISTINCT sample_id FROM cells WHERE CAST(sample_id AS INT) % 5 = 2""", "cells"))
def training_images(spark, sf):
    cells = fx.cells(spark, sf)
    return ST.remaining(cells, ST.unique_values(cells.where(F.col("sample_id").cast("int") % 5 == 2), "sample_id"), ["sample_id"])


@query("x03_common_ids", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders")
def common_ids(spark, sf):
    a = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return ST.common(a, fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), ["id"])


@query("x04_unique_values", with_ctes("SELECT DISTINCT cell_type, level_2_cell_type FROM cells", "cells"))
def unique(spark, sf):
    return ST.unique_values(fx.cells(spark, sf), "cell_type", "level_2_cell_type")


@query("x05_top_sorted", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25")
def top(spark, sf):
    counts = fx.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return ST.top_sorted(counts, ["n", "o_custkey"], 25)


@query("x06_string_functions", """SELECT p_partkey, upper(p_name) AS u, split_part(p_name, ' ', 1) AS first, starts_with(p_brand, 'Brand#1') AS pre,
  ends_with(p_name, 'g') AS suf, contains(p_name, 'red') AS has, trim(concat(' ', p_type, ' ')) AS t FROM part""")
def strings(spark, sf):
    c = F.col
    return fx.table(spark, sf, "part").select(
        "p_partkey", F.upper("p_name").alias("u"), F.split("p_name", " ", 3)[0].alias("first"), c("p_brand").startswith("Brand#1").alias("pre"),
        c("p_name").endswith("g").alias("suf"), c("p_name").contains("red").alias("has"), F.trim(F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("t"))


@query("x07_math_functions", with_ctes(f"""SELECT cell_id, {r6('ln(1 + m1)')} AS l, {r6('asinh(m1)')} AS a, {r6('log2(1 + m2)')} AS l2, {r6('sqrt(m2)')} AS s,
  {r6('pow(m1, 1.5)')} AS p, {r6('abs(m3 - 50)')} AS ab, {r6('least(greatest(m3, 10), 90)')} AS cl FROM cells""", "cells"))
def math(spark, sf):
    m1, m2, m3 = (F.col(m) for m in fx.MARKERS)
    return rounded(fx.cells(spark, sf).select(
        "cell_id", F.log1p(m1).alias("l"), F.asinh(m1).alias("a"), F.log2(1 + m2).alias("l2"), F.sqrt(m2).alias("s"), F.pow(m1, 1.5).alias("p"),
        F.abs(m3 - 50).alias("ab"), F.least(F.greatest(m3, F.lit(10.0)), F.lit(90.0)).alias("cl")))
