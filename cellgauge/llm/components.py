"""Connected components of link tables, by alternating stars.

Every round links a vertex's larger neighbours, then its smaller ones, to the
least of them, until only stars are left; the number of rounds grows with the
logarithm of a component's size. Rounds are written to the shared folder, so
that lineage stays short and survives lost executors. A hub's links are never
gathered: its minimum is an aggregate, and meets the links in a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.session import stage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    down = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least).distinct()


def components(links: DataFrame) -> DataFrame:
    """(member, component) for every vertex of ``links`` (two integer columns) that isn't the least of its component.

    Self-links and null ends say nothing; repeated links and either direction
    are fine. No links give no rows.
    """
    a, b = links.columns
    now = stage(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    mark = None
    while True:
        after = stage(_small_star(_large_star(now)), "stars")
        row = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            return after.select(F.col("a").alias("member"), F.col("b").alias("component"))
        mark, now = tuple(row), after
