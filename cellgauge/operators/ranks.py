"""Exact ranks and quantiles that never put a whole group into one task.

A plain ``row_number() over (partition by class order by ...)`` sorts each class
in one task. Here every group is cut into ordered buckets first: a small count
table gives each bucket its offset, and only the rows of one bucket are sorted
together. The rank is the same as that of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.functions.exprs import order_hash
from cellgauge.session import stage

HASH_DIGITS = 3  # 4096 buckets per group


def _running_before(c: str, by: Sequence[str], order: str) -> Column:
    """Sum of ``c`` over the earlier rows of the group."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint")


#: so many first rows of a group are taken from every partition
FEW = 64


def hash_rank(
    df: DataFrame,
    by: Sequence[str],
    seed: int,
    key: Sequence[str],
    rank: str = "rank",
    size: str | None = None,
    first: int | Column | None = None,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Add the 1-based rank of each row within ``by`` in a seeded random order.

    The order is that of ``md5(seed-key)``, ties by key. The leading hex digits
    of the hash make equal-sized buckets for a group of any size. ``size`` adds
    the row count of the group. With ``first`` only ranks up to it are kept (an
    expression may use ``by`` and ``size``); buckets beyond it are dropped
    before anything is sorted. Up to ``FEW`` of them are found in every input
    partition by itself, and only these are shuffled.
    """
    if isinstance(first, int) and first <= FEW and size is None:
        hashed = df.withColumn("_hash", order_hash(seed, *key))
        # a bare limit on the row number is what the planner turns into a limit per partition
        nth = F.row_number().over(W.partitionBy(*by).orderBy("_hash", *key))
        return hashed.withColumn("_nth", nth).where(F.col("_nth") <= first).select(*df.columns, F.col("_nth").cast("bigint").alias(rank))
    size_col = size or "_group_rows"
    hashed = df.withColumn("_hash", order_hash(seed, *key)).withColumn(
        # one struct is the key of both the join and the window, so rows are shuffled once;
        # nulls in it are equal to each other
        "_cell", F.struct(*by, F.substring("_hash", 1, digits).alias("_bucket"))
    )
    counts = hashed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_c"))
    group = [f"_cell.{b}" for b in by]
    offsets = counts.select(
        "_cell",
        _running_before("_c", group, "_cell._bucket").alias("_before"),
        F.sum("_c").over(W.partitionBy(*group)).alias(size_col),
    )
    out = hashed.join(offsets, "_cell")
    limit = None if first is None else (F.lit(first) if isinstance(first, int) else first)
    if limit is not None:
        out = out.where(F.col("_before") < limit)
    out = out.withColumn(rank, F.col("_before") + F.row_number().over(W.partitionBy("_cell").orderBy("_hash", *key)))
    if limit is not None:
        out = out.where(F.col(rank) <= limit)
    return out.select(*df.columns, *([size] if size else []), rank)


def _bucketed(df: DataFrame, by: Sequence[str], value: str, per_octave: int = 512) -> DataFrame:
    """Add ``_bucket``, a whole number that never falls as the value rises.

    The value's place between a low and a high quantile of its group is taken on
    a logarithmic scale to both sides, which cuts both narrow and long-tailed
    groups into many buckets; a few outliers can't stretch the range. The
    quantiles may be rough: they only set the buckets. They come from one
    aggregation with map-side sketches.
    """
    rough = F.percentile_approx(F.col(value).cast("double"), F.array(F.lit(0.01), F.lit(0.99)), 1000)
    ends = [rough[0].alias("_lo"), rough[1].alias("_hi")]
    if by:
        ranged = df.join(stage(df.groupBy(*by).agg(*ends), "ranges"), list(by))
    else:
        ends_of_all = df.select(F.struct(*ends)).scalar()
        ranged = df.withColumns({"_lo": ends_of_all["_lo"], "_hi": ends_of_all["_hi"]})
    width = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
    place = (F.col(value) - F.col("_lo")) / width
    cut = F.greatest(F.floor(F.log2(F.abs(place)) * per_octave) + 60 * per_octave, F.lit(1))
    bucket = F.when(place > 0, cut).when(place < 0, -cut).otherwise(F.lit(0)).cast("bigint")
    return ranged.withColumn("_bucket", bucket).drop("_lo", "_hi")


def average_ranks(counts: DataFrame, by: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """Average rank of each distinct value per group, from a table of value counts.

    Columns: ``by``, ``value``, ``avg_rank`` (ties share it) and ``group_rows``.
    """
    bucketed = _bucketed(counts.na.drop(subset=[*by, value]), by, value)
    offsets = bucketed.groupBy(*by, "_bucket").agg(F.sum(n).alias("_c")).select(
        *by, "_bucket",
        _running_before("_c", by, "_bucket").alias("_before"),
        F.sum("_c").over(W.partitionBy(*by)).alias("group_rows"),
    )
    less = F.col("_before") + _running_before(n, [*by, "_bucket"], value)
    return bucketed.join(offsets, [*by, "_bucket"]).select(
        *by, value, (less + (F.col(n) + 1) / 2).alias("avg_rank"), "group_rows"
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles per group with linear interpolation between neighbours.

    ``quantiles`` names each output column. Equals ``percentile`` without
    holding all values of a group in one aggregation buffer, and without
    shuffling the values: a histogram finds the buckets of the wanted order
    statistics, and only the values in those buckets leave the scan.
    """
    # rows outside every group go first
    values = df.na.drop(subset=[*by, value]).select(*by, F.col(value).cast("double").alias("value"))
    bucketed = _bucketed(values, by, "value")

    def position(q: float) -> Column:
        return F.lit(q) * (F.col("_rows") - 1)

    def holds(q: float, lo: Column, hi: Column) -> Column:
        # the bucket or value covers the lower or the upper order statistic
        low, high = F.floor(position(q)), F.ceil(position(q))
        return ((low >= lo) & (low < hi)) | ((high >= lo) & (high < hi))

    histogram = bucketed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    buckets = histogram.select(
        *by, "_bucket", "_c",
        _running_before("_c", by, "_bucket").alias("_before"),
        F.sum("_c").over(W.partitionBy(*by)).alias("_rows"),
    )
    wanted = F.lit(False)
    for q in quantiles.values():
        wanted |= holds(q, F.col("_before"), F.col("_before") + F.col("_c"))
    hit = stage(buckets.where(wanted).drop("_c"), "buckets")
    in_bucket = [*by, "_bucket"]
    counts = bucketed.join(hit, in_bucket).groupBy(*in_bucket, "_before", "_rows", "value").agg(F.count(F.lit(1)).alias("cnt"))
    ranked = counts.withColumn("_lo", F.col("_before") + _running_before("cnt", in_bucket, "value")).withColumn(
        "_hi", F.col("_lo") + F.col("cnt")
    )
    aggs = []
    for name, q in quantiles.items():
        low, high = F.floor(position(q)), F.ceil(position(q))
        at = lambda k: F.max(F.when((k >= F.col("_lo")) & (k < F.col("_hi")), F.col("value")))
        share = F.max(position(q) - low)
        aggs.append((at(low) + (at(high) - at(low)) * share).alias(name))
    return ranked.groupBy(*by).agg(*aggs)
