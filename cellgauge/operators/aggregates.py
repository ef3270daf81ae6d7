"""Counts, summaries and group statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from math import erfc

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.functions.exprs import effective_label, pearson
from cellgauge.operators.ranks import average_ranks, exact_quantiles
from cellgauge.session import stage


def to_long(df: DataFrame, ids: Sequence[str], markers: Sequence[str]) -> DataFrame:
    """One row per marker: ``ids, marker, value``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("marker"), F.col(m).cast("double").alias("value")) for m in markers])
    return df.select(*ids, F.explode(pairs).alias("_r")).select(*ids, "_r.*")


# -- counts ----------------------------------------------------------------


def value_counts(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))


def contingency(df: DataFrame, rows: str, cols: str) -> DataFrame:
    return df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull()).groupBy(rows, cols).agg(F.count(F.lit(1)).alias("n"))


def dataset_stats(df: DataFrame, dataset: str, levels: Sequence[str]) -> DataFrame:
    """Rows and distinct labels at each level, per dataset.

    Distinct labels are counted on the label combinations, not on the rows.
    """
    combos = df.groupBy(dataset, *levels).agg(F.count(F.lit(1)).alias("_n"))
    distinct = [F.count_distinct(lv).alias(f"n_{lv}") for lv in levels]
    return combos.groupBy(dataset).agg(F.sum("_n").alias("n_cells"), *distinct)


def sum_by(df: DataFrame, by: Sequence[str], value: str, out: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(out))


def combined_counts(tables: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Class counts over several datasets: per dataset and in total."""
    counts = [value_counts(t, label).withColumn("dataset", F.lit(name)) for name, t in tables.items()]
    union = counts[0]
    for c in counts[1:]:
        union = union.unionByName(c)
    return union.groupBy(label).agg(F.sum("n").alias("n"), F.count_distinct("dataset").alias("n_datasets"))


def mode_per_group(df: DataFrame, by: Sequence[str], name: str, out: str = "mode") -> DataFrame:
    """Most frequent value of each group, ties to the smallest."""
    counts = value_counts(df, name, by)
    return counts.groupBy(*by).agg(F.min_by(name, F.struct(-F.col("n"), name)).alias(out))


def abundance_bins(df: DataFrame, dataset: str, label: str, cuts: Sequence[tuple[float, str]] | None = None) -> DataFrame:
    """Share of each class in its dataset and the abundance bin it falls in."""
    # fixed values: lower bound in percent of each bin
    cuts = cuts or ((20.0, "abundant"), (5.0, "common"), (1.0, "rare"))
    counts = value_counts(df, label, [dataset])
    pct = F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(dataset))
    bins = F
    for low, name in cuts:
        bins = bins.when(F.col("abundance_pct") >= low, name)
    return counts.withColumn("abundance_pct", pct).withColumn("abundance_bin", bins.otherwise("ultra_rare"))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weight ``rows / (classes * rows of the class)`` per class."""
    counts = value_counts(df, label)
    totals = counts.select(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"))).scalar()
    weight = totals["n"] / (totals["c"] * F.greatest(F.col("n"), F.lit(1)))
    return counts.select(label, "n", weight.alias(out))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    weights = stage(class_weights(df, label, out).drop("n"), "weights")
    return df.join(weights, label, "left").select(*df.columns, out)


def expert_agreement(df: DataFrame, original: str, corrected: str, flag: str) -> DataFrame:
    """Overall agreement, agreement per original label, and the replaced pairs, as one table.

    ``scope`` is ``overall``, ``label`` or ``pair``.
    """
    pairs = df.groupBy(F.col(original).alias("label"), effective_label(corrected, original).alias("corrected")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("changed")
    )
    sets = pairs.groupingSets([[], ["label"], ["label", "corrected"]], "label", "corrected").agg(
        F.grouping_id().alias("_g"), F.sum("n").alias("n"), F.sum("changed").alias("changed")
    )
    scope = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "label").otherwise("pair")
    return sets.withColumn("scope", scope).where((F.col("scope") != "pair") | (F.col("changed") > 0)).select(
        "scope", "label", "corrected", "n", "changed", (1 - F.col("changed") / F.col("n")).alias("agreement")
    )


def summary(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Distinct samples, rows and largest value of a table."""
    per_sample = df.groupBy(sample).agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_m"))
    return per_sample.agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("_n").alias("n_rows"), F.max("_m").alias("max_value"),
        F.min("_n").alias("min_per_sample"), F.max("_n").alias("max_per_sample"),
    )


# -- medians, means, correlations -----------------------------------------


def median_of_medians(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Exact median per sample and the median of those."""
    med = exact_quantiles(df, [sample], value, {"median": 0.5})
    return med.withColumn("median_of_medians", exact_quantiles(stage(med, "medians"), [], "median", {"m": 0.5}).scalar())


def expression_by_group(df: DataFrame, group: str, markers: Sequence[str], standardise: bool = False) -> DataFrame:
    """Mean and exact median of each marker per group, optionally z-scored across groups."""
    long = to_long(df, [group], markers)
    mean = long.groupBy(group, "marker").agg(F.avg("value").alias("mean"))
    out = mean.join(exact_quantiles(long, [group, "marker"], "value", {"median": 0.5}), [group, "marker"])
    if not standardise:
        return out
    across = W.partitionBy("marker")
    z = {c: (F.col(c) - F.avg(c).over(across)) / F.nullif(F.stddev_pop(c).over(across), F.lit(0.0)) for c in ("mean", "median")}
    return out.withColumns(z)


def marker_correlation(df: DataFrame, markers: Sequence[str], chunk: int = 100) -> DataFrame:
    """Pearson correlation of every pair of markers: ``a, b, r``.

    Wide aggregates, at most ``chunk`` pairs each, so that code generation holds.
    """
    pairs = list(combinations(markers, 2))
    parts = []
    for i in range(0, len(pairs), chunk):
        some = pairs[i : i + chunk]
        row = df.agg(*[pearson(a, b).alias(f"c{j}") for j, (a, b) in enumerate(some)])
        cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{j}").alias("r")) for j, (a, b) in enumerate(some)]
        parts.append(row.select(F.explode(F.array(*cells)).alias("p")).select("p.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    mirrored = out.select(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    ones = df.limit(1).select(F.explode(F.array(*[F.lit(m) for m in markers])).alias("a"))
    return out.unionByName(mirrored).unionByName(ones.select("a", F.col("a").alias("b"), F.lit(1.0).alias("r")))


def centroid_correlation(df: DataFrame, group: str, markers: Sequence[str]) -> DataFrame:
    """Pearson correlation between the mean marker profiles of every two groups."""
    means = stage(df.groupBy(group).agg(*[F.avg(m).alias(m) for m in markers]), "centroids")
    long = to_long(means, [group], markers)
    a = long.select(F.col(group).alias("a"), "marker", F.col("value").alias("va"))
    b = long.select(F.col(group).alias("b"), "marker", F.col("value").alias("vb"))
    return a.join(b, "marker").where(F.col("a") < F.col("b")).groupBy("a", "b").agg(pearson("va", "vb").alias("r"))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts and density of equal-width bins over the whole range; the last bin is closed."""
    s = df.select(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    width = (s["hi"] - s["lo"]) / bins
    index = F.least(F.floor((F.col(value) - s["lo"]) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.coalesce(index, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(W.partitionBy(*by)) if by else counts.agg(F.sum("n")).scalar()
    return counts.select(*by, "bin", (s["lo"] + F.col("bin") * width).alias("left_edge"), "n",
                         F.try_divide(F.col("n"), total * width).alias("density"))


# -- pixels ----------------------------------------------------------------


def cells_from_pixels(
    pixels: DataFrame, sample: str, mask: str, channels: Sequence[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Mean per channel, area, centroid and bounding box of every mask id but 0."""
    means = [F.avg(c).alias(f"mean_{c}") for c in channels]
    return pixels.where(F.col(mask) != 0).groupBy(sample, mask).agg(
        F.count(F.lit(1)).alias("area"), *means,
        F.avg(x).alias("cx"), F.avg(y).alias("cy"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"),
    )


def box_summary(cells: DataFrame) -> DataFrame:
    """Mean and sample deviation of width, height and area of the bounding boxes."""
    sized = cells.select(
        (F.col("x_max") - F.col("x_min") + 1).alias("width"), (F.col("y_max") - F.col("y_min") + 1).alias("height"), "area"
    )
    return sized.agg(*[f(c).alias(f"{c}_{n}") for c in sized.columns for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))])


def vectors_from_tiles(
    pixels: DataFrame, tiles: DataFrame, sample: str, mask: str, size: int, vec: str = "vec",
    x: str = "x", y: str = "y",
) -> DataFrame:
    """Mean vector of each mask id: tiles averaged per pixel, pixels averaged per id.

    ``tiles`` holds ``sample, tile, x0, y0, vec`` for square tiles. The double
    mean is linear in the tile vectors, so pixels only yield a scalar weight per
    (id, tile); vectors are joined once per such pair, never per pixel. Pixels
    without a tile count as zero vectors, and an id without any is one.
    """
    step = F.lit(size)
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    boxes = (
        tiles.select(sample, "tile", "x0", "y0", F.explode(corners).alias("_o"))
        .select(
            sample, "tile", "x0", "y0",
            F.floor((F.col("x0") + F.col("_o.i") * (size - 1)) / step).alias("_bx"),
            F.floor((F.col("y0") + F.col("_o.j") * (size - 1)) / step).alias("_by"),
        )
        .distinct()
    )
    spots = pixels.where(F.col(mask) != 0).groupBy(sample, x, y, mask).agg(F.count(F.lit(1)).alias("_px"))
    positions = spots.select(sample, x, y).distinct().withColumns({
        "_bx": F.floor(F.col(x) / step), "_by": F.floor(F.col(y) / step)
    })
    inside = (
        (F.col(x) >= F.col("x0")) & (F.col(x) < F.col("x0") + size) & (F.col(y) >= F.col("y0")) & (F.col(y) < F.col("y0") + size)
    )
    cover = positions.join(boxes, [sample, "_bx", "_by"]).where(inside).select(sample, x, y, "tile")
    cover = cover.withColumn("_nt", F.count(F.lit(1)).over(W.partitionBy(sample, x, y)))
    weights = spots.join(cover, [sample, x, y]).groupBy(sample, mask, "tile").agg(F.sum(F.col("_px") / F.col("_nt")).alias("_w"))
    area = spots.groupBy(sample, mask).agg(F.sum("_px").alias("n_pixels"))
    weights = stage(weights.join(area, [sample, mask], "right").select(sample, mask, "n_pixels", "tile", "_w"), "weights")
    width = tiles.select(F.max(F.size(vec))).scalar()
    # vectors are filled up to the longest; ids without a tile have zeros only and need no aggregate
    filled = tiles.select(sample, "tile", F.concat(F.col(vec), F.array_repeat(F.lit(0.0), width - F.size(vec))).alias("_vec"))
    summed = (
        weights.join(filled, [sample, "tile"])
        .select(sample, mask, "n_pixels", "_w", F.posexplode("_vec").alias("pos", "_v"))
        .groupBy(sample, mask, "n_pixels", "pos")
        .agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"))
        .select(sample, mask, "n_pixels", "pos", (F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("n_pixels")).alias("value"))
    )
    none = weights.where("tile is null").withColumn("pos", F.explode(F.sequence(F.lit(0), width - 1)))
    return summed.unionByName(none.select(sample, mask, "n_pixels", "pos", F.lit(0.0).alias("value")))


def as_vectors(long: DataFrame, by: Sequence[str], out: str = "vec") -> DataFrame:
    """One array per key from its rows ``pos, value``."""
    entries = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return long.groupBy(*by).agg(F.transform(entries, lambda e: e["value"]).alias(out))


# -- marker ranking --------------------------------------------------------


def rank_markers_wilcoxon(df: DataFrame, group: str, markers: Sequence[str]) -> DataFrame:
    """Rank-sum z-score of each marker for each group against the rest.

    Ties share their average rank; the variance is not corrected for ties.
    Values are ranked once per marker on their distinct values.
    """
    long = to_long(df, [group], markers).where(F.col("value").isNotNull())
    per_group = long.groupBy("marker", "value", group).agg(F.count(F.lit(1)).alias("_n"))
    per_group = stage(per_group, "marker_values")
    weighted = per_group.groupBy("marker", "value").agg(F.sum("_n").alias("_n"))
    ranks = average_ranks(weighted, ["marker"], n="_n")
    sums = per_group.join(ranks, ["marker", "value"]).groupBy("marker", group).agg(
        F.sum(F.col("_n") * F.col("avg_rank")).alias("rank_sum"), F.sum("_n").alias("n_in"),
        F.max("group_rows").alias("n_all"),
    )
    n1, n = F.col("n_in").cast("double"), F.col("n_all").cast("double")
    n2 = n - n1
    z = (F.col("rank_sum") - n1 * (n + 1) / 2) / F.nullif(F.sqrt(n1 * n2 * (n + 1) / 12), F.lit(0.0))

    @F.pandas_udf("double")
    def two_sided(zs: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else erfc(abs(v) / 2**0.5) for v in zs], dtype=object)

    scored = sums.select(group, "marker", "n_in", "rank_sum", z.alias("z"))
    return scored.withColumn("p_value", two_sided("z"))


def filter_markers(
    df: DataFrame, group: str, markers: Sequence[str], min_in: float = 0.2, max_out: float = 1.0,
    min_fold: float | None = None,
) -> DataFrame:
    """Markers expressed (above 0) in enough of a group and in few enough of the rest.

    ``min_fold`` adds a floor on the ratio of the group mean to the rest mean.
    """
    long = to_long(df, [group], markers)
    own = long.groupBy(group, "marker").agg(
        F.count("value").alias("n"), F.count_if(F.col("value") > 0).alias("pos"), F.sum("value").alias("sum")
    )
    every = W.partitionBy("marker")
    rest_n = F.sum("n").over(every) - F.col("n")
    shares = own.select(
        group, "marker", (F.col("pos") / F.col("n")).alias("share_in"),
        F.try_divide(F.sum("pos").over(every) - F.col("pos"), rest_n).alias("share_out"),
        F.try_divide(F.col("sum") / F.col("n"), F.try_divide(F.sum("sum").over(every) - F.col("sum"), rest_n)).alias("fold"),
    )
    kept = (F.col("share_in") >= min_in) & (F.col("share_out") <= max_out)
    return shares.where(kept if min_fold is None else kept & (F.col("fold") >= min_fold))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each group; each task forwards at most ``n`` rows per group."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


