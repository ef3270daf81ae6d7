"""Folds, validation splits and samples.

All random choices follow the order of ``md5(seed-key)``, so a split is the same
on every run, cluster size and engine.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.functions.exprs import order_hash
from cellgauge.operators.cleaning import expand_range, label_dictionary
from cellgauge.operators.ranks import hash_rank
from cellgauge.session import stage


def stratified_kfold(
    df: DataFrame, label: str, key: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Folds whose class shares are equal up to one row; rows without a label are a class of their own."""
    codes = stage(label_dictionary(df, label), "classes").select(
        F.col("phenotype").alias(label), F.col("label").alias("_code")
    )
    ranked = hash_rank(df.join(codes, label, "left"), [label], seed, key, rank="_rank")
    turn = F.col("_rank") - 1 + F.coalesce(F.col("_code"), F.lit(-1))
    return ranked.withColumn(out, F.pmod(turn, F.lit(k)).cast("int")).select(*df.columns, out)


def first_stratified_fold(
    df: DataFrame, label: str, key: Sequence[str], fraction: float, seed: int = 42, cap: int | None = None
) -> DataFrame:
    """Train and validation rows for tuning: fold 0 of ``max(2, round(1/fraction))``."""
    k = max(2, round(1 / fraction))
    rows = cap_per_class(df, label, key, cap, seed) if cap else df
    folds = stratified_kfold(rows, label, key, k, seed, "_fold")
    return folds.withColumn("split", F.when(F.col("_fold") == 0, "validation").otherwise("train")).drop("_fold")


def stratified_group_kfold(
    df: DataFrame, label: str, group: str, key: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold"
) -> DataFrame:
    """Folds that keep each group whole and spread the classes evenly.

    Groups are dealt out by :func:`assign_groups`. Fewer groups than folds fall
    back to :func:`stratified_kfold`. Rows without a group form one group, rows
    without a label one class.
    """
    counts = stage(df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")), "group_classes")
    if counts.select(group).distinct().limit(k).count() < k:
        return stratified_kfold(df, label, key, k, seed, out)
    assigned = stage(assign_groups(counts, label, group, k, seed, out), "group_folds")
    return df.join(assigned, df[group].eqNullSafe(assigned[group])).select(*[df[c] for c in df.columns], out)


def assign_groups(counts: DataFrame, label: str, group: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """The fold of every group from its class counts (``group, label, n``).

    Groups alike in main class and size (the three leading bits of the row
    count) are dealt to the folds in turn, in a seeded order, so that among them
    no fold has two groups more than another. The first fold of the turn
    changes with class and size. The rule is the same for any number of groups.
    """
    codes = label_dictionary(counts, label).select(F.col("phenotype").alias("_main"), F.col("label").alias("_code"))
    profile = counts.groupBy(group).agg(F.sum("n").alias("_rows_in"), F.max_by(label, F.struct("n", label)).alias("_main"))
    bits = F.length(F.bin("_rows_in"))
    lead = F.expr("shiftright(_rows_in, greatest(length(bin(_rows_in)) - 3, 0))")
    sized = profile.withColumn("_size", (bits * 8 + lead).cast("int"))
    ranked = hash_rank(sized, ["_main", "_size"], seed, [group], rank="_r").join(stage(codes, "classes"), "_main", "left")
    turn = F.col("_r") - 1 + F.coalesce(F.col("_code"), F.lit(-1)) + F.col("_size")
    return ranked.select(group, F.pmod(turn, F.lit(k)).cast("int").alias(out))


#: groups that are placed one after another
LEADERS = 4096


def balanced_group_kfold(
    df: DataFrame, label: str, group: str, key: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold", leaders: int = LEADERS
) -> DataFrame:
    """Folds that keep each group whole and make the classes' shares as equal as whole groups allow.

    The ``leaders`` groups whose class counts spread most are placed one after
    another, the widest first, each where it keeps the classes' shares of the
    folds closest to each other. All other groups, each of which weighs less
    than any of these, are dealt out before by :func:`assign_groups`, and the
    leaders start from the totals that gives. Only counts of the leaders and the
    totals (folds times classes) reach the driver. Fewer groups than folds fall
    back to :func:`stratified_kfold`. Rows without a group form one group, rows
    without a label one class.
    """
    counts = stage(df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")), "group_classes")
    if counts.select(group).distinct().limit(k).count() < k:
        return stratified_kfold(df, label, key, k, seed, out)
    classes = [(r[label], r["n"]) for r in counts.groupBy(label).agg(F.sum("n").alias("n")).orderBy(label).collect()]
    # the deviation of the counts over all classes, zeros included
    mean = F.sum("n") / len(classes)
    spread = F.sqrt(F.greatest(F.sum(F.col("n") * F.col("n")) / len(classes) - mean * mean, F.lit(0.0)))
    wide = counts.groupBy(group).agg(F.round(spread, 9).alias("_spread"), F.collect_list(F.struct(label, "n")).alias("_n"))
    first = stage(wide.orderBy(F.desc("_spread"), order_hash(seed, group), group).limit(leaders), "leaders")
    rest = stage(counts.join(first.select(group), counts[group].eqNullSafe(first[group]), "left_anti"), "group_rest")
    dealt = stage(assign_groups(rest, label, group, k, seed, out), "group_folds")
    number = {c: i for i, (c, _) in enumerate(classes)}
    totals = np.zeros((k, len(classes)))
    for r in rest.join(dealt, rest[group].eqNullSafe(dealt[group])).groupBy(out, label).agg(F.sum("n").alias("n")).collect():
        totals[r[out], number[r[label]]] = r["n"]
    size, placed = np.array([n for _, n in classes], float), []
    for r in first.orderBy(F.desc("_spread"), order_hash(seed, group), group).collect():
        own = np.zeros(len(classes))
        for e in r["_n"]:
            own[number[e[label]]] = e["n"]
        after = np.repeat(totals[None], k, axis=0) + np.eye(k)[:, :, None] * own
        uneven = (after / size).std(axis=1).mean(axis=1)
        fold = min(range(k), key=lambda f: (round(float(uneven[f]), 12), totals[f].sum(), f))
        totals[fold] += own
        placed.append((r[group], fold))
    kind = df.schema[group].dataType.simpleString()
    found = df.sparkSession.createDataFrame(placed, f"`{group}` {kind}, `{out}` int").unionByName(dealt)
    assigned = stage(found, "group_folds")
    return df.join(assigned, df[group].eqNullSafe(assigned[group])).select(*[df[c] for c in df.columns], out)


def group_shuffle_split(
    df: DataFrame, group: str, repeats: int, test_share: float = 0.5, seed: int = 42
) -> DataFrame:
    """The part of every group in each repeat: ``rep, group, split``.

    Join it to the rows on ``group``; with the row key as the group it is a
    plain shuffle split.
    """
    groups = df.select(group).distinct().select(group, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    ranked = hash_rank(groups, ["rep"], seed, ["rep", group], rank="_rank", size="_groups")
    test = F.col("_rank") <= F.ceil(F.lit(test_share) * F.col("_groups"))
    return ranked.select("rep", group, F.when(test, "test").otherwise("train").alias("split"))


def swap_train_test(df: DataFrame, split: str = "split") -> DataFrame:
    s = F.col(split)
    return df.withColumn(split, F.when(s == "train", "test").when(s == "test", "train").otherwise(s))


def validation_split(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    by: Sequence[str] = (),
    share: float = 0.15,
    seed: int = 42,
    split: str = "split",
) -> DataFrame:
    """Turn a stratified share of the training rows into validation rows.

    Where a class has a single training row in a fold, that fold is drawn at
    random over all its classes instead.
    """
    train = df.where(F.col(split) == "train")
    sizes = train.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    lone = sizes.groupBy(*by).agg((F.min("_n") < 2).alias("_lone"))
    if by:
        marked = train.join(stage(lone, "lone"), list(by))
    else:
        marked = train.withColumn("_lone", F.coalesce(lone.select("_lone").scalar(), F.lit(False)))
    marked = marked.withColumn("_stratum", F.when(~F.col("_lone"), F.col(label).cast("string")))
    ranked = hash_rank(marked, [*by, "_stratum"], seed, key, rank="_rank", size="_rows")
    quota = F.when(F.col("_lone"), F.ceil(share * F.col("_rows"))).otherwise(F.round(share * F.col("_rows")))
    drawn = ranked.withColumn(split, F.when(F.col("_rank") <= quota, "validation").otherwise("train"))
    return drawn.select(*df.columns).unionByName(df.where(F.col(split) != "train"))


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all of them)."""
    return hash_rank(df, [], seed, key, rank="_rank", first=n).select(*df.columns)


def sample_fraction(df: DataFrame, fraction: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """The rounded share of rows."""
    n = F.round(fraction * F.col("_rows"))
    return hash_rank(df, [], seed, key, rank="_rank", size="_rows", first=n).select(*df.columns)


def sample_groups(df: DataFrame, group: str, fraction: float, seed: int = 42) -> DataFrame:
    """All rows of a share of the groups, at least one group."""
    ids = df.select(group).distinct()
    n = F.greatest(F.round(fraction * F.col("_groups")), F.lit(1))
    drawn = hash_rank(ids, [], seed, [group], rank="_rank", size="_groups", first=n).select(group)
    return df.join(stage(drawn, "sampled_groups"), group, "left_semi").select(*df.columns)


def cap_per_class(df: DataFrame, label: str, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each class, without replacement."""
    return hash_rank(df, [label], seed, key, rank="_rank", first=n).select(*df.columns)


# -- windows of an image ---------------------------------------------------


def grid_windows(
    df: DataFrame, sample: str, width: int, height: int, n: int | None = None,
    seed: int = 42, x: str = "x", y: str = "y",
) -> DataFrame:
    """Non-overlapping full windows of each sample with their row count, ``n`` drawn per sample.

    The image reaches from 0 to the largest coordinate; windows that do not fit
    completely are left out, empty windows are kept.
    """
    sizes = df.groupBy(sample).agg(
        F.floor((F.floor(F.max(x)) + 1) / width).alias("_cols"), F.floor((F.floor(F.max(y)) + 1) / height).alias("_rows")
    ).where((F.col("_cols") > 0) & (F.col("_rows") > 0))
    rows = expand_range(sizes, F.lit(0), F.col("_rows") - 1, "win_y")
    cells = rows.withColumn("win_x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_cols") - 1))).select(sample, "win_x", "win_y")
    counts = df.groupBy(
        sample, F.floor(F.col(x) / width).alias("win_x"), F.floor(F.col(y) / height).alias("win_y")
    ).agg(F.count(F.lit(1)).alias("_n"))
    out = cells.join(counts, [sample, "win_x", "win_y"], "left").select(
        sample, "win_x", "win_y", F.coalesce("_n", F.lit(0)).alias("n_cells")
    )
    if n is None:
        return out
    return hash_rank(out, [sample], seed, [sample, "win_x", "win_y"], rank="_rank", first=n).drop("_rank")


def smallest_window(
    df: DataFrame, centres: DataFrame, sample: str, m: int, width: int, height: int, x: str = "x", y: str = "y"
) -> DataFrame:
    """The smallest square around each centre that holds ``m`` points of its sample.

    ``centres`` has ``sample, cx, cy`` with one row per sample. The square is
    first sized around the given centre, then shifted into the image and sized
    again. A sample with fewer points gets the square that holds all of them.
    """

    def reach(c: DataFrame) -> DataFrame:
        dist = F.greatest(F.abs(F.col(x) - F.col("cx")), F.abs(F.col(y) - F.col("cy")))
        near = df.join(c, sample).select(sample, "cx", "cy", dist.alias("_d"))
        # equal distances collapse first, so the sort holds distinct radii only
        rings = near.groupBy(sample, "cx", "cy", "_d").agg(F.count(F.lit(1)).alias("_n"))
        order = W.partitionBy(sample, "cx", "cy").orderBy("_d")
        nearest = rings.withColumn("_ring", F.row_number().over(order)).where(F.col("_ring") <= m)
        within = F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
        # beyond the m nearest rings nothing counts, so their sum stands for all points
        reachable = F.sum("_n").over(W.partitionBy(sample, "cx", "cy"))
        return (
            nearest.withColumn("n_cells", within)
            .withColumn("_all", reachable)
            .where(F.col("n_cells") >= F.least(F.lit(m), F.col("_all")))
            .groupBy(sample, "cx", "cy")
            .agg(F.min("_d").alias("_d"), F.min("n_cells").alias("n_cells"))
        )

    def clamp(c: Column, half: Column, size: int) -> Column:
        return F.greatest(F.least(c, size - half), F.least(half, size / F.lit(2)))

    first = reach(stage(centres, "centres"))
    moved = first.select(
        sample, clamp(F.col("cx"), F.col("_d"), width).alias("cx"), clamp(F.col("cy"), F.col("_d"), height).alias("cy")
    )
    return reach(stage(moved, "centres")).select(sample, "cx", "cy", (2 * F.col("_d")).alias("side"), "n_cells")


def covering_starts(c: Column, size: int, extent: Column) -> Column:
    """Starts of all windows covering a coordinate: stride ``size/2``, the last one ending at the border."""
    stride = size // 2
    last = F.floor(F.greatest(extent - size, F.lit(0)) / stride)
    lo = F.greatest(F.ceil((c - size + 1) / stride), F.lit(0))
    hi = F.least(F.floor(c / stride), last)
    regular = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda i: i * stride)).otherwise(
        F.array().cast("array<bigint>")
    )
    border = extent - size
    anchored = (last * stride + size < extent) & (c >= border)
    return F.when(anchored, F.concat(regular, F.array(border.cast("bigint")))).otherwise(regular)


def overlapping_windows(
    df: DataFrame, size: int, width: int | Column, height: int | Column, x: str = "x", y: str = "y"
) -> DataFrame:
    """Each row once per window that covers it, with the window start ``x0, y0``."""
    w = F.lit(width) if isinstance(width, int) else width
    h = F.lit(height) if isinstance(height, int) else height
    gx, gy = F.floor(F.col(x)), F.floor(F.col(y))
    return df.withColumn("x0", F.explode(covering_starts(gx, size, w))).withColumn(
        "y0", F.explode(covering_starts(gy, size, h))
    )
