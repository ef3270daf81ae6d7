"""Windows sized on the pixels of a mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.session import stage


def _half(low_x: Column, high_x: Column, low_y: Column, high_y: Column) -> Column:
    """The least half side, 1 at least, whose window ``[c - half, c + half)`` reaches down to ``low`` and up to ``high`` on both axes."""
    cx, cy = F.col("cx"), F.col("cy")
    return F.greatest(cx - low_x, high_x - cx + 1, cy - low_y, high_y - cy + 1, F.lit(1)).cast("bigint")


def _first_reach(found: DataFrame, key: list[str], half: str, m: int) -> DataFrame:
    """Per key the least half by which ``m`` ids are in (null if never), ids in by then, and ids in all."""
    rings = found.groupBy(*key, half).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*key).orderBy(half).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = rings.withColumn("_in", F.sum("_n").over(order))
    enough = F.col("_in") >= m
    return summed.groupBy(*key).agg(F.min(F.when(enough, F.col(half))).alias("_half"), F.min(F.when(enough, F.col("_in"))).alias("_at"), F.sum("_n").alias("_all"))


def smallest_mask_window(
    pixels: DataFrame, centres: DataFrame, sample: str, mask: str, m: int, width: int, height: int, x: str = "x", y: str = "y"
) -> DataFrame:
    """The smallest square around each centre that holds pixels of ``m`` mask ids other than 0.

    ``pixels`` has whole coordinates and one mask id per row, ``centres`` has
    ``sample, cx, cy``, several per sample if wanted; repeated centres count
    once, rows with a null coordinate or sample not at all, and pixels without
    an id (null) are background. The square reaches from ``c - side // 2`` up to, but not including,
    ``c + side // 2``. It is sized around the given centre, then shifted into
    the image and sized again; ``from_x, from_y`` keep the given centre. Where
    ``m`` ids are out of reach the side is the shorter one of the image.

    An id is inside as soon as its nearest pixel is, so the side is the m-th
    least of these distances. Bounding boxes bound them from both sides: the
    m-th least upper bound tells which ids, and how far out, have to be looked
    up in the pixels. Boxes meet the centres of their image (ids times centres
    rows, which are counted by distance before they are shuffled); pixels meet
    only centres whose window they can decide.
    """
    side, key = min(width, height), [sample, "cx", "cy"]
    most = side // 2
    told = pixels.where(F.col(mask) != 0).select(sample, mask, F.col(x).cast("bigint").alias("_x"), F.col(y).cast("bigint").alias("_y")).dropna()
    boxes = stage(told.groupBy(sample, mask).agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1")), "boxes")

    def reach(c: DataFrame) -> DataFrame:
        spots = c.select(*key).distinct()
        pairs = boxes.join(spots, sample).select(
            sample, mask, "cx", "cy",
            _half(F.col("_x1"), F.col("_x0"), F.col("_y1"), F.col("_y0")).alias("_least"), _half(F.col("_x0"), F.col("_x1"), F.col("_y0"), F.col("_y1")).alias("_whole"))
        bound = _first_reach(pairs.where(F.col("_whole") <= most), key, "_whole", m).select(*key, F.col("_half").alias("_bound"))
        bounds = stage(spots.join(bound, key, "left").select(*key, F.coalesce("_bound", F.lit(most).cast("bigint")).alias("_bound")), "bounds")
        open_ids = pairs.join(bounds, key).where(F.col("_least") <= F.col("_bound"))
        need = _half(F.col("_x"), F.col("_x"), F.col("_y"), F.col("_y"))
        near = told.join(open_ids, [sample, mask]).withColumn("_need", need).where(F.col("_need") <= F.col("_bound"))
        entries = near.groupBy(*key, mask).agg(F.min("_need").alias("_need"))
        sized = c.join(_first_reach(entries, key, "_need", m), key, "left")
        return stage(sized.select(
            *c.columns, F.coalesce(2 * F.col("_half"), F.lit(side)).cast("bigint").alias("side"), F.coalesce("_at", "_all", F.lit(0)).cast("bigint").alias("n_cells")), "windows")

    def clamp(c: Column, size: int) -> Column:
        half = F.floor(F.col("side") / 2)
        return F.least(F.greatest(c, half), F.lit(size) - half).cast("bigint")

    given = centres.select(sample, F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy")).dropna().distinct()
    first = reach(stage(given, "centres"))
    moved = first.select(sample, F.col("cx").alias("from_x"), F.col("cy").alias("from_y"), clamp(F.col("cx"), width).alias("cx"), clamp(F.col("cy"), height).alias("cy"))
    return reach(moved).select(sample, "from_x", "from_y", "cx", "cy", "side", "n_cells")
