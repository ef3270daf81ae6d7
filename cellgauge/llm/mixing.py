"""Mixing sources to target weights by capped water-filling.

Every source has a weight and the mix a budget. A source may be repeated at
most ``max_epochs`` times: sources whose share lies above that are clamped and
the rest is shared out by weight, until none is above. In closed form: with
the sources ordered by capacity over weight, the clamped ones are a prefix of
that order. Whole repetitions go to every document of a source, the fraction
to the first documents in a seeded order.

Only DataFrame functions are used. The order is cut into buckets by leading
digits of the seeded hash, more for larger sources, so that no window sorts a
whole source; sizes per bucket are summed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights repeating over the sources by code point, null last. One row per source, so one window over them all."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int = 3, budget: float = 1.0) -> DataFrame:
    """``target`` for each source with ``source_size`` and ``weight``: the budget (a share of all sizes) by weight, at most ``max_epochs`` sizes each.

    Sources without size have target 0. A budget above ``max_epochs`` times
    all sizes clamps every source.
    """
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    capped = sources.withColumn("cap", F.col("source_size") * max_epochs)
    levelled = capped.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    # the first source that takes less than its capacity sets the level for all behind it
    free = levelled.withColumn("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return free.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), level * F.col("weight")), F.col("cap").cast("double"))).drop("level", "cap")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = 3, budget: float = 1.0, seed: str = "mix", id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per document: id, source, size (words), source_size, target of its source, repeats and taken (words).

    A document is taken ``floor(target / source_size)`` times, and once more
    while half of it still fits into what is left of the target, in the order
    of md5(seed-id). Null text: size 0. Null ids come first in that order,
    equal ids in any. Rows are kept one for one; no rows give no rows.
    """
    sized = stage(docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.concat(F.lit(seed + "-"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("draw")), "mix")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    target = water_fill(cyclic_weights(totals, weights), max_epochs, budget)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    digits = F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("n") / BUCKET_ROWS))).cast("int")
    target = stage(target.select("source", "source_size", "target", whole.alias("whole"), digits.alias("digits")), "mix-targets")
    same = sized["source"].eqNullSafe(target["source"])
    placed = sized.join(target, same).drop(target["source"]).withColumn("bucket", F.substring(F.col("draw"), F.lit(1), F.col("digits")))
    known = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"), F.col("bucket").alias("bucket")).alias("part")
    placed = placed.withColumn("part", known)
    ahead = W.partitionBy("part.none", "part.name").orderBy("part.bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.sum("size").alias("held")).select("part", F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("offset"))
    inner = W.partitionBy("part").orderBy("draw", "size").rowsBetween(W.unboundedPreceding, -1)
    so_far = placed.withColumn("prior", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, "part")
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    extra = (F.col("offset") + F.col("prior") + F.col("size") / 2 <= rest) & (F.col("size") > 0)
    repeats = (F.col("whole") + F.when(extra, 1).otherwise(0)).cast("long")
    return so_far.select(F.col("id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", **settings) -> DataFrame:
    """The mix itself: every document as often as it is taken, with ``epoch`` from 1.

    Documents that are not taken are left out. Rows with the same id are taken
    as often as the id's largest plan says, and null ids are planned like any.
    A column named epoch is replaced.
    """
    times = mix_plan(docs, id_col=id_col, **settings).groupBy(F.col(id_col).alias("_id")).agg(F.max("repeats").alias("_repeats")).filter("_repeats > 0")
    joined = docs.join(times, docs[id_col].eqNullSafe(times["_id"]))
    epoch = F.explode(F.sequence(F.lit(1).cast("long"), times["_repeats"])).alias("epoch")
    return joined.select(*(docs[f"`{c}`"] for c in docs.columns if c != "epoch"), epoch)
