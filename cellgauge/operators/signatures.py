"""Labels from prior knowledge, baselines and centroids: no fitted model, no shuffle per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.functions.exprs import argmax, hash_uniform, order_hash, squared_distance
from cellgauge.operators.joins import average_runs
from cellgauge.operators.metrics import UNDEFINED
from cellgauge.operators.transforms import zscore
from cellgauge.session import stage

# -- clusters --------------------------------------------------------------


def majority_mapping(
    df: DataFrame, cluster: str, label: str, ties: str = "first", seed: int = 42
) -> DataFrame:
    """The most frequent label of each cluster: ``cluster, mapped``.

    Equal counts: ``first`` in label order, ``random`` in seeded order, or ``raise``.
    """
    counts = df.where(F.col(cluster).isNotNull() & F.col(label).isNotNull()).groupBy(cluster, label).agg(
        F.count(F.lit(1)).alias("_n")
    )
    if ties == "random":
        tie: Column = order_hash(seed, cluster, label)
    elif ties in ("first", "raise"):
        tie = F.col(label)
    else:
        raise ValueError(f"unknown tie strategy: {ties}")
    best = F.min_by(label, F.struct(-F.col("_n"), tie))
    if ties != "raise":
        return counts.groupBy(cluster).agg(best.alias("mapped"))
    top = W.partitionBy(cluster)
    at_top = counts.withColumn("_top", F.max("_n").over(top)).where(F.col("_n") == F.col("_top"))
    checked = at_top.groupBy(cluster).agg(best.alias("mapped"), F.count(F.lit(1)).alias("_ties"))
    tied = F.raise_error(F.concat(F.lit("tie in cluster "), F.col(cluster).cast("string"))).cast("string")
    return checked.select(cluster, F.when(F.col("_ties") > 1, tied).otherwise(F.col("mapped")).alias("mapped"))


def assign_majority(df: DataFrame, cluster: str, label: str, ties: str = "first", out: str = "predicted_phenotype") -> DataFrame:
    """Rows with the label of their cluster; rows without a cluster are left out."""
    mapping = stage(majority_mapping(df, cluster, label, ties), "clusters")
    return df.join(mapping, cluster).select(*df.columns, F.col("mapped").alias(out))


# -- baselines per fold ----------------------------------------------------


def _train_counts(df: DataFrame, label: str, fold: str) -> DataFrame:
    """Class counts of the rows outside each fold, from one count table."""
    counts = stage(df.groupBy(fold, label).agg(F.count(F.lit(1)).alias("_n")), "fold_counts")
    total = counts.groupBy(label).agg(F.sum("_n").alias("_all"))
    folds = counts.select(fold).distinct()
    named = total.agg(F.collect_list(F.struct(label, "_all")).alias("_t")).select("_t").scalar()
    grid = folds.select(fold, F.explode(named).alias("_c")).select(fold, "_c.*")
    return grid.join(counts, [fold, label], "left").select(
        fold, label, (F.col("_all") - F.coalesce("_n", F.lit(0))).alias("_n")
    ).where(F.col("_n") > 0)


def most_frequent_baseline(df: DataFrame, label: str, fold: str, out: str = "predicted_phenotype") -> DataFrame:
    """Every test row gets the most frequent training label of its fold."""
    best = _train_counts(df, label, fold).groupBy(fold).agg(F.min_by(label, F.struct(-F.col("_n"), label)).alias(out))
    return df.join(stage(best, "baseline"), fold).select(*df.columns, out)


def stratified_baseline(
    df: DataFrame, label: str, fold: str, key: Sequence[str], seed: int = 42, out: str = "predicted_phenotype"
) -> DataFrame:
    """Every test row draws a label from the training distribution of its fold."""
    counts = _train_counts(df, label, fold)
    upto = F.sum("_n").over(W.partitionBy(fold).orderBy(label).rowsBetween(W.unboundedPreceding, W.currentRow))
    shares = counts.withColumn("_upto", upto / F.sum("_n").over(W.partitionBy(fold)))
    steps = shares.groupBy(fold).agg(F.array_sort(F.collect_list(F.struct("_upto", F.col(label).alias("_lb")))).alias("_steps"))
    u = hash_uniform(seed, *key)
    drawn = F.get(F.filter("_steps", lambda s: s["_upto"] > u), F.lit(0))["_lb"]
    return df.join(stage(steps, "baseline"), fold).select(*df.columns, drawn.alias(out))


# -- decision matrices -----------------------------------------------------

Matrix = dict[str, dict[str, float]]


def matrix_from_table(long: DataFrame) -> Matrix:
    """A decision matrix from its table ``cell_type, marker, weight``, which lists classes times markers, not rows."""
    matrix: Matrix = {}
    for r in long.collect():
        matrix.setdefault(r["cell_type"], {})[r["marker"]] = r["weight"]
    return matrix


def signature_scores(matrix: Matrix, z: dict[str, Column]) -> dict[str, Column]:
    """Mean of weight times standardised expression per type, missing markers skipped."""
    scores = {}
    for cell_type, weights in matrix.items():
        terms = [(z[m] * w) for m, w in weights.items() if m in z and w is not None]
        if not terms:
            continue
        total = sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0)))
        seen = sum((t.isNotNull().cast("int") for t in terms[1:]), terms[0].isNotNull().cast("int"))
        scores[cell_type] = F.try_divide(total, seen)
    return scores


def best_signature(scores: dict[str, Column], threshold: float) -> Column:
    """Type with the highest score, the first in order on ties; ``undefined`` below the threshold."""
    options = F.array(*[F.struct(s.alias("s"), F.lit(t).alias("t")) for t, s in sorted(scores.items())])
    usable = F.filter(options, lambda o: o["s"].isNotNull())
    top = F.aggregate(
        usable,
        F.struct(F.lit(None).cast("double").alias("s"), F.lit(None).cast("string").alias("t")),
        lambda acc, o: F.when(acc["s"].isNull() | (o["s"] > acc["s"]), o).otherwise(acc),
    )
    return F.when(F.coalesce(top["s"] >= threshold, F.lit(False)), top["t"]).otherwise(F.lit(UNDEFINED))


def score_signatures(
    df: DataFrame, matrix: Matrix, threshold: float = 0.0, standardise: bool = True, out: str = "predicted_phenotype"
) -> DataFrame:
    """Label rows by a type x marker matrix of weights; types called ``Others`` mean undefined."""
    markers = sorted({m for w in matrix.values() for m in w if m in df.columns})
    zdf = zscore(df, markers, suffix="_z") if standardise else df.withColumns({f"{m}_z": F.col(m) for m in markers})
    scores = signature_scores(matrix, {m: F.col(f"{m}_z") for m in markers})
    # named columns keep each score computed once
    names = {t: f"_score{i}" for i, t in enumerate(scores)}
    scored = zdf.withColumns({names[t]: s for t, s in scores.items()})
    label = best_signature({t: F.col(c) for t, c in names.items()}, threshold)
    label = F.when(label.isin("Others", "Other"), UNDEFINED).otherwise(label)
    return scored.withColumn(out, label).select(*df.columns, out)


def score_signature_tree(
    df: DataFrame,
    matrix: Matrix,
    children: dict[str, Sequence[str]],
    roots: Sequence[str],
    depth: int = 3,
    thresholds: Sequence[float] = (0.0,),
    out: str = "predicted_phenotype",
) -> DataFrame:
    """Label rows level by level, each among the children of the label above.

    A level whose best score is below its threshold ends the descent with
    ``undefined``; a label without children is final.
    """
    markers = sorted({m for w in matrix.values() for m in w if m in df.columns})
    scored = zscore(df, markers, suffix="_z")
    scores = signature_scores(matrix, {m: F.col(f"{m}_z") for m in markers})
    names = {t: f"_score{i}" for i, t in enumerate(scores)}
    scored = scored.withColumns({names[t]: s for t, s in scores.items()})

    def choose(options: Sequence[str], level: int) -> Column:
        limit = thresholds[min(level, len(thresholds) - 1)]
        return best_signature({t: F.col(names[t]) for t in options if t in names}, limit)

    scored = scored.withColumn("_label", choose(roots, 0))
    for level in range(1, depth):
        step = None
        for parent, kids in children.items():
            cond = F.col("_label") == parent
            step = F.when(cond, choose(kids, level)) if step is None else step.when(cond, choose(kids, level))
        if step is not None:
            scored = scored.withColumn("_label", step.otherwise(F.col("_label")))
    return scored.withColumn(out, F.col("_label")).select(*df.columns, out)


# -- vectors ---------------------------------------------------------------


def centroids(train: DataFrame, label: str, vec: str, size: int | None = None) -> DataFrame:
    """Mean vector per class: ``label, centroid``.

    With a known vector ``size`` the elements are averaged in place; otherwise
    they are spread over rows first.
    """
    if size is not None:
        means = train.groupBy(F.col(label).alias("label")).agg(
            *[F.avg(F.get(F.col(vec), F.lit(i)).cast("double")).alias(f"e{i}") for i in range(size)]
        )
        return means.select("label", F.array(*[f"e{i}" for i in range(size)]).alias("centroid"))
    long = train.select(F.col(label).alias("label"), F.posexplode(vec).alias("_p", "_v"))
    means = long.groupBy("label", "_p").agg(F.avg(F.col("_v").cast("double")).alias("_v"))
    pairs = F.array_sort(F.collect_list(F.struct("_p", "_v")))
    return means.groupBy("label").agg(F.transform(pairs, lambda p: p["_v"]).alias("centroid"))


def nearest_centroid(
    train: DataFrame, rows: DataFrame, label: str, vec: str, out: str = "predicted", size: int | None = None
) -> DataFrame:
    """Class of the closest centroid, ties to the smallest label.

    The centroids travel as one scalar value, so rows are neither joined nor moved.
    """
    cents = centroids(train, label, vec, size)
    table = cents.select(F.array_sort(F.collect_list(F.struct("label", "centroid")))).scalar()
    dists = F.transform("_table", lambda c: F.struct(squared_distance(c["centroid"], vec).alias("d"), c["label"].alias("label")))
    return rows.withColumn("_table", table).withColumn("_best", F.array_min(dists)).select(
        *rows.columns, F.col("_best.label").alias(out), F.sqrt("_best.d").alias("distance")
    )


def ensemble(runs: DataFrame, key: Sequence[str], vec: str, names: Sequence[str] | None = None, size: int | None = None) -> DataFrame:
    """Mean probabilities over runs, their first maximum and its value."""
    mean = average_runs(runs, key, vec, size)
    code = argmax(vec)
    label = F.get(F.array(*[F.lit(n) for n in names]), code) if names else code
    return mean.select(*key, vec, label.alias("prediction"), F.array_max(vec).alias("confidence"))
