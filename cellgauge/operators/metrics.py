"""Label-comparison metrics from one confusion-count table.

The only pass over the rows is ``confusion_counts``; its result has at most
(labels x labels) rows per key, and every metric is an aggregate of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.functions.exprs import pearson

UNDEFINED = "undefined"

#: metric columns of :func:`label_metrics`, in report order
METRICS = (
    "f1_weighted", "hierarchical_f1", "accuracy", "macro_f1", "g_mean", "mcc", "kappa",
    "r2", "pearson_corr", "ari", "nmi", "jsd", "jsd_scaled", "kl_divergence", "kl_scaled",
    "macro_precision", "macro_recall", "weighted_precision", "weighted_recall",
)


def confusion_counts(
    preds: DataFrame,
    keys: Sequence[str],
    true_col: str = "true_phenotype",
    pred_col: str = "predicted_phenotype",
    extra: Sequence[str] = (),
) -> DataFrame:
    """Counts ``n`` per key and (true, predicted) pair.

    A null prediction counts as ``undefined``; a row without a true label is
    dropped (see :func:`dropped_rows`). ``extra`` columns join the grouping.
    """
    return (
        preds.where(F.col(true_col).isNotNull())
        .groupBy(
            *keys,
            F.col(true_col).alias("true_label"),
            F.coalesce(F.col(pred_col), F.lit(UNDEFINED)).alias("pred_label"),
            *extra,
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def dropped_rows(preds: DataFrame, keys: Sequence[str], true_col: str = "true_phenotype") -> DataFrame:
    """Rows per key that carry no true label and so take no part in the metrics."""
    return preds.groupBy(*keys).agg(F.count_if(F.col(true_col).isNull()).alias("n_dropped"))


def map_levels(
    counts: DataFrame,
    levels: Mapping[str, str | None],
    label_dim: DataFrame,
    keys: Sequence[str],
    true_cols: Mapping[str, str] | None = None,
) -> DataFrame:
    """Roll a finest-level count table up to every label level.

    ``levels`` names each output level and the column of ``label_dim`` (keyed by
    ``label``) that holds it, None for the finest level. Predictions without an
    entry keep their own label. True labels come from ``true_cols[level]`` when
    the counts carry such a column, else from ``label_dim``.
    """
    true_cols = true_cols or {}
    mapped = {lv: c for lv, c in levels.items() if c is not None}
    dim_p = label_dim.select(F.col("label").alias("pred_label"), *[F.col(c).alias(f"_p_{c}") for c in mapped.values()])
    out = counts.join(dim_p, "pred_label", "left")
    looked_up = [lv for lv in mapped if lv not in true_cols]
    if looked_up:
        dim_t = label_dim.select(
            F.col("label").alias("true_label"), *[F.col(mapped[lv]).alias(f"_t_{mapped[lv]}") for lv in looked_up]
        )
        out = out.join(dim_t, "true_label", "left")
    rows = []
    for lv, c in levels.items():
        if c is None:
            true, pred = F.col("true_label"), F.col("pred_label")
        else:
            true = F.col(true_cols[lv]) if lv in true_cols else F.coalesce(F.col(f"_t_{c}"), F.col("true_label"))
            pred = F.coalesce(F.col(f"_p_{c}"), F.col("pred_label"))
        rows.append(F.struct(F.lit(lv).alias("level"), true.alias("true_label"), pred.alias("pred_label"), F.col("n")))
    return (
        out.select(*keys, F.explode(F.array(*rows)).alias("r"))
        .groupBy(*keys, "r.level", "r.true_label", "r.pred_label")
        .agg(F.sum("r.n").alias("n"))
        .where(F.col("true_label").isNotNull())
    )


def label_totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and label of either side: true count, predicted count, agreements."""
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("bigint").alias("tp")),
    )
    return (
        counts.select(*keys, F.explode(sides).alias("s"))
        .groupBy(*keys, "s.label")
        .agg(F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.tp").alias("hits"))
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def per_class_metrics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of every label seen on either side."""
    return label_totals(counts, keys).select(
        *keys, "label",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
        "support",
    )


def label_distribution(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percentages of the predicted and the true labels, zero where absent."""
    total = F.sum("support").over(W.partitionBy(*keys)) if keys else None
    totals = label_totals(counts, keys)
    if total is None:
        total = totals.agg(F.sum("support")).scalar()
    return totals.select(
        *keys, F.col("label").alias("cell_type"),
        (F.col("predicted") / total * 100).alias("predicted_percentage"),
        (F.col("support") / total * 100).alias("true_percentage"),
    )


def confusion_matrix(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The count of every pair of labels that occur for a key, zeros included."""
    labels = label_totals(counts, keys).groupBy(*keys).agg(F.collect_set("label").alias("_labels"))
    grid = labels.select(*keys, F.explode("_labels").alias("true_label"), "_labels").select(
        *keys, "true_label", F.explode("_labels").alias("pred_label")
    )
    on = [*keys, "true_label", "pred_label"]
    return grid.join(counts, on, "left").select(*on, F.coalesce("n", F.lit(0)).alias("n"))


def pair_score(true_anc: Column, pred_anc: Column) -> Column:
    """Harmonic mean of precision and recall between two ancestor sets."""
    true_set, pred_set = F.array_distinct(true_anc), F.array_distinct(pred_anc)
    common = F.size(F.array_intersect(true_set, pred_set))
    sizes = F.size(true_set) + F.size(pred_set)
    usable = true_anc.isNotNull() & pred_anc.isNotNull() & (F.size(true_anc) > 0) & (F.size(pred_anc) > 0)
    return F.when(usable, 2 * common / sizes).otherwise(F.lit(0.0))


def with_pair_scores(counts: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Add ``pair_f1``, the ancestor-set F1 of each (true, predicted) pair."""
    t = ancestors.select(F.col("label").alias("true_label"), F.col("ancestors").alias("_ta"))
    p = ancestors.select(F.col("label").alias("pred_label"), F.col("ancestors").alias("_pa"))
    return (
        counts.join(t, "true_label", "left").join(p, "pred_label", "left")
        .withColumn("pair_f1", pair_score(F.col("_ta"), F.col("_pa")))
        .drop("_ta", "_pa")
    )


def label_metrics(
    counts: DataFrame,
    keys: Sequence[str],
    ancestors: DataFrame | None = None,
    hierarchy_when: Column | None = None,
) -> DataFrame:
    """All metrics of every key.

    Both margins and the pair sums travel through one aggregation: each count
    row is sent to its true label, its predicted label and to a pair row with a
    null label. ``hierarchy_when`` restricts hierarchical F1 (null elsewhere).
    """
    n = F.col("n").cast("double")
    zero = F.lit(0.0)
    if ancestors is not None:
        counts = with_pair_scores(counts, ancestors)
        shown = F.lit(True) if hierarchy_when is None else hierarchy_when
        hier = F.when(shown, F.col("pair_f1") * n)
    else:
        hier = F.lit(None).cast("double")
    fields = ("label", "t", "p", "tp", "n2", "nlogn", "hier")

    def row(*values: Column) -> Column:
        return F.struct(*[v.alias(name) for v, name in zip(values, fields)])

    none = F.lit(None).cast("double")
    hit = F.when(F.col("true_label") == F.col("pred_label"), n).otherwise(zero)
    parts = F.array(
        row(F.col("true_label"), n, zero, hit, zero, zero, none),
        row(F.col("pred_label"), zero, n, zero, zero, zero, none),
        row(F.lit(None).cast("string"), zero, zero, zero, n * n, n * F.log(n), hier),
    )
    sums = (
        counts.select(*keys, F.explode(parts).alias("s"))
        .groupBy(*keys, "s.label")
        .agg(*[F.sum(f"s.{f}").alias(f) for f in fields[1:]])
        .withColumn("total", F.sum("t").over(W.partitionBy(*keys)))
    )
    t, p, tp, total = (F.col(c) for c in ("t", "p", "tp", "total"))
    is_class = F.col("label").isNotNull()
    recall, precision, f1 = _ratio(tp, t), _ratio(tp, p), _ratio(2 * tp, t + p)
    q_pct, t_pct = p / total * 100, t / total * 100

    def xlog2(v: Column) -> Column:
        return F.when(v > 0, v * F.log2(2 * v / (t + p))).otherwise(zero)

    def xlogx(v: Column) -> Column:
        return F.when(v > 0, v * F.log(v)).otherwise(zero)

    agg = sums.groupBy(*keys).agg(
        F.max("total").alias("n_rows"),
        F.sum("tp").alias("c"),
        F.sum(f1 * t).alias("wf1"), F.avg(F.when(is_class, f1)).alias("macro_f1"),
        F.sum(precision * t).alias("wp"), F.avg(F.when(is_class, precision)).alias("macro_precision"),
        F.sum(recall * t).alias("wr"), F.avg(F.when(is_class, recall)).alias("macro_recall"),
        F.exp(F.avg(F.when(is_class & (recall > 0), F.log(recall)))).alias("g_mean"),
        F.sum(t * p).alias("tp_sum"), F.sum(t * t).alias("t2"), F.sum(p * p).alias("p2"),
        F.sum("n2").alias("n2"), F.sum("nlogn").alias("nlogn"),
        F.sum(xlogx(t)).alias("tlogt"), F.sum(xlogx(p)).alias("plogp"),
        F.count(F.when(is_class & (t > 0), 1)).alias("n_true"), F.count(F.when(is_class & (p > 0), 1)).alias("n_pred"),
        F.max(F.when(is_class, t)).alias("t_max"), F.min(F.when(is_class, t)).alias("t_min"),
        F.max(F.when(is_class, p)).alias("p_max"), F.min(F.when(is_class, p)).alias("p_min"),
        pearson(F.when(is_class, p), F.when(is_class, t)).alias("corr"),
        F.sum(F.when(is_class, q_pct / 100 * F.log2((q_pct + 1e-9) / (t_pct + 1e-9)))).alias("kl_divergence"),
        F.sum(F.when(is_class, xlog2(t) + xlog2(p))).alias("js"),
        F.sum("hier").alias("hier"),
    )
    nn, c = F.col("n_rows"), F.col("c")
    # Matthews correlation and kappa
    mcc_den = F.sqrt((nn * nn - F.col("p2")) * (nn * nn - F.col("t2")))
    mcc = F.when(mcc_den > 0, (c * nn - F.col("tp_sum")) / mcc_den).otherwise(zero)
    pe = F.col("tp_sum") / (nn * nn)
    kappa = F.when(pe < 1, (c / nn - pe) / (1 - pe))
    # pair counts of the Rand index
    same_both = F.col("n2") - nn
    fn, fp = F.col("t2") - F.col("n2"), F.col("p2") - F.col("n2")
    tn = nn * nn - F.col("t2") - F.col("p2") + F.col("n2")
    ari_den = (same_both + fn) * (fn + tn) + (same_both + fp) * (fp + tn)
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(2 * (same_both * tn - fn * fp) / ari_den)
    # mutual information: sum n ln n separates from the margins
    h_true, h_pred = F.log(nn) - F.col("tlogt") / nn, F.log(nn) - F.col("plogp") / nn
    mi = F.log(nn) + (F.col("nlogn") - F.col("tlogt") - F.col("plogp")) / nn
    nmi = (
        F.when((F.col("n_true") == 1) & (F.col("n_pred") == 1), F.lit(1.0))
        .when(mi < 1e-12, zero)
        .otherwise(mi / ((h_true + h_pred) / 2))
    )
    varies = (F.col("t_max") > F.col("t_min")) & (F.col("p_max") > F.col("p_min"))
    corr = F.when(varies, F.col("corr"))
    jsd = F.sqrt(F.greatest(F.col("js") / (2 * nn), zero))
    return agg.select(
        *keys,
        nn.cast("bigint").alias("n_rows"),
        (F.col("wf1") / nn).alias("f1_weighted"),
        (F.col("hier") / nn).alias("hierarchical_f1"),
        (c / nn).alias("accuracy"),
        "macro_f1", "g_mean", mcc.alias("mcc"), kappa.alias("kappa"),
        (corr * corr).alias("r2"), corr.alias("pearson_corr"),
        ari.alias("ari"), nmi.alias("nmi"), jsd.alias("jsd"), (1 - jsd).alias("jsd_scaled"),
        "kl_divergence", (1 / (1 + F.col("kl_divergence"))).alias("kl_scaled"),
        "macro_precision", "macro_recall",
        (F.col("wp") / nn).alias("weighted_precision"), (F.col("wr") / nn).alias("weighted_recall"),
    )


def mean_std(
    metrics: DataFrame, by: Sequence[str], values: Sequence[str], population: bool = False
) -> DataFrame:
    """Mean and standard deviation over folds; nulls are skipped."""
    std = F.stddev_pop if population else F.stddev_samp
    aggs = [f(v).alias(f"{v}_{s}") for v in values for f, s in ((F.avg, "mean"), (std, "std"))]
    return metrics.groupBy(*by).agg(*aggs)


def adapt_to_vocabulary(
    preds: DataFrame,
    known: Sequence[str],
    extra: Sequence[str] = (),
    true_col: str = "true_phenotype",
    pred_col: str = "predicted_phenotype",
) -> DataFrame:
    """Fair scoring of a method with a fixed vocabulary.

    Rows whose true label the method cannot know are dropped, then predictions
    outside the remaining true labels (plus ``extra``) become ``Other``.
    """
    from cellgauge.operators.cleaning import bin_out_of_vocab, keep_values

    return bin_out_of_vocab(keep_values(preds, true_col, known), true_col, pred_col, extra)


def vocabulary_check(labels: DataFrame, label_col: str, ancestors: DataFrame) -> DataFrame:
    """Each distinct label and whether the label tree knows it."""
    known = ancestors.select("label").union(ancestors.select(F.explode("ancestors").alias("label"))).distinct()
    seen = labels.select(F.col(label_col).alias("label")).where(F.col(label_col).isNotNull()).distinct()
    return seen.join(known.withColumn("in_tree", F.lit(True)), "label", "left").select(
        "label", F.coalesce("in_tree", F.lit(False)).alias("in_tree")
    )
