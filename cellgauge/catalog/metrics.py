"""Label-comparison metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog.fixtures import r6, rounded, with_ctes
from cellgauge.catalog.registry import query
from cellgauge.operators import metrics as M
from cellgauge.operators.cleaning import keep_values
from cellgauge.plans.evaluation import LEVELS, fold_metrics

KEYS = ("method", "fold", "level")
TRUE_COLS = {"level_1": "level_1_cell_type", "level_2": "level_2_cell_type"}

# -- reference SQL ---------------------------------------------------------

LEVELLED = """dim AS (SELECT DISTINCT cell_type, level_2_cell_type AS l2, level_1_cell_type AS l1 FROM cells),
lv AS (
  SELECT method, fold, 'level_3' AS level, true_phenotype AS t, predicted_phenotype AS p FROM preds
  UNION ALL SELECT method, fold, 'level_2', level_2_cell_type, coalesce(l2, predicted_phenotype)
            FROM preds LEFT JOIN dim ON predicted_phenotype = dim.cell_type
  UNION ALL SELECT method, fold, 'level_1', level_1_cell_type, coalesce(l1, predicted_phenotype)
            FROM preds LEFT JOIN dim ON predicted_phenotype = dim.cell_type)"""

COUNTED = """nij AS (SELECT method, fold, level, t, p, count(*)::DOUBLE AS n FROM lv GROUP BY ALL),
tot AS (SELECT method, fold, level, sum(n) AS nn, sum(CASE WHEN t = p THEN n ELSE 0 END) AS c FROM nij GROUP BY ALL),
ti AS (SELECT method, fold, level, t AS lab, sum(n) AS tn FROM nij GROUP BY ALL),
pj AS (SELECT method, fold, level, p AS lab, sum(n) AS pn FROM nij GROUP BY ALL),
labs AS (SELECT method, fold, level, lab FROM ti UNION SELECT method, fold, level, lab FROM pj),
cls0 AS (SELECT l.*, coalesce(tn, 0) AS tn, coalesce(pn, 0) AS pn, coalesce(n, 0) AS tp, tot.nn
  FROM labs l JOIN tot USING (method, fold, level)
  LEFT JOIN ti USING (method, fold, level, lab) LEFT JOIN pj USING (method, fold, level, lab)
  LEFT JOIN nij ON nij.method = l.method AND nij.fold = l.fold AND nij.level = l.level AND nij.t = l.lab AND nij.p = l.lab),
cls1 AS (SELECT *, CASE WHEN pn > 0 THEN tp / pn ELSE 0 END AS pr, CASE WHEN tn > 0 THEN tp / tn ELSE 0 END AS re FROM cls0),
cls AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1,
  100 * tn / nn AS tpct, 100 * pn / nn AS ppct, (tn + pn) / (2 * nn) AS mid FROM cls1)"""

SCORED = f"""{COUNTED},
anc AS (SELECT cell_type, [l1, l2] AS a FROM dim),
pairs AS (SELECT method, fold, level,
    sum(n * (n - 1) / 2) AS idx, sum(n / nn * ln(n * nn / (tn * pn))) AS mi,
    sum(n * CASE WHEN ta.a IS NULL OR pa.a IS NULL THEN 0 ELSE
        2.0 * len(list_intersect(ta.a, pa.a)) / (len(list_distinct(ta.a)) + len(list_distinct(pa.a))) END) / max(nn) AS hf
  FROM nij JOIN tot USING (method, fold, level)
  JOIN ti ON ti.method = nij.method AND ti.fold = nij.fold AND ti.level = nij.level AND ti.lab = nij.t
  JOIN pj ON pj.method = nij.method AND pj.fold = nij.fold AND pj.level = nij.level AND pj.lab = nij.p
  LEFT JOIN anc ta ON ta.cell_type = nij.t LEFT JOIN anc pa ON pa.cell_type = nij.p
  GROUP BY method, fold, level),
sums AS (SELECT method, fold, level, max(nn) AS nn, sum(tp) AS c,
    sum(f1 * tn) / max(nn) AS f1_weighted, avg(f1) AS macro_f1, avg(pr) AS macro_precision, avg(re) AS macro_recall,
    sum(pr * tn) / max(nn) AS weighted_precision, sum(re * tn) / max(nn) AS weighted_recall,
    pow(product(CASE WHEN re > 0 THEN re END), 1.0 / count(CASE WHEN re > 0 THEN 1 END)) AS g_mean,
    sum(tn * pn) AS tp2, sum(tn * tn) AS t2, sum(pn * pn) AS p2,
    sum(tn * (tn - 1) / 2) AS a2, sum(pn * (pn - 1) / 2) AS b2,
    -sum(CASE WHEN tn > 0 THEN tn / nn * ln(tn / nn) ELSE 0 END) AS ht,
    -sum(CASE WHEN pn > 0 THEN pn / nn * ln(pn / nn) ELSE 0 END) AS hp,
    count(CASE WHEN tn > 0 THEN 1 END) AS nt, count(CASE WHEN pn > 0 THEN 1 END) AS np,
    CASE WHEN max(tn) > min(tn) AND max(pn) > min(pn) THEN corr(ppct, tpct) END AS r,
    sum(ppct / 100 * log2((ppct + 1e-9) / (tpct + 1e-9))) AS kl,
    sqrt(greatest(0, 0.5 * sum(CASE WHEN tn > 0 THEN tn / nn * log2(tn / nn / mid) ELSE 0 END
                + CASE WHEN pn > 0 THEN pn / nn * log2(pn / nn / mid) ELSE 0 END))) AS jsd
  FROM cls GROUP BY method, fold, level),
mt AS (SELECT s.method, s.fold, s.level, f1_weighted, macro_f1, macro_precision, macro_recall,
    weighted_precision, weighted_recall, g_mean, c / nn AS accuracy,
    CASE WHEN s.level = 'level_3' THEN hf END AS hierarchical_f1,
    CASE WHEN (nn * nn - p2) * (nn * nn - t2) > 0
         THEN (c * nn - tp2) / sqrt((nn * nn - p2) * (nn * nn - t2)) ELSE 0 END AS mcc,
    CASE WHEN tp2 < nn * nn THEN (c / nn - tp2 / nn / nn) / (1 - tp2 / nn / nn) END AS kappa,
    r * r AS r2, r AS pearson_corr,
    CASE WHEN idx = a2 AND idx = b2 THEN 1 ELSE
      (idx - a2 * b2 / (nn * (nn - 1) / 2)) / ((a2 + b2) / 2 - a2 * b2 / (nn * (nn - 1) / 2)) END AS ari,
    CASE WHEN nt = 1 AND np = 1 THEN 1 WHEN mi < 1e-12 THEN 0 ELSE mi / ((ht + hp) / 2) END AS nmi,
    jsd, 1 - jsd AS jsd_scaled, kl AS kl_divergence, 1 / (1 + kl) AS kl_scaled
  FROM sums s JOIN pairs USING (method, fold, level))"""


def metric_sql(*cols: str, source: str = LEVELLED, tail: str = "") -> str:
    picked = ", ".join(f"{r6(c)} AS {c}" for c in cols)
    return with_ctes(f"WITH {source},\n{SCORED}\nSELECT method, fold, level, {picked} FROM mt {tail}", "preds")


# -- every metric per method, fold and level -------------------------------


def suite(spark, sf):
    return fold_metrics(fx.predictions(spark, sf), fx.label_dim(spark, sf), fx.ancestors(spark, sf), true_cols=TRUE_COLS)


def _register(name: str, *cols: str) -> None:
    @query(name, metric_sql(*cols))
    def _(spark, sf, cols=cols):
        return rounded(suite(spark, sf).select(*KEYS, *cols))


_register("m01_accuracy", "accuracy")
_register("m03_macro_f1", "macro_f1")
_register("m04_weighted_f1", "f1_weighted")
_register("m05_precision_recall", "macro_precision", "macro_recall", "weighted_precision", "weighted_recall")
_register("m06_mcc", "mcc")
_register("m07_kappa", "kappa")
_register("m08_ari", "ari")
_register("m09_nmi", "nmi")
_register("m10_hierarchical_f1", "hierarchical_f1")
_register("m11_g_mean", "g_mean")
_register("m12_pearson_r2", "pearson_corr", "r2")
_register("m13_kl_divergence", "kl_divergence", "kl_scaled")
_register("m14_jensen_shannon", "jsd", "jsd_scaled")
_register("m00_full_suite", *M.METRICS)


@query("m02_per_class", with_ctes(
    f"""WITH {LEVELLED}, {COUNTED}
    SELECT method, fold, level, lab AS label, {r6('pr')} AS precision, {r6('re')} AS recall, {r6('f1')} AS f1,
           CAST(tn AS BIGINT) AS support FROM cls""", "preds"))
def per_class(spark, sf):
    return rounded(M.per_class_metrics(levelled_counts(spark, sf), KEYS))


def levelled_counts(spark, sf):
    keys = ["method", "fold"]
    counts = M.confusion_counts(fx.predictions(spark, sf), keys, extra=list(TRUE_COLS.values()))
    return M.map_levels(counts, LEVELS, fx.label_dim(spark, sf), keys, TRUE_COLS)


@query("m15_level_mapping", with_ctes(
    f"WITH {LEVELLED} SELECT method, fold, level, t AS true_label, p AS pred_label, count(*) AS n FROM lv GROUP BY ALL", "preds"))
def level_mapping(spark, sf):
    return levelled_counts(spark, sf)


LIMITED = ("click", "view", "error")


@query("m16_restricted_classes", metric_sql(
    *M.METRICS,
    source=LEVELLED.replace("FROM preds", "FROM (SELECT * FROM preds WHERE true_phenotype IN ('click', 'view', 'error')) preds")))
def restricted(spark, sf):
    kept = keep_values(fx.predictions(spark, sf), "true_phenotype", LIMITED)
    out = fold_metrics(kept, fx.label_dim(spark, sf), fx.ancestors(spark, sf), true_cols=TRUE_COLS)
    return rounded(out.select(*KEYS, *M.METRICS))


@query("m17_adapted_vocabulary", with_ctes(
    """SELECT method, true_phenotype,
         CASE WHEN predicted_phenotype IN ('click', 'view', 'signup', 'bot') THEN predicted_phenotype ELSE 'Other' END AS predicted_phenotype,
         count(*) AS n
       FROM preds WHERE true_phenotype IN ('click', 'view', 'bot') GROUP BY ALL""", "preds"))
def adapted(spark, sf):
    out = M.adapt_to_vocabulary(fx.predictions(spark, sf), ["click", "view", "bot"], ["signup"])
    return out.groupBy("method", "true_phenotype", "predicted_phenotype").agg(F.count(F.lit(1)).alias("n"))


@query("m18_vocabulary_check", with_ctes(
    """WITH known AS (SELECT DISTINCT unnest([cell_type, level_2_cell_type, level_1_cell_type]) AS label FROM cells),
       seen AS (SELECT DISTINCT CASE WHEN predicted_phenotype = 'view' AND method = 'm_b' THEN 'views' ELSE predicted_phenotype END AS label FROM preds)
       SELECT label, label IN (SELECT label FROM known) AS in_tree FROM seen""", "preds"))
def vocabulary(spark, sf):
    odd = F.when((F.col("predicted_phenotype") == "view") & (F.col("method") == "m_b"), "views").otherwise(F.col("predicted_phenotype"))
    preds = fx.predictions(spark, sf).withColumn("predicted_phenotype", odd)
    return M.vocabulary_check(preds, "predicted_phenotype", fx.ancestors(spark, sf))


@query("m20_fold_summary", metric_sql("accuracy").split("SELECT method, fold, level, (round")[0]
       + f"""SELECT method, level, {r6('avg(accuracy)')} AS accuracy_mean, {r6('stddev_pop(accuracy)')} AS accuracy_std,
             {r6('avg(macro_f1)')} AS macro_f1_mean, {r6('stddev_pop(macro_f1)')} AS macro_f1_std FROM mt GROUP BY method, level""")
def fold_summary(spark, sf):
    return rounded(M.mean_std(suite(spark, sf), ["method", "level"], ["accuracy", "macro_f1"], population=True))


@query("m21_null_policy", with_ctes(
    """SELECT method, fold, count(*) FILTER (WHERE true_phenotype IS NULL) AS n_dropped,
         count(*) FILTER (WHERE true_phenotype IS NOT NULL AND predicted_phenotype IS NULL) AS n_undefined
       FROM (SELECT method, fold, nullif(true_phenotype, 'signup') AS true_phenotype,
                    nullif(predicted_phenotype, 'click') AS predicted_phenotype FROM preds) GROUP BY ALL""", "preds"))
def null_policy(spark, sf):
    preds = fx.predictions(spark, sf).withColumns({
        "true_phenotype": F.nullif("true_phenotype", F.lit("signup")), "predicted_phenotype": F.nullif("predicted_phenotype", F.lit("click")),
    })
    keys = ["method", "fold"]
    counts = M.confusion_counts(preds, keys)
    undefined = counts.groupBy(*keys).agg(F.sum(F.when(F.col("pred_label") == M.UNDEFINED, F.col("n")).otherwise(0)).alias("n_undefined"))
    return M.dropped_rows(preds, keys).join(undefined, keys)
