"""Scores and rankings of methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog import metrics as cm
from cellgauge.catalog.fixtures import r6, rounded, with_ctes
from cellgauge.catalog.registry import query
from cellgauge.operators.metrics import METRICS, mean_std
from cellgauge.plans import leaderboard as L
from cellgauge.plans.evaluation import leaderboard, summarise_folds
from cellgauge.sources.tables import parse_fold_times

GROUPS = {"supervised": ["m_b", "m_a"], "baseline": ["m_c"]}
BY = ["method", "level"]

MEANS = ", ".join(f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in METRICS)
HEAD = f"WITH {cm.LEVELLED},\n{cm.SCORED},\nms AS (SELECT method, level, {MEANS} FROM mt GROUP BY method, level)"
STAB = "CASE WHEN 1 - f1_weighted_std / 0.2 < 0 THEN 0 ELSE 1 - f1_weighted_std / 0.2 END"
OVERALL = "0.16 * f1_weighted_mean + 0.20 * macro_f1_mean + 0.20 * mcc_mean + 0.08 * ari_mean + 0.12 * jsd_scaled_mean"


def sql(body: str) -> str:
    return with_ctes(f"{HEAD}\n{body}", "preds")


def summary(spark, sf):
    return summarise_folds(cm.suite(spark, sf))


SHOWN = ["f1_weighted_mean", "hierarchical_f1_mean", "macro_f1_mean", "mcc_mean", "ari_mean", "jsd_scaled_mean"]
AVERAGE = "list_avg([" + ", ".join([*SHOWN, "overall", "stability"]) + "])"


@query("l00_leaderboard", sql(f"""
, sc AS (SELECT *, {STAB} AS stability, {OVERALL} AS overall FROM ms),
av AS (SELECT *, {AVERAGE} AS average FROM sc)
SELECT level, CAST(row_number() OVER (PARTITION BY level ORDER BY round(average, 12) DESC, method) AS INT) AS rank, method,
  {', '.join(f'{r6(c)} AS {c}' for c in [*SHOWN, 'overall', 'stability', 'average'])} FROM av"""))
def board(spark, sf):
    return rounded(leaderboard(fx.predictions(spark, sf), fx.label_dim(spark, sf), fx.ancestors(spark, sf)))


# two datasets, with runtimes and automation; the dataset rides in the method's name through the metric SQL
DATASETS = HEAD.replace("FROM preds", "FROM two").replace("WITH ", """WITH two AS (SELECT * REPLACE (concat(CASE WHEN cell_id % 3 = 0 THEN 'a' ELSE 'b' END, '/', method) AS method) FROM preds),
""", 1)


@query("l00_leaderboard_datasets", with_ctes(f"""{DATASETS},
au AS (SELECT * FROM (VALUES ('m_a', 1.0), ('m_b', 0.5)) v(name, automation)),
tm AS (SELECT method, avg(seconds) AS seconds FROM (SELECT method, fold * 1000.0 + length(method) AS seconds FROM (SELECT DISTINCT method, fold FROM two)) GROUP BY method),
sc AS (SELECT ms.*, {STAB} AS stability, {OVERALL} AS overall, 0.5 * automation + 0.5 * greatest(0, 1 - seconds / 86400.0) AS scalability
       FROM ms LEFT JOIN tm USING (method) LEFT JOIN au ON au.name = split_part(ms.method, '/', 2)),
av AS (SELECT *, list_avg([{', '.join([*SHOWN, 'overall', 'stability', 'scalability'])}]) AS average FROM sc)
SELECT split_part(method, '/', 1) AS dataset, level,
  CAST(row_number() OVER (PARTITION BY split_part(method, '/', 1), level ORDER BY round(average, 12) DESC, method) AS INT) AS rank, split_part(method, '/', 2) AS method,
  {', '.join(f'{r6(c)} AS {c}' for c in [*SHOWN, 'overall', 'stability', 'scalability', 'average'])} FROM av""", "preds"))
def board_of_datasets(spark, sf):
    preds = fx.predictions(spark, sf).withColumn("dataset", F.when(F.col("cell_id") % 3 == 0, "a").otherwise("b"))
    # a second folder with coarse labels, which the finest level replaces
    coarse = preds.withColumn("predicted_phenotype", F.col("level_1_cell_type"))
    both = preds.withColumn("level", F.lit("level3")).unionByName(coarse.withColumn("level", F.lit("level1")))
    times = preds.select("dataset", "method", "fold").distinct().select("dataset", "method", F.lit("inference_time").alias("event"), (F.col("fold") * 1000.0 + 5).alias("seconds"))
    automation = spark.createDataFrame([("m_a", 1.0), ("m_b", 0.5)], "method string, automation double")
    return rounded(leaderboard(both, fx.label_dim(spark, sf), fx.ancestors(spark, sf), times=times, automation=automation))


@query("a03_mean_std_over_folds", sql(
    f"SELECT method, level, {', '.join(f'{r6(f'{m}_{s}')} AS {m}_{s}' for m in METRICS for s in ('mean', 'std'))} FROM ms"))
def mean_std_folds(spark, sf):
    return rounded(mean_std(cm.suite(spark, sf), BY, METRICS))


@query("j13_mean_std_joined", sql(
    f"SELECT method, level, {r6('f1_weighted_mean')} AS f1_weighted_mean, {r6('f1_weighted_std')} AS f1_weighted_std FROM ms"))
def mean_std_joined(spark, sf):
    return rounded(mean_std(cm.suite(spark, sf), BY, ["f1_weighted"]))


@query("l01_stability", sql(
    f"""SELECT method, level, {r6(STAB)} AS stability,
        {r6('greatest(0, 1 - f1_weighted_std / 0.1)')} AS stability_tight, {r6('1 - mcc_std / 5')} AS stability_mcc FROM ms"""))
def stability(spark, sf):
    return rounded(summary(spark, sf).select(
        *BY, "stability", L.stability("f1_weighted_std", 0.1).alias("stability_tight"),
        L.stability("mcc_std", 5.0, clip=False).alias("stability_mcc"),
    ))


# -- times and scalability -------------------------------------------------

TIMES = """WITH lines AS (
  SELECT o_orderkey % 3 AS run, o_orderkey AS line,
    CASE WHEN o_orderkey % 97 = 0 THEN 'note without number' WHEN o_orderkey % 89 = 0 THEN 'Fold 1: training_time: 3'
         ELSE concat('Fold ', CAST(o_orderkey % 5 + 1 AS VARCHAR),
              CASE WHEN o_orderkey % 2 = 0 THEN ' training_time: ' ELSE ' inference_time, ' END, CAST(o_orderkey % 100 AS VARCHAR),
              CASE WHEN o_orderkey % 7 = 0 THEN ' seconds' WHEN o_orderkey % 7 = 1 THEN 's' ELSE '' END) END AS value
  FROM orders),
parts AS (SELECT run, line, string_split(replace(value, ',', ':'), ':') AS ps FROM lines),
named AS (SELECT run, line, trim(ps[1]) AS nm, TRY_CAST(regexp_extract(trim(ps[2]), '^[0-9.]+') AS DOUBLE) AS seconds
          FROM parts WHERE len(ps) = 2),
times AS (SELECT run, split_part(nm, ' ', 2) AS fold, split_part(nm, ' ', 3) AS event, seconds FROM named
          QUALIFY row_number() OVER (PARTITION BY run, nm ORDER BY line DESC) = 1)
"""


def times(spark, sf):
    return parse_fold_times(fx.time_lines(spark, sf), by=["run"], order=["line"])


@query("l02_mean_times", TIMES + f"""SELECT run, {r6("avg(seconds) FILTER (WHERE event IN ('train_time', 'training_time'))")} AS train_time,
  {r6('avg(seconds)')} AS inference_time,
  {r6("avg(seconds) FILTER (WHERE event NOT IN ('train_time', 'training_time'))")} AS strict_inference_time FROM times GROUP BY run""")
def mean_times(spark, sf):
    t = times(spark, sf)
    strict = L.mean_times(t, ["run"], strict=True).select("run", F.col("inference_time").alias("strict_inference_time"))
    return rounded(L.mean_times(t, ["run"]).join(strict, "run"))


@query("l03_scalability", TIMES + f"""SELECT run,
  {r6('0.5 * CASE run WHEN 0 THEN 0.25 WHEN 1 THEN 0.75 ELSE 1.0 END + 0.5 * greatest(0, 1 - sum(seconds) * 60 / 86400)')} AS scalability
  FROM times GROUP BY run""")
def scalability(spark, sf):
    automation = spark.createDataFrame([(0, 0.25), (1, 0.75), (2, 1.0)], "run bigint, automation double")
    total = times(spark, sf).groupBy("run").agg((F.sum("seconds") * 60).alias("seconds"))
    return rounded(L.add_scalability(total, automation, "seconds", "run").select("run", "scalability"))


# -- scores ----------------------------------------------------------------


@query("l04_overall_score", sql(f"""SELECT method, level, {r6(OVERALL)} AS overall,
  {r6(f'(f1_weighted_mean + accuracy_mean + macro_f1_mean + mcc_mean + kappa_mean + r2_mean + pearson_corr_mean + ari_mean + ({STAB})) / 9')} AS score_9,
  {r6(f'(f1_weighted_mean + accuracy_mean + macro_f1_mean + mcc_mean + kappa_mean + r2_mean + pearson_corr_mean + ari_mean + nmi_mean + ({STAB})) / 10')} AS score_10
  FROM ms"""))
def overall(spark, sf):
    return rounded(summary(spark, sf).select(
        *BY, L.weighted_sum(L.OVERALL_WEIGHTS, "_mean").alias("overall"),
        L.mean_score(L.NINE_METRICS).alias("score_9"), L.mean_score(L.TEN_METRICS).alias("score_10"),
    ))


@query("l05_weighted_score", sql(f"""SELECT method, level, {r6(
    '0.1 * macro_f1_mean + 0.1 * mcc_mean + 0.1 * kappa_mean + 0.06 * f1_weighted_mean + 0.04 * accuracy_mean'
    f' + 0.06 * r2_mean + 0.06 * pearson_corr_mean + 0.09 * ari_mean + 0.09 * nmi_mean + 0.2 * ({STAB})')} AS weighted_score FROM ms"""))
def weighted(spark, sf):
    return rounded(L.category_score(summary(spark, sf)).select(*BY, "weighted_score"))


RANKED = f""", sc AS (SELECT *, {STAB} AS stability FROM ms),
av AS (SELECT method, level, list_avg([f1_weighted_mean, hierarchical_f1_mean, mcc_mean, stability]) AS average FROM sc)"""


@query("l06_rank_methods", sql(RANKED + f"""SELECT method, level, {r6('average')} AS average,
  CAST(row_number() OVER (PARTITION BY level ORDER BY round(average, 12) DESC, method) AS INT) AS rank FROM av"""))
def ranked(spark, sf):
    r = L.rank_methods(summary(spark, sf), ["f1_weighted_mean", "hierarchical_f1_mean", "mcc_mean", "stability"], ["level"])
    return rounded(r.select(*BY, "average", "rank"))


@query("l06_group_order", sql("""SELECT method, CAST(row_number() OVER (ORDER BY
    CASE method WHEN 'm_b' THEN 0 WHEN 'm_a' THEN 1 ELSE 2 END) AS INT) AS position FROM ms WHERE level = 'level_3'"""))
def grouped_order(spark, sf):
    return L.sort_by_groups(L.select_rows(summary(spark, sf), level="level_3"), GROUPS).select("method", "position")


@query("l07_sort_by_score", sql(f"SELECT level, method, {r6(OVERALL)} AS overall FROM ms ORDER BY level, overall DESC, method"))
def sorted_scores(spark, sf):
    scored = summary(spark, sf).withColumn("overall", L.weighted_sum(L.OVERALL_WEIGHTS, "_mean"))
    return rounded(L.sort_by_score(scored, "overall").select("level", "method", "overall"))


@query("l08_select_rows", sql(f"""SELECT method, level, {r6('mcc_mean')} AS mcc_mean FROM ms
  WHERE level = 'level_2' AND method IN ('m_a', 'm_b')"""))
def selected(spark, sf):
    rows = L.select_rows(summary(spark, sf), level="level_2", groups=GROUPS, chosen=["supervised"])
    return rounded(rows.select(*BY, "mcc_mean"))


CLASS_COLS = ", ".join(f"{r6(f'avg(CASE WHEN lab = ' + repr(c) + ' THEN f1 END)')} AS {c}" for c in fx.CLASSES)


@query("l09_per_class_table", with_ctes(f"""WITH {cm.LEVELLED}, {cm.COUNTED},
  pm AS (SELECT method, lab, avg(f1) AS f1 FROM cls WHERE level = 'level_3' AND lab IN
         (SELECT lab FROM cls WHERE level = 'level_3' GROUP BY lab HAVING max(tn) > 0) GROUP BY method, lab)
  SELECT method, {CLASS_COLS}, {r6('avg(f1)')} AS average FROM pm GROUP BY method""", "preds"))
def class_table(spark, sf):
    pc = cm.M.per_class_metrics(cm.levelled_counts(spark, sf).where(F.col("level") == "level_3"), cm.KEYS)
    return rounded(L.per_class_table(pc, fx.CLASSES))


@query("l09_class_support", with_ctes(f"""WITH {cm.LEVELLED}, {cm.COUNTED}
  SELECT lab AS label, CAST(max(tn) AS BIGINT) AS max_support FROM cls GROUP BY lab HAVING max(tn) > 0""", "preds"))
def support(spark, sf):
    return L.class_support(cm.M.per_class_metrics(cm.levelled_counts(spark, sf), cm.KEYS))


@query("l10_normalise_visible", sql(f""", g AS (SELECT min(least(f1_weighted_mean, mcc_mean, ari_mean)) AS lo,
    max(greatest(f1_weighted_mean, mcc_mean, ari_mean)) AS hi FROM ms)
  SELECT method, level, {', '.join(f'{r6(f"({m} - lo) / (hi - lo)")} AS {m}' for m in ('f1_weighted_mean', 'mcc_mean', 'ari_mean'))} FROM ms, g"""))
def normalised(spark, sf):
    ms = ["f1_weighted_mean", "mcc_mean", "ari_mean"]
    return rounded(L.normalise_visible(summary(spark, sf).select(*BY, *ms), ms))


@query("l11_average_over_datasets", sql(
    "SELECT method, round(avg(mcc_mean), 3) + 0.0 AS mcc_mean, round(avg(ari_mean), 3) + 0.0 AS ari_mean FROM ms GROUP BY method"))
def over_datasets(spark, sf):
    return L.average_over_datasets(summary(spark, sf), ["mcc_mean", "ari_mean"])


@query("l12_metric_range", sql(f"SELECT method, {r6('max(mcc_mean) - min(mcc_mean)')} AS range FROM ms GROUP BY method"))
def spread(spark, sf):
    return rounded(L.metric_range(summary(spark, sf), "mcc_mean"))
