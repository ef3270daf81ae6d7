"""Metrics on tables small enough to work out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from cellgauge.operators import metrics as M
from cellgauge.plans.leaderboard import OVERALL_WEIGHTS, scalability, stability, weighted_sum


def scores(spark, pairs, ancestors=None):
    df = spark.createDataFrame([("k", t, p) for t, p in pairs], "key string, true_phenotype string, predicted_phenotype string")
    return M.label_metrics(M.confusion_counts(df, ["key"]), ["key"], ancestors).first().asDict()


def test_all_equal(spark):
    s = scores(spark, [("a", "a"), ("b", "b"), ("b", "b")])
    for m in ("accuracy", "macro_f1", "f1_weighted", "mcc", "kappa", "ari", "nmi", "g_mean", "jsd_scaled", "pearson_corr"):
        assert s[m] == pytest.approx(1.0), m
    assert s["jsd"] == pytest.approx(0.0)
    assert s["kl_divergence"] == pytest.approx(0.0)


def test_all_wrong(spark):
    s = scores(spark, [("a", "b"), ("b", "a"), ("b", "a")])
    assert s["accuracy"] == 0 and s["macro_f1"] == 0 and s["f1_weighted"] == 0
    assert s["g_mean"] is None
    assert s["ari"] == pytest.approx(1.0) and s["nmi"] == pytest.approx(1.0)
    assert s["mcc"] == pytest.approx(-1.0)


def test_one_class_only(spark):
    s = scores(spark, [("a", "a"), ("a", "a")])
    assert s["mcc"] == 0 and s["kappa"] is None
    assert s["ari"] == 1 and s["nmi"] == 1
    assert s["pearson_corr"] is None and s["r2"] is None


def test_label_only_in_predictions(spark):
    # a: precision 1, recall 1/2; c: never true
    s = scores(spark, [("a", "a"), ("a", "c"), ("b", "b"), ("b", "b")])
    assert s["macro_f1"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert s["f1_weighted"] == pytest.approx((2 / 3 * 2 + 1 * 2) / 4)
    assert s["g_mean"] == pytest.approx(math.sqrt(0.5 * 1))
    assert s["macro_recall"] == pytest.approx((0.5 + 1 + 0) / 3)


def test_label_only_in_truth(spark):
    s = scores(spark, [("a", "a"), ("b", "a"), ("a", "a"), ("c", "a")])
    assert s["accuracy"] == 0.5 and s["mcc"] == 0
    assert s["kappa"] == pytest.approx(0)
    assert s["g_mean"] == pytest.approx(1.0)  # classes without a hit are left out
    assert s["nmi"] == 0


def test_one_row(spark):
    s = scores(spark, [("a", "b")])
    assert s["accuracy"] == 0 and s["ari"] == 1 and s["nmi"] == 1
    assert s["jsd"] == pytest.approx(1.0)


def test_known_values(spark):
    pairs = [("a", "a")] * 4 + [("a", "b")] + [("b", "b")] * 3 + [("b", "a")] * 2
    s = scores(spark, pairs)
    n, c = 10, 7
    tp, t2, p2 = 5 * 6 + 5 * 4, 25 + 25, 36 + 16
    assert s["mcc"] == pytest.approx((c * n - tp) / math.sqrt((n * n - p2) * (n * n - t2)))
    pe = tp / n**2
    assert s["kappa"] == pytest.approx((c / n - pe) / (1 - pe))
    pair = lambda x: x * (x - 1) / 2
    idx, a, b = sum(map(pair, (4, 1, 3, 2))), 2 * pair(5), pair(6) + pair(4)
    assert s["ari"] == pytest.approx((idx - a * b / pair(10)) / ((a + b) / 2 - a * b / pair(10)))
    kl = 0.6 * math.log2(60 / 50) + 0.4 * math.log2(40 / 50)
    assert s["kl_divergence"] == pytest.approx(kl, abs=1e-9)


def test_hierarchical(spark):
    anc = spark.createDataFrame([("a", ["r", "x"]), ("b", ["r", "y"]), ("c", ["r", "x", "z"])], "label string, ancestors array<string>")
    s = scores(spark, [("a", "a"), ("a", "b"), ("a", "c"), ("a", "unknown")], anc)
    assert s["hierarchical_f1"] == pytest.approx((1 + 0.5 + 2 * 2 / 5 + 0) / 4)


def test_repeated_ancestors_count_once(spark):
    anc = spark.createDataFrame([("a", ["r", "r"]), ("b", ["r"])], "label string, ancestors array<string>")
    assert scores(spark, [("a", "b")], anc)["hierarchical_f1"] == pytest.approx(1.0)


def test_order_and_names_do_not_matter(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "c")] * 4 + [("c", "c")] * 3
    names = {"a": "x", "b": "y", "c": "z"}
    one, two = scores(spark, pairs), scores(spark, [(t, names[p]) for t, p in reversed(pairs)])
    assert one["ari"] == pytest.approx(two["ari"]) and one["nmi"] == pytest.approx(two["nmi"])
    assert scores(spark, pairs[::-1])["macro_f1"] == pytest.approx(one["macro_f1"])


def test_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", "a")], "true_phenotype string, predicted_phenotype string")
    counts = {(r.true_label, r.pred_label): r.n for r in M.confusion_counts(df, []).collect()}
    assert counts == {("a", "undefined"): 1, ("a", "a"): 1}
    assert M.dropped_rows(df.withColumn("k", F.lit(1)), ["k"]).first().n_dropped == 1


def test_large_counts(spark):
    counts = spark.createDataFrame(
        [("k", "a", "a", 30_000_000_000), ("k", "a", "b", 10_000_000_000), ("k", "b", "b", 60_000_000_000)],
        "key string, true_label string, pred_label string, n bigint")
    s = M.label_metrics(counts, ["key"]).first()
    assert s.accuracy == pytest.approx(0.9)
    assert 0 < s.ari < 1 and 0 < s.nmi < 1


# fixed values: published weighted F1, macro F1, MCC, ARI, scaled JSD and overall score of three rows
PUBLISHED = [
    (0.8567535003195254, 0.4440796920738522, 0.3875390746449053, 0.4100737178604749, 0.7749342524482511, 0.42920232111750367),
    (0.7294201194486736, 0.6124572284128994, 0.5233155763846694, 0.386249737325098, 0.8934677546570379, 0.4819778896161539),
    (0.532263450565873, 0.5081793456552626, 0.4832002686818534, 0.2611978660673753, 0.80128100411892, 0.40048762473762334),
]


def test_published_overall_score(spark):
    names = list(OVERALL_WEIGHTS)
    df = spark.createDataFrame(PUBLISHED, [*names, "published"])
    worst = df.select(F.max(F.abs(weighted_sum(OVERALL_WEIGHTS) - F.col("published")))).first()[0]
    assert worst < 1e-12


def test_stability_and_scalability(spark):
    row = spark.range(1).select(
        stability(F.lit(0.05), 0.2).alias("a"), stability(F.lit(0.5), 0.2).alias("b"), stability(F.lit(6.0), 5.0, clip=False).alias("c"),
        scalability(F.lit(0.25), F.lit(8640.0)).alias("d"), scalability(F.lit(1.0), F.lit(1e9)).alias("e")).first()
    assert row.a == pytest.approx(0.75) and row.b == 0 and row.c == pytest.approx(-0.2)
    assert row.d == pytest.approx(0.125 + 0.45) and row.e == 0.5


def test_degenerate_statistics(spark):
    from cellgauge.operators import aggregates as A
    from cellgauge.operators import transforms as T

    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 4.0)], "g string, flat double, v double")
    r = {(x.a, x.b): x.r for x in A.marker_correlation(df, ["flat", "v"]).collect()}
    assert r[("flat", "v")] is None and r[("v", "v")] == 1.0
    assert [x.flat for x in T.zscore(df, ["flat"]).collect()] == [None] * 3
    assert A.histogram(df, "flat", 4).first().n == 3
    assert {x.flat for x in T.minmax(df, ["flat"]).collect()} == {None}
    scaled = T.standard_scale(df.selectExpr("*", "'train' AS split"), ["flat"])
    assert {x.flat for x in scaled.collect()} == {0.0}
    z = A.rank_markers_wilcoxon(df.where("g = 'a'"), "g", ["v"]).first()
    assert z.z is None
