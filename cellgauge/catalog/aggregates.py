"""Counts, summaries and group statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog.fixtures import r6, rounded, with_ctes
from cellgauge.catalog.registry import query
from cellgauge.operators import aggregates as A
from cellgauge.operators import metrics as M


def sql(body: str, *ctes: str) -> str:
    return with_ctes(body, *(ctes or ("cells",)))


@query("a01_value_counts", sql("SELECT cell_type, count(*) AS n FROM (SELECT nullif(cell_type, 'error') AS cell_type FROM cells) WHERE cell_type IS NOT NULL GROUP BY 1"))
def value_counts(spark, sf):
    return A.value_counts(fx.cells(spark, sf).select(F.nullif("cell_type", F.lit("error")).alias("cell_type")), "cell_type")


@query("a02_label_distribution", sql(f"""WITH t AS (SELECT method, fold, true_phenotype AS cell_type, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY method, fold) AS tp FROM preds GROUP BY 1, 2, 3),
  p AS (SELECT method, fold, predicted_phenotype AS cell_type, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY method, fold) AS pp FROM preds GROUP BY 1, 2, 3)
  SELECT method, fold, cell_type, {r6('coalesce(pp, 0)')} AS predicted_percentage, {r6('coalesce(tp, 0)')} AS true_percentage
  FROM t FULL JOIN p USING (method, fold, cell_type)""", "preds"))
def distribution(spark, sf):
    keys = ["method", "fold"]
    return rounded(M.label_distribution(M.confusion_counts(fx.predictions(spark, sf), keys), keys))


LEVELS = ["cell_type", "level_2_cell_type", "level_1_cell_type"]


@query("a04_dataset_stats", sql("""SELECT sample_id, count(*) AS n_cells, count(DISTINCT cell_type) AS n_cell_type,
  count(DISTINCT level_2_cell_type) AS n_level_2_cell_type, count(DISTINCT level_1_cell_type) AS n_level_1_cell_type FROM cells GROUP BY 1"""))
def dataset_stats(spark, sf):
    return A.dataset_stats(fx.cells(spark, sf), "sample_id", LEVELS)


@query("a05_sum_by_platform", sql("""SELECT platform, tissue, CAST(sum(n) AS BIGINT) AS total FROM meta
  JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1, 2""", "meta"))
def sum_by(spark, sf):
    sizes = fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return A.sum_by(fx.meta(spark, sf).join(sizes, "c_custkey"), ["platform", "tissue"], "n")


@query("a06_combined_counts", sql("""WITH u AS (SELECT cell_type AS label, 'c' AS d FROM cells UNION ALL SELECT predicted_phenotype, 'p' FROM preds
    UNION ALL SELECT o_orderstatus, 'o' FROM orders)
  SELECT label, count(*) AS n, count(DISTINCT d) AS n_datasets FROM u GROUP BY 1""", "preds"))
def combined(spark, sf):
    tables = {
        "c": fx.cells(spark, sf).select(F.col("cell_type").alias("label")),
        "p": fx.predictions(spark, sf).select(F.col("predicted_phenotype").alias("label")),
        "o": fx.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("label")),
    }
    return A.combined_counts(tables, "label")


@query("a07_median_of_medians", sql(f"""WITH m AS (SELECT sample_id, median(l_extendedprice) AS med FROM expr GROUP BY 1)
  SELECT sample_id, {r6('med')} AS median, {r6('(SELECT median(med) FROM m)')} AS median_of_medians FROM m""", "expr"))
def medians(spark, sf):
    return rounded(A.median_of_medians(fx.expr(spark, sf), "sample_id", "l_extendedprice"))


@query("a08_expression_by_type", sql(f"""SELECT cell_type, marker, {r6('avg(value)')} AS mean, {r6('median(value)')} AS median
  FROM exprlong GROUP BY 1, 2""", "exprlong"))
def expression(spark, sf):
    return rounded(A.expression_by_group(fx.expr(spark, sf), "cell_type", fx.EXPR_MARKERS))


@query("a08_expression_zscored", sql(f"""WITH g AS (SELECT cell_type, marker, avg(value) AS mean, median(value) AS median FROM cellslong GROUP BY 1, 2)
  SELECT cell_type, marker, {r6('(mean - avg(mean) OVER w) / nullif(stddev_pop(mean) OVER w, 0)')} AS mean,
         {r6('(median - avg(median) OVER w) / nullif(stddev_pop(median) OVER w, 0)')} AS median FROM g WINDOW w AS (PARTITION BY marker)""", "cellslong"))
def expression_z(spark, sf):
    return rounded(A.expression_by_group(fx.cells(spark, sf), "cell_type", fx.MARKERS, standardise=True))


@query("a09_contingency", sql("SELECT cell_type, CAST(x // 100 AS BIGINT) AS cluster, count(*) AS n FROM cells GROUP BY 1, 2"))
def contingency(spark, sf):
    return A.contingency(fx.cells(spark, sf).select("cell_type", F.floor(F.col("x") / 100).alias("cluster")), "cell_type", "cluster")


@query("a10_confusion_matrix", sql("""WITH n AS (SELECT method, fold, true_phenotype AS t, predicted_phenotype AS p, count(*) AS n FROM preds GROUP BY 1, 2, 3, 4),
  l AS (SELECT method, fold, t AS lab FROM n UNION SELECT method, fold, p FROM n)
  SELECT a.method, a.fold, a.lab AS true_label, b.lab AS pred_label, coalesce(n, 0) AS n
  FROM l a JOIN l b ON a.method = b.method AND a.fold = b.fold
  LEFT JOIN n ON n.method = a.method AND n.fold = a.fold AND n.t = a.lab AND n.p = b.lab""", "preds"))
def confusion(spark, sf):
    keys = ["method", "fold"]
    return M.confusion_matrix(M.confusion_counts(fx.predictions(spark, sf), keys), keys)


@query("a11_mode_per_group", sql("""SELECT sample_id, cell_type AS mode FROM (SELECT sample_id, cell_type, row_number() OVER (PARTITION BY sample_id ORDER BY count(*) DESC, cell_type) AS r
  FROM cells GROUP BY 1, 2) WHERE r = 1"""))
def mode(spark, sf):
    return A.mode_per_group(fx.cells(spark, sf), ["sample_id"], "cell_type")


PAIRS = [(a, b) for i, a in enumerate(fx.EXPR_MARKERS) for b in fx.EXPR_MARKERS[i + 1 :]]


@query("a12_marker_correlation", sql("WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM expr" for a, b in PAIRS) + f""")
  SELECT a, b, {r6('r')} AS r FROM c UNION ALL SELECT b, a, {r6('r')} FROM c
  UNION ALL SELECT m, m, 1.0::DOUBLE FROM (SELECT unnest({list(fx.EXPR_MARKERS)}) AS m)""", "expr"))
def correlation(spark, sf):
    return rounded(A.marker_correlation(fx.expr(spark, sf), fx.EXPR_MARKERS, chunk=4))


@query("a13_centroid_correlation", sql(f"""WITH g AS (SELECT cell_type, marker, avg(value) AS v FROM cellslong GROUP BY 1, 2)
  SELECT a.cell_type AS a, b.cell_type AS b, {r6('corr(a.v, b.v)')} AS r FROM g a JOIN g b ON a.marker = b.marker AND a.cell_type < b.cell_type GROUP BY 1, 2""", "cellslong"))
def centroid_corr(spark, sf):
    return rounded(A.centroid_correlation(fx.cells(spark, sf), "cell_type", fx.MARKERS))


@query("a14_histogram", sql(f"""WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM expr),
  b AS (SELECT cell_type, least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 20)) AS INT), 19) AS bin, lo, (hi - lo) / 20 AS w FROM expr, s)
  SELECT cell_type, bin, {r6('min(lo) + bin * min(w)')} AS left_edge, count(*) AS n,
     round(count(*) / (sum(count(*)) OVER (PARTITION BY cell_type) * min(w)), 12) AS density FROM b GROUP BY cell_type, bin""", "expr"))
def histogram(spark, sf):
    h = A.histogram(fx.expr(spark, sf), "l_extendedprice", 20, ["cell_type"])
    return rounded(h, "left_edge").withColumn("density", F.round("density", 12))


@query("a15_cells_from_pixels", sql(f"""SELECT sample_id, cell_id, count(*) AS area, {r6('avg(price)')} AS mean_price, {r6('avg(discount)')} AS mean_discount,
  {r6('avg(x)')} AS cx, {r6('avg(y)')} AS cy, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max
  FROM pixels WHERE cell_id <> 0 GROUP BY 1, 2""", "pixels"))
def from_pixels(spark, sf):
    return rounded(A.cells_from_pixels(fx.pixels(spark, sf), "sample_id", "cell_id", ["price", "discount"]))


@query("a16_box_summary", sql(f"""WITH c AS (SELECT max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area FROM pixels WHERE cell_id <> 0 GROUP BY sample_id, cell_id)
  SELECT {', '.join(f'{r6(f"{f}({c})")} AS {c}_{n}' for c in ('width', 'height', 'area') for f, n in (('avg', 'mean'), ('stddev_samp', 'std')))} FROM c""", "pixels"))
def boxes(spark, sf):
    return rounded(A.box_summary(A.cells_from_pixels(fx.pixels(spark, sf), "sample_id", "cell_id", ["price"])))


WEIGHTS = "w AS (SELECT cell_type, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE) AS weight FROM cells GROUP BY 1)"


@query("a17_class_weights", sql(f"WITH {WEIGHTS} SELECT cell_type, n, {r6('weight')} AS weight FROM w"))
def weights(spark, sf):
    return rounded(A.class_weights(fx.cells(spark, sf), "cell_type"))


@query("a17_row_weights", sql(f"WITH {WEIGHTS} SELECT cell_id, cell_type, {r6('weight')} AS weight FROM cells JOIN w USING (cell_type)"))
def row_weights(spark, sf):
    return rounded(A.with_class_weight(fx.cells(spark, sf).select("cell_id", "cell_type"), "cell_type"))


MIXED = """CASE WHEN p_partkey % 200 = 0 THEN 'type_d' WHEN p_partkey % 40 = 1 THEN 'type_c' WHEN p_partkey % 8 = 2 THEN 'type_b'
                 WHEN p_partkey % 2 = 0 THEN 'type_a' ELSE p_type END"""


@query("a18_abundance_bins", sql(f"""WITH c AS (SELECT p_size % 7 AS dataset, {MIXED} AS cell_type, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY p_size % 7) AS pct
    FROM part GROUP BY 1, 2)
  SELECT dataset, cell_type, n, {r6('pct')} AS abundance_pct,
    CASE WHEN pct >= 20 THEN 'abundant' WHEN pct >= 5 THEN 'common' WHEN pct >= 1 THEN 'rare' ELSE 'ultra_rare' END AS abundance_bin FROM c"""))
def abundance(spark, sf):
    df = fx.table(spark, sf, "part").selectExpr("p_size % 7 AS dataset", f"{MIXED} AS cell_type")
    return rounded(A.abundance_bins(df, "dataset", "cell_type"))


@query("a19_expert_agreement", sql(f"""WITH e AS (SELECT cell_labels AS label, coalesce(new_label, cell_labels) AS corrected, CASE WHEN reannotated THEN 1 ELSE 0 END AS ch FROM reann),
  g AS (SELECT 'overall' AS scope, NULL AS label, NULL AS corrected, count(*) AS n, sum(ch) AS ch FROM e
   UNION ALL SELECT 'label', label, NULL, count(*), sum(ch) FROM e GROUP BY label
   UNION ALL SELECT 'pair', label, corrected, count(*), sum(ch) FROM e GROUP BY label, corrected HAVING sum(ch) > 0)
  SELECT scope, label, corrected, n, CAST(ch AS BIGINT) AS changed, {r6('1 - ch / n::DOUBLE')} AS agreement FROM g""", "reann"))
def agreement(spark, sf):
    return rounded(A.expert_agreement(fx.reannotated(spark, sf), "cell_labels", "new_label", "reannotated"))


RANKED = """r AS (SELECT cell_type, marker, rank() OVER (PARTITION BY marker ORDER BY value) + (count(*) OVER (PARTITION BY marker, value) - 1) / 2.0 AS rk,
    count(*) OVER (PARTITION BY marker)::DOUBLE AS nn FROM cellslong),
  g AS (SELECT cell_type, marker, sum(rk) AS rs, count(*)::DOUBLE AS n1, max(nn) AS nn FROM r GROUP BY 1, 2),
  z AS (SELECT cell_type, marker, n1, rs, (rs - n1 * (nn + 1) / 2) / sqrt(n1 * (nn - n1) * (nn + 1) / 12) AS z FROM g)"""


@query("a20_rank_markers_wilcoxon", sql(f"WITH {RANKED} SELECT cell_type, marker, CAST(n1 AS BIGINT) AS n_in, {r6('rs')} AS rank_sum, {r6('z')} AS z FROM z", "cellslong"))
def wilcoxon(spark, sf):
    return rounded(A.rank_markers_wilcoxon(fx.cells(spark, sf), "cell_type", fx.MARKERS).drop("p_value"))


# the normal tail from the series erf(x) = 2 / sqrt(pi) * exp(-x^2) * sum of 2^i x^(2i + 1) / (2i + 1)!!, whose terms are all positive
@query("a20_wilcoxon_p_values", sql(f"""WITH {RANKED}, x AS (SELECT cell_type, marker, least(abs(z) / sqrt(2), 6) AS x FROM z),
  t AS (SELECT cell_type, marker, sum(CASE WHEN x > 0 THEN exp(2 * i * ln(2) + (2 * i + 1) * ln(x) + lgamma(i + 1) - lgamma(2 * i + 2) - x * x) ELSE 0 END) AS s
        FROM x, (SELECT unnest(range(200)) AS i) GROUP BY ALL)
  SELECT cell_type, marker, {r6('greatest(0, 1 - 2 / sqrt(pi()) * s)')} AS p_value FROM t""", "cellslong"))
def wilcoxon_p(spark, sf):
    return rounded(A.rank_markers_wilcoxon(fx.cells(spark, sf), "cell_type", fx.MARKERS).select("cell_type", "marker", "p_value"))


@query("a21_filter_markers", sql(f"""WITH l AS (SELECT cell_type, marker, CASE WHEN value > 30 THEN value - 30 ELSE 0 END AS v FROM cellslong),
  g AS (SELECT cell_type, marker, count(*)::DOUBLE AS n, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END)::DOUBLE AS pos, sum(v) AS s FROM l GROUP BY 1, 2),
  h AS (SELECT cell_type, marker, pos / n AS share_in, (sum(pos) OVER w - pos) / (sum(n) OVER w - n) AS share_out,
        (s / n) / ((sum(s) OVER w - s) / (sum(n) OVER w - n)) AS fold FROM g WINDOW w AS (PARTITION BY marker))
  SELECT cell_type, marker, {r6('share_in')} AS share_in, {r6('share_out')} AS share_out, {r6('fold')} AS fold FROM h
  WHERE share_in >= 0.2 AND share_out <= 0.8 AND fold >= 0.99""", "cellslong"))
def filtered(spark, sf):
    df = fx.cells(spark, sf).select("cell_type", *[F.greatest(F.col(m) - 30, F.lit(0.0)).alias(m) for m in fx.MARKERS])
    return rounded(A.filter_markers(df, "cell_type", fx.MARKERS, 0.2, 0.8, 0.99))


@query("a22_top_markers", sql(f"""WITH {RANKED}, o AS (SELECT cell_type, marker, CAST(row_number() OVER (PARTITION BY cell_type ORDER BY round(z, 9) DESC, marker) AS INT) AS rank FROM z)
  SELECT * FROM o WHERE rank <= 2""", "cellslong"))
def top(spark, sf):
    scores = A.rank_markers_wilcoxon(fx.cells(spark, sf), "cell_type", fx.MARKERS)
    return A.top_n(scores, ["cell_type"], [F.desc(F.round("z", 9)), "marker"], 2).select("cell_type", "marker", "rank")


@query("a23_summary", sql("""WITH s AS (SELECT sample_id, count(*) AS n, max(m1) AS m FROM cells GROUP BY 1)
  SELECT count(*) AS n_samples, CAST(sum(n) AS BIGINT) AS n_rows, max(m) AS max_value, min(n) AS min_per_sample, max(n) AS max_per_sample FROM s"""))
def summary(spark, sf):
    return A.summary(fx.cells(spark, sf), "sample_id", "m1")


TILES = "tiles AS (SELECT vec_id % 20 AS sample_id, vec_id AS tile, (vec_id * 7) % 45 - 2 AS x0, (vec_id * 3) % 5 AS y0, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


def tile_vectors(spark, sf):
    return fx.table(spark, sf, "embeddings").selectExpr(
        "vec_id % 20 AS sample_id", "vec_id AS tile", "(vec_id * 7) % 45 - 2 AS x0", "(vec_id * 3) % 5 AS y0", "CAST(embedding AS ARRAY<DOUBLE>) AS vec")


@query("a24_uncovered_ids", sql(f"""WITH all_{TILES}, tiles AS (SELECT * FROM all_tiles WHERE tile % 10 = 3), px AS (SELECT * FROM pixels WHERE cell_id <> 0),
  spots AS (SELECT DISTINCT sample_id, x, y FROM px),
  cov AS (SELECT s.sample_id, s.x, s.y, t.vec FROM spots s JOIN tiles t ON s.sample_id = t.sample_id AND s.x >= t.x0 AND s.x < t.x0 + 6 AND s.y >= t.y0 AND s.y < t.y0 + 6),
  long AS (SELECT sample_id, x, y, unnest(vec) AS v, unnest(range(len(vec))) AS pos FROM cov),
  pv AS (SELECT sample_id, x, y, pos, avg(v) AS v FROM long GROUP BY ALL),
  ar AS (SELECT sample_id, cell_id, count(*) AS n_pixels FROM px GROUP BY 1, 2),
  ag AS (SELECT sample_id, cell_id, pos, sum(v) AS s FROM px JOIN pv USING (sample_id, x, y) GROUP BY 1, 2, 3)
  SELECT ar.sample_id, ar.cell_id, ar.n_pixels, CAST(g.pos AS INT) AS pos, {r6('coalesce(s, 0) / ar.n_pixels')} AS value FROM ar
  CROSS JOIN (SELECT unnest(range(max(len(vec)))) AS pos FROM tiles) g
  LEFT JOIN ag ON ag.sample_id = ar.sample_id AND ag.cell_id = ar.cell_id AND ag.pos = g.pos""", "pixels"))
def tiles_of_few(spark, sf):
    # most ids have no tile: zero vectors
    t = tile_vectors(spark, sf).where("tile % 10 = 3")
    vectors = A.as_vectors(A.vectors_from_tiles(fx.pixels(spark, sf), t, "sample_id", "cell_id", 6), ["sample_id", "cell_id", "n_pixels"])
    return rounded(vectors.select("sample_id", "cell_id", "n_pixels", F.posexplode("vec").alias("pos", "value")))


@query("a24_vectors_from_tiles", sql(f"""WITH {TILES}, px AS (SELECT * FROM pixels WHERE cell_id <> 0),
  spots AS (SELECT DISTINCT sample_id, x, y FROM px),
  cov AS (SELECT s.sample_id, s.x, s.y, t.vec FROM spots s JOIN tiles t ON s.sample_id = t.sample_id AND s.x >= t.x0 AND s.x < t.x0 + 6 AND s.y >= t.y0 AND s.y < t.y0 + 6),
  long AS (SELECT sample_id, x, y, unnest(vec) AS v, unnest(range(len(vec))) AS pos FROM cov),
  pv AS (SELECT sample_id, x, y, pos, avg(v) AS v FROM long GROUP BY ALL),
  ar AS (SELECT sample_id, cell_id, count(*) AS n_pixels FROM px GROUP BY 1, 2),
  ag AS (SELECT sample_id, cell_id, pos, sum(v) AS s FROM px JOIN pv USING (sample_id, x, y) GROUP BY 1, 2, 3)
  SELECT ar.sample_id, ar.cell_id, ar.n_pixels, CAST(g.pos AS INT) AS pos, {r6('coalesce(s, 0) / ar.n_pixels')} AS value FROM ar
  CROSS JOIN (SELECT unnest(range(max(len(vec)))) AS pos FROM tiles) g
  LEFT JOIN ag ON ag.sample_id = ar.sample_id AND ag.cell_id = ar.cell_id AND ag.pos = g.pos""", "pixels"))
def tiles(spark, sf):
    return rounded(A.vectors_from_tiles(fx.pixels(spark, sf), tile_vectors(spark, sf), "sample_id", "cell_id", 6))
