"""Labelling: clusters, baselines, signatures, neighbourhoods and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog import joins as cj
from cellgauge.catalog.fixtures import r6, rounded, with_ctes
from cellgauge.catalog.registry import query
from cellgauge.operators import models as ML
from cellgauge.operators import signatures as G
from cellgauge.operators import spatial as SP
from cellgauge.operators import vectors as V
from cellgauge.operators.metrics import confusion_counts, label_metrics
from cellgauge.plans.labelling import cluster_and_transfer, make_folds, train_and_evaluate
from cellgauge.session import stage


def sql(body: str, *ctes: str) -> str:
    return with_ctes(body, *(ctes or ("cells",)))


# -- clusters and baselines ------------------------------------------------


def clustered(spark, sf):
    return fx.cells(spark, sf).select("cell_id", "cell_type", F.floor(F.col("x") / 4).alias("cluster"))


MAPPED = """cl AS (SELECT cell_id, cell_type, x // 4 AS cluster FROM cells),
  mp AS (SELECT cluster, cell_type AS mapped FROM cl GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, cell_type) = 1)"""


@query("c01_greedy_majority", sql(f"WITH {MAPPED} SELECT cell_id, cell_type, CAST(cluster AS BIGINT) AS cluster, mapped AS predicted_phenotype FROM cl JOIN mp USING (cluster)"))
def greedy(spark, sf):
    return G.assign_majority(clustered(spark, sf), "cluster", "cell_type")


def _greedy_metrics_sql() -> str:
    from cellgauge.catalog.metrics import SCORED

    cols = ("macro_f1", "f1_weighted", "ari", "nmi", "accuracy", "mcc", "kappa")
    picked = ", ".join(f"{r6(c)} AS {c}" for c in cols)
    return sql(f"""WITH dim AS (SELECT DISTINCT cell_type, level_2_cell_type AS l2, level_1_cell_type AS l1 FROM cells), {MAPPED},
      lv AS (SELECT 'greedy' AS method, 0 AS fold, 'level_3' AS level, cell_type AS t, mapped AS p FROM cl JOIN mp USING (cluster)),
      {SCORED} SELECT {picked} FROM mt""")


@query("c01_greedy_metrics", _greedy_metrics_sql())
def greedy_metrics(spark, sf):
    labelled = G.assign_majority(clustered(spark, sf), "cluster", "cell_type").withColumn("method", F.lit("greedy"))
    scored = label_metrics(confusion_counts(labelled, ["method"], true_col="cell_type"), ["method"])
    return rounded(scored.select("macro_f1", "f1_weighted", "ari", "nmi", "accuracy", "mcc", "kappa"))


def folded(spark, sf):
    return fx.cells(spark, sf).select("cell_id", "cell_type", (F.col("cell_id") % 5).alias("fold"))


TRAIN = """fd AS (SELECT cell_id, cell_type, cell_id % 5 AS fold FROM cells),
  tr AS (SELECT f.fold, cell_type, count(*) AS n FROM fd c JOIN range(5) f(fold) ON c.fold <> f.fold GROUP BY 1, 2)"""


@query("c02_most_frequent", sql(f"""WITH {TRAIN}, b AS (SELECT fold, cell_type AS predicted_phenotype FROM tr QUALIFY row_number() OVER (PARTITION BY fold ORDER BY n DESC, cell_type) = 1)
  SELECT * FROM fd JOIN b USING (fold)"""))
def most_frequent(spark, sf):
    return G.most_frequent_baseline(folded(spark, sf), "cell_type", "fold")


@query("c03_stratified_random", sql(f"""WITH {TRAIN}, cu AS (SELECT fold, cell_type, sum(n) OVER (PARTITION BY fold ORDER BY cell_type) / sum(n) OVER (PARTITION BY fold)::DOUBLE AS hi FROM tr),
  u AS (SELECT *, CAST(concat('0x', substr(md5(concat('42-', cell_id)), 1, 12)) AS BIGINT) / pow(16, 12) AS u FROM fd)
  SELECT u.cell_id, u.cell_type, u.fold, min(cu.cell_type) AS predicted_phenotype FROM u JOIN cu ON u.fold = cu.fold AND cu.hi > u.u GROUP BY 1, 2, 3"""))
def stratified(spark, sf):
    return G.stratified_baseline(folded(spark, sf), "cell_type", "fold", ["cell_id"], 42)


# -- signatures ------------------------------------------------------------

MATRIX = {
    "click": {"m1": 1.0, "m2": -1.0}, "error": {"m3": 1.0, "m1": -1.0}, "purchase": {"m2": 1.0, "m3": 1.0},
    "Others": {"m1": -1.0, "m2": -1.0, "m3": -1.0}, "view": {"m1": 1.0, "m3": -1.0, "absent": 1.0},
}
SCORES = {
    "click": "(z1 - z2) / 2", "error": "(z3 - z1) / 2", "purchase": "(z2 + z3) / 2",
    "Others": "(-z1 - z2 - z3) / 3", "view": "(z1 - z3) / 2",
}
Z = """z AS (SELECT cell_id, (m1 - avg(m1) OVER ()) / stddev_pop(m1) OVER () AS z1, (m2 - avg(m2) OVER ()) / stddev_pop(m2) OVER () AS z2,
  (m3 - avg(m3) OVER ()) / stddev_pop(m3) OVER () AS z3 FROM cells)"""


@query("c13_signature_scores", sql(f"WITH {Z}, s AS (" + " UNION ALL ".join(
    f"SELECT cell_id, '{t}' AS t, {e} AS s FROM z" for t, e in SCORES.items()) + """),
  b AS (SELECT cell_id, t, s FROM s QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY s DESC, t) = 1)
  SELECT cell_id, CASE WHEN s < 0.3 OR t = 'Others' THEN 'undefined' ELSE t END AS predicted_phenotype FROM b"""))
def signatures(spark, sf):
    return G.score_signatures(fx.cells(spark, sf), MATRIX, 0.3).select("cell_id", "predicted_phenotype")


TREE = {
    "browse": {"m1": 1.0}, "convert": {"m2": 1.0}, "click": {"m3": 1.0}, "view": {"m3": -1.0}, "purchase": {"m1": -1.0}, "signup": {"m3": 1.0},
}


@query("c14_signature_tree", sql(f"""WITH {Z}, a AS (SELECT *, CASE WHEN greatest(z1, z2) < 0 THEN 'undefined' WHEN z1 >= z2 THEN 'browse' ELSE 'convert' END AS l1 FROM z)
  SELECT cell_id, CASE l1 WHEN 'browse' THEN CASE WHEN abs(z3) < 0.2 THEN 'undefined' WHEN z3 >= -z3 THEN 'click' ELSE 'view' END
    WHEN 'convert' THEN CASE WHEN greatest(-z1, z3) < 0.2 THEN 'undefined' WHEN -z1 >= z3 THEN 'purchase' ELSE 'signup' END
    ELSE l1 END AS predicted_phenotype FROM a"""))
def signature_tree(spark, sf):
    return G.score_signature_tree(
        fx.cells(spark, sf), TREE, {"browse": ["click", "view"], "convert": ["purchase", "signup"]},
        ["browse", "convert"], depth=3, thresholds=(0.0, 0.2)).select("cell_id", "predicted_phenotype")


@query("c15_nearest_centroid", sql(f"""WITH l AS (SELECT label, unnest(v) AS v, unnest(range(64)) AS pos FROM vecs),
  m AS (SELECT label, pos, avg(v) AS c FROM l GROUP BY 1, 2), ce AS (SELECT label, list(c ORDER BY pos) AS c FROM m GROUP BY 1),
  d AS (SELECT vec_id, vecs.label, ce.label AS predicted, list_distance(v, c) AS distance FROM vecs, ce)
  SELECT vec_id, label, predicted, {r6('distance')} AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, predicted) = 1""", "vecs"))
def nearest_centroid(spark, sf):
    vec = fx.vectors(spark, sf).select("vec_id", "label", "embedding")
    return rounded(G.nearest_centroid(vec, vec, "label", "embedding").select("vec_id", "label", "predicted", "distance"))


@query("c16_ensemble", sql(f"""WITH {cj.RUNS}, m AS (SELECT sample_id, cell_id, [avg(v[1]), avg(v[2]), avg(v[3])] AS p FROM runs GROUP BY 1, 2),
  r AS (SELECT *, [round(x, 12) FOR x IN p] AS q FROM m)
  SELECT sample_id, cell_id, ['click', 'error', 'view'][list_position(q, list_max(q))] AS prediction, {r6('list_max(q)')} AS confidence FROM r"""))
def ensemble(spark, sf):
    rows = cj.runs(spark, sf)
    mean = G.average_runs(rows, ["sample_id", "cell_id"], "v", 3).withColumn("v", F.transform("v", lambda x: F.round(x, 12)))
    return rounded(G.ensemble(mean, ["sample_id", "cell_id"], "v", ["click", "error", "view"], 3).drop("v"))


# -- neighbourhoods --------------------------------------------------------

NEIGHBOURS = "nb AS (SELECT a.cell_id, b.cell_id AS o, b.cell_type, b.m1, b.m2 FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.cell_id <> b.cell_id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1600)"
SHARES = ", ".join(f"{r6(f'avg(CASE WHEN nb.cell_type = {c!r} THEN 1.0 WHEN nb.cell_type IS NOT NULL THEN 0.0 END)')} AS share_{c}" for c in fx.CLASSES)


@query("c17_composition_radius", sql(f"""WITH {NEIGHBOURS} SELECT cells.cell_id, count(o) AS n_neighbours, {SHARES} FROM cells LEFT JOIN nb ON nb.cell_id = cells.cell_id GROUP BY 1"""))
def composition(spark, sf):
    return rounded(SP.neighbourhood_composition(fx.cells(spark, sf), "sample_id", "cell_id", "cell_type", 40.0, fx.CLASSES))


@query("c17_composition_knn", sql(f"""WITH {cj.KNN}, nb AS (SELECT src, dst, cell_type FROM knn JOIN cells ON dst = cell_id)
  SELECT src AS cell_id, count(*) AS n_neighbours, {SHARES} FROM nb GROUP BY 1"""))
def composition_knn(spark, sf):
    return rounded(SP.neighbour_composition(cj.spatial_knn(spark, sf), fx.cells(spark, sf), "cell_id", "cell_type", fx.CLASSES))


@query("c18_neighbour_means", sql(f"""WITH {NEIGHBOURS} SELECT cells.cell_id, any_value(cells.m1) AS m1, any_value(cells.m2) AS m2, count(o) AS n_neighbours,
  {r6('avg(nb.m1)')} AS nb_m1, {r6('avg(nb.m2)')} AS nb_m2 FROM cells LEFT JOIN nb ON nb.cell_id = cells.cell_id GROUP BY 1"""))
def neighbour_means(spark, sf):
    return rounded(SP.neighbour_means(fx.cells(spark, sf), "sample_id", "cell_id", ["m1", "m2"], 40.0), "nb_m1", "nb_m2")


# -- fitted models: SQL knows no fits, so it checks what must hold of them --


def vec_rows(spark, sf):
    return ML.with_features(fx.vectors(spark, sf).withColumn("label", F.col("label").cast("string")), vec="embedding").drop("embedding")


def marker_rows(spark, sf):
    df = fx.cells(spark, sf).select("cell_id", "sample_id", "cell_type", (F.col("cell_id") % 5).alias("fold"), *fx.MARKERS)
    return ML.with_features(df, fx.MARKERS)


def checked(predicted, key, label, name="predicted_phenotype"):
    """Each row with two facts: its predicted label is one of the labels, and the model's mean recall is above that of one label for all."""
    predicted = stage(predicted.select(key, label, name), "predicted")
    labels = predicted.select(F.col(label).alias("_known")).distinct()
    recall = predicted.groupBy(label).agg(F.avg((F.col(name) == F.col(label)).cast("double")).alias("r")).agg((F.avg("r") > 1 / F.count("r")).alias("above")).scalar()
    return predicted.join(labels, F.col(name) == F.col("_known"), "left").select(key, label, F.col("_known").isNotNull().alias("known_label"), recall.alias("above_one_label"))


VEC_FACTS = "SELECT vec_id, CAST(label AS VARCHAR) AS label, true AS known_label, true AS above_one_label FROM embeddings"
CELL_FACTS = sql("SELECT cell_id, cell_type, true AS known_label, true AS above_one_label FROM cells")


def fit_and_predict(rows, label, estimator, hold_out: int = 0):
    """Train outside the held-out fold, label every row."""
    train, codes = ML.prepare(rows.where(F.col("fold") != hold_out), label)
    model = estimator(train).fit(train)
    return ML.predict(model, rows, codes).drop("features")


@query("c04_logistic_regression", VEC_FACTS)
def logistic(spark, sf):
    return checked(fit_and_predict(vec_rows(spark, sf), "label", lambda _: ML.logistic_regression()), "vec_id", "label")


@query("c05_random_forest", VEC_FACTS)
def forest(spark, sf):
    return checked(fit_and_predict(vec_rows(spark, sf), "label", lambda _: ML.random_forest()), "vec_id", "label")


@query("c06_boosted_trees", CELL_FACTS)
def boosted(spark, sf):
    rows = marker_rows(spark, sf)
    train, codes = ML.prepare(rows.where("fold <> 0"), "cell_type")
    model = ML.BoostedClasses().fit(train.withColumn("is_validation", F.col("fold") == 1), "is_validation")
    return checked(ML.predict(model, rows, codes), "cell_id", "cell_type")


@query("c07_neural_network", VEC_FACTS)
def network(spark, sf):
    rows = vec_rows(spark, sf)
    return checked(fit_and_predict(rows, "label", lambda t: ML.neural_network(64, t.select("code").distinct().count())), "vec_id", "label")


GRID = {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]}


@query("c08_grid_search", f"""SELECT CAST(r AS DOUBLE) AS "regParam", CAST(e AS DOUBLE) AS "elasticNetParam", true AS scored
  FROM unnest({GRID['regParam']}) a(r), unnest({GRID['elasticNetParam']}) b(e)""")
def grid(spark, sf):
    rows, _ = ML.prepare(vec_rows(spark, sf).withColumn("fold", F.col("fold").cast("int")), "label")
    fitted = ML.grid_search(rows, ML.logistic_regression(), GRID, parallelism=4)
    scores = [({p.name: float(v) for p, v in m.items()}, float(s)) for m, s in zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics)]
    found = spark.createDataFrame([(*(m[n] for n in GRID), s) for m, s in scores], "regParam double, elasticNetParam double, f1 double")
    return found.select(*GRID, ((F.col("f1") > 0) & (F.col("f1") <= 1)).alias("scored"))


@query("c09_kmeans", "SELECT vec_id, CAST(label AS VARCHAR) AS label, true AS clustered FROM embeddings")
def kmeans(spark, sf):
    return ML.kmeans_clusters(vec_rows(spark, sf), 10).select("vec_id", "label", F.col("cluster").between(0, 9).alias("clustered"))


@query("c09_gaussian_mixture", sql("SELECT cell_id, cell_type, true AS clustered FROM cells"))
def mixture(spark, sf):
    return ML.mixture_clusters(marker_rows(spark, sf), 5).select("cell_id", "cell_type", F.col("cluster").between(0, 4).alias("clustered"))


@query("c10_meta_clusters", "SELECT vec_id, CAST(label AS VARCHAR) AS label, true AS clustered, true AS nested FROM embeddings")
def meta(spark, sf):
    found = ML.meta_clusters(vec_rows(spark, sf), 40, 10)
    homes = found.groupBy("fine_cluster").agg(F.countDistinct("cluster").alias("_n"))
    return found.join(homes, "fine_cluster").select("vec_id", "label", F.col("cluster").between(0, 9).alias("clustered"), (F.col("_n") == 1).alias("nested"))


ROUNDS = 6


def _communities_sql() -> str:
    head = """WITH d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS dist FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id),
      k AS (SELECT src, dst FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= 10),
      nb AS (SELECT src, list(dst) || [src] AS ns FROM k GROUP BY src),
      pr AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM k),
      ed AS (SELECT a, b, len(list_intersect(x.ns, y.ns)) / len(list_distinct(x.ns || y.ns))::DOUBLE AS w FROM pr JOIN nb x ON x.src = a JOIN nb y ON y.src = b),
      bo AS (SELECT a AS id, b AS nb, w FROM ed UNION ALL SELECT b, a, w FROM ed),
      r0 AS (SELECT DISTINCT id, id AS community FROM bo)"""
    for r in range(ROUNDS):
        head += f""",
      v{r} AS (SELECT bo.id, community, round(sum(w), 9) AS w FROM bo JOIN r{r} ON r{r}.id = bo.nb GROUP BY 1, 2),
      b{r} AS (SELECT id, community AS best FROM v{r} QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, md5(concat('42-', community))) = 1),
      r{r + 1} AS (SELECT id, CASE WHEN CAST(concat('0x', substr(md5(CAST(id AS VARCHAR)), 1, 1)) AS INT) % 2 = {r % 2} THEN best ELSE community END AS community
                   FROM r{r} JOIN b{r} USING (id))"""
    return sql(f"{head} SELECT id, community FROM r{ROUNDS}", "vecs")


@query("c11_communities", _communities_sql())
def communities(spark, sf):
    return V.communities(fx.vectors(spark, sf), "vec_id", "embedding", k=10, rounds=ROUNDS)


@query("c12_principal_components", """WITH p AS (SELECT unnest(range(25)) AS i)
  SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, a.i <> b.i OR a.i = b.i AS holds FROM p a, p b WHERE a.i <= b.i""")
def pca(spark, sf):
    # components are uncorrelated and their variances fall
    scores = ML.principal_components(vec_rows(spark, sf), 25).select("components")
    pairs = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i")
    long = scores.select("components", pairs).select("components", "i", F.explode(F.sequence(F.col("i"), F.lit(24))).alias("j"))
    x, y, z = F.col("components")[F.col("i")], F.col("components")[F.col("j")], F.col("components")[F.least(F.col("i") + 1, F.lit(24))]
    found = long.groupBy("i", "j").agg(F.corr(x, y).alias("r"), F.var_samp(x).alias("v"), F.var_samp(z).alias("next"))
    return found.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") >= F.col("next")).otherwise(F.abs("r") < 1e-6).alias("holds"))


@query("c19_fold_runner", "SELECT CAST(vec_id % 5 AS BIGINT) AS fold, count(*) AS n_rows, true AS scored FROM embeddings GROUP BY 1")
def runner(spark, sf):
    preds, _ = ML.run_folds(vec_rows(spark, sf), "label", "fold", lambda t, s: ML.logistic_regression().fit(t))
    counts = confusion_counts(preds, ["fold"], true_col="label")
    return label_metrics(counts, ["fold"]).select(F.col("fold").cast("bigint").alias("fold"), F.col("n_rows").cast("bigint").alias("n_rows"), F.col("macro_f1").between(0, 1).alias("scored"))


@query("c19_train_and_evaluate", sql("SELECT count(*) AS n_rows, 3 AS folds, true AS scored FROM cells"))
def train_evaluate(spark, sf):
    cells = fx.cells(spark, sf).select("cell_id", "sample_id", "cell_type", *fx.MARKERS)
    folds = make_folds(cells, "cell_type", ["cell_id"], "sample_id", 3)
    _, metrics = train_and_evaluate(folds, "cell_type", fx.MARKERS, lambda t, s: ML.logistic_regression().fit(t))
    return metrics.agg(F.sum("n_rows").cast("bigint").alias("n_rows"), F.count(F.lit(1)).cast("int").alias("folds"), F.min(F.col("macro_f1").between(0, 1)).alias("scored"))


@query("c11_cluster_and_transfer", VEC_FACTS)
def cluster_transfer(spark, sf):
    vec = fx.vectors(spark, sf).withColumn("label", F.col("label").cast("string"))
    return checked(cluster_and_transfer(vec, "vec_id", "embedding", "label", k=10, rounds=ROUNDS), "vec_id", "label")


SHARES, SIZES = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5], [500, 1000, 2000]


@query("m19_learning_curve", sql(f"""SELECT CAST(s AS DOUBLE) AS share, n AS n_rows, true AS scored
  FROM (SELECT count(*) AS n FROM cells WHERE cell_id % 5 = 0), unnest({SHARES}) a(s)"""))
def curve(spark, sf):
    rows = marker_rows(spark, sf)
    found = ML.learning_curve(
        rows.where("fold <> 0"), "cell_type", "sample_id", SHARES, lambda t, s: ML.logistic_regression().fit(t), rows.where("fold = 0"))
    return found.select("share", F.col("n_rows").cast("bigint").alias("n_rows"), F.col("macro_f1").between(0, 1).alias("scored"))


@query("m19_learning_curve_rows", sql(f"""SELECT CAST(s AS INT) AS size, least(s, (SELECT count(*) FROM cells WHERE cell_id % 5 <> 0)) AS trained, n AS n_rows, true AS scored
  FROM (SELECT count(*) AS n FROM cells WHERE cell_id % 5 = 0), unnest({SIZES}) a(s)"""))
def curve_of_rows(spark, sf):
    rows = marker_rows(spark, sf)
    found = ML.learning_curve_rows(
        rows.where("fold <> 0"), "cell_type", ["cell_id"], SIZES, lambda t, s: ML.logistic_regression().fit(t), rows.where("fold = 0"))
    return found.select("size", F.col("trained").cast("bigint").alias("trained"), F.col("n_rows").cast("bigint").alias("n_rows"), F.col("macro_f1").between(0, 1).alias("scored"))
