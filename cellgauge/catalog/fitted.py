"""Models fitted by this library itself, with facts about each row or round that SQL can state."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog.labelling import MATRIX, VEC_FACTS, checked, marker_rows, sql, vec_rows
from cellgauge.catalog.registry import query
from cellgauge.operators import models as ML
from cellgauge.operators.boosting import SoftmaxTrees
from cellgauge.operators.integration import batch_gap, integrate
from cellgauge.operators.maps import fit_map, map_clusters
from cellgauge.operators.mixture import fit_marker_mixture
from cellgauge.operators.search import halving_search
from cellgauge.session import stage

ROUNDS = 6


@query("c06_softmax_trees", VEC_FACTS)
def softmax_trees(spark, sf):
    rows = vec_rows(spark, sf)
    train, codes = ML.prepare(rows.where("fold <> 0"), "label")
    model = SoftmaxTrees(rounds=ROUNDS, depth=3, bins=16).fit(train)
    return checked(ML.predict(model, rows, codes), "vec_id", "label")


@query("c06_softmax_losses", f"SELECT CAST(i AS INT) AS round, i > 0 AS fell, n AS n_rows FROM range(0, {ROUNDS + 1}) r(i), (SELECT count(*) AS n FROM events) ORDER BY 1")
def softmax_losses(spark, sf):
    # the first round's loss is that of equal probabilities; each further one must lie below the one before
    train, _ = ML.prepare(marker_rows(spark, sf), "cell_type")
    model = SoftmaxTrees(rounds=ROUNDS, depth=3).fit(train)
    losses = [a for a, _ in model.losses]
    found = [(i, bool(i and losses[i] < losses[i - 1])) for i in range(len(losses))]
    return spark.createDataFrame(found, "round int, fell boolean").withColumn("n_rows", F.lit(train.count()).cast("bigint"))


@query("c10_self_organising_map", "SELECT vec_id, true AS nearest, true AS nested, true AS improves FROM embeddings")
def self_organising_map(spark, sf):
    """No node is nearer to a row than its own; a node lies in one cluster; passes lower the mean distance to the nodes."""
    rows = vec_rows(spark, sf).select("vec_id", "features")
    found, model = map_clusters(rows, 10, 6, 6, passes=6, repeats=20)
    found = stage(found.select("vec_id", "node", "cluster", vector_to_array("features").alias("x")), "mapped")
    nodes = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.nodes))
    far = lambda c: F.aggregate(F.zip_with("x", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    nearest = far(nodes[F.col("node")]) <= F.array_min(F.transform(nodes, far)) + 1e-9
    homes = found.groupBy("node").agg((F.countDistinct("cluster") == 1).alias("nested"))
    first = fit_map(rows, 6, 6, passes=0).errors(rows).select("quantisation").scalar()
    last = model.errors(rows).select("quantisation").scalar()
    return found.select("vec_id", "node", nearest.alias("nearest")).join(homes, "node").select("vec_id", "nearest", "nested", (last < first).alias("improves"))


@query("c13_mixture_rounds", f"SELECT CAST(i AS INT) AS round, i > 0 AS kept_rising FROM range(0, {ROUNDS + 1}) r(i)")
def mixture_rounds(spark, sf):
    # the objective before the first round has none to compare with
    objective = fit_marker_mixture(fx.cells(spark, sf), MATRIX, rounds=ROUNDS, tol=-1.0).objective
    found = [(i, bool(i and objective[i] >= objective[i - 1] - 1e-9 * abs(objective[i]))) for i in range(len(objective))]
    return spark.createDataFrame(found, "round int, kept_rising boolean")


@query("c13_marker_mixture", sql("SELECT cell_id, true AS sums_to_one, true AS label_follows FROM cells"))
def marker_mixture(spark, sf):
    """Responsibilities sum to 1; a label is the type of the greatest one, or none where that is below a half or below that of merged rows."""
    cells = fx.cells(spark, sf)
    model = fit_marker_mixture(cells, MATRIX, rounds=ROUNDS)
    out = model.predict(cells)
    r, types = F.col("responsibilities"), len(model.types)
    own = [r[i] for i in range(types)]
    top, rest = F.greatest(*own), F.lit(1.0) - sum(own[1:], own[0])
    want = F.lit("undefined")
    for i in reversed(range(types)):
        want = F.when((own[i] == top) & (top >= 0.5) & (top >= rest), model.types[i]).otherwise(want)
    total = F.aggregate(r, F.lit(0.0), lambda a, v: a + v)
    return out.select("cell_id", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (F.col("predicted_phenotype") == want).alias("label_follows"))


@query("n10_integration", "SELECT vec_id, CAST(vec_id % 3 AS INT) AS batch, true AS kept_length, true AS batches_closer FROM embeddings")
def integration(spark, sf):
    """Vectors of every third row are shifted by a fixed amount; integration must take the greater part of it out again."""
    vec = fx.vectors(spark, sf).select("vec_id", F.pmod("vec_id", F.lit(3)).cast("int").alias("batch"), "embedding")
    shifted = vec.withColumn("v", F.transform("embedding", lambda e, i: e.cast("double") + F.when(F.col("batch") == 2, F.sin(i + 1) / 8).otherwise(0.0)))
    out = stage(integrate(shifted, "v", "batch", clusters=8, rounds=4), "integrated")
    before, after = (batch_gap(out, c, "batch").select("gap").scalar() for c in ("v", "integrated"))
    return out.select("vec_id", "batch", (F.size("integrated") == F.size("v")).alias("kept_length"), (after < 0.5 * before).alias("batches_closer"))


TRIALS, KEEP, SHARE = 6, 0.5, 0.25


@query("c08_halving_search", f"""WITH g(rung, n, s) AS (VALUES (0, {TRIALS}, 0.25), (1, 3, 0.5), (2, 2, 1.0)), p AS (SELECT rung, n, s, unnest(range(1, n + 1)) AS place FROM g)
  SELECT CAST(rung AS INT) AS rung, CAST(place AS INT) AS place, CAST(s AS DOUBLE) AS share, place <= CASE rung WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS survives,
         true AS in_range, true AS in_order, rung > 0 AS had_survived FROM p""")
def halving(spark, sf):
    """Each fit by its place: who survives follows from the places, who is on a rung from the rung before, and scores fall with the places."""
    rows = vec_rows(spark, sf)
    lowest, highest = 1e-4, 1e2
    _, table = halving_search(
        rows.where("fold > 1"), rows.where("fold = 1"), "label", ["vec_id"], lambda t, p: ML.logistic_regression(maxIter=15, **p).fit(t),
        {"regParam": (lowest, highest)}, TRIALS, KEEP, SHARE)
    table = stage(table, "trials")
    before = table.where("survives").select((F.col("rung") + 1).alias("rung"), "trial", F.lit(True).alias("_kept"))
    above = table.select("rung", (F.col("place") + 1).alias("place"), F.col("score").alias("_above"))
    joined = table.join(before, ["rung", "trial"], "left").join(above, ["rung", "place"], "left")
    return joined.select("rung", "place", "share", "survives", F.col("regParam").between(lowest, highest).alias("in_range"), (F.col("score") <= F.coalesce("_above", F.lit(1.0))).alias("in_order"), F.coalesce("_kept", F.lit(False)).alias("had_survived"))
