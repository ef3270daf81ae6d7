"""Approximate neighbours and communities by modularity.

SQL can't repeat a search that starts at random, so these queries give facts
about every row of the result, worked out from the result by other means (an
exact search, a plain formula), and the SQL says what they must be.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellgauge.catalog import fixtures as fx
from cellgauge.catalog.registry import query
from cellgauge.operators import modularity as Q
from cellgauge.operators import spatial as SP
from cellgauge.operators import vectors as V
from cellgauge.operators.descent import knn_descent, knn_search
from cellgauge.operators.splits import sample_fraction
from cellgauge.session import stage


def recall(found, exact):
    """Share of the exact neighbours that were found."""
    hits = exact.join(found.select("src", "dst", F.lit(1).alias("_hit")), ["src", "dst"], "left")
    return hits.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall")).select("recall").scalar()


def measured(found, vec):
    """Lists with their distances computed anew from the table."""
    a, b = vec.select(F.col("vec_id").alias("src"), F.col("embedding").alias("_a")), vec.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("_b"))
    d = F.sqrt(F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))
    return found.join(a, "src").join(b, "dst").withColumn("_d", d)


@query("j11_knn_descent", "SELECT vec_id AS src, 10 AS listed, true AS ordered, true AS distances_hold, true AS recall_95 FROM embeddings")
def descent(spark, sf):
    vec = fx.vectors(spark, sf)
    found, exact = stage(knn_descent(vec, "vec_id", "embedding", 10), "found"), knn_vectors_of(vec)
    rows = measured(found, vec)
    lists = F.array_sort(F.collect_list(F.struct("rank", "dist")))
    by = rows.groupBy("src").agg(
        F.countDistinct("dst").cast("int").alias("listed"), F.max(F.abs(F.col("_d") - F.col("dist")) < 1e-9).alias("distances_hold"), lists.alias("_l"))
    ordered = F.transform("_l", lambda e: e["dist"]) == F.array_sort(F.transform("_l", lambda e: e["dist"]))
    return by.select("src", "listed", ordered.alias("ordered"), "distances_hold", (recall(found, exact) >= 0.95).alias("recall_95"))


def knn_vectors_of(vec):
    return stage(V.knn_vectors(vec, vec, "vec_id", "embedding", 10).select("src", "dst"), "exact")


@query("j12_label_transfer_descent", "SELECT vec_id, true AS known_label, true AS recall_95, true AS agrees_95 FROM embeddings")
def transfer(spark, sf):
    vec = fx.vectors(spark, sf).select("vec_id", "label", "embedding")
    labelled = stage(sample_fraction(vec, 0.4, ["vec_id"], seed=7), "labelled")
    near = stage(knn_search(vec, labelled, "vec_id", "embedding", 5), "found")
    exact = stage(V.knn_vectors(vec, labelled, "vec_id", "embedding", 5, same_table=False), "exact")
    ours = stage(SP.transfer_labels(near, labelled, "vec_id", "label", "predicted"), "predicted")
    theirs = SP.transfer_labels(exact, labelled, "vec_id", "label", "_exact")
    agree = ours.join(theirs, "vec_id").agg(F.avg((F.col("predicted") == F.col("_exact")).cast("double")).alias("a")).select("a").scalar()
    labels = labelled.select(F.col("label").alias("predicted"), F.lit(True).alias("known_label")).distinct()
    return ours.join(labels, "predicted", "left").select("vec_id", F.coalesce("known_label", F.lit(False)).alias("known_label"), (recall(near, exact) >= 0.95).alias("recall_95"), (agree >= 0.95).alias("agrees_95"))


def judged(edges, found, spread):
    """Each node with two facts: modularity is above that of ``spread``, and its community hangs together."""
    better = Q.modularity(edges, found).select("modularity").scalar() > Q.modularity(edges, spread).select("modularity").scalar()
    links = edges.select(F.col("a").alias("id"), F.col("b").alias("nb")).union(edges.select("b", "a"))
    parts = Q.connected_parts(links, found).select("id", F.col("community").alias("_part"))
    whole = found.join(parts, "id").groupBy("community").agg((F.countDistinct("_part") == 1).alias("connected"))
    return found.join(whole, "community").select("id", better.alias("beats_propagation"), "connected")


COMMUNITY_FACTS = "SELECT vec_id AS id, true AS beats_propagation, true AS connected FROM embeddings"


@query("c11_modularity", COMMUNITY_FACTS)
def by_modularity(spark, sf):
    edges = Q.neighbour_edges(fx.vectors(spark, sf), "vec_id", "embedding")
    return judged(edges, stage(Q.leiden(edges), "communities"), V.label_propagation(edges, 6))


@query("c11_modularity_descent", COMMUNITY_FACTS)
def by_modularity_descent(spark, sf):
    edges = Q.neighbour_edges(fx.vectors(spark, sf), "vec_id", "embedding", weighted=False, exact=False)
    return judged(edges, stage(Q.leiden(edges, resolution=2.0), "communities"), V.label_propagation(edges, 6))
