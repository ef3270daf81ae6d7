"""Communities of a weighted graph by modularity, with refinement into well-connected parts.

A level moves nodes between communities while modularity rises, refines every
community into parts, and contracts each part to one node of a smaller graph,
which starts from the communities found so far. All steps are joins and
aggregates of two tables, links and nodes, which are written out after each
round; no node's links are ever gathered, so a hub may have any number.

Many nodes move at a time. A share of them, drawn by hash, takes its best move
in a round; a round that doesn't raise modularity is taken back and repeated
with a smaller share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.descent import knn_descent
from cellgauge.operators.vectors import knn_vectors, shared_neighbour_weights
from cellgauge.session import stage

SMALLEST_SHARE = 16
TINY = 1e-12


def _links(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; a self-loop counts twice, as its weight is inside."""
    rows = edges.select("a", "b", F.col("weight").cast("double").alias("w")).where("a is not null and b is not null")
    both = rows.select(F.col("a").alias("id"), F.col("b").alias("nb"), "w").unionByName(rows.select(F.col("b").alias("id"), F.col("a").alias("nb"), "w"))
    return both.groupBy("id", "nb").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row with the ``modularity`` of ``labels`` (id, community) on undirected ``edges`` (a, b, weight)."""
    links = _links(edges)
    ends = links.join(labels.select("id", F.col("community").alias("_c")), "id").join(labels.select(F.col("id").alias("nb"), F.col("community").alias("_d")), "nb")
    per = ends.groupBy("_c").agg(F.sum(F.when(F.col("_c") == F.col("_d"), F.col("w")).otherwise(0.0)).alias("_in"), F.sum("w").alias("_tot"))
    total = per.agg(F.sum("_tot").alias("_all"), F.sum("_in").alias("_in"), F.sum(F.col("_tot") * F.col("_tot")).alias("_sq"))
    return total.select((F.col("_in") / F.col("_all") - resolution * F.col("_sq") / (F.col("_all") * F.col("_all"))).alias("modularity"))


def _draw(seed: int, r: int, share: int, column: str = "id") -> Column:
    return F.pmod(F.xxhash64(column, F.lit(seed), F.lit(r)), F.lit(share)) == 0


def _votes(links: DataFrame, nodes: DataFrame, whole: float, resolution: float) -> DataFrame:
    """For every node its links into its own community, the best community beside it, and what moving there gains."""
    near = links.where("id <> nb").join(nodes.select(F.col("id").alias("nb"), F.col("community").alias("_c")), "nb")
    into = near.groupBy("id", "_c").agg(F.sum("w").alias("_in"))
    totals = nodes.groupBy("community").agg(F.sum("k").alias("_tot"), (F.count(F.lit(1)) == 1).alias("_alone"))
    alone = totals.select("community", F.col("_alone").alias("_single"))
    scored = into.join(totals.withColumnRenamed("community", "_c"), "_c").join(nodes.join(alone, "community"), "id")
    own = F.col("_c") == F.col("community")
    # two nodes that are alone must not swap places
    scored = scored.where(~(F.col("_alone") & F.col("_single") & (F.col("_c") > F.col("community"))))
    score = F.col("_in") - resolution * F.col("k") * (F.col("_tot") - F.when(own, F.col("k")).otherwise(0.0)) / whole
    rated = scored.withColumn("_s", score)
    best = rated.groupBy("id").agg(
        F.sum(F.when(own, F.col("_in")).otherwise(0.0)).alias("k_own"), F.max(F.when(~own, F.struct(F.col("_s"), (-F.col("_c")).alias("_m")))).alias("_best"))
    joined = nodes.join(totals, "community").join(best, "id", "left")
    stay = F.coalesce(F.col("k_own"), F.lit(0.0)) - resolution * F.col("k") * (F.col("_tot") - F.col("k")) / whole
    return joined.select("id", "k", "community", F.coalesce("k_own", F.lit(0.0)).alias("k_own"), (-F.col("_best._m")).alias("best"), (F.col("_best._s") - stay).alias("gain"))


def _move(links: DataFrame, nodes: DataFrame, whole: float, loops: float, resolution: float, seed: int, max_rounds: int, tol: float) -> tuple[DataFrame, float]:
    """Nodes with better communities, and their modularity."""
    kept, reached, share = None, float("-inf"), 2
    for r in range(max_rounds):
        votes = stage(_votes(links, nodes, whole, resolution), "votes")
        squares = votes.groupBy("community").agg(F.sum("k").alias("t"), F.sum("k_own").alias("i")).agg(F.sum("i"), F.sum(F.col("t") * F.col("t"))).first()
        quality = (squares[0] + loops) / whole - resolution * squares[1] / whole**2
        if quality > reached + (tol if kept is not None else 0):
            kept, reached = votes, quality
        else:
            share *= 2
            if share > SMALLEST_SHARE:
                break
        if kept.where(F.col("gain") > TINY).isEmpty():
            break
        moving = (F.col("gain") > TINY) & _draw(seed, r, share)
        nodes = stage(kept.select("id", "k", F.when(moving, F.col("best")).otherwise(F.col("community")).alias("community")), "nodes")
    return kept.select("id", "k", "community"), reached


def _refine(links: DataFrame, nodes: DataFrame, whole: float, resolution: float, seed: int, rounds: int) -> DataFrame:
    """(id, k, community, part): parts of communities, each connected.

    Every node starts alone. In a round those drawn and still alone join the
    part of their community that gains most, if they are well linked to their
    community and the part is too; parts they may join don't move in that
    round, so what is joined stays connected.
    """
    inner = links.where("id <> nb").join(nodes.select("id", "community"), "id").join(nodes.select(F.col("id").alias("nb"), F.col("community").alias("_c")), "nb")
    inner = stage(inner.where(F.col("community") == F.col("_c")).select("id", "nb", "w"), "inner")
    parts = stage(nodes.withColumn("part", F.col("id")), "parts")
    totals = stage(nodes.groupBy("community").agg(F.sum("k").alias("_all")), "totals")
    for r in range(rounds):
        ends = inner.join(parts.select("id", "part"), "id").join(parts.select(F.col("id").alias("nb"), F.col("part").alias("_to")), "nb")
        ends = stage(ends, "ends")
        sums = parts.groupBy("part", "community").agg(F.sum("k").alias("_tot"), F.count(F.lit(1)).alias("_n"))
        outer = ends.where(F.col("part") != F.col("_to")).groupBy("part").agg(F.sum("w").alias("_out"))
        linked = sums.join(outer, "part", "left").join(totals, "community")
        well = F.coalesce(F.col("_out"), F.lit(0.0)) >= resolution * F.col("_tot") * (F.col("_all") - F.col("_tot")) / whole
        drawn = (F.col("_n") == 1) & _draw(seed, r, 2, "part")
        rated = stage(linked.select("part", "_tot", (drawn & well).alias("_moves"), (~drawn & well).alias("_open")), "rated")
        into = ends.where(F.col("part") != F.col("_to")).groupBy("part", "_to").agg(F.sum("w").alias("_in"))
        into = into.join(rated.where("_moves").select("part", F.col("_tot").alias("_k")), "part").join(rated.where("_open").select(F.col("part").alias("_to"), "_tot"), "_to")
        gain = F.col("_in") - resolution * F.col("_k") * F.col("_tot") / whole
        best = into.withColumn("_g", gain).where(F.col("_g") > TINY).groupBy("part").agg(F.max_by("_to", F.struct("_g", -F.col("_to"))).alias("_new"))
        moved = stage(best, "joined")
        if moved.isEmpty():
            break
        parts = stage(parts.join(moved, "part", "left").select("id", "k", "community", F.coalesce("_new", "part").alias("part")), "parts")
    return parts


def connected_parts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, community): communities split where no links (id, nb) inside hold them together; each is named by its least node."""
    same = links.where("id <> nb").join(nodes.select("id", "community"), "id").join(nodes.select(F.col("id").alias("nb"), F.col("community").alias("_c")), "nb")
    same = stage(same.where(F.col("community") == F.col("_c")).select("id", "nb"), "inside")
    found = stage(nodes.select("id", F.col("id").alias("least")), "least")
    while True:
        near = same.join(found.select(F.col("id").alias("nb"), "least"), "nb").groupBy("id").agg(F.min("least").alias("_m"))
        lower = stage(found.join(near, "id", "left").select("id", "least", F.least("least", F.coalesce("_m", "least")).alias("_l")), "lower")
        hops = lower.select(F.col("id").alias("_l"), F.col("_l").alias("_next"))
        after = stage(lower.join(hops, "_l").select("id", F.col("_next").alias("least"), (F.col("_next") != F.col("least")).alias("_changed")), "least")
        if after.where("_changed").isEmpty():
            return after.select("id", F.col("least").alias("community"))
        found = after.select("id", "least")


def leiden(
    edges: DataFrame, resolution: float = 1.0, seed: int = 42, max_levels: int = 6, max_rounds: int = 16, refine_rounds: int = 4, tol: float = 1e-5
) -> DataFrame:
    """Communities ``id, community`` of undirected ``edges`` (a, b, weight; whole-number ids), each named by its least node.

    Modularity with the given ``resolution`` decides: higher ones give smaller
    communities. Every community is connected. Repeated edges add up; edges
    with a null end and edges without weight above zero say nothing. No edges give no rows.
    """
    links = stage(_links(edges.where("weight > 0")), "links")
    first = links
    size = links.agg(F.sum("w").alias("whole"), F.sum(F.when(F.col("id") == F.col("nb"), F.col("w")).otherwise(0.0)).alias("loops")).first()
    if size["whole"] is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("community")).where("false")
    whole, loops = size["whole"], size["loops"]
    nodes = stage(links.groupBy("id").agg(F.sum("w").alias("k")).withColumn("community", F.col("id")), "nodes")
    homes = nodes.select(F.col("id").alias("_own"), "id")
    for level in range(max_levels):
        nodes, _ = _move(links, nodes, whole, loops, resolution, seed + level, max_rounds, tol)
        n = nodes.agg(F.count(F.lit(1)), F.countDistinct("community")).first()
        if n[0] == n[1]:
            break
        parts = _refine(links, nodes, whole, resolution, seed + level, refine_rounds)
        if parts.select("part").distinct().count() == n[0]:
            # no part is well enough linked to grow: whole communities are contracted
            parts = stage(connected_parts(links, nodes).withColumnRenamed("community", "part").join(nodes, "id"), "parts")
        to = parts.select("id", "part")
        homes = stage(homes.join(to, "id").select("_own", F.col("part").alias("id")), "homes")
        ends = links.join(to, "id").join(to.select(F.col("id").alias("nb"), F.col("part").alias("_to")), "nb")
        links = stage(ends.groupBy(F.col("part").alias("id"), F.col("_to").alias("nb")).agg(F.sum("w").alias("w")), "links")
        loops = links.where("id = nb").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        nodes = stage(parts.groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k"), F.first("community").alias("community")), "nodes")
    found = homes.join(nodes.select("id", "community"), "id").select(F.col("_own").alias("id"), "community")
    return connected_parts(first, stage(found, "found"))


def neighbour_edges(df: DataFrame, key: str, vec: str, k: int = 10, weighted: bool = True, exact: bool = True, **settings) -> DataFrame:
    """Undirected edges (a, b, weight) to the ``k`` nearest vectors, weighted by shared neighbours or by 1."""
    near = knn_vectors(df, df, key, vec, k, **settings) if exact else knn_descent(df, key, vec, k, **settings)
    pairs = stage(near.select("src", "dst"), "knn")
    if weighted:
        return stage(shared_neighbour_weights(pairs), "edges")
    return stage(pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("weight", F.lit(1.0)), "edges")


def graph_communities(
    df: DataFrame, key: str, vec: str, k: int = 10, resolutions: Sequence[float] = (1.0,), weighted: bool = True, exact: bool = True, seed: int = 42
) -> DataFrame:
    """Communities of the neighbour graph at each resolution: ``id, resolution, community``. The graph is built once."""
    edges, out = neighbour_edges(df, key, vec, k, weighted, exact), None
    for resolution in resolutions:
        found = leiden(edges, resolution, seed).select("id", F.lit(float(resolution)).alias("resolution"), "community")
        out = found if out is None else out.unionByName(found)
    return out
