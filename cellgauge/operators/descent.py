"""Approximate nearest neighbours of vectors by descent on a neighbour graph.

Work and rows per round are a constant times the number of vectors, whatever
their dimension: where :func:`cellgauge.operators.vectors.knn_vectors` is exact
but meets more pairs of blocks as a table grows, the search here starts from
small leaves of random hyperplanes and improves every list by the neighbours of
its neighbours until hardly any list changes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.operators.vectors import _nearest
from cellgauge.session import spread, stage

LEAF = 64
#: leaves of large tables, and how many rows call for one more vector in a leaf
LARGE_LEAF, LEAF_SHARE = 2048, 16
#: candidates that one neighbourhood hands to one of its members, at most
OFFERS = 12
LINK = "src bigint, dst bigint, dist double"
#: share of the true neighbours that a search must find for vectors drawn by hash, and how many are drawn
LEAST_RECALL, DRAWN = 0.97, 256
#: a round that finds less than this share of the true neighbours anew ends the search with lists of one width
LEAST_GAIN = 0.01


def _plain(df: DataFrame, vec: str) -> Column:
    """The vector without negative zeros; floats travel as they are and are measured as doubles."""
    kind = "float" if df.schema[vec].dataType.elementType.simpleString() == "float" else "double"
    return F.transform(vec, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))


def distinct_vectors(df: DataFrame, key: str, vec: str, copies: int) -> DataFrame:
    """(node, v, ids): each vector once, with the ``copies`` least keys that have it.

    More copies than that can't all be among the nearest of anything. The
    grouping is salted, so that no task holds all keys of a frequent vector.
    """
    rows = df.select(F.col(key).alias("id"), _plain(df, vec).alias("v"))
    salted = rows.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(256)).alias("_salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, copies).alias("ids"))
    merged = salted.groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, copies).alias("ids"))
    return stage(merged.select(F.monotonically_increasing_id().alias("node"), "v", "ids"), "vectors")


def _stacked(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64, copy=False)


def _planes(nodes: DataFrame, n: int, leaf: int, trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random directions (tree, bit, dimension) and the offset of each, so that about half of the vectors lie beyond it."""
    dims = len(nodes.select("v").first()[0])
    bits = max(0, math.ceil(math.log2(max(1, n / leaf))))
    means = nodes.select(F.posexplode("v")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()  # one row per dimension
    mean = [r["m"] for r in means]
    w = np.random.default_rng(seed).normal(size=(trees, bits, dims))
    return w, w @ np.array(mean)


def _leaves(nodes: DataFrame, planes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, v, tree, code): the leaf of each vector in each tree."""
    w, offset = planes
    trees, bits, _ = w.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, n = _stacked(batch.column("v")), batch.num_rows
            codes = np.stack([((x @ w[t].T > offset[t]) @ (1 << np.arange(bits, dtype=np.int64))) for t in range(trees)], axis=1)
            rows = np.repeat(np.arange(n), trees)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(rows)), batch.column("v").take(pa.array(rows)), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(codes.ravel().astype(np.int64))],
                ["node", "v", "tree", "code"])

    return nodes.select("node", "v").mapInArrow(run, f"node bigint, v {nodes.schema['v'].dataType.simpleString()}, tree int, code bigint")


def _forest(n: int, trees: int | None, leaf: int | None) -> tuple[int, int]:
    """Trees and leaves for ``n`` vectors: products make large leaves cheap, and what they find needs no round."""
    leaf = leaf or max(LEAF, min(LARGE_LEAF, n // LEAF_SHARE))
    return trees or (3 if leaf <= LEAF else 8), leaf


def _cut(placed: DataFrame, leaf: int) -> DataFrame:
    """Leaves in parts of about ``leaf`` vectors, dealt by hash: a leaf may hold any share of the table."""
    sizes = placed.groupBy("tree", "code").agg(F.ceil(F.count(F.lit(1)) / leaf).alias("parts"))
    part = F.pmod(F.xxhash64("node", "tree"), F.col("parts"))
    return placed.join(stage(sizes, "leaves"), ["tree", "code"]).withColumn("part", part)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


def _near(x: np.ndarray, few: int, barred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ``few`` nearest others and their distances; those of barred pairs are infinite.

    Products tell who can be among them, differences only tell those apart;
    where rounding could leave one out, differences decide about all.
    """
    n, pool = len(x), few + 8
    barred = barred | np.eye(n, dtype=bool)
    with np.errstate(all="ignore"):
        y = x - x.mean(axis=0)
        q = (y * y).sum(axis=1)
        rough = q[:, None] + q[None, :] - 2 * (y @ y.T)
    if pool < n and np.isfinite(rough).all():
        rough[barred] = np.inf
        some = np.sort(np.argpartition(rough, pool - 1, axis=1)[:, :pool], axis=1)
        least = np.sort(np.take_along_axis(rough, some, axis=1), axis=1)
        far, last = least[:, -1], least[:, few - 1]
        if (np.isinf(far) | (far > np.where(np.isinf(last), 0, last) + 1e-11 * q.max())).all():
            dist = np.sqrt(((x[:, None, :] - x[some]) ** 2).sum(axis=2))
            dist[np.take_along_axis(barred, some, axis=1)] = np.inf
            at = np.argsort(dist, axis=1, kind="stable")[:, :few]
            return np.take_along_axis(some, at, axis=1), np.take_along_axis(dist, at, axis=1)
    dist = _distances(x, x)
    dist[barred] = np.inf
    near = np.argsort(dist, axis=1, kind="stable")[:, :few]
    return near, np.take_along_axis(dist, near, axis=1)


def _links(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    src, dst, dist = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(dist, pa.float64())], ["src", "dst", "dist"])


def _first(width: int):
    """The nearest of a leaf for each vector in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for rows in batch.column("rows"):
                ids, x = rows.values.field("node").to_numpy(zero_copy_only=False), _stacked(rows.values.field("v"))
                near, dist = _near(x, min(width, len(ids) - 1), np.zeros((len(ids), len(ids)), bool))
                src = np.repeat(np.arange(len(ids)), near.shape[1])
                found.append((ids[src], ids[near.ravel()], dist.ravel()))
            yield _links(found)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All members of a neighbourhood meet, pairs of which neither is fresh excepted; who is nearer than a member's worst is offered to it."""
    for batch in batches:
        found = []
        for rows in batch.column("rows"):
            part = rows.values
            ids, worst = part.field("member").to_numpy(zero_copy_only=False), part.field("worst").to_numpy(zero_copy_only=False)
            fresh, x = part.field("fresh").to_numpy(zero_copy_only=False).astype(bool), _stacked(part.field("v"))
            near, dist = _near(x, OFFERS, ~(fresh[:, None] | fresh[None, :]))
            src, dist = np.repeat(np.arange(len(ids)), near.shape[1]), dist.ravel()
            some = np.isfinite(dist) & (dist < worst[src])
            found.append((ids[src[some]], ids[near.ravel()[some]], dist[some]))
        yield _links(found)


def _best(links: DataFrame, width: int) -> DataFrame:
    """The ``width`` nearest of each list; a link that was there before isn't fresh."""
    once = spread(links, "src").groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))
    return once.withColumn("_r", rank).where(F.col("_r") <= width).drop("_r")


def neighbour_graph(
    nodes: DataFrame, width: int, trees: int | None = None, leaf: int | None = None, stop: float = 0.002, max_rounds: int = 12, seed: int = 42,
    known: DataFrame | None = None, enough: Callable[[DataFrame], bool] | None = None,
) -> tuple[DataFrame, list[dict]]:
    """Lists of ``width`` near vectors (src, dst, dist, fresh), and what each round did.

    In a round the members of each vector's neighbourhood meet: its own list and
    as many vectors that list it, chosen by hash (a hub is listed by any number).
    Pairs that met before don't meet again. Each round is written out. The
    search ends when a round changes at most ``stop`` of all entries, or where
    ``enough`` says so. Lists of an earlier search (``known``) are a further start.
    """
    n = nodes.count()
    if n < 2:
        return nodes.sparkSession.createDataFrame([], f"{LINK}, fresh boolean"), []
    trees, leaf = _forest(n, trees, leaf)
    placed = _leaves(nodes, _planes(nodes, n, leaf, trees, seed))
    blocks = spread(_cut(placed, leaf), "tree", "code", "part").groupBy("tree", "code", "part").agg(F.collect_list(F.struct("node", "v")).alias("rows"))
    start = blocks.select("rows").mapInArrow(_first(width), LINK).withColumn("fresh", F.lit(True))
    # a vector alone in its leaves starts from others by chance
    ring = nodes.select("node", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(max(1, n // LEAF))).alias("code"), "v").groupBy("code").agg(F.collect_list(F.struct("node", "v")).alias("rows"))
    start = start.unionByName(ring.select("rows").mapInArrow(_first(max(2, width // 4)), LINK).withColumn("fresh", F.lit(True)))
    if known is not None:
        start = start.unionByName(known.select("src", "dst", "dist", F.lit(True).alias("fresh")))
    graph, rounds = stage(_best(start, width), "graph"), []
    for r in range(max_rounds):
        worst = graph.groupBy("src").agg(F.when(F.count(F.lit(1)) >= width, F.max("dist")).otherwise(F.lit(float("inf"))).alias("worst"))
        known = nodes.join(worst, nodes["node"] == worst["src"], "left").select(F.col("node").alias("member"), "v", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        back = graph.select(F.col("dst").alias("centre"), F.col("src").alias("member"), "fresh")
        chosen = F.row_number().over(W.partitionBy("centre").orderBy(~F.col("fresh"), F.xxhash64("member", F.lit(seed + r))))
        back = back.withColumn("_r", chosen).where(F.col("_r") <= width).drop("_r")
        both = graph.select(F.col("src").alias("centre"), F.col("dst").alias("member"), "fresh").unionByName(back).groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
        # where nobody is fresh nobody meets: the vectors stay at home
        both = both.withColumn("_any", F.max("fresh").over(W.partitionBy("centre"))).where("_any").drop("_any")
        around = spread(both.join(known, "member"), "centre").groupBy("centre").agg(F.collect_list(F.struct("member", "fresh", "worst", "v")).alias("rows"))
        offered = around.select("rows").mapInArrow(_meet, LINK).withColumn("fresh", F.lit(True))
        graph = stage(_best(graph.withColumn("fresh", F.lit(False)).unionByName(offered), width), "graph")
        changed = graph.where("fresh").count()
        rounds.append({"round": r, "changed": changed, "entries": n * width})
        if enough is not None and enough(graph) or changed <= stop * n * width:
            break
    return graph, rounds


class Recall:
    """Share of the ``k`` nearest nodes that lists have for at most DRAWN points, which meet all nodes once."""

    def __init__(self, points: DataFrame, nodes: DataFrame, k: int, same: bool, seed: int = 42):
        self.near, self.of = stage(drawn_neighbours(points, nodes, k, same, seed), "drawn"), 0.0

    def __call__(self, lists: DataFrame) -> float:
        hits = self.near.join(lists.select("src", "dst", F.lit(1).alias("_hit")), ["src", "dst"], "left")
        self.of = hits.agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0]
        return self.of

    def enough(self) -> Callable[[DataFrame], bool]:
        """For a search: whether its lists find what they should, or hardly more than a round before."""
        last = 0.0

        def run(lists: DataFrame) -> bool:
            nonlocal last
            before, last = last, self(lists)
            return last >= LEAST_RECALL or last - before < LEAST_GAIN

        return run


def drawn_neighbours(points: DataFrame, nodes: DataFrame, k: int, same: bool, seed: int = 42) -> DataFrame:
    """The ``k`` nearest nodes (src, dst) of at most DRAWN points, by the exact search."""
    drawn = points.select("node", "v").orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(DRAWN).collect()
    ids, x = np.array([r["node"] for r in drawn], np.int64), np.array([r["v"] for r in drawn], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                others = batch.column("node").to_numpy(zero_copy_only=False)
                rows, cols, dist = _nearest(ids, x, others, _stacked(batch.column("v")), k, same)
                yield _links([(ids[rows], others[cols], dist)])

    near = nodes.select("node", "v").mapInArrow(run, LINK).withColumn("_r", F.row_number().over(W.partitionBy("src").orderBy("dist", "dst")))
    return near.where(F.col("_r") <= k).select("src", "dst")


def _expand(lists: DataFrame, queries: DataFrame, nodes: DataFrame, k: int, same: bool) -> DataFrame:
    """From lists of distinct vectors to the keys that have them: ``src, dst, dist, rank``."""
    near = lists.join(nodes.select(F.col("node").alias("dst"), F.col("ids").alias("_ids")), "dst")
    if same:
        # the copies of a vector are its nearest
        near = near.select("src", "dist", "_ids").unionByName(nodes.select(F.col("node").alias("src"), F.lit(0.0).alias("dist"), F.col("ids").alias("_ids")))
    pool = near.groupBy("src").agg(F.array_sort(F.flatten(F.collect_list(F.transform("_ids", lambda i: F.struct(F.col("dist"), i.alias("id")))))).alias("_near"))
    listed = queries.join(pool, queries["node"] == pool["src"]).select("id", F.slice(F.filter("_near", lambda e: e["id"] != F.col("id")) if same else F.col("_near"), 1, k).alias("_near"))
    return listed.select(F.col("id").alias("src"), F.posexplode("_near").alias("_pos", "_e")).select("src", F.col("_e.id").alias("dst"), F.col("_e.dist").alias("dist"), (F.col("_pos") + 1).alias("rank"))


def _named(df: DataFrame, key: str, vec: str, nodes: DataFrame) -> DataFrame:
    rows = df.select(F.col(key).alias("id"), _plain(df, vec).alias("v"))
    return rows.join(nodes.select("node", "v"), "v").select("id", "node")


def knn_descent(df: DataFrame, key: str, vec: str, k: int, width: int | None = None, **settings) -> DataFrame:
    """About the ``k`` nearest vectors of every row: ``src, dst, dist, rank``.

    Distances and their order are exact; a list may miss a neighbour. Lists are
    ``width`` long while they improve (default 6 k): longer ones miss less, and
    they are doubled until at most the share 1 - LEAST_RECALL is missed.
    Copies of a vector are one node of the graph, and all of them are found.
    Rows with a null vector take no part; keys are unique.
    """
    rows = df.where(F.col(vec).isNotNull())
    nodes = distinct_vectors(rows, key, vec, k + 1)
    width, n = width or 6 * k, nodes.count()
    recall = Recall(nodes, nodes, k, True) if n > 1 else None
    graph, _ = neighbour_graph(nodes, width, enough=recall and recall.enough(), **settings)
    while width < n - 1 and recall.of < LEAST_RECALL:
        width *= 2
        graph, _ = neighbour_graph(nodes, width, known=graph, enough=recall.enough(), **settings)
    return _expand(graph.drop("fresh"), _named(rows, key, vec, nodes), nodes, k, True)


def knn_search(
    queries: DataFrame, base: DataFrame, key: str, vec: str, k: int, width: int | None = None, trees: int | None = None, leaf: int | None = None,
    stop: float = 0.002, max_rounds: int = 12, seed: int = 42,
) -> DataFrame:
    """About the ``k`` nearest base vectors of every query: ``src, dst, dist, rank``.

    Queries fall into leaves with the base vectors, and then follow the
    neighbour graph of the base: in each round a list meets the lists of its
    new entries, until hardly any list changes. Where the lists miss more than
    the share 1 - LEAST_RECALL, lists and graph are made twice as wide.
    """
    spark, width = base.sparkSession, width or max(64, 6 * k)
    found, asked = base.where(F.col(vec).isNotNull()), queries.where(F.col(vec).isNotNull())
    nodes, points = distinct_vectors(found, key, vec, k), distinct_vectors(asked, key, vec, 1)
    n, m = nodes.count(), points.count()
    if not n or not m:
        return spark.createDataFrame([], f"src {base.schema[key].dataType.simpleString()}, dst {base.schema[key].dataType.simpleString()}, dist double, rank int")
    trees, leaf = _forest(n, trees, leaf)
    inner, recall = Recall(nodes, nodes, k, True) if n > 1 else None, Recall(points, nodes, k, False)
    known = lists = None
    while True:
        known, _ = neighbour_graph(nodes, max(20, width), trees, leaf, stop, max_rounds, seed, known, inner and inner.enough())
        lists = _follow(known, nodes, points, n, m, width, trees, leaf, stop, max_rounds, seed, lists, recall.enough())
        if width >= 2 * n or recall.of >= LEAST_RECALL:
            return _expand(lists.drop("fresh"), _named(asked, key, vec, points), nodes, k, False)
        width *= 2


def _across(few: int):
    """The nearest ``few`` vectors of each group for those that ask in it, as far as they are nearer than what each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for asks, offers in zip(batch.column("asks"), batch.column("offers")):
                src, worst, x = asks.values.field("node").to_numpy(zero_copy_only=False), asks.values.field("worst").to_numpy(zero_copy_only=False), _stacked(asks.values.field("v"))
                dst, y = offers.values.field("node").to_numpy(zero_copy_only=False), _stacked(offers.values.field("v"))
                rows, cols, dist = _nearest(src, x, dst, y, min(few, len(dst)), False)
                some = dist < worst[rows]
                found.append((src[rows[some]], dst[cols[some]], dist[some]))
            yield _links(found)

    return run


def _starts(seats: DataFrame, homes: DataFrame, few: int, leaf: int) -> DataFrame:
    """Links of the points at ``seats`` to the nearest vectors of the part of a leaf that they meet."""
    at = ["tree", "code", "part"]
    asks = seats.select(*at, "node", F.lit(float("inf")).alias("worst"), "v")
    cuts = stage(asks.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("cuts")), "cuts")
    asks = asks.join(cuts, at).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    offers = homes.join(cuts, at).withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    at.append("cut")
    asks = spread(asks, *at).groupBy(*at).agg(F.collect_list(F.struct("node", "worst", "v")).alias("asks"))
    offers = spread(offers, *at).groupBy(*at).agg(F.collect_list(F.struct("node", "v")).alias("offers"))
    return asks.join(offers, at).select("asks", "offers").mapInArrow(_across(few), LINK)


def _follow(
    graph: DataFrame, nodes: DataFrame, points: DataFrame, n: int, m: int, width: int, trees: int, leaf: int, stop: float, max_rounds: int, seed: int,
    known: DataFrame | None = None, enough: Callable[[DataFrame], bool] | None = None,
) -> DataFrame:
    """Lists (src, dst, dist, fresh) of the nodes near each point, found along the graph of the nodes.

    In a round all points whose list has a vector anew meet its neighbours at
    one place, at most ``leaf`` points at a time: a vector travels once per
    entry of a list, never once per pair.
    """
    # both directions, at most ``width`` of the second
    back = graph.select(F.col("dst").alias("_via"), F.col("src").alias("dst"), "dist")
    back = back.withColumn("_r", F.row_number().over(W.partitionBy("_via").orderBy("dist", "dst"))).where(F.col("_r") <= width)
    links = graph.select(F.col("src").alias("_via"), "dst").unionByName(back.select("_via", "dst")).distinct()
    around = spread(links.join(nodes.select(F.col("node").alias("dst"), "v"), "dst"), "_via").groupBy("_via").agg(F.collect_list(F.struct(F.col("dst").alias("node"), "v")).alias("offers"))
    around = stage(around, "around")
    planes = _planes(nodes, n, leaf, trees, seed)
    homes = _cut(_leaves(nodes, planes), leaf)
    # the part of a leaf that a query meets
    sizes = stage(homes.groupBy("tree", "code").agg((F.max("part") + 1).alias("parts")), "leaves")
    seats = _leaves(points, planes).join(sizes, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    start = _starts(seats, homes, width, leaf)
    # a query without company in all its leaves enters the graph at ``width`` fixed vectors
    alone = points.join(seats.select("node").distinct(), "node", "left_anti").select(F.lit(0).alias("tree"), F.lit(0).alias("code"), F.lit(0).alias("part"), "node", "v")
    entry = nodes.orderBy(F.xxhash64("node", F.lit(seed))).limit(width).select(F.lit(0).alias("tree"), F.lit(0).alias("code"), F.lit(0).alias("part"), "node", "v")
    start = start.unionByName(_starts(alone, entry, width, leaf)).withColumn("fresh", F.lit(True))
    if known is not None:
        start = start.unionByName(known.select("src", "dst", "dist", F.lit(True).alias("fresh")))
    lists = stage(_best(start, width), "lists")
    for _ in range(max_rounds):
        worst = lists.groupBy("src").agg(F.when(F.count(F.lit(1)) >= width, F.max("dist")).otherwise(F.lit(float("inf"))).alias("worst"))
        asking = points.join(worst, points["node"] == worst["src"]).select("node", "worst", "v")
        asks = lists.where("fresh").select(F.col("src").alias("node"), F.col("dst").alias("_via")).join(asking, "node")
        # a vector may be in any number of lists
        asks = spread(asks, "_via").groupBy("_via", F.pmod(F.xxhash64("node"), F.lit(max(1, m * width // (n * leaf)))).alias("_cut")).agg(F.collect_list(F.struct("node", "worst", "v")).alias("asks"))
        offered = asks.join(around, "_via").select("asks", "offers").mapInArrow(_across(OFFERS), LINK).withColumn("fresh", F.lit(True))
        lists = stage(_best(lists.withColumn("fresh", F.lit(False)).unionByName(offered), width), "lists")
        if enough is not None and enough(lists) or lists.where("fresh").count() <= stop * m * width:
            break
    return lists
