"""Exact nearest neighbours of vectors, and graphs built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellgauge.operators.splits import sample_n
from cellgauge.session import stage

#: rows packed into one block of candidates, and of queries, at most: what pairs of blocks shuffle falls as blocks grow
BLOCK_ROWS = 16_384
#: rows that call for another pivot
PIVOT_ROWS = 1_024
#: queries of a block that meet its candidates at a time
TILE = 512


def _pack(df: DataFrame, key: str, vec: str, centers: np.ndarray, rows: int, name: str) -> DataFrame:
    """Blocks of nearby vectors: ``block, pivot, part, parts, radius, ids, flat``.

    A vector belongs to its nearest pivot; a pivot with many vectors is cut into
    blocks by hash, so a block stays near ``rows`` rows whatever the data.
    """

    @F.pandas_udf("pivot int, dist double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        if len(v) == 0:
            return pd.DataFrame({"pivot": pd.Series(dtype="int32"), "dist": pd.Series(dtype="float64")})
        x = np.stack(v.to_numpy())
        d = np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centers], axis=1)
        best = d.argmin(axis=1)
        return pd.DataFrame({"pivot": best.astype("int32"), "dist": d[np.arange(len(x)), best]})

    # floats travel as they are, and are measured as doubles
    plain = df.schema[vec].dataType.elementType.simpleString() == "float"
    tagged = df.select(F.col(key).alias("id"), (F.col(vec) if plain else F.transform(vec, lambda v: v.cast("double"))).alias("v"))
    placed = stage(tagged.withColumn("_n", nearest("v")).select("id", "v", "_n.*"), name)
    cut = stage(placed.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts")), "parts")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    packed = placed.join(cut, "pivot").groupBy("pivot", "parts", part.alias("part")).agg(
        F.max("dist").alias("radius"), F.collect_list(F.struct("id", "v")).alias("_rows")
    )
    blocks = packed.select(
        F.concat_ws(":", "pivot", "part").alias("block"), "pivot", "part", "parts", "radius",
        F.transform("_rows", lambda r: r["id"]).alias("ids"),
        F.flatten(F.transform("_rows", lambda r: r["v"])).alias("flat"),
    )
    return stage(blocks, name)


def _rough(c: np.ndarray, k: int) -> Callable[[np.ndarray, tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """A function that gives (row, column) of all pairs that may be among the ``k`` nearest of a row, those of ``barred`` pairs left out.

    Products of floats decide about nearly all pairs: how far rounding can
    reach is known beforehand. Where that leaves too many, and for numbers that
    floats don't hold, products of doubles decide.
    """
    cc = (c * c).sum(axis=1)
    centre = c.mean(axis=0) if len(c) else np.zeros(c.shape[1])
    with np.errstate(all="ignore"):
        moved = c - centre
        square = (moved * moved).sum(axis=1)
        plain = len(c) > 4 * k and bool(square.max() < 1e30)
        # one product gives the squared distance but for what depends on the row alone
        right = np.concatenate((-2 * moved, square[:, None]), axis=1).astype(np.float32).T if plain else None
    # of so many parts each has its least; the k-th of them is no less than the k-th of all
    parts = np.arange(0, len(c), max(1, len(c) // max(128, 4 * k)))

    def by_doubles(x: np.ndarray, barred: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        qq = (x * x).sum(axis=1)
        rough = qq[:, None] + cc[None, :] - 2.0 * (x @ c.T)
        rough[barred] = np.inf
        slack = 1e-9 * (qq.max() + cc.max() + 1.0)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(x), np.inf)
        return np.nonzero((rough <= limit[:, None] + slack) & np.isfinite(rough))

    def run(x: np.ndarray, barred: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if plain:
            with np.errstate(all="ignore"):
                y = x - centre
                most = (y * y).sum(axis=1).max(initial=0)
            if most < 1e30:
                rough = np.concatenate((y, np.ones((len(y), 1))), axis=1).astype(np.float32) @ right
                rough[barred] = np.inf
                limit = np.partition(np.minimum.reduceat(rough, parts, axis=1), k - 1, axis=1)[:, k - 1]
                slack = 4 * (x.shape[1] + 4) * 2.0**-24 * (most + square.max())
                at = np.flatnonzero(rough <= (limit + np.float32(slack)).astype(np.float32)[:, None])
                if len(at) <= 64 * k * len(x):
                    rows, cols = np.divmod(at, rough.shape[1])
                    some = np.isfinite(rough[rows, cols])
                    return rows[some], cols[some]
        return by_doubles(x, barred)

    return run


def _nearest(q_ids, q, c_ids, c, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number of the query, candidate position and exact distance of the best ``k`` each.

    Matrix products give distances good to rounding; only candidates near the
    k-th of them are measured exactly, and those are ordered by (distance, id).
    """
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    near, found = _rough(c, k), []
    for at in range(0, len(q), TILE):
        some, x = q_ids[at: at + TILE], q[at: at + TILE]
        low = np.searchsorted(c_ids, some)
        own = np.searchsorted(c_ids, some, side="right") - low if same else np.zeros(len(some), int)
        mine = np.repeat(np.arange(len(some)), own), np.repeat(low - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
        rows, cols = near(x, mine)
        dist = np.sqrt(((x[rows] - c[cols]) ** 2).sum(axis=1))
        best = np.lexsort((cols, dist, rows))
        rows, cols, dist = rows[best], cols[best], dist[best]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
        found.append((rows[keep] + at, order[cols[keep]], dist[keep]))
    return tuple(np.concatenate(f) for f in zip(*found))


def _matrix(ids, flat) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(ids)
    return ids, np.asarray(flat, dtype=float).reshape(len(ids), -1)


def knn_vectors(
    queries: DataFrame, base: DataFrame, key: str, vec: str, k: int, same_table: bool = True,
    max_pivots: int = 64, block_rows: int = BLOCK_ROWS, seed: int = 42,
) -> DataFrame:
    """The exact ``k`` nearest base vectors of every query: ``src, dst, dist, rank``.

    Vectors are packed into blocks around pivots. A first pass inside the own
    pivot bounds the k-th distance of a query block; block pairs whose distance
    bound exceeds it are never met (triangle inequality). Tasks see one pair of
    blocks at a time, and return at most ``k`` rows per query.
    """
    spark = base.sparkSession
    # at most max_pivots rows reach the driver
    n_pivots = max(1, min(max_pivots, base.count() // min(block_rows, PIVOT_ROWS)))
    drawn = sample_n(base.select(key, vec), n_pivots, [key], seed).orderBy(key).collect()
    centers = np.array([r[vec] for r in drawn], dtype=float)
    cand = _pack(base, key, vec, centers, block_rows, "candidates")
    query = cand if same_table and queries is base else _pack(queries, key, vec, centers, block_rows, "queries")
    id_type = base.schema[key].dataType.simpleString()

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                q_ids, q = _matrix(r.q_ids, r.q_flat)
                c_ids, c = _matrix(r.c_ids, r.c_flat)
                rows, _, dist = _nearest(q_ids, q, c_ids, c, k, same_table)
                full = len(rows) == k * len(q_ids)
                out.append((r.q_block, float(dist.max()) if full else np.inf))
            yield pd.DataFrame(out, columns=["q_block", "reach"])

    def prefixed(blocks: DataFrame, p: str) -> DataFrame:
        return blocks.select(*[F.col(c).alias(p + c) for c in blocks.columns])

    # one candidate block of its own pivot is enough to bound a query block
    parts = cand.groupBy("pivot").agg(F.max("parts").alias("_cp"))
    probe = query.join(parts, "pivot").withColumn("_probe", F.concat_ws(":", "pivot", F.pmod("part", "_cp")))
    own = prefixed(probe, "q_").join(prefixed(cand, "c_"), F.col("q__probe") == F.col("c_block")).select(
        "q_block", "q_ids", "q_flat", "c_ids", "c_flat"
    )
    reach = own.mapInPandas(bound, "q_block string, reach double").groupBy("q_block").agg(F.min("reach").alias("q_reach"))
    between = np.sqrt(((centers[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2))
    gaps = spark.createDataFrame(
        [(i, j, float(between[i, j])) for i in range(len(centers)) for j in range(len(centers))],
        "q_pivot int, c_pivot int, _gap double",
    )
    heads_q = query.select(F.col("block").alias("q_block"), F.col("pivot").alias("q_pivot"), F.col("radius").alias("q_radius"))
    heads_c = cand.select(F.col("block").alias("c_block"), F.col("pivot").alias("c_pivot"), F.col("radius").alias("c_radius"))
    meet = (
        heads_q.join(reach, "q_block", "left").join(gaps, "q_pivot").join(heads_c, "c_pivot")
        .where(F.col("_gap") - F.col("q_radius") - F.col("c_radius") - 1e-9 <= F.coalesce("q_reach", F.lit(float("inf"))))
        .select("q_block", "c_block")
        # pairs are few rows and much work: dealt out, whether or not the joins below shuffle
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "q_block", "c_block")
    )
    q = query.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    c = cand.select(F.col("block").alias("c_block"), F.col("ids").alias("c_ids"), F.col("flat").alias("c_flat"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            src, dst, dist = [], [], []
            for r in pdf.itertuples(index=False):
                q_ids, x = _matrix(r.q_ids, r.q_flat)
                c_ids, y = _matrix(r.c_ids, r.c_flat)
                rows, cols, d = _nearest(q_ids, x, c_ids, y, k, same_table)
                src.append(q_ids[rows])
                dst.append(c_ids[cols])
                dist.append(d)
            if src:
                yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "dist": np.concatenate(dist)})

    found = meet.join(q, "q_block").join(c, "c_block").select("q_ids", "q_flat", "c_ids", "c_flat").mapInPandas(
        search, f"src {id_type}, dst {id_type}, dist double"
    )
    rank = F.row_number().over(W.partitionBy("src").orderBy("dist", "dst"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# -- graphs ----------------------------------------------------------------


def shared_neighbour_weights(edges: DataFrame) -> DataFrame:
    """Undirected edges weighted by the Jaccard overlap of the two neighbour lists.

    ``edges`` are ``src, dst`` with at most k rows per ``src``, so the lists are short.
    """
    lists = edges.groupBy("src").agg(F.collect_set("dst").alias("_nb"))
    pair = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    a = lists.select(F.col("src").alias("a"), F.col("_nb").alias("_na"))
    b = lists.select(F.col("src").alias("b"), F.col("_nb").alias("_nb"))
    both = pair.join(a, "a").join(b, "b")
    # each end counts as a member of its own neighbourhood
    na, nb = F.array_union("_na", F.array("a")), F.array_union("_nb", F.array("b"))
    weight = F.size(F.array_intersect(na, nb)) / F.size(F.array_union(na, nb))
    return both.select("a", "b", weight.alias("weight"))


def label_propagation(edges: DataFrame, rounds: int = 8, seed: int = 42) -> DataFrame:
    """Communities ``id, community`` by weighted label propagation for a fixed number of rounds.

    Every round is written out, so the plan does not grow and lost executors
    cost at most one round. Nodes of one hash half move at a time, which keeps
    neighbours from swapping labels for ever.
    """
    both = stage(
        edges.select(F.col("a").alias("id"), F.col("b").alias("nb"), "weight")
        .unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("nb"), "weight")),
        "edges",
    )
    labels = stage(both.select("id").distinct().withColumn("community", F.col("id")), "labels")
    for r in range(rounds):
        near = both.join(labels.select(F.col("id").alias("nb"), "community"), "nb")
        votes = near.groupBy("id", "community").agg(F.round(F.sum("weight"), 9).alias("_w"))
        tie = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("community").cast("string")))
        best = votes.groupBy("id").agg(F.min_by("community", F.struct(-F.col("_w"), tie)).alias("_new"))
        moves = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 1), 16, 10).cast("int") % 2 == r % 2
        labels = stage(
            labels.join(best, "id", "left").select(
                "id", F.when(moves, F.coalesce("_new", "community")).otherwise(F.col("community")).alias("community")
            ),
            "labels",
        )
    return labels


def communities(df: DataFrame, key: str, vec: str, k: int = 10, rounds: int = 8, weighted: bool = True) -> DataFrame:
    """k nearest neighbours, shared-neighbour weights, communities."""
    edges = stage(knn_vectors(df, df, key, vec, k).select("src", "dst"), "knn")
    if weighted:
        graph = shared_neighbour_weights(edges)
    else:
        graph = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("weight", F.lit(1.0))
    return label_propagation(graph, rounds)
