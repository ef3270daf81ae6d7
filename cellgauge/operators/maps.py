"""Self-organising maps fitted in batches, and meta-clusters of their nodes by consensus.

Each pass over the rows is one aggregate: for every node the number of rows
nearest to it and their sum. The kernel that lets nodes learn from their
neighbours on the grid is applied to these sums, so a pass sends the map's own
size, whatever the number of rows. All that follows the passes works on the
nodes, of which there are a few hundred.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nearest(x: np.ndarray, nodes: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest nodes of each row, by exact distances; ties to the first."""
    d = np.stack([((x - c) ** 2).sum(axis=1) for c in nodes], axis=1)
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def _totals(nodes: np.ndarray):
    """Per task and used node: rows, their sum, their squared distances, and those whose second node isn't beside the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(nodes), np.int64), np.zeros(nodes.shape)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                home = _nearest(x, nodes)[:, 0]
                count += np.bincount(home, minlength=len(nodes))
                np.add.at(total, home, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], ["node", "n", "total"])

    return run


@dataclass
class SelfOrganisingMap:
    """``nodes`` in the space of the rows, row by row of a ``height`` x ``width`` grid, and ``sizes`` in rows."""

    height: int
    width: int
    nodes: np.ndarray
    sizes: np.ndarray

    @property
    def grid(self) -> np.ndarray:
        return np.stack(np.divmod(np.arange(self.height * self.width), self.width), axis=1).astype(float)

    def assign(self, df: DataFrame, out: str = "node", second: str | None = None, features: str = "features") -> DataFrame:
        """Add the nearest node of each row, and the second nearest on request."""
        nodes = self.nodes

        @F.pandas_udf("first int, second int")
        def near(v: pd.Series) -> pd.DataFrame:
            if not len(v):
                return pd.DataFrame({"first": pd.Series(dtype="int32"), "second": pd.Series(dtype="int32")})
            found = _nearest(np.stack(v.to_numpy()), nodes, 2).astype("int32")
            return pd.DataFrame({"first": found[:, 0], "second": found[:, -1]})

        found = df.withColumn("_near", near(vector_to_array(features)))
        added = {out: F.col("_near.first")} | ({second: F.col("_near.second")} if second else {})
        return found.withColumns(added).drop("_near")

    def errors(self, df: DataFrame, features: str = "features") -> DataFrame:
        """One row: mean distance to the nearest node (``quantisation``) and share of rows whose two nearest aren't neighbours on the grid (``topographic``)."""
        near = self.assign(df.select(features), "_a", "_b", features)
        table = F.array(*(F.array(*map(float_lit, c)) for c in self.nodes))
        x = vector_to_array(features)
        d = F.sqrt(F.aggregate(F.zip_with(x, table[F.col("_a")], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
        rows, cols = (lambda c: F.floor(F.col(c) / self.width)), (lambda c: F.pmod(F.col(c), F.lit(self.width)))
        apart = F.greatest(F.abs(rows("_a") - rows("_b")), F.abs(cols("_a") - cols("_b"))) > 1
        return near.agg(F.avg(d).alias("quantisation"), F.avg(apart.cast("double")).alias("topographic"))

    def spanning_tree(self) -> list[tuple[int, int, float]]:
        """Edges (a, b, distance) of the minimum spanning tree of the nodes."""
        d = np.sqrt(((self.nodes[:, None] - self.nodes[None]) ** 2).sum(axis=2))
        best, parent, inside, out = d[0].copy(), np.zeros(len(d), int), {0}, []
        while len(inside) < len(d):
            b = min((i for i in range(len(d)) if i not in inside), key=lambda i: best[i])
            out.append((int(parent[b]), b, float(best[b])))
            inside.add(b)
            closer = d[b] < best
            best[closer], parent[closer] = d[b][closer], b
        return out


def float_lit(v: float):
    return F.lit(float(v))


def fit_map(df: DataFrame, height: int = 10, width: int = 10, passes: int = 10, start: float | None = None, end: float = 0.5, seed: int = 42, features: str = "features") -> SelfOrganisingMap:
    """A map fitted by ``passes`` over all rows with a ``features`` vector.

    Nodes start on the plane of the two main directions of the rows, which needs
    their moments only, so the fit is the same on any cluster. The radius of the
    kernel falls from ``start`` (half the longer side) to ``end`` in equal
    ratios. Rows with a null vector take no part.
    """
    rows = df.select(vector_to_array(features).alias("x")).where(F.col("x").isNotNull())
    mean, spread = _moments(rows)
    value, vector = np.linalg.eigh(spread)
    axes = (vector * np.sqrt(np.maximum(value, 0)))[:, ::-1][:, :2].T
    axes *= np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]
    place = np.stack(np.meshgrid(np.linspace(-1.5, 1.5, height), np.linspace(-1.5, 1.5, width), indexing="ij"), axis=-1).reshape(-1, 2)
    found = SelfOrganisingMap(height, width, mean + place[:, : len(axes)] @ axes, np.zeros(height * width, np.int64))
    gap = ((found.grid[:, None] - found.grid[None]) ** 2).sum(axis=2)
    first = start or max(height, width) / 2
    for p in range(passes):
        radius = first * (end / first) ** (p / max(1, passes - 1))
        count, total = _sums(rows, found.nodes)
        kernel = np.exp(-gap / (2 * radius**2))
        weight = kernel @ count
        learnt = kernel @ total / np.maximum(weight, 1e-300)[:, None]
        found.nodes = np.where(weight[:, None] > 1e-12, learnt, found.nodes)
    found.sizes = _sums(rows, found.nodes)[0]
    return found


def _sums(rows: DataFrame, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each node and their sum; one row per node reaches the driver."""
    per = rows.mapInArrow(_totals(nodes), "node int, n bigint, total array<double>").select("node", "n", F.posexplode("total"))
    per = per.groupBy("node", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    count, total = np.zeros(len(nodes), np.int64), np.zeros(nodes.shape)
    for r in per.collect():
        count[r["node"]], total[r["node"], r["pos"]] = r["n"], r["s"]
    return count, total


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance, summed in the tasks around the first row."""
    first = rows.first()
    if first is None:
        raise ValueError("no rows")
    near = np.array(first["x"], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(len(near)), np.zeros((len(near), len(near)))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - near
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, q.size + len(s))), pa.array(np.concatenate(([n], s, q.ravel())))], ["at", "v"])

    sums = rows.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r["v"] for r in sums])
    n, s, q = flat[0], flat[1: len(near) + 1], flat[len(near) + 1:].reshape(len(near), -1)
    return near + s / n, q / n - np.outer(s, s) / n**2


def _ward(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """``k`` clusters of weighted points, merged by the least growth of squared distances; labels by first point."""
    centres, mass, label = list(x), list(weight.astype(float)), list(range(len(x)))
    alive = list(range(len(x)))
    while len(alive) > k:
        c, m = np.array([centres[i] for i in alive]), np.array([mass[i] for i in alive])
        cost = (m[:, None] * m[None] / (m[:, None] + m[None])) * ((c[:, None] - c[None]) ** 2).sum(axis=2)
        cost[np.tril_indices(len(alive))] = np.inf
        i, j = (alive[v] for v in np.unravel_index(cost.argmin(), cost.shape))
        centres[i] = (mass[i] * centres[i] + mass[j] * centres[j]) / (mass[i] + mass[j])
        mass[i] += mass[j]
        label = [i if v == j else v for v in label]
        alive.remove(j)
    return np.unique(label, return_inverse=True)[1]


def consensus_clusters(found: SelfOrganisingMap, k: int, repeats: int = 50, share: float = 0.9, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Meta-cluster of each node, and the share of draws in which two nodes fell together.

    In each repeat a ``share`` of the nodes, drawn by seed, is clustered by their
    centres and sizes; nodes are then clustered by how often they fell together
    when both were drawn. Nodes without rows join the cluster of the nearest
    node with rows.
    """
    used = np.flatnonzero(found.sizes)
    k, rng = min(k, len(used)), np.random.default_rng(seed)
    met, same = np.zeros((len(used), len(used))), np.zeros((len(used), len(used)))
    for _ in range(repeats):
        drawn = np.sort(rng.choice(len(used), max(k, round(share * len(used))), replace=False))
        label = _ward(found.nodes[used[drawn]], found.sizes[used[drawn]], k)
        met[np.ix_(drawn, drawn)] += 1
        same[np.ix_(drawn, drawn)] += label[:, None] == label[None]
    agree = same / np.maximum(met, 1)
    label = _ward(agree, np.ones(len(used)), k)
    nearest = ((found.nodes[:, None] - found.nodes[used][None]) ** 2).sum(axis=2).argmin(axis=1)
    return label[nearest], agree


def map_clusters(df: DataFrame, k: int, height: int = 10, width: int = 10, passes: int = 10, repeats: int = 50, seed: int = 42, out: str = "cluster") -> tuple[DataFrame, SelfOrganisingMap]:
    """Rows with their ``node`` and the meta-cluster of it, and the map."""
    found = fit_map(df, height, width, passes, seed=seed)
    label, _ = consensus_clusters(found, k, repeats, seed=seed)
    names: Sequence[int] = label.tolist()
    return found.assign(df).withColumn(out, F.array(*map(F.lit, names))[F.col("node")]), found
