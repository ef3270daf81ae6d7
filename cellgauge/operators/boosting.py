"""Boosted trees for many classes at once: softmax objective, histograms, second-order splits.

Features are cut into bins by quantiles. A round grows one tree per class; one
pass over the rows per depth sums gradients and second derivatives by (class,
node, feature, bin), and these sums, whose number doesn't depend on the rows,
give all splits of that depth. Trees stay on the driver, they are small; rows
carry their bins and their scores so far in a table that each round writes
anew, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.functions.exprs import argmax
from cellgauge.session import discard, even, scratch_path

ROWS = "code int, weight double, held boolean, bins binary, scores binary"


@dataclass
class Tree:
    """Nodes in order of growth: feature (-1 at a leaf), the last bin that goes left, left child (the right one follows), value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    child: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> int:
        self.feature[node], self.cut[node], self.child[node] = feature, cut, len(self.feature)
        for v in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.child.append(0)
            self.value.append(v)
        return self.child[node]

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, child = np.array(self.feature), np.array(self.cut), np.array(self.child)
        while (live := np.flatnonzero(feature[at] >= 0)).size:
            f = feature[at[live]]
            at[live] = child[at[live]] + (bins[live, f] > cut[at[live]])
        return at


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Values up to the first edge fall into bin 0, and so on; NaN into the last."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def _flat(column: pa.Array, kind: type) -> np.ndarray:
    """The values of a binary column end to end."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    begin, end = int(at[column.offset]), int(at[column.offset + len(column)])
    return np.frombuffer(data, kind, (end - begin) // np.dtype(kind).itemsize, begin) if end > begin else np.zeros(0, kind)


def _rows(values: np.ndarray) -> pa.Array:
    """Each row of an array as bytes."""
    values = np.ascontiguousarray(values)
    at = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(at), pa.py_buffer(values)])


def _arrays(batch: pa.RecordBatch, classes: int) -> tuple[np.ndarray, ...]:
    bins = _flat(batch.column("bins"), np.uint8).reshape(batch.num_rows, -1)
    scores = _flat(batch.column("scores"), np.float64).reshape(-1, classes)
    return batch.column("code").to_numpy(), batch.column("weight").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False).astype(bool), bins, scores


def _sums(trees: list[Tree], open_nodes: list[dict[int, int]], bins_of: int, losses: bool):
    """Per task one row for each cell (class, open node, feature, bin): sums of gradients and second derivatives.

    Cells -1 and -2 are the losses of training and held-out rows and their weights.
    """
    classes, width = len(trees), max(len(o) for o in open_nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss = None, np.zeros((2, 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            code, weight, held, bins, scores = _arrays(batch, classes)
            p = _softmax(scores)
            if losses:
                own = -np.log(np.maximum(p[np.arange(len(code)), code], 1e-300)) * weight
                for i, part in enumerate((~held, held)):
                    loss[i] += own[part].sum(), weight[part].sum()
            fit = np.flatnonzero(~held)
            features = bins.shape[1]
            if total is None:
                total = np.zeros((2, classes, width, features, bins_of))
            for c, tree in enumerate(trees):
                slot = np.full(len(tree.feature), -1)
                slot[list(open_nodes[c])] = list(open_nodes[c].values())
                at = slot[tree.leaf(bins[fit])]
                live = fit[at >= 0]
                at = at[at >= 0]
                g = weight[live] * (p[live, c] - (code[live] == c))
                h = weight[live] * p[live, c] * (1 - p[live, c])
                for f in range(features):
                    cell = at * bins_of + bins[live, f]
                    for i, v in enumerate((g, h)):
                        total[i, c, :, f] += np.bincount(cell, v, width * bins_of).reshape(width, bins_of)
        cells, g, h = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        if total is not None:
            cells = np.flatnonzero(total[1])
            g, h = total[0].ravel()[cells], total[1].ravel()[cells]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((cells, [-1, -2]))), pa.array(np.concatenate((g, loss[:, 0]))), pa.array(np.concatenate((h, loss[:, 1])))], ["cell", "g", "h"])

    return run


class SoftmaxTrees:
    """Settings of the fit.

    ``rounds`` trees per class of at most ``depth``, shrunk by ``rate``; ``bins``
    per feature (256 at most); leaves have second derivatives of ``least`` in
    sum at least, and ``ridge`` is added to them. With a validation flag the fit
    ends when the held-out log loss hasn't fallen for ``patience`` rounds, and
    keeps the rounds up to its lowest.
    """

    def __init__(self, rounds: int = 20, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 1.0, patience: int = 3):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least, self.patience = rounds, depth, rate, min(bins, 256), ridge, least, patience

    def fit(self, train: DataFrame, validation: str | None = None) -> SoftmaxTreesModel:
        """``train`` has ``features`` (vector), ``code`` (0, 1, ...) and ``weight``."""
        spark = train.sparkSession
        flag = F.coalesce(F.col(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
        rows = train.select(F.col("code").cast("int").alias("code"), F.col("weight").cast("double").alias("weight"), flag.alias("held"), vector_to_array("features").alias("x"))
        shape = rows.agg(F.max("code"), F.max(F.size("x"))).first()
        if shape[0] is None:
            raise ValueError("no training rows")
        classes, features = shape[0] + 1, shape[1]
        shares = [i / self.bins for i in range(1, self.bins)]
        # features * bins numbers reach the driver
        cuts = rows.where("not held").select(*(F.percentile_approx(F.col("x")[f], F.array(*map(F.lit, shares)), 10_000).alias(str(f)) for f in range(features))).first()
        edges = [np.unique(np.array(c, float)) for c in cuts]

        def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, features)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("code", "weight", "held")), _rows(_binned(x, edges)), _rows(np.zeros((batch.num_rows, classes)))], ["code", "weight", "held", "bins", "scores"])

        path = self._written(even(rows).mapInArrow(start, ROWS))
        trees, losses, best, waited = [], [], 0, 0
        for _ in range(self.rounds + 1):
            now = spark.read.schema(ROWS).parquet(path)
            grown, loss = self._grow(now, classes, features, len(trees) < self.rounds)
            losses.append(loss)
            watched = [b if validation and b is not None else a for a, b in losses]
            if watched[-1] < watched[best]:
                best, waited = len(losses) - 1, 0
            elif len(losses) > 1:
                waited += 1
            if len(trees) == self.rounds or waited >= self.patience or not any(len(t.feature) > 1 for t in grown):
                break
            trees.append(grown)
            after = self._written(now.mapInArrow(self._scored(grown), ROWS))
            discard(spark, path)
            path = after
        discard(spark, path)
        return SoftmaxTreesModel(edges, classes, trees[:best], losses)

    @staticmethod
    def _written(df: DataFrame) -> str:
        path = scratch_path(df.sparkSession, "boosting")
        df.write.parquet(path)
        return path

    @staticmethod
    def _scored(trees: list[Tree]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *_, bins, scores = _arrays(batch, len(trees))
                after = scores + np.stack([np.array(t.value)[t.leaf(bins)] for t in trees], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _rows(after)], batch.schema.names)

        return run

    def _grow(self, rows: DataFrame, classes: int, features: int, more: bool) -> tuple[list[Tree], tuple[float, float | None]]:
        """A tree per class, and the log losses before they count."""
        trees, open_nodes, loss = [Tree() for _ in range(classes)], [{0: 0} for _ in range(classes)], None
        for depth in range(self.depth if more else 1):
            width = max(len(o) for o in open_nodes)
            if not width:
                break
            found = rows.mapInArrow(_sums(trees, open_nodes, self.bins, depth == 0), "cell bigint, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            total = np.zeros((2, classes, width, features, self.bins))
            for r in found:
                if r["cell"] >= 0:
                    total[0].flat[r["cell"]], total[1].flat[r["cell"]] = r["g"], r["h"]
            if depth == 0:
                parts = {r["cell"]: r["g"] / r["h"] if r["h"] else None for r in found if r["cell"] < 0}
                loss = parts[-1], parts[-2]
            if more:
                open_nodes = [self._split(tree, nodes, total[:, c]) for c, (tree, nodes) in enumerate(zip(trees, open_nodes))]
        return trees, loss

    def _split(self, tree: Tree, nodes: dict[int, int], total: np.ndarray) -> dict[int, int]:
        """Splits the open nodes where that gains, and returns the new ones."""
        fresh = []
        for node, slot in nodes.items():
            g, h = total[0, slot], total[1, slot]  # feature, bin
            left, right = (np.cumsum(v, axis=1)[:, :-1] for v in (g, h)), (g[0].sum(), h[0].sum())
            gl, hl = left
            gr, hr = right[0] - gl, right[1] - hl
            gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - right[0] ** 2 / (right[1] + self.ridge)
            gain[(hl < self.least) | (hr < self.least)] = -np.inf
            if not gain.size or gain.max() <= 1e-9:
                continue
            f, b = np.unravel_index(gain.argmax(), gain.shape)
            values = tuple(float(-self.rate * a / (s + self.ridge)) for a, s in ((gl[f, b], hl[f, b]), (gr[f, b], hr[f, b])))
            first = tree.split(node, int(f), int(b), values)
            fresh += [first, first + 1]
        return {n: i for i, n in enumerate(fresh)}


class SoftmaxTreesModel:
    """``losses`` has the log losses (training, held out) after 0, 1, ... rounds; ``trees`` the rounds that count."""

    def __init__(self, edges: list[np.ndarray], classes: int, trees: list[list[Tree]], losses: list[tuple[float, float | None]]):
        self.edges, self.classes, self.trees, self.losses = edges, classes, trees, losses

    def transform(self, df: DataFrame) -> DataFrame:
        edges, classes, trees = self.edges, self.classes, self.trees

        @F.pandas_udf("array<double>")
        def probabilities(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            bins = _binned(np.stack(v.to_numpy()), edges)
            scores = sum((np.stack([np.array(t.value)[t.leaf(bins)] for t in grown], axis=1) for grown in trees), np.zeros((len(bins), classes)))
            return pd.Series(list(_softmax(scores)))

        scored = df.withColumn("_p", probabilities(vector_to_array("features")))
        return scored.select(*df.columns, argmax("_p").cast("double").alias("prediction"), array_to_vector("_p").alias("probability"))
