"""Integration of batches before neighbours or clusters: soft clusters that avoid single-batch ones, then linear corrections.

Rows are assigned softly to clusters by the cosine distance to their centres,
with a penalty on a cluster in which a row's batch is over-represented. Per
cluster a ridge regression on the batches says by how much each batch is off,
and every row is corrected by its own mix of these amounts, which leaves what
rows of a batch have in common with no other batch's clusters. Both steps need
sums per (cluster, batch) only; the model is of that size, and all corrections
start from the original vectors, so nothing has to be written between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n > 0, n, 1)


@dataclass
class Integration:
    """``centres`` (cluster, dim); ``counts`` (cluster, batch) of the last assignment; ``offsets`` (cluster, batch, dim) from the last regression."""

    batches: list
    shares: np.ndarray
    centres: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray
    width: float
    penalty: float
    history: list[np.ndarray] = field(default_factory=list)

    def soft(self, x: np.ndarray, batch: np.ndarray) -> np.ndarray:
        """Cluster shares of each row."""
        logs = -2 * (1 - _unit(x) @ self.centres.T) / self.width
        expected = self.counts.sum(axis=1, keepdims=True) * self.shares
        logs += self.penalty * np.log((expected + 1) / (self.counts + 1)).T[batch]
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def corrected(self, x: np.ndarray, batch: np.ndarray, shares: np.ndarray) -> np.ndarray:
        out = x.copy()
        for k in range(len(self.centres)):
            out -= shares[:, k, None] * self.offsets[k][batch]
        return out


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column("b").to_numpy()


def _sums(model: Integration, assign: Integration, corrected: bool):
    """Per task and (cluster, batch): the shares' sum, and the shares times the vectors (corrected to unit length, or original)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, b = model.counts.shape
        n, total = np.zeros((k, b)), np.zeros(model.offsets.shape)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, of = _read(batch)
            moved = model.corrected(x, of, assign.soft(x, of)) if corrected else x
            r = model.soft(moved, of) if corrected else assign.soft(x, of)
            y = _unit(moved) if corrected else x
            for c in np.unique(of):
                own = of == c
                n[:, c] += r[own].sum(axis=0)
                total[:, c] += r[own].T @ y[own]
        cells = np.concatenate((n.ravel(), total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["at", "v"])

    return run


def _gather(rows: DataFrame, run, shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    found = rows.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r["v"] for r in found])
    size = shape[0] * shape[1]
    return flat[:size].reshape(shape[:2]), flat[size:].reshape(shape)


def fit_integration(
    df: DataFrame, vec: str, batch: str, clusters: int = 20, rounds: int = 5, inner: int = 3, width: float = 0.1, penalty: float = 2.0, ridge: float = 1.0, seed: int = 42
) -> Integration:
    """The model after ``rounds`` of ``inner`` assignments and a regression; ``history`` has the counts (cluster, batch) of each.

    Starting centres come from at most ``FIT_ROWS`` rows in the order of a
    hash; all rows take part in every sum. Clusters, batches and dimensions
    bound what reaches the driver.
    """
    rows, names = _coded(df, vec, batch)
    sizes = {r["b"]: r["count"] for r in rows.groupBy("b").count().collect()}
    drawn = np.array([r["v"] for r in rows.orderBy(F.xxhash64("v", F.lit(seed)), "b").limit(FIT_ROWS).select("v").collect()], float)
    if not len(drawn):
        raise ValueError("no rows")
    rng, unit = np.random.default_rng(seed), _unit(drawn)
    clusters = min(clusters, len(unit))
    centres = unit[rng.choice(len(unit), clusters, replace=False)]
    for _ in range(10):
        home = (unit @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, unit)
        centres = np.where((total != 0).any(axis=1, keepdims=True), _unit(total), centres)
    n = np.array([sizes.get(b, 0) for b in range(len(names))], float)
    shares, shape = n / n.sum(), (clusters, len(names), drawn.shape[1])
    model = Integration(names, shares, centres, np.outer(np.full(clusters, n.sum() / clusters), shares), np.zeros(shape), width, penalty)
    for _ in range(rounds):
        # assign the corrected rows, and move the centres
        fixed = model
        for _ in range(inner):
            counts, total = _gather(rows, _sums(model, fixed, True), shape)
            # halfway to the new counts: all rows turn at once, and would turn back at once
            model = Integration(names, shares, _unit(total.sum(axis=1)), (model.counts + counts) / 2, model.offsets, width, penalty, model.history)
        model.history = [*model.history, counts]
        # regress the original rows on their batches within each cluster
        counts, total = _gather(rows, _sums(model, model, False), shape)
        offsets = np.zeros(shape)
        for k in range(clusters):
            left = np.zeros((len(names) + 1,) * 2)
            left[0, 0], left[0, 1:], left[1:, 0] = counts[k].sum(), counts[k], counts[k]
            left[1:, 1:] = np.diag(counts[k] + ridge)
            right = np.concatenate((total[k].sum(axis=0)[None], total[k]))
            offsets[k] = np.linalg.lstsq(left, right, rcond=None)[0][1:]
        model = Integration(names, shares, model.centres, model.counts, offsets, width, penalty, model.history)
    return model


def _coded(df: DataFrame, vec: str, batch: str) -> tuple[DataFrame, list]:
    """Vectors (v) and batch codes (b); rows without a vector go, those without a batch are a batch."""
    names = [r[0] for r in df.select(batch).distinct().orderBy(F.col(batch).asc_nulls_last()).collect()]
    code = F.lit(len(names) - 1)
    for i, name in enumerate(names):
        code = F.when(F.col(batch).eqNullSafe(F.lit(name)), i).otherwise(code)
    return df.where(F.col(vec).isNotNull()).select(F.transform(vec, lambda e: e.cast("double")).alias("v"), code.cast("int").alias("b")), names


def integrate(df: DataFrame, vec: str, batch: str, out: str = "integrated", model: Integration | None = None, **settings) -> DataFrame:
    """``df`` with the corrected vector; a null vector stays null. Rows of a batch that the model doesn't know stay as they are."""
    model = model or fit_integration(df, vec, batch, **settings)

    @F.pandas_udf("array<double>")
    def moved(v: pd.Series, b: pd.Series) -> pd.Series:
        res = pd.Series([None] * len(v), dtype=object)
        some = np.flatnonzero(v.notna().to_numpy())
        if len(some):
            x, of = np.stack(v.iloc[some].to_numpy()).astype(float), b.iloc[some].to_numpy(dtype=np.int64)
            known = of >= 0
            if known.any():
                x[known] = model.corrected(x[known], of[known], model.soft(x[known], of[known]))
            for i, row in zip(some, x):
                res.iloc[i] = row
        return res

    code = F.lit(-1)
    for i, name in enumerate(model.batches):
        code = F.when(F.col(batch).eqNullSafe(F.lit(name)), i).otherwise(code)
    return df.withColumn(out, moved(F.transform(vec, lambda e: e.cast("double")), code))


def batch_gap(df: DataFrame, vec: str, batch: str) -> DataFrame:
    """One row: the share of the variance of the vectors that lies between the batches (``gap``)."""
    long = df.where(F.col(vec).isNotNull()).select(F.col(batch).alias("b"), F.posexplode(vec).alias("i", "x"))
    per = long.groupBy("b", "i").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    dims = per.groupBy("i").agg(F.sum(F.col("n") * F.col("s")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) ** 2 / F.sum("n")).alias("between"))
    return dims.agg((F.sum("between") / (F.sum("between") + F.sum("within"))).alias("gap"))
