"""A mixture of types with prior knowledge of their markers, and of pairs of types for merged rows.

A type's mean of each standardised marker has a prior: high where the decision
matrix says 1, low where it says -1, in between where it says nothing. Every
pair of types may have a component of its own, whose mean is that of the pair:
rows measured from two touching objects. Expectation is a projection of the
rows; what maximisation needs are sums per component (rows, marker sums,
squares), one aggregate per round whose size doesn't depend on the rows. The
penalised likelihood never falls from round to round.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.operators.signatures import UNDEFINED
from cellgauge.operators.transforms import zscore

#: prior mean of a standardised marker by the entry of the matrix
EXPECTED = {1.0: 1.0, -1.0: -1.0}


@dataclass
class MarkerMixture:
    """``means`` (type, marker) and ``variance`` (marker); ``parts`` (component, type) says how components mix the types' means."""

    types: list[str]
    markers: list[str]
    prior: np.ndarray
    parts: np.ndarray
    means: np.ndarray
    variance: np.ndarray
    shares: np.ndarray
    strength: float
    objective: list[float] = field(default_factory=list)

    @property
    def singles(self) -> int:
        return len(self.types)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log density of each row and component, with the component's share; a missing marker says nothing."""
        seen = ~np.isnan(x)
        filled, inverse = np.where(seen, x, 0.0), 1 / self.variance
        centre = self.parts @ self.means
        square = (filled**2 * seen) @ inverse[:, None] - 2 * (filled * inverse) @ centre.T + (seen * inverse) @ (centre**2).T
        return np.log(self.shares) - 0.5 * (square + (seen @ np.log(2 * np.pi * self.variance))[:, None])

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logs = self.logs(x)
        top = logs.max(axis=1)
        p = np.exp(logs - top[:, None])
        total = p.sum(axis=1)
        return p / total[:, None], top + np.log(total)

    def penalty(self) -> float:
        return -0.5 * self.strength * float(((self.means - self.prior) ** 2).sum())

    def sums(self):
        """Per task: likelihood and rows, and per component the rows, and per marker rows, sum and squares of it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, m = len(self.parts), len(self.markers)
            out, like = np.zeros((c, 1 + 3 * m)), np.zeros(2)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch, m)
                    r, log = self.responsibilities(x)
                    seen = ~np.isnan(x)
                    filled = np.where(seen, x, 0.0)
                    out += np.concatenate((r.sum(axis=0)[:, None], r.T @ seen, r.T @ filled, r.T @ filled**2), axis=1)
                    like += log.sum(), len(x)
            cells = np.concatenate((like, out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["at", "v"])

        return run

    def learn(self, flat: np.ndarray) -> None:
        """Means for the given variances, then variances for these means, then shares."""
        m = len(self.markers)
        table = flat.reshape(len(self.parts), 1 + 3 * m)
        n, count, total, square = table[:, 0], *(table[:, 1 + i * m: 1 + (i + 1) * m] for i in range(3))
        for j in range(m):
            # normal equations of all components at once, with the prior
            left = self.parts.T @ (count[:, j, None] * self.parts) / self.variance[j] + self.strength * np.eye(self.singles)
            right = self.parts.T @ total[:, j] / self.variance[j] + self.strength * self.prior[:, j]
            self.means[:, j] = np.linalg.solve(left, right)
        centre = self.parts @ self.means
        spread = (square - 2 * centre * total + centre**2 * count).sum(axis=0)
        self.variance = np.maximum(spread / np.maximum(count.sum(axis=0), 1e-300), 1e-6)
        self.shares = np.maximum(n / n.sum(), 1e-12)

    def predict(self, df: DataFrame, least: float = 0.5, out: str = "predicted_phenotype") -> DataFrame:
        """Add the label, its probability (``confidence``), that of a merged row (``doublet``), and all responsibilities.

        The label is the likeliest type if the row is no likelier a merged one
        and the probability is ``least`` at least; else ``undefined``.
        """
        model, single = self, self.singles

        @F.pandas_udf("array<double>")
        def share(v: pd.Series) -> pd.Series:
            x = np.array([[np.nan if e is None else e for e in row] for row in v], float).reshape(len(v), -1)
            return pd.Series(list(model.responsibilities(x)[0])) if len(v) else pd.Series([], dtype=object)

        own = F.slice("responsibilities", 1, single)
        top = F.array_max(own)
        names = F.array(*map(F.lit, self.types))
        rows = zscore(df, self.markers, suffix="_z").withColumn("responsibilities", share(_vector(self.markers)))
        doublet = F.lit(1.0) - F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
        label = F.when((top >= least) & (top >= doublet), names[(F.array_position(own, top) - 1).cast("int")]).otherwise(UNDEFINED)
        return rows.select(*df.columns, label.alias(out), top.alias("confidence"), F.greatest(doublet, F.lit(0.0)).alias("doublet"), "responsibilities")


def _vector(markers: Sequence[str]):
    return F.array(*(F.col(f"{m}_z") for m in markers))


def _matrix(batch: pa.RecordBatch, m: int) -> np.ndarray:
    return np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(-1, m)


def fit_marker_mixture(
    df: DataFrame, matrix: Mapping[str, Mapping[str, float]], rounds: int = 15, strength: float = 10.0, doublets: bool = True, singlet_share: float = 0.9, tol: float = 0.0
) -> MarkerMixture:
    """The mixture fitted by ``rounds`` passes over all rows; ``objective`` has the penalised log likelihood before each and after the last.

    ``strength`` weighs the prior means like so many rows of variance 1. Null
    markers say nothing. The fit ends early when the objective rises by at
    most the share ``tol``. Markers that aren't columns are ignored.
    """
    markers = sorted({m for w in matrix.values() for m in w if m in df.columns})
    types = sorted(t for t in matrix if t not in ("Others", "Other"))
    prior = np.array([[EXPECTED.get(float(matrix[t][m] or 0), 0.0) if m in matrix[t] else 0.0 for m in markers] for t in types])
    pairs = list(combinations(range(len(types)), 2)) if doublets else []
    parts = np.concatenate((np.eye(len(types)), np.array([[0.5 * (i in p) for i in range(len(types))] for p in pairs]).reshape(len(pairs), len(types))))
    shares = np.array([singlet_share / len(types)] * len(types) + [(1 - singlet_share) / max(1, len(pairs))] * len(pairs))
    model = MarkerMixture(types, markers, prior, parts, prior.copy(), np.ones(len(markers)), shares / shares.sum(), strength)
    rows = zscore(df, markers, suffix="_z").select(_vector(markers).alias("x"))
    for r in range(rounds + 1):
        found = rows.mapInArrow(model.sums(), "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()  # components times markers
        flat = np.array([row["v"] for row in found])
        if not len(flat) or not flat[1]:
            raise ValueError("no rows")
        model.objective.append(float(flat[0]) + model.penalty())
        gain = model.objective[-1] - model.objective[-2] if r else np.inf
        if r == rounds or gain <= tol * abs(model.objective[-1]):
            break
        model.learn(flat[2:])
    return model
