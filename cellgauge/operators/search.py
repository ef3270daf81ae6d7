"""Search for parameters on a log scale with successive halving.

Trials are drawn once, from a seed. The first rung fits all of them on a small
share of the training rows, the next one the best part of them on a larger
share, and the last the rest on all rows. Shares are nested: rows are taken in
the order of a hash, so what a trial saw on one rung it sees on the next.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.functions.exprs import order_hash
from cellgauge.operators.metrics import confusion_counts, label_metrics
from cellgauge.operators.models import predict, prepare
from cellgauge.session import stage

Params = dict[str, float]


def log_uniform(ranges: Mapping[str, tuple[float, float]], n: int, seed: int = 42) -> list[Params]:
    """``n`` draws whose logarithms are uniform between the ends of each range (both above zero)."""
    rng = np.random.default_rng(seed)
    ends = {k: (math.log(lo), math.log(hi)) for k, (lo, hi) in ranges.items()}
    return [{k: float(math.exp(rng.uniform(lo, hi))) for k, (lo, hi) in ends.items()} for _ in range(n)]


def rungs(trials: int, keep: float, share: float) -> list[tuple[int, float]]:
    """(trials, share of the rows) of each rung: the share grows as the trials fall, up to all rows."""
    out = [(trials, share)]
    while out[-1][1] < 1:
        n, s = out[-1]
        out.append((max(1, math.ceil(n * keep)), min(1.0, s / keep)))
    return out


def halving_search(
    train: DataFrame, validation: DataFrame, label: str, key: Sequence[str], fitter: Callable[[DataFrame, Params], Model],
    ranges: Mapping[str, tuple[float, float]], trials: int = 9, keep: float = 1 / 3, share: float = 1 / 9, metric: str = "macro_f1", seed: int = 42,
    parallelism: int = 2, balanced: bool = True,
) -> tuple[Params, DataFrame]:
    """The best parameters and the table of all fits: ``rung, trial, share, trained, score, place, survives`` and the parameters.

    ``fitter`` gets training rows with ``features``, ``code`` and ``weight``, and
    the parameters. A rung ranks its trials by ``metric`` on all validation
    rows, ties by number; the best ``keep`` of them survive to the next, one on
    the last. Validation rows whose label isn't in a share count as errors. The
    loop only starts Spark jobs.
    """
    spark, drawn = train.sparkSession, log_uniform(ranges, trials, seed)
    # a place between 0 and 1 by hash: a share of the rows is a filter, and the shares are nested
    place = F.conv(F.substring(order_hash(seed, *key), 1, 12), 16, 10).cast("double") / 16.0**12
    rows, held = stage(train.withColumn("_place", place), "search"), stage(validation, "held")
    alive, table = list(range(trials)), []
    steps = rungs(trials, keep, share)
    for r, (_, part) in enumerate(steps):
        fitted, codes = prepare(rows.where(F.col("_place") < part).drop("_place"), label, balanced)
        fitted = stage(fitted, "rung")
        n = fitted.count()

        def score(t: int) -> float:
            out = predict(fitter(fitted, drawn[t]), held, codes)
            counts = confusion_counts(out.withColumn("_t", F.lit(t)), ["_t"], true_col=label)
            return float(label_metrics(counts, ["_t"]).first()[metric])

        with ThreadPool(min(parallelism, len(alive))) as pool:
            scores = dict(zip(alive, pool.map(inheritable_thread_target(spark)(score), alive)))
        ranked = sorted(alive, key=lambda t: (-scores[t], t))
        left = ranked[: steps[r + 1][0] if r + 1 < len(steps) else 1]
        table += [(r, t, float(part), n, scores[t], p + 1, t in left, *drawn[t].values()) for p, t in enumerate(ranked)]
        alive = sorted(left)
    names = ", ".join(f"`{k}` double" for k in ranges)
    found = spark.createDataFrame(table, f"rung int, trial int, share double, trained bigint, score double, place int, survives boolean, {names}")
    return drawn[alive[0]], found
