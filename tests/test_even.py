"""Fits go over rows on all cores, also where the table came in one partition."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.tuning import CrossValidator

from cellgauge.operators import boosting as B
from cellgauge.operators import models as ML


class Seen(Exception):
    pass


@pytest.fixture
def one(spark):
    rows = [(i, i % 2, float(i >= 32), 1.0, float(i), float(i * i % 7)) for i in range(64)]
    df = spark.createDataFrame(rows, "id int, fold int, code double, weight double, a double, b double").coalesce(1)
    return ML.with_features(df, ["a", "b"])


def test_fits_use_all_cores(spark, one, monkeypatch):
    def fit(self, rows, *_):
        raise Seen(rows.rdd.getNumPartitions(), rows.count())

    cores = spark.sparkContext.defaultParallelism
    for kind, run in ((GaussianMixture, lambda: ML.mixture_clusters(one, 2)), (CrossValidator, lambda: ML.grid_search(one, ML.logistic_regression(), {"regParam": [0.0]}))):
        monkeypatch.setattr(kind, "fit", fit)
        with pytest.raises(Seen) as seen:
            run()
        assert seen.value.args == (cores, 64)


def test_boosting_writes_a_part_per_core(spark, one, monkeypatch):
    parts = []
    written = B.SoftmaxTrees._written
    monkeypatch.setattr(B.SoftmaxTrees, "_written", staticmethod(lambda df: parts.append(df.rdd.getNumPartitions()) or written(df)))
    model = B.SoftmaxTrees(rounds=2, depth=2).fit(one)
    assert parts[0] == spark.sparkContext.defaultParallelism and len(model.losses) == 3


def test_binary_columns_as_arrays():
    for kind in (np.uint8, np.float64):
        values = np.arange(12).reshape(4, 3).astype(kind)
        column = B._rows(values)
        assert column.to_pylist() == [v.tobytes() for v in values]
        for part in (column, column.slice(1, 2), column.slice(4), column.cast(pa.large_binary())):
            assert (B._flat(part, kind).tobytes()) == b"".join(part.to_pylist())
