"""Self-organising maps: sums against numpy, order on the grid, clusters that are there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import models as ML
from cellgauge.operators.maps import _moments, _nearest, _sums, _ward, consensus_clusters, fit_map, map_clusters
from pyspark.ml.functions import vector_to_array


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0, 0], [8, 0, 0], [0, 8, 0], [8, 8, 4]])
    y = rng.choice(4, 800, p=[0.6, 0.2, 0.15, 0.05])
    x = centres[y] + rng.normal(size=(800, 3))
    df = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x))], "id bigint, y int, m1 double, m2 double, m3 double")
    return ML.with_features(df.repartition(5), ["m1", "m2", "m3"]).cache(), x


def test_sums_equal_numpy(blobs):
    df, x = blobs
    rows = df.select(vector_to_array("features").alias("x"))
    mean, spread = _moments(rows)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(spread, np.cov(x.T, bias=True))
    nodes = x[:7]
    count, total = _sums(rows, nodes)
    home = _nearest(x, nodes)[:, 0]
    assert count.tolist() == np.bincount(home, minlength=7).tolist()
    assert np.allclose(total, [x[home == i].sum(axis=0) for i in range(7)])


def test_map_is_ordered_and_passes_help(blobs):
    df, x = blobs
    rough, fine = fit_map(df, 6, 6, passes=1), fit_map(df, 6, 6, passes=8)
    q = [m.errors(df).first() for m in (rough, fine)]
    assert q[1].quantisation < 0.8 * q[0].quantisation and q[1].topographic < 0.3
    near = _nearest(x, fine.nodes, 2)
    assert q[1].quantisation == pytest.approx(np.sqrt(((x - fine.nodes[near[:, 0]]) ** 2).sum(axis=1)).mean())
    apart = np.abs(fine.grid[near[:, 0]] - fine.grid[near[:, 1]]).max(axis=1) > 1
    assert q[1].topographic == pytest.approx(apart.mean()) and fine.sizes.sum() == 800
    again = fit_map(df.repartition(3), 6, 6, passes=8)
    assert np.allclose(again.nodes, fine.nodes)
    tree = fine.spanning_tree()
    assert len(tree) == 35 and {n for e in tree for n in e[:2]} == set(range(36))


def test_consensus_finds_the_clusters(blobs):
    df, _ = blobs
    out, found = map_clusters(df, 4, 7, 7, passes=8, repeats=20)
    table = out.groupBy("y", "cluster").count().collect()
    best = {}
    for r in table:
        best[r.y] = max(best.get(r.y, 0), r["count"])
    assert sum(best.values()) > 0.97 * 800 and out.select("cluster").distinct().count() == 4
    label, agree = consensus_clusters(found, 4, 20)
    assert len(label) == 49 and np.allclose(agree, agree.T) and np.allclose(np.diag(agree), 1)


def test_edges(spark, blobs):
    df, _ = blobs
    same = df.withColumn("features", df.select("features").where("id = 0").scalar())
    out, found = map_clusters(same, 3, 3, 3, passes=2, repeats=3)
    assert out.select("cluster").distinct().count() == 1 and found.errors(same).first().quantisation < 1e-9
    with pytest.raises(ValueError):
        fit_map(df.where("false"))
    assert _ward(np.array([[0.0], [1.0], [10.0], [11.0]]), np.ones(4), 2).tolist() == [0, 0, 1, 1]
