"""Searches by descent widen their lists until they find what they should."""

import numpy as np

from cellgauge.operators import descent as D


def test_narrow_lists_are_widened(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (600, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = {(i, int(j)) for i, row in enumerate(np.argsort(d, axis=1)[:, :5]) for j in row}
    found = {(r.src, r.dst) for r in D.knn_descent(df, "id", "v", 5, width=5, leaf=16, trees=1).collect()}
    assert len(found) == 3000 and len(found & near) >= 0.95 * len(near)


def test_vectors_travel_as_they_are(spark):
    """Floats stay floats, and points meet the neighbours of a vector at one place: no row has two vectors."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(0, 1, (40, 8)))], "id bigint, v array<float>")
    assert D.distinct_vectors(df, "id", "v", 3).schema["v"].dataType.simpleString() == "array<float>"
    x, y, worst = rng.normal(size=(30, 8)).astype(np.float32), rng.normal(size=(50, 8)).astype(np.float32), rng.uniform(2, 4, 30)
    asks = pa.array([[{"node": 100 + i, "worst": worst[i], "v": x[i].tolist()} for i in range(30)]], pa.list_(pa.struct([("node", pa.int64()), ("worst", pa.float64()), ("v", pa.list_(pa.float32()))])))
    offers = pa.array([[{"node": i, "v": y[i].tolist()} for i in range(50)]], pa.list_(pa.struct([("node", pa.int64()), ("v", pa.list_(pa.float32()))])))
    batch = pa.RecordBatch.from_arrays([asks, offers], ["asks", "offers"])
    got = {(r["src"], r["dst"], r["dist"]) for b in D._across(7)(iter([batch])) for r in b.to_pylist()}
    d = np.sqrt(((x[:, None].astype(float) - y[None]) ** 2).sum(axis=2))
    assert got == {(100 + i, int(j), d[i, j]) for i in range(30) for j in np.argsort(d[i])[:7] if d[i, j] < worst[i]}


def test_a_search_ends_when_it_has_found_enough(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(0, 1, (300, 16)))], "id bigint, v array<double>")
    nodes = D.distinct_vectors(df, "id", "v", 6)
    recall = D.Recall(nodes, nodes, 5, True)
    _, rounds = D.neighbour_graph(nodes, 30, enough=recall.enough())
    assert recall.of >= D.LEAST_RECALL and rounds[-1]["changed"] > 0.002 * rounds[-1]["entries"]
    assert D._forest(900, None, None) == (3, 64) and D._forest(10**6, None, None) == (8, D.LARGE_LEAF)
