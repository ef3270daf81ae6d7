"""Neighbour descent against the exact search, communities against planted ones and small optima."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import modularity as Q
from cellgauge.operators.descent import distinct_vectors, knn_descent, knn_search, neighbour_graph
from cellgauge.operators.vectors import knn_vectors


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], "id bigint, v array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    return rng.normal(size=(12, 24))[rng.integers(0, 12, 900)] * 1.5 + rng.normal(size=(900, 24))


def lists(df):
    out = {}
    for r in df.orderBy("src", "rank").collect():
        out.setdefault(r.src, []).append((r.dst, r.dist))
    return out


def test_descent_recall_and_bounded_rounds(spark, cloud):
    df = vectors(spark, cloud)
    got, want = lists(knn_descent(df, "id", "v", 10)), lists(knn_vectors(df, df, "id", "v", 10))
    assert all(len(l) == 10 and [d for _, d in l] == sorted(d for _, d in l) for l in got.values()) and len(got) == 900
    assert sum(len({d for d, _ in got[i]} & {d for d, _ in want[i]}) for i in want) >= 0.95 * 9000
    for i, l in list(got.items())[:50]:
        assert np.allclose([d for _, d in l], [np.linalg.norm(cloud[i] - cloud[j]) for j, _ in l])
    graph, rounds = neighbour_graph(distinct_vectors(df, "id", "v", 11), 20)
    assert graph.groupBy("src").count().agg(F.max("count")).first()[0] <= 20
    assert rounds[-1]["changed"] < rounds[0]["changed"] and len(rounds) < 12


def test_descent_with_copies_and_few_rows(spark, cloud):
    x = np.concatenate((cloud[:150], np.repeat(cloud[:1], 200, axis=0)))
    df = vectors(spark, x)
    got, want = lists(knn_descent(df, "id", "v", 5)), lists(knn_vectors(df, df, "id", "v", 5))
    assert all(got[i] == want[i] for i in [0, *range(150, 350)])  # copies are each other's neighbours, the least ids first
    assert knn_descent(df.where("id < 0"), "id", "v", 5).count() == 0 and knn_descent(df.where("id = 3"), "id", "v", 5).count() == 0
    assert {s: [d for d, _ in l] for s, l in lists(knn_descent(df.where("id in (150, 151)"), "id", "v", 5)).items()} == {150: [151], 151: [150]}
    assert knn_descent(df.withColumn("v", F.when(F.col("id") > 9, F.col("v"))).where("id < 12"), "id", "v", 5).select("src").distinct().count() == 2


def test_search_between_tables(spark, cloud):
    base, queries = vectors(spark, cloud[:700]), vectors(spark, cloud[700:], 700)
    got, want = lists(knn_search(queries, base, "id", "v", 5)), lists(knn_vectors(queries, base, "id", "v", 5, same_table=False))
    assert len(got) == 200 and sum(len({d for d, _ in got[i]} & {d for d, _ in want[i]}) for i in want) >= 0.95 * 1000
    far = vectors(spark, [[1000.0] * 24], 5000)
    assert len(lists(knn_search(far, base, "id", "v", 5))[5000]) == 5
    assert knn_search(queries, base.where("id < 0"), "id", "v", 5).count() == 0


def graph(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "a bigint, b bigint, weight double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.community, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def quality(edges, parts, resolution=1.0):
    """Modularity from the definition."""
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, x in edges:
        w[at[a], at[b]] += x
        w[at[b], at[a]] += x
    home = {n: c for c, p in enumerate(parts) for n in p}
    same = np.array([[home[a] == home[b] for b in nodes] for a in nodes])
    k = w.sum(axis=1)
    return ((w - resolution * np.outer(k, k) / k.sum()) * same).sum() / k.sum()


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i, p in enumerate(rest):
            yield [*rest[:i], [items[0], *p], *rest[i + 1:]]


def test_ring_of_cliques(spark):
    edges = [(10 * c + i, 10 * c + j, 1) for c in range(8) for i, j in itertools.combinations(range(5), 2)] + [(10 * c, 10 * ((c + 1) % 8) + 1, 1) for c in range(8)]
    found = Q.leiden(graph(spark, edges)).cache()
    parts, best = groups(found), [[10 * c + i for i in range(5)] for c in range(8)]
    assert all(any(set(b) <= set(p) for p in parts) for b in best)  # no clique is cut
    assert all(r.community == min(p) for p in parts for r in found.where(F.col("id").isin(p)).collect())
    assert Q.modularity(graph(spark, edges), found).first()[0] == pytest.approx(quality(edges, parts))
    assert quality(edges, parts) >= 0.97 * quality(edges, best)


def test_small_graph_near_its_optimum(spark):
    rng = np.random.default_rng(4)
    edges = [(i, j, round(float(rng.uniform(0.5, 2)), 3)) for i, j in itertools.combinations(range(9), 2) if rng.random() < (0.8 if i // 3 == j // 3 else 0.2)] + [(2, 2, 0.5)]
    best = max(quality(edges, p) for p in partitions(sorted({n for a, b, _ in edges for n in (a, b)})))
    assert quality(edges, groups(Q.leiden(graph(spark, edges)))) >= 0.85 * best


def test_resolution_and_odd_edges(spark):
    edges = [(i, j, 1) for i, j in itertools.combinations(range(6), 2)]
    assert groups(Q.leiden(graph(spark, edges))) == [list(range(6))]
    assert len(groups(Q.leiden(graph(spark, edges), resolution=3.0))) > 1
    odd = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (None, 1, 1.0), (3, 4, 0.0), (5, 6, -1.0), (7, 8, None)], "a bigint, b bigint, weight double")
    assert groups(Q.leiden(odd)) == [[1, 2]]
    assert Q.leiden(odd.where("false")).count() == 0


def test_parts_are_split_where_nothing_holds_them(spark):
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2), (4, 5), (5, 4), (3, 4), (4, 3)], "id bigint, nb bigint")
    nodes = spark.createDataFrame([(1, 7), (2, 7), (3, 9), (4, 7), (5, 7), (6, 7)], "id bigint, community bigint")
    assert groups(Q.connected_parts(links, nodes)) == [[1, 2], [3], [4, 5], [6]]


@pytest.mark.parametrize("spread", [1.0, 1e-9])
def test_wide_neighbourhoods_take_little_memory(spread):
    """400 vectors that meet, some of them nearly or wholly equal: each is offered its nearest, and not all differences stand at once."""
    import tracemalloc

    import pyarrow as pa

    from cellgauge.operators import descent as D

    rng, n = np.random.default_rng(5), 400
    x = rng.normal(size=(n, 64))
    x[-20:] = x[0] + spread * rng.normal(size=(20, 64))
    fresh, worst = rng.random(n) < 0.5, np.where(rng.random(n) < 0.5, np.inf, 10.0)
    rows = [[{"member": i, "fresh": bool(fresh[i]), "worst": worst[i], "v": x[i].tolist()} for i in range(n)]]
    kind = pa.list_(pa.struct([("member", pa.int64()), ("fresh", pa.bool_()), ("worst", pa.float64()), ("v", pa.list_(pa.float64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array(rows, kind)], ["rows"])
    tracemalloc.start()
    found = [(r["src"], r["dst"], r["dist"]) for b in D._meet(iter([batch])) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = D._distances(x, x)
    d[~(fresh[:, None] | fresh[None, :]) | (d >= worst[:, None]) | np.eye(n, dtype=bool)] = np.inf
    near = np.argsort(d, axis=1, kind="stable")[:, : D.OFFERS]
    assert sorted(found) == sorted((i, int(j), d[i, j]) for i in range(n) for j in near[i] if np.isfinite(d[i, j]))
    assert spread < 1 or most < 60e6
