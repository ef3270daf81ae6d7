"""Neighbour searches against brute force, with copies and dense spots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgauge.operators import spatial as S
from cellgauge.operators import vectors as V


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for s, n in (("a", 400), ("b", 3), ("c", 1)):
        for x, y in rng.uniform(-300, 300, (n, 2)):
            rows.append((i, s, float(x), float(y)))
            i += 1
    rows += [(i + j, "a", 10.0, 20.0) for j in range(200)]  # copies of one position
    i += 200
    rows += [(i + j, "a", float(50 + dx), float(60 + dy)) for j, (dx, dy) in enumerate(rng.normal(0, 0.01, (200, 2)))]
    return rows


def brute(queries, base, k=None, d=None, same=True):
    out = {}
    for i, s, x, y in queries:
        near = sorted(((bx - x) ** 2 + (by - y) ** 2, j) for j, bs, bx, by in base if bs == s and not (same and i == j))
        out[i] = [j for d2, j in near if d2 <= d * d] if d is not None else [j for _, j in near[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, s string, x double, y double")


@pytest.mark.parametrize("k", [1, 10])
def test_knn_points(spark, points, k):
    df = frame(spark, points)
    got = {}
    for r in S.knn_points(df, df, "s", "id", k).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    want = {i: n for i, n in brute(points, points, k=k).items() if n}
    assert got == want


def test_knn_points_between_tables(spark, points):
    base, queries = points[::2], points[1::2]
    got = {}
    for r in S.knn_points(frame(spark, queries), frame(spark, base), "s", "id", 5, same_table=False).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    assert got == {i: n for i, n in brute(queries, base, k=5, same=False).items() if n}


@pytest.mark.parametrize("cell_rows", [7, 2000])
def test_radius_pairs(spark, points, cell_rows):
    got = {}
    for r in S.radius_pairs(frame(spark, points), "s", "id", 25.0, cell_rows=cell_rows).collect():
        got.setdefault(r.src, []).append(r.dst)
    want = {i: sorted(n) for i, n in brute(points, points, d=25.0).items() if n}
    assert {i: sorted(n) for i, n in got.items()} == want


@pytest.mark.parametrize("cell_rows", [3, 2000])
def test_composition_and_means(spark, points, cell_rows):
    df = frame(spark, points).withColumn("lb", F.when(F.col("id") % 3 == 0, "p").otherwise("q")).withColumn("m", F.col("id") * 1.0)
    near = brute(points, points, d=25.0)
    shares = {r.id: r for r in S.neighbourhood_composition(df, "s", "id", "lb", 25.0, ["p", "q"], cell_rows=cell_rows).collect()}
    means = {r.id: r for r in S.neighbour_means(df, "s", "id", ["m"], 25.0, cell_rows=cell_rows).collect()}
    for i, n in near.items():
        assert shares[i].n_neighbours == means[i].n_neighbours == len(n)
        if n:
            assert shares[i].share_p == pytest.approx(sum(j % 3 == 0 for j in n) / len(n))
            assert means[i].nb_m == pytest.approx(sum(n) / len(n))
        else:
            assert shares[i].share_p is None and means[i].nb_m is None


@pytest.mark.parametrize("same", [True, False])
def test_knn_vectors(spark, same):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1, (150, 6)), np.repeat(rng.normal(0, 1, (1, 6)), 120, axis=0), rng.normal(9, 0.1, (60, 6))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    base = df if same else df.where("id % 3 = 0")
    ids = np.arange(len(x)) if same else np.arange(0, len(x), 3)
    got = {}
    out = V.knn_vectors(df, base, "id", "v", 7, same_table=same, max_pivots=8, block_rows=32)
    for r in out.orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r.dst, r.dist))
    for i in range(len(x)):
        d = np.sqrt(((x[ids] - x[i]) ** 2).sum(axis=1))
        near = sorted((d[p], int(j)) for p, j in enumerate(ids) if not (same and j == i))[:7]
        assert [j for j, _ in got[i]] == [j for _, j in near]
        assert [d for _, d in got[i]] == pytest.approx([d for d, _ in near])


def test_communities_find_cliques(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.2, (40, 4)) for c in (0, 10, 20)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    got = {r.id: r.community for r in V.communities(df, "id", "v", k=8, rounds=8).collect()}
    assert len(got) == 120
    # no community spans two groups
    groups = {}
    for i, c in got.items():
        groups.setdefault(c, set()).add(i // 40)
    assert all(len(g) == 1 for g in groups.values())


@pytest.mark.parametrize("kind", ["plain", "offset", "huge", "whole numbers"])
def test_nearest_by_products(kind):
    """Whatever the numbers, the nearest are those of the differences, ties by id."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12))
    x = {"plain": x, "offset": x + 1e4, "huge": x * 1e40, "whole numbers": np.round(x)}[kind]
    ids = rng.permutation(400)
    with np.errstate(all="ignore"):
        rows, cols, dist = V._nearest(ids, x, ids, x, 5, True)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    d[np.eye(400, dtype=bool) | ~np.isfinite(d)] = np.inf
    want = [(i, j) for i in range(400) for j in np.lexsort((ids, d[i]))[:5] if np.isfinite(d[i, j])]
    assert list(zip(rows.tolist(), cols.tolist())) == want and np.array_equal(dist, [d[i, j] for i, j in want])


def test_a_tile_of_the_exact_search_takes_little_memory():
    """512 queries and a full block: products are floats, and not several tables of doubles."""
    import tracemalloc

    x = np.random.default_rng(4).normal(size=(V.BLOCK_ROWS, 16))
    tracemalloc.start()
    V._nearest(np.arange(V.TILE), x[: V.TILE], np.arange(len(x)), x, 10, True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6
