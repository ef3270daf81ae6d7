import math
import random

import numpy as np
import pytest

from cellgauge.llm import negatives as M
from cellgauge.llm.negatives import hard_negatives, products

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, cluster string, v string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "a", "c", "v", "s") for i, v, y in rows], SCHEMA)


def brute(rows, anchors, k=5, m=5, share=80):
    part = sorted({(i, y, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, y in rows
                   if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, y, v in part:
        if i not in anchors:
            continue
        ranked = sorted((-dot(v, w), j, z) for j, z, w in part if j != i)
        for s, j, _ in [r for r in ranked if r[2] == y][:k]:
            fits = [r for r in ranked if r[2] != y and share * -s <= 100 * -r[0] <= 100 * -s][:m]
            out += [(i, j, n, r[1], -s, -r[0]) for n, r in enumerate(fits, 1)]
    return sorted(out)


def mined(df, anchors):
    return sorted(tuple(r) for r in hard_negatives(df, anchors).collect())


def cloud(n, dims, seed, labels=3, copies=0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(labels, dims))
    y = rng.integers(0, labels, n)
    x = middles[y] + rng.normal(size=(n, dims))
    rows = [(int(i), [float(c) for c in v], int(l)) for i, v, l in zip(rng.permutation(3 * n)[:n], x, y)]
    same = rows[0][1]
    return rows + [(10_000 + i, same, i % 2) for i in range(copies)]


@pytest.mark.parametrize("seed,copies", [(1, 0), (2, 300)])
def test_equals_brute_force(spark, monkeypatch, seed, copies):
    # short bands and many clusters, so that anchors walk several rounds
    monkeypatch.setattr(M, "HEAD", 40)
    monkeypatch.setattr(M, "PART", 8)
    rows = cloud(600, 8, seed, copies=copies)
    df = table(spark, rows)
    wanted = {i for i, _, _ in rows if i % 4 == 0}
    got = mined(df.repartition(5), df.filter("vec_id % 4 = 0").select("vec_id"))
    assert len(got) > 1000 and got == brute(rows, wanted)


def test_walks_stop_early(spark, monkeypatch):
    seen = []
    whole = M._band
    monkeypatch.setattr(M, "_band", lambda lists, dims, low, high: seen.append(int((lists.counts * ((np.arange(M.BINS) >= low[:, None]) & (np.arange(M.BINS) < high[:, None]))).sum())) or whole(lists, dims, low, high))
    monkeypatch.setattr(M, "HEAD", 100)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 16)) * 3
    rows = [(i, (middles[i % 40] + rng.normal(size=16) * 0.1).tolist(), int(i % 80 // 40)) for i in range(4000)]
    df = table(spark, rows)
    wanted = {i for i, _, _ in rows if i % 100 == 0}
    assert mined(df, df.filter("vec_id % 100 = 0").select("vec_id")) == brute(rows, wanted)
    assert sum(seen) < 2 * len(rows)  # both walks of the one cluster together


def test_edges(spark):
    rng = random.Random(4)
    few = [[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(60)]
    rows = [(i, v, i % 3) for i, v in enumerate(few)]
    odd = [(None, [1.0, 1.0, 1.0], 1), (100, None, 1), (101, [1.0, None, 1.0], 1), (102, [float("nan"), 0.0, 0.0], 0), (103, [float("inf"), 0.0, 0.0], 0), (104, [1.0, 0.0, 1.0], None), (105, [], 2), (106, [1.0], 0), (106, [1.0], 0), (107, [-0.0, 0.0, 0.0], 1)]
    df = table(spark, rows + odd)
    assert mined(df, df.select("vec_id")) == brute(rows + odd, set(range(200)))
    none = df.filter("vec_id < 0")
    assert mined(none, df.select("vec_id")) == [] and mined(df, none.select("vec_id")) == []
    # one label only: positives without negatives
    assert mined(df.filter("label = 1"), df.select("vec_id")) == []


def test_products_are_exact():
    big = np.array([[2.0**52, 3.0], [1e30, -1e30]])
    assert products(big[:1], np.array([[5.0, 1.0]])).tolist() == [[5 * 2**52 + 3]]
    assert products(big[1:], np.array([[1.0, 0.0], [1.0, 1.0]])).tolist() == [[2**63 - 1, 0]]
