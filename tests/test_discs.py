"""Disc sums against brute force, in tiles of any size, with lattices, dense spots and values that aren't finite."""

import math

import numpy as np
import pytest

from cellgauge.operators.discs import disc_sums, sums_around


@pytest.mark.parametrize("n, span, whole", [(1, 1, False), (300, 10, False), (2000, 100, False), (2000, 40, True), (50, 1e6, False)])
def test_disc_sums(n, span, whole):
    rng = np.random.default_rng(n)
    x, y = rng.uniform(-span, span, (2, n))
    if whole:
        x, y = np.floor(x), np.floor(y)  # many locations exactly on a rim
    values = rng.integers(-9, 99, (n, 2))
    inside = (x - x[:, None]) ** 2 + (y - y[:, None]) ** 2 <= 25.0
    assert (disc_sums(x, y, values, x, y, 5.0) == inside @ values).all()


@pytest.mark.parametrize("tile_rows", [5, 40, 20_000])
def test_sums_around(spark, tile_rows):
    rng = np.random.default_rng(3)
    at = [(s, float(x), float(y)) for s, n in (("a", 200), ("b", 3)) for x, y in rng.integers(-40, 40, (n, 2))]
    at = sorted({*at, *(("a", 5.0 + i / 1000, 7.0) for i in range(120))})  # a dense spot
    odd = {3: math.nan, 60: math.inf, 61: -math.inf, 90: None}
    rows = [(*p, i, odd.get(i, i / 4)) for i, p in enumerate(at)] + [("a", math.nan, 1.0, 1, 1.0), ("a", None, 1.0, 1, 1.0)]
    got = {r[:3]: r[3:] for r in sums_around(spark.createDataFrame(rows, "_s string, _x double, _y double, k bigint, v double"), 9.0, ["k", "v"], tile_rows).collect()}
    assert set(got) == set(at)
    for s, x, y in at:
        near = [r for r in rows[: len(at)] if r[0] == s and (r[1] - x) ** 2 + (r[2] - y) ** 2 <= 81]
        seen = [r[4] for r in near if r[4] is not None]
        k, v = got[s, x, y]
        assert k == sum(r[3] for r in near)
        assert v is None if not seen else v == pytest.approx(sum(seen), nan_ok=True)
