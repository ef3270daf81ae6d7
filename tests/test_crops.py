import random

from cellgauge.operators.crops import smallest_mask_window

W, H = 23, 17


def brute(mask, cx, cy, m):
    """Side and ids of the smallest window around a centre, by trying all sides."""
    def held(side):
        half = side // 2
        return {i for (x, y), got in mask.items() for i in got if i and cx - half <= x < cx + half and cy - half <= y < cy + half}

    for side in range(1, min(W, H) + 1):
        if len(held(side)) >= m:
            return side, len(held(side))
    return min(W, H), len(held(min(W, H)))


def expected(mask, cx, cy, m):
    half = brute(mask, cx, cy, m)[0] // 2
    x, y = min(max(cx, half), W - half), min(max(cy, half), H - half)
    return (cx, cy, x, y, *brute(mask, x, y, m))


def test_equals_trying_all_sides(spark):
    rng = random.Random(3)
    images, rows = {}, []
    for s in range(4):
        mask = images[f"s{s}"] = {}
        for i in range(1, 14):
            x, y = rng.randrange(W), rng.randrange(H)
            # cells of many shapes, some in two far parts
            for _ in range(rng.choice((1, 3, 20))):
                mask.setdefault((min(max(x + rng.randrange(-2, 3), 0), W - 1), min(max(y + rng.randrange(-2, 3), 0), H - 1)), set()).add(i)
            if i % 5 == 0:
                mask.setdefault((W - 1 - x, H - 1 - y), set()).add(i)
        mask.setdefault((0, 0), set()).add(0)
        rows += [(f"s{s}", i, x, y) for (x, y), got in mask.items() for i in got]
    rows += [("s0", None, 3, 3), (None, 4, 3, 3), ("s0", 99, None, 1), *rows[:20]]
    pixels = spark.createDataFrame(rows, "sample string, cell int, x int, y int")
    spots = [(s, rng.randrange(W), rng.randrange(H)) for s in images for _ in range(6)]
    centres = spark.createDataFrame([*spots, spots[0], ("s1", None, 2), (None, 1, 1)], "sample string, cx int, cy int")
    for m in (1, 4, 9, 50):
        got = smallest_mask_window(pixels, centres, "sample", "cell", m, W, H).collect()
        assert sorted(tuple(r) for r in got) == sorted((s, *expected(images[s], x, y, m)) for s, x, y in set(spots))


def test_edges(spark):
    none = spark.createDataFrame([], "sample string, cell int, x int, y int")
    centre = spark.createDataFrame([("a", 2, 2)], "sample string, cx int, cy int")
    assert [tuple(r) for r in smallest_mask_window(none, centre, "sample", "cell", 3, 9, 5).collect()] == [("a", 2, 2, 2, 2, 5, 0)]
    assert smallest_mask_window(none, centre.limit(0), "sample", "cell", 3, 9, 5).count() == 0
