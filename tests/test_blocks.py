"""Blocks of the exact search of vectors: wide, of the type the table has, and met in tiles."""

import numpy as np

from cellgauge.operators import vectors as V


def test_wide_blocks_of_floats(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (1300, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<float>")
    # what pairs of blocks shuffle falls with their number and with the width of a component
    blocks = V._pack(df, "id", "v", x[:1].astype(float), V.BLOCK_ROWS, "blocks")
    assert blocks.count() == 1 and dict(blocks.dtypes)["flat"] == "array<float>"
    got = {}
    for r in V.knn_vectors(df, df, "id", "v", 3).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    d = np.sqrt(((x.astype(float)[:, None] - x.astype(float)[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got == {i: row.tolist() for i, row in enumerate(np.argsort(d, axis=1, kind="stable")[:, :3])}
