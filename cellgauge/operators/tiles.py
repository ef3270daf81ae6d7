"""Nearest neighbours in the plane, searched tile by tile.

A sample is cut into squares, each again into sixteen while it holds too many
points. A square answers its own locations first; that bounds the distance of
the last neighbour, and only locations whose circle leaves the square visit
the squares it touches.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.session import spread, stage

#: points of one square; fuller ones are cut again
SQUARE_ROWS = 4_096
#: a square of this level is not cut further
DEEPEST = 44
#: pairs of a location and a point that are measured at once
BLOCK = 2_000_000


def nearest(qx: np.ndarray, qy: np.ndarray, limit: np.ndarray, x: np.ndarray, y: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, squared distance) of the first ``need`` points within ``limit`` (squared), by distance and place in the arrays."""
    found = []
    step = max(1, BLOCK // max(1, len(x)))
    for a in range(0, len(qx) if len(x) else 0, step):
        dx, dy = qx[a: a + step, None] - x, qy[a: a + step, None] - y
        d2 = dx * dx + dy * dy
        last = limit[a: a + step]
        if len(x) > need:
            last = np.minimum(last, np.partition(d2, need - 1, axis=1)[:, need - 1])
        q, p = np.nonzero(d2 <= last[:, None])
        d = d2[q, p]
        order = np.lexsort((p, d, q))
        q, p, d = q[order], p[order], d[order]
        begin = np.searchsorted(q, q)
        first = np.arange(len(q)) - begin < need
        found.append((q[first] + a, p[first], d[first]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(f) for f in zip(*found))


def _lists(n: int, q: np.ndarray, d: np.ndarray, keys: pa.Array) -> pa.Array:
    """One list of (d2, dst) per query."""
    offsets = np.searchsorted(q, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(d), keys], names=["d2", "dst"]))


def _points(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Positions and keys of the points of a square, in the order of keys."""
    base = table.filter(pc.equal(table.column("_kind"), 0)).combine_chunks()
    base = base.take(pc.sort_indices(base.column("_dst")))
    keys = base.column("_dst")
    return base.column("_x").to_numpy(), base.column("_y").to_numpy(), keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys


def _own(need: int, same: bool):
    names = ["_s", "_l", "_cx", "_cy"]

    def run(table: pa.Table) -> pa.Table:
        x, y, keys = _points(table)
        kind = table.column("_kind").to_numpy()
        ask = kind == (0 if same else 1)
        at = np.unique(np.stack((table.column("_x").to_numpy()[ask], table.column("_y").to_numpy()[ask]), axis=1) + 0.0, axis=0)
        qx, qy = np.ascontiguousarray(at[:, 0]), np.ascontiguousarray(at[:, 1])
        q, p, d = nearest(qx, qy, np.full(len(qx), np.inf), x, y, need)
        begin = np.searchsorted(q, np.arange(len(qx) + 1))
        bound = np.full(len(qx), np.inf)
        full = np.diff(begin) == need
        bound[full] = d[begin[1:][full] - 1]
        bound = np.minimum(bound, table.column("_bound")[0].as_py() ** 2)
        key = [table.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(qx), np.int64))) for c in names]
        key = [k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in key]
        return pa.table([*key, pa.array(qx), pa.array(qy), pa.array(bound), _lists(len(qx), q, d, keys.take(pa.array(p)))], names=[*names, "_x", "_y", "_r2", "_near"])

    return run


def _visits(need: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.filter(pc.equal(table.column("_kind"), 2))
        x, y, keys = _points(table)
        qx, qy = asks.column("_x").to_numpy(), asks.column("_y").to_numpy()
        q, p, d = nearest(qx, qy, asks.column("_bound").to_numpy(), x, y, need)
        near = _lists(len(qx), q, d, keys.take(pa.array(p)))
        return pa.table([asks.column("_s"), pa.array(qx), pa.array(qy), near], names=["_s", "_x", "_y", "_near"])

    return run


def nearest_points(spots: DataFrame, asks: DataFrame | None, need: int, square_rows: int = SQUARE_ROWS) -> DataFrame:
    """``_s, _x, _y, _near``: the first ``need`` of ``spots`` (``_s, _x, _y, _dst``) around each location of the same sample.

    Locations are those of ``asks`` (each once), or of ``spots`` themselves;
    ``_near`` is an array of ``(d2, dst)`` in this order. No more than ``need``
    spots may share a position, and positions are finite. Task memory depends
    on ``square_rows``, and one row of the result holds one location.
    """
    same = asks is None
    none = F.lit(None).cast(spots.schema["_dst"].dataType)
    rows = spots.select("_s", "_x", "_y", "_dst", F.lit(0).alias("_kind"))
    if not same:
        rows = rows.unionByName(asks.select("_s", "_x", "_y", none.alias("_dst"), F.lit(1).alias("_kind")))
    extent = F.greatest(F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / square_rows) / 2)).cast("int")
    grid = stage(rows.groupBy("_s").agg(
        F.min("_x").alias("_x0"), F.min("_y").alias("_y0"), F.when(extent > 0, extent).otherwise(1.0).alias("_w"), level.alias("_l"),
    ), "grid")
    cell = ["_s", "_l", "_cx", "_cy"]

    def index(c: str) -> Column:
        n = F.pow(F.lit(2.0), F.col("_l"))
        return F.least(F.floor((F.col(c) - F.col(f"{c}0")) / F.col("_w") * n), n - 1).cast("bigint")

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_cx": index("_x"), "_cy": index("_y")})

    todo, parts, squares = placed(rows.join(grid, "_s")), [], []
    while True:
        counts = stage(todo.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_kind") == 0).alias("_base")), "squares")
        full = (F.col("_n") > square_rows) & (F.col("_l") < DEEPEST)
        squares.append(counts.where(~full).drop("_n"))
        parts.append((todo, counts.where(~full).select(*cell)))
        cut = counts.where(full).select(*cell)
        if cut.isEmpty():
            break
        todo = placed(todo.join(cut, cell, "left_semi").withColumn("_l", F.col("_l") + 2))
    leaves = reduce(DataFrame.unionByName, squares)
    # the smallest square around a leaf that holds enough points bounds every distance in it
    up = leaves.select(*cell, F.explode(F.sequence(F.lit(0), F.col("_l"))).alias("_up"), "_base").withColumns(
        {f"_u{c}": F.floor(F.col(f"_c{c}") / F.pow(F.lit(2.0), F.col("_l") - F.col("_up"))) for c in "xy"})
    enough = up.groupBy("_s", "_up", "_ux", "_uy").agg(F.sum("_base").alias("_in")).where(F.col("_in") >= need).drop("_in")
    best_level = up.join(enough, ["_s", "_up", "_ux", "_uy"]).groupBy(*cell).agg(F.max("_up").alias("_up"))
    side = F.col("_w") / F.pow(F.lit(2.0), F.col("_l"))
    bound = F.coalesce(F.col("_w") / F.pow(F.lit(2.0), F.col("_up")) * 1.4142136, F.lit(float("inf")))
    leaves = stage(
        leaves.join(best_level, cell, "left").join(grid.drop("_l"), "_s").select(
            *cell, bound.alias("_bound"), "_base", side.alias("_side"), (F.col("_w") * 1e-9).alias("_slack"),
            (F.col("_x0") + F.col("_cx") * side).alias("_left"), (F.col("_y0") + F.col("_cy") * side).alias("_low")), "leaves")
    every = stage(reduce(DataFrame.unionByName, [p.join(s, cell).select(*cell, "_x", "_y", "_dst", "_kind") for p, s in parts]), "placed")

    kinds = {f.name: f.dataType.simpleString() for f in spots.schema.fields}
    near = f"_near array<struct<d2: double, dst: {kinds['_dst']}>>"
    first = spread(every.join(leaves.select(*cell, "_bound"), cell), *cell).groupBy(*cell).applyInArrow(
        _own(need, same), f"_s {kinds['_s']}, _l int, _cx bigint, _cy bigint, _x double, _y double, _r2 double, {near}")
    # sides beyond which the circle reaches; a little slack guards against rounding
    r = F.sqrt("_r2") * (1 + 1e-9) + F.col("_slack")
    leaving = (F.col("_x") - r < F.col("_left")) | (F.col("_x") + r > F.col("_left") + F.col("_side")) | (
        F.col("_y") - r < F.col("_low")) | (F.col("_y") + r > F.col("_low") + F.col("_side"))
    first = stage(first.join(leaves, cell).withColumns({"_leaves": leaving, "_r": r}).select(*cell, "_x", "_y", "_r2", "_r", "_near", "_leaves"), "first")
    out = first.where("_leaves")
    far = out.groupBy(*cell).agg(F.max("_r").alias("_far"))
    here = leaves.join(far, cell).select("_s", *[F.col(c).alias(f"{c}q") for c in ("_l", "_cx", "_cy", "_left", "_low", "_side", "_far")])
    there = leaves.where("_base > 0").drop("_bound", "_base")
    other = (F.col("_l") != F.col("_lq")) | (F.col("_cx") != F.col("_cxq")) | (F.col("_cy") != F.col("_cyq"))
    touch = (F.col("_leftq") - F.col("_farq") <= F.col("_left") + F.col("_side")) & (F.col("_left") <= F.col("_leftq") + F.col("_sideq") + F.col("_farq")) & (
        F.col("_lowq") - F.col("_farq") <= F.col("_low") + F.col("_side")) & (F.col("_low") <= F.col("_lowq") + F.col("_sideq") + F.col("_farq"))
    ways = stage(here.join(there, "_s").where(other & touch).select(
        "_s", "_lq", "_cxq", "_cyq", *[F.col(c).alias(f"{c}t") for c in ("_l", "_cx", "_cy", "_left", "_low", "_side", "_slack")]), "ways")
    gap = {c: F.greatest(F.col(low) - F.col(c), F.col(c) - F.col(low) - F.col("_sidet"), F.lit(0.0)) - F.col("_slackt") for c, low in (("_x", "_leftt"), ("_y", "_lowt"))}
    visits = (
        out.select("_s", F.col("_l").alias("_lq"), F.col("_cx").alias("_cxq"), F.col("_cy").alias("_cyq"), "_x", "_y", "_r2", "_r")
        .join(ways, ["_s", "_lq", "_cxq", "_cyq"])
        .where((gap["_x"] <= F.col("_r")) & (gap["_y"] <= F.col("_r")))
        .select("_s", F.col("_lt").alias("_l"), F.col("_cxt").alias("_cx"), F.col("_cyt").alias("_cy"), "_x", "_y",
                none.alias("_dst"), F.lit(2).alias("_kind"), F.col("_r2").alias("_bound"))
    )
    # a square that nobody visits sends no points
    visited = ways.select("_s", F.col("_lt").alias("_l"), F.col("_cxt").alias("_cx"), F.col("_cyt").alias("_cy")).distinct()
    hosts = every.where("_kind = 0").join(visited, cell, "left_semi").withColumn("_bound", F.lit(None).cast("double"))
    second = spread(hosts.unionByName(visits), *cell).groupBy(*cell).applyInArrow(_visits(need), f"_s {kinds['_s']}, _x double, _y double, {near}")
    merged = out.select("_s", "_x", "_y", "_near").unionByName(second).groupBy("_s", "_x", "_y").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("_near"))), 1, need).alias("_near"))
    return first.where("NOT _leaves").select("_s", "_x", "_y", "_near").unionByName(merged)
