"""Sums over discs, worked out tile by tile.

A tile holds the locations whose sums it gives and all others within reach.
Inside, locations are cut into strips by y and sorted by x: what lies in a
disc for certain is a difference of prefix sums, and only locations near the
rim are measured one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellgauge.session import spread, stage

#: locations of one tile that meet in one task; fuller tiles are split
TILE_ROWS = 20_000


def disc_sums(x: np.ndarray, y: np.ndarray, values: np.ndarray, qx: np.ndarray, qy: np.ndarray, d: float) -> np.ndarray:
    """Column sums of ``values`` over the points (x, y) at most ``d`` from each (qx, qy)."""
    out = np.zeros((len(qx), values.shape[1]), values.dtype)
    if not len(x) or not len(qx):
        return out
    area = max(float(np.ptp(x)), d) * max(float(np.ptp(y)), d)
    # as many strips to a radius as balances strips and locations near the rim
    per_radius = min(64.0, max(1.0, np.rint(np.sqrt(len(x) * d * d / area))))
    low = float(y.min())
    strip = np.floor((y - low) * (per_radius / d))
    order = np.lexsort((x, strip))
    x, y, values, strip = x[order], y[order], values[order], strip[order]
    edge = np.flatnonzero(np.concatenate(([True], strip[1:] != strip[:-1], [True])))
    by_y = np.argsort(qy, kind="stable")
    sx, sy = qx[by_y], qy[by_y]
    total = np.zeros_like(out)
    # what rounding can move, far below the distance of two measured positions
    slack = 1e-9 * d + 1e-11 * float(max(np.abs(x).max(), np.abs(y).max(), np.abs(qx).max(), np.abs(qy).max()))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        xs, ys, vs = x[a:b], y[a:b], values[a:b]
        bottom, top = float(ys.min()), float(ys.max())
        i, j = np.searchsorted(sy, bottom - d - slack), np.searchsorted(sy, top + d + slack, side="right")
        if i == j:
            continue
        cx, cy = sx[i:j], sy[i:j]
        far = np.maximum(np.abs(cy - bottom), np.abs(cy - top))
        near = np.maximum(np.maximum(bottom - cy, cy - top), 0.0)
        reach = np.sqrt(np.maximum(d * d - near * near, 0.0)) + slack * 2 + np.sqrt(2 * d * slack) * (near > d - slack)
        sure = np.sqrt(np.maximum(d * d - far * far, 0.0)) - 2 * slack
        sure[(far >= d - slack) | (sure < 0)] = -1.0
        begin, end = np.searchsorted(xs, cx - reach), np.searchsorted(xs, cx + reach, side="right")
        first, last = np.searchsorted(xs, cx - sure), np.searchsorted(xs, cx + sure, side="right")
        none = sure < 0
        first[none] = last[none] = end[none]
        prefix = np.zeros((b - a + 1, values.shape[1]), values.dtype)
        np.cumsum(vs, axis=0, out=prefix[1:])
        total[i:j] += prefix[last] - prefix[first]
        for start, stop in ((begin, first), (last, end)):
            size = np.maximum(stop - start, 0)
            n = int(size.sum())
            # a part at a time, so that memory doesn't follow the rim
            cuts = np.searchsorted(np.cumsum(size), np.arange(1_000_000, n, 1_000_000)) + 1 if n > 1_000_000 else ()
            for rows in np.split(np.arange(j - i), cuts) if n else ():
                m = size[rows]
                who = np.repeat(rows, m)
                at = np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m) + start[who]
                dx, dy = cx[who] - xs[at], cy[who] - ys[at]
                inside = dx * dx + dy * dy <= d * d
                who, at = who[inside], at[inside]
                if len(who):
                    new = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
                    total[i + who[new]] += np.add.reduceat(vs[at], new, axis=0)
    out[by_y] = total
    return out


def _tile(d: float, names: Sequence[str], whole: Sequence[bool]):
    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        x, y, source, asks = get("_x"), get("_y"), get("_source"), get("_asks")
        kinds: dict[bool, list[np.ndarray]] = {True: [], False: []}
        told = []
        for name, integral in zip(names, whole):
            column = table.column(name).combine_chunks()
            seen = column.is_valid().to_numpy(zero_copy_only=False)
            v = column.fill_null(0).to_numpy(zero_copy_only=False)[source]
            parts = {"v": (integral, len(kinds[integral]))}
            if integral:
                kinds[True].append(v)
            else:
                ok = np.isfinite(v)
                kinds[False].append(np.where(ok, v, 0.0))
                if not ok.all():
                    for key, odd in (("nan", np.isnan(v)), ("up", v == np.inf), ("down", v == -np.inf)):
                        parts[key] = (True, len(kinds[True]))
                        kinds[True].append(odd.astype(np.int64))
            if not seen.all():
                parts["seen"] = (True, len(kinds[True]))
                kinds[True].append(seen[source].astype(np.int64))
            told.append(parts)
        sums = {
            k: disc_sums(x[source], y[source], np.stack(v, axis=1), x[asks], y[asks], d) if v else None for k, v in kinds.items()
        }
        out = [pa.array(x[asks]), pa.array(y[asks])]
        for parts in told:
            part = {k: sums[integral][:, i] for k, (integral, i) in parts.items()}
            v = part["v"]
            if "nan" in part:
                up, down = part["up"] > 0, part["down"] > 0
                v = np.where((part["nan"] > 0) | (up & down), np.nan, np.where(up, np.inf, np.where(down, -np.inf, v)))
            out.append(pa.array(v, mask=part["seen"] == 0 if "seen" in part else None))
        key = table.column("_s")
        return pa.table([key.filter(pa.array(asks)).combine_chunks(), *out], names=["_s", "_x", "_y", *names])

    return run


def sums_around(locs: DataFrame, d: float, payload: Sequence[str], tile_rows: int = TILE_ROWS) -> DataFrame:
    """Sums of the payload over all locations (``_s, _x, _y``, each once) within ``d`` of each, itself included.

    Tiles are squares of whole multiples of ``d``, as wide as the number of
    locations in a square of ``d`` allows. Locations near an edge go to the
    tiles beyond it too. A tile with more than ``tile_rows`` is divided by hash
    on both sides, so that a task never holds more than about twice that.
    Positions that aren't finite have no sums. Sums of whole numbers are long,
    all others double.
    """
    whole = [isinstance(locs.schema[c].dataType, T.IntegralType) for c in payload]
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    cast = [F.col(c).cast("long" if w else "double").alias(c) for c, w in zip(payload, whole)]
    locs = stage(locs.where(finite("_x") & finite("_y")).select("_s", "_x", "_y", *cast), "locations")
    squares = locs.groupBy("_s", F.floor(F.col("_x") / d).alias("_gx"), F.floor(F.col("_y") / d).alias("_gy")).agg(F.count(F.lit(1)).alias("_n"))
    width = F.least(F.lit(64.0), F.greatest(F.lit(1.0), F.floor(F.sqrt(tile_rows / F.avg("_n"))))) * d
    widths = stage(squares.groupBy("_s").agg(width.alias("_w")), "tile_widths")

    def tiles(c: str):
        reach = d * (1 + 1e-9) + (F.abs(F.col(c)) + F.col("_w")) * 1e-12
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / F.col("_w")), F.floor((F.col(c) + reach) / F.col("_w"))))

    at = ["_s", "_tx", "_ty"]
    placed = locs.join(widths, "_s").withColumn("_tx", tiles("_x")).withColumn("_ty", tiles("_y"))
    asks = (F.floor(F.col("_x") / F.col("_w")) == F.col("_tx")) & (F.floor(F.col("_y") / F.col("_w")) == F.col("_ty"))
    placed = placed.withColumn("_home", asks)
    full = stage(
        placed.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / (2 * tile_rows)).cast("int").alias("_parts")).where("_parts > 1"), "full_tiles"
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    mine = F.pmod(F.xxhash64("_x", "_y"), F.col("_parts"))
    dealt = (
        placed.join(full, at, "left").withColumn("_parts", parts).withColumn("_mine", mine)
        .withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_parts") * F.col("_parts") - 1)))
        .withColumns({
            "_source": F.expr("_group div _parts") == F.col("_mine"),
            "_asks": F.col("_home") & (F.col("_group") % F.col("_parts") == F.col("_mine")),
        })
        .where(F.col("_source") | F.col("_asks"))
        .select(*at, "_group", "_x", "_y", "_source", "_asks", *payload)
    )
    kind = locs.schema["_s"].dataType.simpleString()
    schema = ", ".join([f"_s {kind}, _x double, _y double", *(f"`{c}` {'bigint' if w else 'double'}" for c, w in zip(payload, whole))])
    found = spread(dealt, *at, "_group").groupBy(*at, "_group").applyInArrow(_tile(float(d), list(payload), whole), schema)
    return found.groupBy("_s", "_x", "_y").agg(*[F.sum(c).alias(c) for c in payload])
