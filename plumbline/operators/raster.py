"""Raster operators on cell tables (rw, cl, value); an absent row or a null is NoData."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def grid(cells: DataFrame) -> DataFrame:
    """All (rw, cl) of the bounding box, built per row so no single task makes the whole grid."""
    box = cells.agg(F.min("rw").alias("r0"), F.max("rw").alias("r1"), F.min("cl").alias("c0"), F.max("cl").alias("c1")).where("r0 is not null")
    rows = box.select(F.explode(F.sequence("r0", "r1")).alias("rw"), "c0", "c1").repartition("rw")
    return rows.select("rw", F.explode(F.sequence("c0", "c1")).alias("cl"))


TILE = 256


def tiled(cells: DataFrame, columns: list[str], halo: int, solve, schema: str, tile: int = TILE) -> DataFrame:
    """`solve(arrays, own)` on every tile of the bounding box, each with a halo of `halo` cells around it.

    One exchange: a cell goes to each tile whose halo it is in.  `arrays` holds
    a float array per column, NaN where there is no cell; `own` are the slices
    of the tile without its halo.  The result is a dict of arrays over `own`;
    rw and cl are added.  Tiles without a cell are solved too.
    """
    spark = cells.sparkSession
    box = cells.agg(F.min("rw").alias("r0"), F.max("rw").alias("r1"), F.min("cl").alias("c0"), F.max("cl").alias("c1")).first()
    if box["r0"] is None:
        return spark.createDataFrame([], schema)
    r0, r1, c0, c1 = box
    down, across = -(-(r1 - r0 + 1) // tile), -(-(c1 - c0 + 1) // tile)
    reach = lambda k, low, most: F.sequence(F.greatest(F.floor((c(k) - low - halo) / tile), F.lit(0)), F.least(F.floor((c(k) - low + halo) / tile), F.lit(most - 1).cast("long")))
    dealt = cells.select("rw", "cl", *[c(x).cast("double").alias(x) for x in columns]).withColumn("_tr", F.explode(reach("rw", r0, down))).withColumn("_tc", F.explode(reach("cl", c0, across)))
    marks = spark.range(down * across).select(F.lit(None).cast("long").alias("rw"), F.lit(None).cast("long").alias("cl"), *[F.lit(None).cast("double").alias(x) for x in columns], F.floor(c("id") / across).alias("_tr"), (c("id") % across).alias("_tc"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(key, t):
        tr, tc = key[0].as_py(), key[1].as_py()
        top, left = r0 + tr * tile, c0 + tc * tile
        bottom, right = min(top + tile - 1, r1), min(left + tile - 1, c1)
        a, b = max(top - halo, r0), max(left - halo, c0)
        shape = (min(bottom + halo, r1) - a + 1, min(right + halo, c1) - b + 1)
        t = t.filter(pc.is_valid(t["rw"]))
        at = t["rw"].to_numpy() - a, t["cl"].to_numpy() - b
        arrays = {}
        for x in columns:
            arrays[x] = np.full(shape, np.nan)
            arrays[x][at] = t[x].to_numpy()
        own = slice(top - a, bottom - a + 1), slice(left - b, right - b + 1)
        rw, cl = np.mgrid[top : bottom + 1, left : right + 1]
        out = solve(arrays, own) | {"rw": rw, "cl": cl}
        return pa.table({n: pa.array(np.asarray(out[n]).ravel(), from_pandas=True) for n in names})

    return dealt.unionByName(marks).groupBy("_tr", "_tc").applyInArrow(run, schema)


def swept(x: np.ndarray, half: int, what) -> np.ndarray:
    """`what` (np.minimum or np.maximum) over a square window, rows first, then columns; at the border the window is cut."""
    for axis in (0, 1):
        x = np.moveaxis(x, axis, 0)
        out = x.copy()
        for k in range(1, min(half, len(x) - 1) + 1):
            out[k:] = what(out[k:], x[: len(x) - k])
            out[: len(x) - k] = what(out[: len(x) - k], x[k:])
        x = np.moveaxis(out, 0, axis)
    return x


def ground(cells: DataFrame, res: float, dh0: float = 0.3, slope: float = 0.15, dh_max: float = 2.5, max_window: float = 40.0) -> DataFrame:
    """(rw, cl, zmin, ground): progressive morphological filter; empty cells are filled high and never ground."""
    steps, k, before = [], 0, 1
    while k == 0 or (2 * 2**k + 1) * res <= max_window:
        size = 2 * 2**k + 1
        steps.append((size // 2, dh0 if k == 0 else min(dh0 + slope * (size - before) * res, dh_max)))
        before, k = size, k + 1
    high = cells.agg(F.max("zmin")).first()[0] or 0.0

    def solve(arrays, own):
        z = arrays["zmin"]
        have = ~np.isnan(z)
        filled = np.where(have, z, high)
        surface, off = filled, np.zeros(z.shape, bool)
        for half, dh in steps:
            surface = swept(swept(surface, half, np.minimum), half, np.maximum)
            off |= filled - surface > dh
        return {"zmin": z[own], "ground": (have & ~off)[own]}

    # an opening looks twice its half window far, and each works on the one before
    return tiled(cells, ["zmin"], 2 * sum(h for h, _ in steps), solve, "rw long, cl long, zmin double, ground boolean")


def neighbours(cells: DataFrame, value: list[str], shifts: list[tuple[int, int]]) -> DataFrame:
    """Each cell with the neighbours that exist: (rw, cl, dr, dc, values of the neighbour as n_*)."""
    around = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in shifts])
    me = cells.select("rw", "cl", F.explode(around).alias("_s")).select("rw", "cl", "_s.dr", "_s.dc", (c("rw") + c("_s.dr")).alias("_r"), (c("cl") + c("_s.dc")).alias("_c"))
    other = cells.select(c("rw").alias("_r"), c("cl").alias("_c"), *[c(x).alias(f"n_{x}") for x in value])
    return me.join(other, ["_r", "_c"]).drop("_r", "_c")


SQUARE = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd rule."""
    hits = F.lit(0)
    for (x0, y0), (x1, y1) in zip(polygon, polygon[1:] + polygon[:1]):
        if y0 != y1:
            cross = ((F.lit(y0) > y) != (F.lit(y1) > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            hits = hits + cross.cast("int")
    return hits % 2 == 1


def area(polygon: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(polygon, polygon[1:] + polygon[:1]))) / 2
