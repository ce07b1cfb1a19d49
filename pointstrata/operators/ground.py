"""Ground mask by a progressive morphological filter on cell minima.

The reference drapes a simulated cloth over the inverted cloud.  Here the
cell-minimum surface is opened with growing windows (Zhang et al. 2003): an
object narrower than the window disappears, terrain stays.  Points close to the
resulting surface are ground.  Work after the first aggregate is on cells only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import cells
from .cells import Extent, extent


@dataclass(frozen=True)
class GroundParams:
    resolution: float = 0.5
    rigidness: int = 2
    threshold: float = 0.5
    max_window: float = 16.0

    @property
    def slope(self) -> float:
        """Height change per metre that still counts as terrain; stiffer means flatter."""
        return {1: 1.0, 2: 0.5, 3: 0.3}[self.rigidness]


def auto_params(ext: Extent) -> GroundParams:
    side = max(ext.width, ext.height)
    density = ext.n / (side * side) if side > 0 else 1.0
    resolution = 0.5 if density > 100 else 1.0 if density > 20 else 2.0
    rigidness = 1 if ext.depth > 50 else 2 if ext.depth > 20 else 3
    return GroundParams(resolution, rigidness, 0.3 if density > 50 else 0.5)


def _radii(reach: int) -> list[tuple[int, int]]:
    """Shifts that widen a window from radius 0 to ``reach`` and the radius after each: three copies a step."""
    out, r = [], 0
    while r < reach:
        shift = min(2 * r + 1, reach - r)
        r += shift
        out.append((shift, r))
    return out


def _extreme(grid: DataFrame, reach: int, lowest: bool) -> DataFrame:
    """Minimum or maximum over the square window, axis by axis, in steps that triple the window."""
    agg = F.min if lowest else F.max
    cols = grid.select("ix", "iy", "h")
    for axis, other in (("ix", "iy"), ("iy", "ix")):
        for shift, _ in _radii(reach):
            steps = F.array(*(F.lit(s) for s in (-shift, 0, shift)))
            sent = cols.select(F.explode(steps).alias("_s"), axis, other, "h")
            cols = sent.select((F.col(axis) + F.col("_s")).alias(axis), other, "h").groupBy("ix", "iy").agg(agg("h").alias("h"))
    return grid.select("ix", "iy").join(cols, ["ix", "iy"])


#: Side of the tiles that a task filters at once, in widths of their rim; wider rims than ``RIM`` cells are not kept in one array.
SIDE, RIM = 4, 512


def _reaches(p: GroundParams) -> list[tuple[int, float]]:
    """(half width of the window in cells, height step that is cut) of all rounds."""
    out, reach, before = [], 1, 0
    while True:
        out.append((reach, p.slope * (reach - before) * 2 * p.resolution + p.threshold))
        if (2 * reach + 1) * p.resolution >= p.max_window:
            return out
        before, reach = reach, reach * 2


def _window(a: np.ndarray, reach: int, lowest: bool) -> np.ndarray:
    """Minimum or maximum over the square window; beyond the array there is nothing."""
    pick, none, width = (np.minimum, np.inf, 2 * reach + 1) if lowest else (np.maximum, -np.inf, 2 * reach + 1)
    for _ in range(2):
        a = np.pad(a, ((reach, reach), (0, 0)), constant_values=none)
        size = 1
        while size < width:  # a is the extreme of ``size`` rows from each row on
            step = min(size, width - size)
            a = pick(a[:-step], a[step:])
            size += step
        a = a.T
    return a


def _filter_kernel(side: int, reaches: list[tuple[int, float]]):
    """All rounds for the cells of a tile, from its cells and those of its rim."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ix, iy = (rows.column(c).to_numpy() for c in ("ix", "iy"))
        own = (ix // side == key[0].as_py()) & (iy // side == key[1].as_py())
        value = rows.column("h").to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN
        if own.any():
            i, j = ix - ix.min(), iy - iy.min()
            h, here = np.full((i.max() + 1, j.max() + 1), np.nan), np.zeros((i.max() + 1, j.max() + 1), bool)
            h[i, j], here[i, j] = value, True
            for reach, step in reaches:
                low = _window(np.where(np.isnan(h), np.inf, h), reach, True)
                o = _window(np.where(here & (low < np.inf), low, -np.inf), reach, False)
                with np.errstate(invalid="ignore"):
                    h = np.where(h - o > step, o, h)
            value = h[i, j]
        return pa.table({"ix": ix[own], "iy": iy[own], "surface": pa.array(value[own], pa.float64(), from_pandas=True)})

    return run


def ground_surface(points: DataFrame, ext: Extent, p: GroundParams) -> DataFrame:
    """(ix, iy, surface) per occupied cell.

    A cell depends on cells up to twice the sum of all windows away, so tiles with
    a rim of that width are filtered in one pass over the cells.  Where the rim is
    too wide for an array every window is a round of aggregates.
    """
    grid = cells.with_cell(points, ext, p.resolution, extra=1).groupBy("ix", "iy").agg(F.min("z").alias("h"))
    reaches = _reaches(p)
    rim = 2 * sum(r for r, _ in reaches)
    if rim <= RIM:
        side = SIDE * rim
        tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - rim) / side).cast("long"), F.floor((F.col(c) + rim) / side).cast("long")))
        tiled = grid.select(F.col("ix").cast("long"), F.col("iy").cast("long"), F.col("h").cast("double"), tiles("ix").alias("_tx"))
        tiled = tiled.withColumn("_ty", tiles("iy"))
        return tiled.groupBy("_tx", "_ty").applyInArrow(_filter_kernel(side, reaches), "ix long, iy long, surface double")
    grid = cut(grid)
    for reach, step in reaches:
        opened = _extreme(_extreme(grid, reach, True), reach, False).withColumnRenamed("h", "o")
        grid = cut(grid.join(opened, ["ix", "iy"]).select(
            "ix", "iy", F.when(F.col("h") - F.col("o") > F.lit(step), F.col("o")).otherwise(F.col("h")).alias("h")))
    return grid.withColumnRenamed("h", "surface")


def ground_mask(points: DataFrame, params: GroundParams | None = None, ext: Extent | None = None,
                valid: Column | None = None) -> DataFrame:
    """Adds ``is_ground``; rows outside ``valid`` (noise) are never ground."""
    ext = ext or extent(points)
    valid = F.lit(True) if valid is None else valid
    p = params or auto_params(ext)
    surface = ground_surface(points.where(valid).select("x", "y", "z"), ext, p)
    keyed = cells.with_cell(points, ext, p.resolution, extra=1, names=("_gx", "_gy"))
    s = surface.select(F.col("ix").alias("_gx"), F.col("iy").alias("_gy"), "surface")
    near = valid & (F.col("z") - F.col("surface") <= F.lit(p.threshold))
    return keyed.join(s, ["_gx", "_gy"], "left").withColumn(
        "is_ground", F.coalesce(near, F.lit(False))).drop("_gx", "_gy", "surface")


def ground_statistics(points: DataFrame, is_ground: Column) -> DataFrame:
    n, g = F.count(F.lit(1)), F.count(F.when(is_ground, 1))
    z = F.when(is_ground, F.col("z"))
    return points.agg(n.alias("n_points"), g.alias("n_ground"), (n - g).alias("n_non_ground"), (g / n * 100).alias("ground_pct"),
                      F.min(z).alias("ground_z_min"), F.max(z).alias("ground_z_max"), F.avg(z).alias("ground_z_mean"))


def hag_statistics(points: DataFrame, n_ground: Column) -> DataFrame:
    """HAG summary; the median is exact (see ``cells.quantiles``)."""
    n = F.count(F.lit(1))
    h = F.col("hag")
    base = points.agg(n.alias("n_points"), n_ground.alias("n_ground"), F.min(h).alias("hag_min"), F.max(h).alias("hag_max"),
                      F.avg(h).alias("hag_mean"), F.stddev_pop(h).alias("hag_std"),
                      (F.count(F.when(h < 0, 1)) / n * 100).alias("below_ground_pct"))
    return base.withColumn("hag_median", F.lit(cells.quantiles(points, "hag", [0.5])[0]))
