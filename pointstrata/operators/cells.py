"""Grid cells: extents, keys, per-cell statistics, order statistics.

A cloud's extent is a one-row aggregate; it is read once on the driver and
becomes literals in the plan, so every later operator is free of extra joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Extent:
    n: int
    x_min: float
    x_max: float
    y_min: float
    y_max: float
    z_min: float
    z_max: float

    @property
    def width(self) -> float:
        return self.x_max - self.x_min

    @property
    def height(self) -> float:
        return self.y_max - self.y_min

    @property
    def depth(self) -> float:
        return self.z_max - self.z_min

    @property
    def area(self) -> float:
        return self.width * self.height

    @property
    def density(self) -> float:
        return self.n / self.area if self.area > 0 else 0.0


def extent_frame(points: DataFrame) -> DataFrame:
    """One row: count, bounds, area and density."""
    aggs = [F.count(F.lit(1)).alias("n_points")]
    for axis in "xyz":
        aggs += [F.min(axis).alias(f"{axis}_min"), F.max(axis).alias(f"{axis}_max")]
    area = (F.col("x_max") - F.col("x_min")) * (F.col("y_max") - F.col("y_min"))
    return points.agg(*aggs).withColumn("area_m2", area).withColumn(
        "density", F.when(F.col("area_m2") > 0, F.col("n_points") / F.col("area_m2")).otherwise(F.lit(0.0))
    )


def extent(points: DataFrame) -> Extent:
    r = extent_frame(points).first()
    if r.n_points == 0:
        return Extent(0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    return Extent(r.n_points, r.x_min, r.x_max, r.y_min, r.y_max, r.z_min, r.z_max)


def beside(*rows: DataFrame) -> DataFrame:
    """One-row tables put side by side (each is an ungrouped aggregate)."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(F.broadcast(r.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def index(col: Column | str, origin: float, size: float, n: int | None = None) -> Column:
    """Cell number along one axis, clipped to [0, n-1] when n is given."""
    col = F.col(col) if isinstance(col, str) else col
    idx = F.floor((col - F.lit(float(origin))) / F.lit(float(size))).cast("long")
    if n is None:
        return idx
    return F.least(F.greatest(idx, F.lit(0).cast("long")), F.lit(n - 1).cast("long"))


def cells_along(length: float, size: float, extra: int = 0) -> int:
    return max(1, int(math.ceil(length / size)) + extra)


def with_cell(points: DataFrame, ext: Extent, size: float, extra: int = 0,
              names: tuple[str, str] = ("ix", "iy")) -> DataFrame:
    """Adds clipped 2-D cell indices anchored at the cloud's lower corner."""
    nx, ny = cells_along(ext.width, size, extra), cells_along(ext.height, size, extra)
    return points.withColumns(
        {names[0]: index("x", ext.x_min, size, nx), names[1]: index("y", ext.y_min, size, ny)}
    )


def with_voxel(points: DataFrame, size: float) -> DataFrame:
    """Adds voxel indices anchored at zero."""
    return points.withColumns({f"v{a}": index(a, 0.0, size) for a in "xyz"})


def voxel_centroids(points: DataFrame, size: float, colours: bool = False) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(a).alias(a) for a in "xyz"]
    if colours:
        aggs += [F.avg(c).alias(c) for c in ("red", "green", "blue")]
    return with_voxel(points, size).groupBy("vx", "vy", "vz").agg(*aggs)


def cell_stats(points: DataFrame, size: float, keys=("ix", "iy")) -> DataFrame:
    """Count, mean, population variance (>= 0), range of z and density per cell."""
    n = F.count(F.lit(1))
    return points.groupBy(*keys).agg(
        n.alias("cell_count"),
        F.avg("z").alias("z_mean"),
        F.greatest(F.var_pop("z"), F.lit(0.0)).alias("z_variance"),
        (F.max("z") - F.min("z")).alias("z_range"),
        (n / F.lit(size * size)).alias("density"),
    )


def order_statistics(df: DataFrame, value: str, ranks: list[int], buckets: int = 2048) -> list[float]:
    """Exact k-th smallest values (0-based ranks) without sorting the data.

    Each pass counts equal-width buckets of the interval that still holds the
    rank; only bucket counts reach the driver.  A pass shrinks the interval by
    the number of buckets, so a handful of map-side-combined scans suffices
    whatever the size of the data.
    """
    v = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    lo0, hi0 = v.agg(F.min("v"), F.max("v")).first()
    state = {r: (lo0, hi0, 0) for r in set(ranks)}  # rank -> interval, rows below it
    found: dict[int, float] = {}
    while True:
        for r, (lo, hi, _) in list(state.items()):
            if hi <= lo:
                found[r] = lo
                del state[r]
        if not state:
            return [found[r] for r in ranks]
        spans = sorted({(lo, hi) for lo, hi, _ in state.values()})
        keys = []
        for i, (lo, hi) in enumerate(spans):
            width = (hi - lo) / buckets
            b = F.floor((F.col("v") - F.lit(lo)) / F.lit(width)) if width > 0 else F.lit(0)
            # a span too narrow for equal widths is bucketed by value
            b = F.least(F.greatest(b, F.lit(0)), F.lit(buckets - 1)).cast("int")
            keys.append(F.when(F.col("v").between(F.lit(lo), F.lit(hi)), F.struct(F.lit(i).alias("s"), b.alias("b"))))
        rows = (
            v.select("v", F.explode(F.array(*keys)).alias("k")).where("k is not null")
            .groupBy("k.s", "k.b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()  # at most `buckets` rows per rank
        )
        by_span: dict[int, list] = {}
        for row in sorted(rows, key=lambda x: (x.s, x.b)):
            by_span.setdefault(row.s, []).append(row)
        for r, (lo, hi, before) in list(state.items()):
            for row in by_span[spans.index((lo, hi))]:
                if before + row.n > r:
                    break
                before += row.n
            if (row.lo, row.hi) == (lo, hi):
                # not separable by width in floating point: count single values
                part = v.where(F.col("v").between(F.lit(lo), F.lit(hi)))
                for x in part.groupBy("v").count().orderBy("v").limit(buckets).collect():
                    before += x["count"]
                    if before > r:
                        break
                state[r] = (x.v, x.v, before)
            else:
                state[r] = (row.lo, row.hi, before)


def quantiles(df: DataFrame, value: str, probs: list[float], n: int | None = None) -> list[float]:
    """Exact percentiles with linear interpolation between neighbouring ranks."""
    n = df.where(F.col(value).isNotNull()).count() if n is None else n
    pos = [p * (n - 1) for p in probs]
    ranks = sorted({int(math.floor(p)) for p in pos} | {int(math.ceil(p)) for p in pos})
    vals = dict(zip(ranks, order_statistics(df, value, ranks)))
    out = []
    for p in pos:
        a, b = vals[int(math.floor(p))], vals[int(math.ceil(p))]
        out.append(a + (b - a) * (p - math.floor(p)))
    return out
