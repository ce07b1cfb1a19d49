"""Object geometry: boxes, PCA shape, hulls, footprints, buildings, sections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.eigen import direction2, moments, with_covariance, with_eigen3
from ..functions.height import capped_ratio
from ..session import cut
from . import cells, planes
from .cluster import dbscan
from .railway import reference_level

HULL_CHUNK = 20_000


# ---- sections and projections --------------------------------------------

def plane_section(points: DataFrame, p: tuple, n: tuple, tol: float = 0.1) -> DataFrame:
    """Points closer than ``tol`` to the plane through p with unit normal n; adds the signed distance."""
    d = sum(((F.col(a) - F.lit(float(v))) * F.lit(float(w)) for a, v, w in zip("xyz", p, n)), F.lit(0.0))
    return points.withColumn("plane_distance", d).where(F.abs("plane_distance") < tol)


def horizontal_slice(points: DataFrame, z: float, tol: float = 0.1) -> DataFrame:
    return plane_section(points, (0, 0, z), (0, 0, 1), tol)


def projection(points: DataFrame, axis: str = "z") -> DataFrame:
    u, v = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}[axis]
    return points.select("point_id", F.col(u).alias("u"), F.col(v).alias("v"))


# ---- boxes ----------------------------------------------------------------

def boxes(points: DataFrame, key: str) -> DataFrame:
    """Axis-aligned box of every object: limits, centre, sizes, volume, surface."""
    b = points.groupBy(key).agg(F.count(F.lit(1)).alias("point_count"),
                                *[f(a).alias(f"{a}_{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    return box_measures(b)


def box_measures(b: DataFrame) -> DataFrame:
    s = {a: F.col(f"{a}_max") - F.col(f"{a}_min") for a in "xyz"}
    b = b.withColumns({f"size_{a}": v for a, v in s.items()} | {f"center_{a}": (F.col(f"{a}_max") + F.col(f"{a}_min")) / 2 for a in "xyz"})
    x, y, z = (F.col(f"size_{a}") for a in "xyz")
    return b.withColumns({"volume": x * y * z, "surface_area": F.lit(2.0) * (x * y + y * z + z * x)})


def merge_boxes(b: DataFrame) -> DataFrame:
    """One box around all boxes (one row; zeros when there are none)."""
    m = b.agg(*[F.coalesce(f(f"{a}_{n}"), F.lit(0.0)).alias(f"{a}_{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])
    return box_measures(m)


def oriented_boxes(points: DataFrame, key: str) -> DataFrame:
    """PCA-aligned box: eigenvalues (n-1), half extents, volume, direction of the main axis."""
    o = points.groupBy(key).agg(*[F.min(a).alias(f"o{a}") for a in "xyz"])
    rel = points.join(o, key).withColumns({f"r{a}": F.col(a) - F.col(f"o{a}") for a in "xyz"})
    m = rel.groupBy(key).agg(*moments("rx", "ry", "rz"))
    e = with_eigen3(with_covariance(m, sample=True), normal=True, axis=True)
    # middle axis completes the right-handed frame
    c = F.col
    e = e.withColumns({"bx": c("ny") * c("az") - c("nz") * c("ay"), "by": c("nz") * c("ax") - c("nx") * c("az"),
                       "bz": c("nx") * c("ay") - c("ny") * c("ax")})
    keep = ["l1", "l2", "l3", *[f"{v}{a}" for v in "abn" for a in "xyz"]]
    e = cut(e.select(key, "m_n", *[(c(f"m_{a}") / c("m_n")).alias(f"g{a}") for a in "xyz"], *keep))
    r = rel.join(e, key)
    t = {v: sum(((c(f"r{a}") - c(f"g{a}")) * c(f"{v}{a}") for a in "xyz"), F.lit(0.0)) for v in "abn"}
    r = r.withColumns({f"t_{v}": x for v, x in t.items()})
    h = r.groupBy(key).agg(*[((F.max(f"t_{v}") - F.min(f"t_{v}")) / 2).alias(f"half_{i}") for i, v in enumerate("abn")],
                           *[((F.max(f"t_{v}") + F.min(f"t_{v}")) / 2).alias(f"mid_{i}") for i, v in enumerate("abn")])
    out = e.join(o, key).join(h, key)
    centre = {f"obb_{a}": c(f"o{a}") + c(f"g{a}") + sum((c(f"mid_{i}") * c(f"{v}{a}") for i, v in enumerate("abn")), F.lit(0.0)) for a in "xyz"}
    return out.withColumns(centre).withColumns({
        "obb_volume": F.lit(8.0) * c("half_0") * c("half_1") * c("half_2"),
        "orientation_deg": F.degrees(F.atan2(c("ay"), c("ax")))}).drop(*[f"o{a}" for a in "xyz"], *[f"g{a}" for a in "xyz"], "mid_0", "mid_1", "mid_2")


def shape_ratios(o: DataFrame) -> DataFrame:
    c = F.col
    return o.withColumns({
        "elongation": F.when(c("l3") > 1e-12, F.sqrt(c("l1") / c("l3"))),
        "planarity": F.when(c("l2") > 0, (c("l2") - c("l3")) / c("l2")).otherwise(F.lit(0.0)),
        "sphericity": F.when(c("l1") > 0, c("l3") / c("l1")).otherwise(F.lit(0.0))})


def octant_uniformity(points: DataFrame, key: str) -> DataFrame:
    """1 - spread of the eight octant counts around the centroid, not below 0."""
    g = points.groupBy(key).agg(*[F.avg(a).alias(f"g{a}") for a in "xyz"])
    p = points.join(g, key)
    octant = sum((F.when(F.col(a) >= F.col(f"g{a}"), F.lit(w)).otherwise(F.lit(0)) for a, w in zip("xyz", (1, 2, 4))), F.lit(0))
    p = p.withColumn("octant", octant)
    counts = [F.count(F.when(F.col("octant") == i, 1)).alias(f"o{i}") for i in range(8)]
    q = p.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *counts)
    mean = F.col("n") / 8
    var = sum(((F.col(f"o{i}") - mean) * (F.col(f"o{i}") - mean) for i in range(8)), F.lit(0.0)) / 8
    return q.select(key, F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(var) / mean).alias("density_uniformity"))


def compactness(points: DataFrame, key: str, voxel: float = 0.5) -> DataFrame:
    """Volume of occupied voxels over the box volume, at most 1 (0.5 for a flat box or under ten points)."""
    v = cells.with_voxel(points, voxel).select(key, "vx", "vy", "vz").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_v"))
    b = boxes(points, key).select(key, "volume", "point_count")
    ratio = F.least(F.lit(1.0), F.col("_v") * F.lit(voxel ** 3) / F.col("volume"))
    return v.join(b, key).select(key, F.when((F.col("volume") > 0) & (F.col("point_count") >= 10), ratio).otherwise(F.lit(0.5)).alias("compactness"))


def shape_metrics(points: DataFrame, key: str) -> DataFrame:
    """All shape metrics per object (four or more points)."""
    b = boxes(points, key).where(F.col("point_count") >= 4)
    o = shape_ratios(oriented_boxes(points, key)).drop("m_n")
    return b.join(o, key).join(compactness(points, key), key).join(octant_uniformity(points, key), key)


# ---- hulls ----------------------------------------------------------------

def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _chain(pts: np.ndarray) -> list[tuple[float, float]]:
    """Counter-clockwise hull from the lowest x (monotone chain, collinear points dropped)."""
    p = [tuple(v) for v in np.unique(pts, axis=0)]
    if len(p) < 3:
        return p
    half = []
    for seq in (p, p[::-1]):
        h: list = []
        for q in seq:
            while len(h) > 1 and _cross(h[-2], h[-1], q) <= 0:
                h.pop()
            h.append(q)
        half.append(h[:-1])
    return half[0] + half[1]


def hulls(points: DataFrame, key: str) -> DataFrame:
    """Hull vertices per object: (key, seq, x, y), counter-clockwise.

    Only the lowest and highest y of every x can be a vertex, which a map-side
    aggregate settles first.  An object that is still large is split into
    chunks whose hulls replace them, until its candidates fit one small group;
    no task ever receives the raw points of a whole object.
    """
    kt = dict(points.dtypes)[key]
    ends = points.groupBy(key, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    p = ends.select(key, "x", F.explode(F.array("lo", "hi")).alias("y")).distinct()

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _chain(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[0], "x": [a for a, _ in v], "y": [b for _, b in v]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _chain(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[0], "seq": np.arange(len(v), dtype=np.int32), "x": [a for a, _ in v], "y": [b for _, b in v]})

    while True:
        p = cut(p)
        size = p.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        if (size.agg(F.max("_n")).first()[0] or 0) <= HULL_CHUNK:
            break
        parts = F.ceil(F.col("_n") / F.lit(HULL_CHUNK))
        split = p.join(size, key).withColumn("part", F.pmod(F.xxhash64("x", "y"), parts).cast("int"))
        p = split.groupBy(key, "part").applyInPandas(partial, f"{key} {kt}, x double, y double")
    return p.groupBy(key).applyInPandas(final, f"{key} {kt}, seq int, x double, y double")


def _first_two(axis: str) -> Column:
    """First two vertices of a ring, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("seq") < 2, F.struct("seq", axis)))), lambda s: s[axis])


def polygon_measures(vertices: DataFrame, key: str) -> DataFrame:
    """Shoelace area, perimeter, vertex centroid, vertex count, rectangle test and orientation."""
    w = Window.partitionBy(key).orderBy("seq")  # hull vertices only
    nxt = lambda a, k: F.coalesce(F.lead(a, k).over(w), F.element_at(F.col(f"_f{a}"), k - (F.col("n_vertices") - F.col("seq") - 1)))
    head = vertices.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n_vertices"),
                                     *[_first_two(a).alias(f"_f{a}") for a in "xy"])
    v = vertices.join(head, key)
    v = v.withColumns({"x1": nxt("x", 1), "y1": nxt("y", 1), "x2": nxt("x", 2), "y2": nxt("y", 2)})
    ex, ey = F.col("x1") - F.col("x"), F.col("y1") - F.col("y")
    fx, fy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cosine = (ex * fx + ey * fy) / (F.sqrt(ex * ex + ey * ey) * F.sqrt(fx * fx + fy * fy) + F.lit(1e-8))
    v = v.withColumns({"_a": F.col("x") * F.col("y1") - F.col("x1") * F.col("y"), "_p": F.sqrt(ex * ex + ey * ey),
                       "_w": F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))})
    m = v.groupBy(key, "n_vertices").agg(
        (F.abs(F.sum("_a")) / 2).alias("area_m2"), F.sum("_p").alias("perimeter_m"), F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"),
        (F.min((F.abs(F.col("_w") - 90) < 15).cast("int")) == 1).alias("_right"),
        F.covar_samp("x", "x").alias("_xx"), F.covar_samp("y", "y").alias("_yy"), F.covar_samp("x", "y").alias("_xy"))
    dx, dy = direction2(F.col("_xx"), F.col("_yy"), F.col("_xy"))
    return m.withColumns({"is_rectangular": (F.col("n_vertices") == 4) & F.col("_right"),
                          "orientation_deg": F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))}).drop("_right", "_xx", "_yy", "_xy")


def footprint_area(points: DataFrame, key: str) -> DataFrame:
    return polygon_measures(hulls(points, key), key).select(key, "area_m2")


# ---- roofs and buildings --------------------------------------------------

def roof_points(points: DataFrame, key: str, share: float = 0.3) -> DataFrame:
    """Points in the top 30 % of the height range of their object."""
    lim = points.groupBy(key).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    top = F.col("_hi") - F.lit(share) * (F.col("_hi") - F.col("_lo"))
    return points.join(lim, key).where(F.col("z") >= top).drop("_lo", "_hi")


def roof_symmetry(roof: DataFrame, key: str) -> DataFrame:
    """Equal mean height (0.5 m) left and right of the mean x, ten points on each side."""
    mid = roof.groupBy(key).agg(F.avg("x").alias("_m"))
    r = roof.join(mid, key)
    left = F.col("x") < F.col("_m")
    s = r.groupBy(key).agg(F.count(F.when(left, 1)).alias("nl"), F.count(F.when(~left, 1)).alias("nr"),
                           F.avg(F.when(left, F.col("z"))).alias("zl"), F.avg(F.when(~left, F.col("z"))).alias("zr"))
    ok = (F.col("nl") >= 10) & (F.col("nr") >= 10) & (F.abs(F.col("zl") - F.col("zr")) < 0.5)
    return s.select(key, F.coalesce(ok, F.lit(False)).alias("is_symmetric"))


def slope_degrees(nz: Column) -> Column:
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(nz))))


def roof_type(slope: Column, symmetric: Column) -> Column:
    return (F.when(slope < 5, "flat").when(slope < 25, F.when(symmetric, "gable").otherwise("shed"))
            .when(slope < 45, "hip").otherwise("complex"))


def roofs(points: DataFrame, key: str, trials: int = 100, seed: int = 0) -> DataFrame:
    """Roof type and slope per object."""
    roof = cut(roof_points(points.select(key, "point_id", "x", "y", "z"), key))
    n = roof.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    best = planes.best_planes(roof, key, trials, 0.1, seed).select(key, "nz", "inliers")
    r = n.join(best, key, "left").join(roof_symmetry(roof, key), key, "left")
    slope = slope_degrees(F.coalesce(F.col("nz"), F.lit(1.0)))
    few = F.col("_n") < 20
    return r.select(key, F.when(few, "unknown").otherwise(roof_type(slope, F.col("is_symmetric"))).alias("roof_type"),
                    F.when(few, F.lit(0.0)).otherwise(slope).alias("roof_slope_deg"))


def building_clusters(points: DataFrame, eps: float = 2.0, min_samples: int = 20) -> DataFrame:
    b = points.where(F.col("classification") == 6).select("point_id", "x", "y", "z")
    return dbscan(b, eps, min_samples, ("x", "y"))


def buildings(points: DataFrame, min_area: float = 20.0, min_height: float = 2.5, clusters: DataFrame | None = None,
              seed: int = 0) -> DataFrame:
    """One row per building: footprint, height, roof, volume, floors, confidence."""
    level = reference_level(points, classes=(2,))
    c = cut(clusters if clusters is not None else building_clusters(points))
    size = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_points"), F.min("z").alias("height_min"), F.max("z").alias("height_max"))
    size = size.where(F.col("n_points") >= 20)
    foot = polygon_measures(hulls(c, "cluster"), "cluster")
    b = size.join(foot, "cluster").where(F.col("area_m2") >= min_area)
    b = b.withColumn("height", F.col("height_max") - F.lit(level)).where(F.col("height") >= min_height)
    b = b.join(roofs(c, "cluster", seed=seed), "cluster")
    return b.withColumns({
        "volume_m3": F.col("area_m2") * F.col("height"), "floor_count": floors(F.col("height")),
        "confidence": capped_ratio(F.col("n_points"), 500)}).withColumnRenamed("cluster", "building_id")


def floors(height: Column, storey: float = 3.0) -> Column:
    return F.greatest(F.lit(1), (height / F.lit(storey) + F.lit(0.5)).cast("int"))


def building_totals(b: DataFrame) -> DataFrame:
    t = lambda k: F.count(F.when(F.col("roof_type") == k, 1)).alias(f"roof_{k}")
    return b.agg(F.count(F.lit(1)).alias("total_count"), F.sum("area_m2").alias("total_area_m2"), F.sum("volume_m3").alias("total_volume_m3"),
                 F.avg("area_m2").alias("avg_area_m2"), F.avg("height").alias("avg_height_m"), F.max("height").alias("max_height_m"),
                 F.min("height").alias("min_height_m"), *[t(k) for k in ("flat", "gable", "hip", "shed", "complex", "unknown")],
                 F.count(F.when(F.col("is_rectangular"), 1)).alias("rectangular_count"), F.sum("floor_count").cast("long").alias("total_floors"))
