"""Neighbourhood features: PCA shape, density, height spread, model feature table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.eigen import with_covariance, with_eigen3
from ..session import cut
from . import cells
from .cells import Extent, extent
from .neighbours import XYZ, nearest, plane_distances, radius_count, radius_moments

EPS = 1e-8
SHAPE = ("planarity", "linearity", "sphericity", "verticality", "horizontality", "roughness", "height_variance", "density")


def radius_features(points: DataFrame, radius: float = 1.0, min_neighbours: int = 10, within: tuple[str, ...] = ()) -> DataFrame:
    """Points plus PCA features of the neighbours within ``radius`` (itself included).

    Works on distinct positions with weights.  Moments are sums of offsets from
    the query point; a second search sums the distances from the fitted planes.
    ``within`` restricts neighbours to the same tile.
    """
    key = [*XYZ, *within]
    pos = cut(points.groupBy(*key).agg(F.count(F.lit(1)).alias("w")))
    m = with_eigen3(with_covariance(radius_moments(pos, pos, radius, equal=within).where(F.col("m_n") >= min_neighbours)))
    offset = sum((F.col(f"m_{a}") / F.col("m_n") * F.col(f"n{a}") for a in "xyz"), F.lit(0.0))
    m = cut(m.select(*key, "m_n", "l1", "l2", "l3", "nx", "ny", "nz", "czz", offset.alias("offset")))
    flat = plane_distances(m, pos, radius, within).join(m.select(*key, "m_n"), key).select(*key, (F.col("m_d") / F.col("m_n")).alias("_ad"))
    den = F.col("l1") + F.lit(EPS)
    feats = m.join(flat, key).select(
        *key,
        ((F.col("l2") - F.col("l3")) / den).alias("planarity"), ((F.col("l1") - F.col("l2")) / den).alias("linearity"),
        (F.col("l3") / den).alias("sphericity"), (F.lit(1.0) - F.abs("nz")).alias("verticality"),
        F.abs("nz").alias("horizontality"),
        F.sqrt(F.greatest(F.col("l3") - F.col("_ad") * F.col("_ad"), F.lit(0.0))).alias("roughness"),
        F.sqrt("czz").alias("height_variance"),
        (F.col("m_n") / F.lit(4.0 / 3.0 * math.pi * radius ** 3)).alias("density"),
        F.col("nx").alias("normal_x"), F.col("ny").alias("normal_y"), F.col("nz").alias("normal_z"))
    out = points.join(feats, key, "left")
    return out.na.fill(0.0, [*SHAPE, "normal_x", "normal_y", "normal_z"])


def default_fill(points: DataFrame, sampled: Column, ext_std: float) -> DataFrame:
    """Constants for points outside the sample, chosen by the spread of z."""
    steep = ext_std > 5.0
    fill = {"verticality": 0.5, "linearity": 0.3} if steep else {"horizontality": 0.5, "planarity": 0.3}
    return points.withColumns({c: F.when(sampled, F.col(c)).otherwise(F.lit(v)) for c, v in fill.items()})


def _fold(arr: str) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, b: a + b)


def _shifted(arr: str, origin: Column) -> Column:
    return F.transform(arr, lambda v: v - origin)


def array_moments(near: DataFrame, xs: str = "n_x", ys: str = "n_y", zs: str = "n_z") -> DataFrame:
    """Moment sums over neighbour arrays, relative to the first neighbour."""
    first = {a: F.element_at(c, 1) for a, c in zip("xyz", (xs, ys, zs))}
    d = {f"_{a}": _shifted(c, first[a]) for a, c in zip("xyz", (xs, ys, zs))}
    near = near.withColumns(d)
    prod = lambda p, q: F.aggregate(F.zip_with(f"_{p}", f"_{q}", lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    out = {"m_n": F.size(xs).cast("double")}
    out |= {f"m_{a}": _fold(f"_{a}") for a in "xyz"}
    out |= {f"m_{p}{q}": prod(p, q) for p, q in ("xx", "yy", "zz", "xy", "xz", "yz")}
    return near.withColumns(out).drop("_x", "_y", "_z")


def knn_shape(points: DataFrame, k: int = 30, near: DataFrame | None = None) -> DataFrame:
    """(point_id, linearity, planarity, sphericity, verticality, normal_z, z_var) over k neighbours (self excluded)."""
    near = near if near is not None else nearest(points, points, k, carry=XYZ, exclude_self=True)
    m = with_eigen3(with_covariance(array_moments(near), sample=True))
    fl = lambda c: F.greatest(F.col(c), F.lit(1e-10))
    return m.select(
        "point_id", ((fl("l1") - fl("l2")) / fl("l1")).alias("linearity"), ((fl("l2") - fl("l3")) / fl("l1")).alias("planarity"),
        (fl("l3") / fl("l1")).alias("sphericity"), (F.lit(1.0) - F.abs("nz")).alias("verticality"), F.abs("nz").alias("normal_z"),
        F.when(F.col("m_n") > 1, F.greatest(F.col("m_zz") / F.col("m_n") - (F.col("m_z") / F.col("m_n")) ** 2, F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("z_var"))


def planarity_mask(points: DataFrame, k: int = 30, threshold: float = 0.7, min_hag: float = 2.0) -> DataFrame:
    """(point_id, planarity, is_planar) for points high above ground; the point is one of its k neighbours."""
    near = nearest(points.where(F.col("hag") >= min_hag), points, k, carry=XYZ)
    m = with_eigen3(with_covariance(array_moments(near)), normal=False)
    m = m.withColumn("planarity", (F.col("l2") - F.col("l3")) * F.col("m_n") / (F.col("l1") * F.col("m_n") + F.lit(EPS)))
    return m.select("point_id", "planarity", (F.col("planarity") > threshold).alias("is_planar"))


def surface_roughness(points: DataFrame, k: int = 10) -> DataFrame:
    """Mean over all points of the deviation of plane distances among k neighbours (one row)."""
    near = nearest(points, points, k, carry=XYZ, exclude_self=True)
    m = with_eigen3(with_covariance(array_moments(near)))
    first = {a: F.element_at(f"n_{a}", 1) for a in "xyz"}
    dist = F.transform(F.arrays_zip("n_x", "n_y", "n_z"), lambda p: F.abs(
        sum(((p[f"n_{a}"] - first[a] - F.col(f"m_{a}") / F.col("m_n")) * F.col(f"n{a}") for a in "xyz"), F.lit(0.0))))
    m = m.withColumn("_d", dist)
    mean = _fold("_d") / F.col("m_n")
    rough = F.sqrt(F.greatest(F.col("l3") - mean * mean, F.lit(0.0)))
    return m.agg(F.coalesce(F.avg(rough), F.lit(0.0)).alias("roughness"))


def local_density(points: DataFrame, radius: float = 1.0) -> DataFrame:
    """Points with ``density`` = neighbours within radius over the largest such count."""
    c = cut(radius_count(points, points, radius))
    top = c.agg(F.max("n_near")).first()[0] or 1
    return c.withColumn("density", F.col("n_near") / F.lit(float(top))).drop("n_near")


def hag_nearest(points: DataFrame, ground: DataFrame | None) -> DataFrame:
    """(point_id, height_above_ground): z over the nearest ground point in XY, not below 0."""
    if ground is None or ground.isEmpty():
        low = cells.quantiles(points, "z", [0.05])[0]
        return points.select("point_id", F.greatest(F.col("z") - F.lit(low), F.lit(0.0)).alias("height_above_ground"))
    near = nearest(points, ground, 1, dims=("x", "y"), carry=("z",))
    return points.select("point_id", "z").join(near, "point_id").select(
        "point_id", F.greatest(F.col("z") - F.element_at("n_z", 1), F.lit(0.0)).alias("height_above_ground"))


FEATURES = ["height_above_ground", "z_normalized", "linearity", "planarity", "sphericity", "verticality", "normal_z",
            "density", "height_variance", "intensity", "red", "green", "blue"]


def feature_table(points: DataFrame, k: int = 30, ground: Column | None = None, ext: Extent | None = None) -> DataFrame:
    """Points plus the model features; neighbour lists are computed once."""
    ext = ext or extent(points)
    g = points.where(ground) if ground is not None else None
    shape = cut(knn_shape(points, k))
    top = shape.agg(F.max("z_var")).first()[0] or 0.0
    zn = (F.col("z") - F.lit(ext.z_min)) / F.lit(ext.depth + 1e-6)
    shape = shape.withColumn("height_variance", F.col("z_var") / F.lit(top + 1e-6)).drop("z_var")
    return (local_density(points).join(shape, "point_id").join(hag_nearest(points, g), "point_id").withColumn("z_normalized", zn))


def normalised_coordinates(points: DataFrame, ext: Extent | None = None) -> DataFrame:
    """Coordinates scaled to [-1, 1] per axis; an axis without range keeps divisor 1."""
    ext = ext or extent(points)
    spans = {"x": (ext.x_min, ext.width), "y": (ext.y_min, ext.height), "z": (ext.z_min, ext.depth)}
    return points.withColumns({
        a: F.lit(2.0) * (F.col(a) - F.lit(lo)) / F.lit(r if r > 0 else 1.0) - F.lit(1.0) for a, (lo, r) in spans.items()})


def augment(points: DataFrame, seed: int = 0) -> DataFrame:
    """Rotate about z by one angle per block, jitter, scale; all amounts follow from hashes of ids."""
    from ..functions.hashing import unit_hash
    angle = unit_hash(F.col("chunk_id"), seed) * F.lit(2 * math.pi)
    scale = F.lit(0.9) + F.lit(0.2) * unit_hash(F.col("chunk_id"), seed + 1)
    c, s = F.cos(angle), F.sin(angle)

    def jitter(i: int) -> Column:
        u, v = unit_hash(F.col("point_id"), seed + 2 + 2 * i), unit_hash(F.col("point_id"), seed + 3 + 2 * i)
        return F.lit(0.01) * F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)

    return points.withColumns({
        "x": (F.col("x") * c - F.col("y") * s + jitter(0)) * scale, "y": (F.col("x") * s + F.col("y") * c + jitter(1)) * scale,
        "z": (F.col("z") + jitter(2)) * scale})
