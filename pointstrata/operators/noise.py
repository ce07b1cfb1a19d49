"""Noise detection: statistical, radius, voxel-accelerated and cell density."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import cells
from .neighbours import nearest, radius_count


def mean_distance(points: DataFrame, k: int, id_col: str = "point_id") -> DataFrame:
    """Mean distance to the k nearest other points."""
    near = nearest(points, points, k, query_id=id_col, data_id=id_col, exclude_self=True)
    total = F.aggregate("nd", F.lit(0.0), lambda a, b: a + b)
    return near.select(id_col, F.when(F.size("nd") > 0, total / F.size("nd")).otherwise(F.lit(0.0)).alias("mean_dist"))


def distance_threshold(mean_dist: DataFrame, std_ratio: float, sample: int | None = None) -> float:
    """mean + ratio * population deviation over all rows (or a hash sample of them)."""
    d = mean_dist
    if sample:
        from .sampling import hash_sample
        d = hash_sample(d, sample, id_col=d.columns[0])
    r = d.agg(F.avg("mean_dist").alias("m"), F.stddev_pop("mean_dist").alias("s")).first()
    return (r.m or 0.0) + std_ratio * (r.s or 0.0)


def sor(points: DataFrame, k: int = 30, std_ratio: float = 2.0, sample: int | None = None) -> DataFrame:
    """(point_id, mean_dist, is_noise) by statistical outlier removal."""
    d = cut(mean_distance(points, k))
    limit = distance_threshold(d, std_ratio, sample)
    return d.withColumn("is_noise", F.col("mean_dist") > F.lit(limit))


def radius_noise(points: DataFrame, radius: float = 1.0, min_neighbors: int = 5) -> DataFrame:
    """(point_id, is_noise): fewer than ``min_neighbors`` others within the radius.

    A cell whose diagonal is the radius and that holds enough points settles
    all of them at once; only points of thin cells look at their neighbours.
    """
    side = radius / math.sqrt(3.0)
    keys = ["_a", "_b", "_c"]
    p = points.select("point_id", "x", "y", "z",
                      *[F.floor(F.col(d) / F.lit(side)).cast("long").alias(k) for d, k in zip("xyz", keys)])
    full = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sized = p.join(full, keys)
    thin = sized.where(F.col("_n") <= min_neighbors).select("point_id", "x", "y", "z")
    counted = radius_count(thin, points, radius).select(
        "point_id", (F.col("n_near") - 1 < min_neighbors).alias("is_noise"))
    clear = sized.where(F.col("_n") > min_neighbors).select("point_id", F.lit(False).alias("is_noise"))
    return clear.unionByName(counted)


def voxel_sor(points: DataFrame, voxel: float = 0.5, k: int = 30, std_ratio: float = 2.0) -> DataFrame:
    """Points with ``is_noise``: SOR over voxel centroids, carried back to the points.

    Only voxels above the threshold travel back, so the join side is small.
    """
    cen = cells.voxel_centroids(points, voxel).withColumn("voxel_id", F.xxhash64("vx", "vy", "vz"))
    cen = cut(cen)
    d = cut(mean_distance(cen.select("voxel_id", "x", "y", "z"), k, "voxel_id"))
    limit = distance_threshold(d, std_ratio)
    bad = d.where(F.col("mean_dist") > F.lit(limit)).join(cen, "voxel_id").select("vx", "vy", "vz", F.lit(True).alias("is_noise"))
    return (cells.with_voxel(points, voxel).join(bad, ["vx", "vy", "vz"], "left")
            .withColumn("is_noise", F.coalesce("is_noise", F.lit(False))).drop("vx", "vy", "vz"))


def grid_density_noise(points: DataFrame, size: float = 0.5, min_points: int = 3) -> DataFrame:
    """Points with ``is_noise``: the voxel holds fewer than ``min_points`` points."""
    keys = ["vx", "vy", "vz"]
    keyed = cells.with_voxel(points, size)
    thin = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < min_points)
    return (keyed.join(thin.select(*keys, F.lit(True).alias("is_noise")), keys, "left")
            .withColumn("is_noise", F.coalesce("is_noise", F.lit(False))).drop(*keys))


def noise_statistics(points: DataFrame, is_noise: Column) -> DataFrame:
    n = F.count(F.lit(1))
    bad = F.count(F.when(is_noise, 1))
    z = F.when(is_noise, F.col("z"))
    return points.agg(n.alias("n_points"), bad.alias("n_noise"), (n - bad).alias("n_valid"),
                      (bad / n * 100).alias("noise_pct"), F.avg(z).alias("noise_z_mean"),
                      F.stddev_pop(z).alias("noise_z_std"))


def choose_detector(n_points: int) -> str:
    """The published size rule, for reports; the plans name their method themselves."""
    return "sor" if n_points < 10_000_000 else "voxel_sor"


def detect(points: DataFrame, method: str = "sor", k: int = 30, std_ratio: float = 2.0, voxel: float = 0.5) -> DataFrame:
    """Points with ``is_noise`` by the named method, at every size alike."""
    if method == "voxel_sor":
        return voxel_sor(points, voxel, k, std_ratio)
    if method != "sor":
        raise ValueError(f"unknown noise method {method!r}")
    bad = sor(points, k, std_ratio).where("is_noise").select("point_id", "is_noise")
    return points.join(bad, "point_id", "left").withColumn("is_noise", F.coalesce("is_noise", F.lit(False)))
