"""Planes across tiles: limits hold for the joined plane, every trial is counted on all points."""

import numpy as np
import pytest

from pointstrata.operators import planes


def cloud(spark, *groups):
    """Points of several arrays (n, 3), numbered in order."""
    xyz = np.concatenate(groups)
    rows = [(i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(xyz)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double")


def sheet(rng, n, x, y, height, noise=0.02):
    p = np.column_stack((rng.uniform(*x, n), rng.uniform(*y, n), np.zeros(n)))
    p[:, 2] = height(p[:, 0], p[:, 1]) + rng.uniform(-noise, noise, n)
    return p


def test_roof_cut_by_a_tile_border_is_one_plane_at_default_limits(spark):
    rng = np.random.default_rng(1)
    slope = lambda x, y: 8 + 0.2 * x
    roof = np.concatenate((sheet(rng, 7000, (20, 64), (5, 45), slope), sheet(rng, 5000, (64, 95), (5, 45), slope)))
    lawn = sheet(rng, 9000, (0, 128), (60, 127), lambda x, y: 0 * x)  # one plane below the limit
    clutter = np.column_stack((rng.uniform(0, 128, 1500), rng.uniform(0, 128, 1500), rng.uniform(0, 40, 1500)))
    got = planes.extract_planes(cloud(spark, roof, lawn, clutter), trials=200).collect()
    assert {r["plane"] for r in got} == {0} and {r["kind"] for r in got} == {"roof"}
    hit = {r["point_id"] for r in got}
    assert len(hit & set(range(12000))) == 12000 and len(hit) < 12150  # and what lies in the plane by chance
    assert abs(abs(got[0]["normal_z"]) - 1 / np.sqrt(1.04)) < 1e-3


def test_pieces_at_other_heights_or_too_far_stay_apart(spark):
    rng = np.random.default_rng(2)
    a = sheet(rng, 600, (0, 60), (0, 60), lambda x, y: 10 + 0 * x)
    b = sheet(rng, 500, (66, 120), (0, 60), lambda x, y: 11 + 0 * x)
    c = sheet(rng, 400, (66, 120), (66, 120), lambda x, y: 10 + 0 * x)
    p = cloud(spark, a, b, c)
    sizes = lambda **o: sorted(p for p in planes.extract_planes(cloud(spark, a, b, c), trials=60, **o).groupBy("plane").count().toPandas()["count"])
    assert sizes(min_points=300) == [500, 1000]  # the same plane in neighbouring tiles is one
    assert sizes(min_points=300, reach=2.0) == [400, 500, 600]  # boxes 8.5 m apart
    assert sizes(min_points=300, max_planes=1) == [1000]
    assert sizes(min_points=300, max_planes=None) == [500, 1000]
    assert planes.extract_planes(p.limit(0), planes.extent(p)).collect() == []


def test_slivers_in_a_neighbouring_tile_follow_the_plane(spark):
    rng = np.random.default_rng(3)
    roof = sheet(rng, 800, (10, 63.5), (10, 40), lambda x, y: 6 + 0 * x)
    sliver = sheet(rng, 12, (64.1, 64.9), (10, 40), lambda x, y: 6 + 0 * x)
    far = np.array([[0.0, 0.0, 0.0], [128.0, 64.0, 0.0]])
    got = planes.extract_planes(cloud(spark, roof, sliver, far), min_points=500, trials=60).collect()
    assert {r["point_id"] for r in got} == set(range(812))


def plain_best(xyz, ids, order, trials, threshold):
    xyz = xyz[order][:3 * trials]
    best = (-1, None)
    for t in range(len(xyz) // 3):
        a, b, c = xyz[3 * t:3 * t + 3]
        n = np.cross(b - a, c - a)
        if np.linalg.norm(n) < 1e-8:
            continue
        n /= np.linalg.norm(n)
        hits = int((np.abs((ids - a) @ n) < threshold).sum())
        if hits > best[0]:
            best = (hits, n)
    return best


@pytest.mark.parametrize("chunk", [50_000, 37])
def test_every_trial_counts_all_points(spark, chunk):
    """A third of the rows in one group; chunks do not change the winner."""
    from pyspark.sql import functions as F

    from pointstrata.functions.hashing import hash_key

    rng = np.random.default_rng(4)
    xyz = np.column_stack((rng.uniform(0, 9, (900, 2)), rng.integers(0, 3, 900) + rng.uniform(-0.05, 0.05, 900)))
    p = cloud(spark, xyz).withColumn("g", F.when(F.col("point_id") < 300, 0).otherwise(1 + F.col("point_id") % 40).cast("long"))
    p = p.withColumn("h", hash_key(F.col("point_id"), 0))
    planes_of = planes.packed.__defaults__
    planes.packed.__defaults__ = (planes_of[0], chunk)
    try:
        got = {r["g"]: r for r in planes.best_planes(p, "g", 50, 0.1).collect()}
    finally:
        planes.packed.__defaults__ = planes_of
    pdf = p.toPandas()
    for g, rows in pdf.groupby("g"):
        own = rows[["x", "y", "z"]].to_numpy()
        order = np.lexsort((rows["point_id"].to_numpy(), rows["h"].to_numpy()))
        hits, n = plain_best(own, own, order, 50, 0.1)
        assert got[g]["inliers"] == hits and abs(abs(got[g]["nz"]) - abs(n[2])) < 1e-9
