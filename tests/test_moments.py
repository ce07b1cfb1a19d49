"""Counts, moments and plane distances within a radius against all pairs, with a third of the rows in one cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointstrata.operators import features, neighbours, smoothing
from tests.test_limits import cloud


def crowd(n=1200):
    rng = np.random.default_rng(3)
    xyz = rng.integers(0, 12 * 1024, (n, 3)) / 1024.0 * [1, 1, 0.25]
    xyz[:n // 3] = [5, 5, 1] + rng.integers(0, 700, (n // 3, 3)) / 1024.0
    xyz[n // 3:n // 3 + 30] = xyz[:30]
    return xyz


@pytest.mark.parametrize("tile_rows", [40_000, 120])
def test_moments_equal_all_pairs(spark, tile_rows):
    xyz = crowd()
    kind = np.arange(len(xyz)) % 2
    p = cloud(spark, xyz).withColumn("kind", (F.col("point_id") % 2).cast("int"))
    pos = neighbours.positions(p, neighbours.XYZ, ("kind",))
    got = neighbours.radius_moments(pos.select("x", "y", "z", "kind"), pos, 1.0, equal=("kind",), tile_rows=tile_rows).collect()
    assert len(got) == pos.count()
    at = {(*x, k): i for i, (x, k) in enumerate(zip(map(tuple, xyz), kind.tolist()))}
    for r in got:
        i = at[r["x"], r["y"], r["z"], r["kind"]]
        off = xyz[kind == kind[i]] - xyz[i]
        off = off[(off * off).sum(axis=1) <= 1.0]
        want = [len(off), *off.sum(axis=0), *[(off[:, a] * off[:, b]).sum() for a in range(3) for b in range(a, 3)]]
        assert [r[c] for c in neighbours.MOMENTS] == want  # exact: all coordinates are multiples of 1/1024


@pytest.mark.parametrize("tile_rows", [40_000, 120])
def test_plane_distances_equal_all_pairs(spark, tile_rows):
    xyz = crowd(600)
    p = cloud(spark, xyz)
    pos = neighbours.positions(p)
    planes = pos.select("x", "y", "z", F.lit(0.6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.8).alias("nz"), (F.col("x") / 64).alias("offset"))
    for r in neighbours.plane_distances(planes, pos, 1.5, tile_rows=tile_rows).collect():
        off = xyz - [r["x"], r["y"], r["z"]]
        off = off[(off * off).sum(axis=1) <= 2.25]
        assert abs(r["m_d"] - np.abs(off @ [0.6, 0, 0.8] - r["x"] / 64).sum()) < 1e-9


def test_features_do_not_depend_on_how_tiles_are_split(spark, monkeypatch):
    p = cloud(spark, crowd(900))
    one = {r["point_id"]: r for r in features.radius_features(p).collect()}
    monkeypatch.setattr(neighbours._per_position, "__defaults__", None)
    plain = neighbours._per_position
    monkeypatch.setattr(neighbours, "_per_position", lambda *a: plain(*a[:-1], 90))
    two = {r["point_id"]: r for r in features.radius_features(p).collect()}
    assert one.keys() == two.keys() and all(abs(one[i][c] - two[i][c]) < 1e-9 for i in one for c in features.SHAPE)


def test_isolated_points_take_the_majority(spark):
    xyz = crowd(600)
    p = cloud(spark, xyz).withColumn("classification", F.when(F.col("point_id") % 7 == 0, 6).otherwise(2 + F.col("point_id") % 3).cast("int"))
    cls = {r["point_id"]: r["classification"] for r in p.collect()}
    c = np.array([cls[i] for i in range(len(xyz))])
    for r in smoothing.drop_isolated(p, 6, 4, 1.0).collect():
        i = r["point_id"]
        near = ((xyz - xyz[i]) ** 2).sum(axis=1) <= 1.0
        votes = {k: int((near & (c == k)).sum()) for k in (2, 3, 4)}
        want = c[i]
        if c[i] == 6 and (near & (c == 6)).sum() < 4 and max(votes.values()):
            want = min(k for k in votes if votes[k] == max(votes.values()))
        assert r["new_class"] == want
    assert smoothing.drop_isolated(p.where("classification = 6"), 6, 10).where("new_class <> 6").count() == 0
