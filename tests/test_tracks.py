"""Tracks in their own frame: curves, parallel tracks, lines in any direction, rings."""

import math

import numpy as np
from pyspark.sql import functions as F

from pointstrata.operators import railway, tracks
from pointstrata.session import cut

KEYS = ("track", "segment")


def rails_of(line, normal, s, z=None):
    """Points of both rails of a centre line: (x, y, z, s, side) with side by the offset from the line."""
    out = []
    for sign in (-1, 1):
        p = line + sign * railway.GAUGE / 2 * normal
        out += [(x, y, 0.0 if z is None else z[i], s[i], "right" if sign > 0 else "left") for i, (x, y) in enumerate(p)]
    return out


def arc(radius, start, length, step=0.5, centre=(0.0, 0.0)):
    s = np.arange(0, length, step)
    a = start + s / radius
    normal = np.column_stack((-np.cos(a), -np.sin(a)))  # to the left of counter-clockwise motion
    return np.column_stack((radius * np.cos(a), radius * np.sin(a))) + np.array(centre), normal, s


def straight(origin, angle, length, step=0.5):
    s = np.arange(0, length, step)
    d = np.array([math.cos(angle), math.sin(angle)])
    return np.array(origin) + s[:, None] * d, np.tile([-d[1], d[0]], (len(s), 1)), s


def scene(spark, *lines, seed=0):
    """Points of several lines in random order; ``line`` and ``s`` are the truth."""
    rows = [(k, *r) for k, line in enumerate(lines) for r in rails_of(*line)]
    order = np.random.default_rng(seed).permutation(len(rows))
    data = [(i, *rows[j]) for i, j in enumerate(order.tolist())]
    data = [(int(i), int(k), float(x), float(y), float(z), float(s), side) for i, k, x, y, z, s, side in data]
    return spark.createDataFrame(data, "point_id long, line int, x double, y double, z double, s double, truth string").withColumn("classification", F.lit(18))


def against_truth(p, placed=None):
    placed = tracks.along_track(p) if placed is None else placed
    got = placed.join(p.select("point_id", "line", "s", "truth"), "point_id").toPandas()
    for line, rows in got.groupby("line"):
        assert rows["track"].nunique() == 1
        up = np.corrcoef(rows["s"], rows["chainage"])[0, 1] > 0
        s = rows["s"] if up else rows["s"].max() - rows["s"]
        assert np.abs(rows["chainage"] - s).max() < 0.6, (line, np.abs(rows["chainage"] - s).max())
        flip = rows["truth"] == rows["side"]
        assert flip.all() or not flip.any()  # sides are those of the chosen direction
        assert (rows["segment"] == np.floor(rows["chainage"] / 50)).all() and rows["segment"].min() == 0
    assert got.groupby("track")["line"].nunique().max() == 1
    return got


def test_curve_and_parallel_track_get_their_own_frames(spark):
    p = scene(spark, arc(400, 0.3, 320), arc(404.2, 0.3, 320 * 404.2 / 400), straight((3000, 50), 2.5, 330), straight((900, -800), -math.pi / 2, 230))
    placed = cut(tracks.along_track(p))
    got = against_truth(p, placed)
    assert got.groupby("line")["point_id"].count().to_dict() == p.groupBy("line").count().toPandas().set_index("line")["count"].to_dict()
    segments = cut(railway.track_segments(p, axes=railway.two_sided(placed, KEYS, 50), keys=KEYS, order=("chainage",)))
    seg = segments.toPandas()
    line_of = got.groupby("track")["line"].first()
    seg["line"] = seg["track"].map(line_of)
    full = seg[seg.groupby("track")["segment"].transform("max") != seg["segment"]]
    assert np.abs(full["length"] - 49.5).max() < 1.2 and np.abs(full["gauge"] - railway.GAUGE).max() < 1e-3
    curved = full[full["line"] < 2]
    assert (curved["geometry_type"] == "curve").all() and np.abs(1 / curved["curvature"] - 402).max() < 12
    assert (full[full["line"] >= 2]["geometry_type"] == "straight").all()
    geo = railway.track_geometry(segments, within=("track",)).toPandas()
    assert (geo[geo["segment"] == 0]["km_start"].abs() < 1e-9).all() and geo.groupby("track")["km_end"].max().max() < 0.7


def test_ring_is_opened_once(spark):
    p = scene(spark, arc(60, 0.0, 2 * math.pi * 60 - 0.5))
    got = tracks.along_track(p).toPandas()
    assert got["track"].nunique() == 1 and len(got) == p.count()
    assert abs(got["chainage"].max() - 2 * math.pi * 60) < 8 and got["segment"].max() == 7


def test_gap_splits_and_lone_rail_is_no_track(spark):
    p = scene(spark, straight((0, 0), 0.2, 120), straight((150, 30), 0.2, 120))
    lone = spark.range(200).select((F.col("id") + 100_000).alias("point_id"), F.lit(9).alias("line"), (F.col("id") * 0.5).alias("x"), F.lit(500.0).alias("y"),
                                   F.lit(0.0).alias("z"), F.lit(0.0).alias("s"), F.lit("left").alias("truth"), F.lit(18).alias("classification"))
    got = against_truth(p.unionByName(lone))
    assert sorted(got["line"].unique()) == [0, 1] and got["track"].nunique() == 2
    assert tracks.along_track(p.limit(0)).collect() == []
