"""Work that is done in one pass or on the smaller side: ground tiles, tile files, growing regions."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointstrata.operators import ground, smoothing
from pointstrata.operators.cells import extent, with_cell
from pointstrata.sources import points as pts


def _rough(spark, seed):
    """A sloping patch with boxes and holes, a third of the rows in one cell, and a cell without heights."""
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(-150, 150, 4000), rng.uniform(-40, 40, 4000)
    z = 100 + 0.05 * x + np.where((np.abs(x) % 40 < 9) & (np.abs(y) < 20), 6.0, 0.0) + rng.uniform(0, 0.4, 4000)
    rows = [*zip(x.tolist(), y.tolist(), z.tolist()), *[(3.2, 3.2, 101.0)] * 2000, (7.5, 39.9, None), (200.0, 200.0, 90.0)]
    return spark.createDataFrame(rows, "x double, y double, z double")


def _rounds(cells, params):
    """The surface by comparing all cells, window after window."""
    at = np.array(list(cells))
    h = np.array([np.nan if v is None else v for v in cells.values()])
    for reach, step in ground._reaches(params):
        near = (np.abs(at[:, None] - at[None]) <= reach).all(axis=2)
        low = np.where(near, np.where(np.isnan(h), np.inf, h), np.inf).min(axis=1)
        o = np.where(near & (low < np.inf), low, -np.inf).max(axis=1)
        h = np.where(h - o > step, o, h)
    return {c: None if np.isnan(v) else v for c, v in zip(cells, h.tolist())}


@pytest.mark.parametrize("window", [3.0, 16.0])
def test_ground_tiles_equal_all_windows(spark, window):
    points = _rough(spark, 5)
    params, ext = ground.GroundParams(1.0, 2, 0.5, window), extent(points)
    tiled = ground.ground_surface(points, ext, params)
    assert "FlatMapGroupsInArrow" in tiled._jdf.queryExecution().optimizedPlan().toString()
    cells = {(int(r.ix), int(r.iy)): r.h for r in with_cell(points, ext, 1.0, extra=1).groupBy("ix", "iy").agg(F.min("z").alias("h")).collect()}
    got = {(r.ix, r.iy): r.surface for r in tiled.collect()}
    assert got == _rounds(cells, params) and len(got) > 3000


def test_a_tile_is_one_file_unless_crowded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pts, "TILE_FILE_ROWS", 500)
    rows = spark.range(3000).select(F.col("id").alias("point_id"), (F.col("id") % 7).cast("double").alias("x"), F.lit(0.0).alias("y"),
                                    F.when(F.col("id") < 2000, 1).when(F.col("id") < 2990, F.col("id") % 20 + 2).alias("tile_id"))
    pts.write_tiles(rows, f"{tmp_path}/t")
    files = {d.split("tile_id=")[1]: len(glob.glob(d + "/*.parquet")) for d in glob.glob(f"{tmp_path}/t/tile_id=*")}
    crowded = files.pop("1")
    assert 2 <= crowded <= 4 and set(files.values()) == {1} and len(files) == 21
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == 3000 and back.columns == ["point_id", "x", "y", "tile_id"]


def test_growing_copies_the_wave_only(spark, monkeypatch):
    """The points that are not reached yet are not copied to 27 cells in every round."""
    n, seen = 400, []
    pairs = smoothing.radius_pairs
    monkeypatch.setattr(smoothing, "radius_pairs", lambda left, right, *a, **b: (seen.append(left.count()), pairs(left, right, *a, **b))[1])
    far = [(i, 0.9 * i if i < 4 else 500.0 + 3 * i, 0.0, 0.0, 30 if i == 0 else 2) for i in range(n)]
    grown = smoothing.grow_regions(spark.createDataFrame(far, "point_id long, x double, y double, z double, classification int"), 30, 2, 1.0)
    assert sorted(r.point_id for r in grown.where("new_class = 30").collect()) == [0, 1, 2, 3]
    assert seen == [1, 1, 1, 1]
