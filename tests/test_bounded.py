"""Nearest rows within a radius against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointstrata.operators import neighbours


@pytest.mark.parametrize("tile_rows", [40_000, 150])
def test_nearest_within_equals_all_distances(spark, tile_rows):
    rng = np.random.default_rng(1)
    xyz = rng.uniform(-20, 20, (1500, 3))
    xyz[:500] = [5, 5, 5] + rng.uniform(0, 0.4, (500, 3))  # a third in one place
    xyz[500:520] = xyz[520:540]  # the same positions again
    kind = rng.integers(0, 3, 1500)
    df = spark.createDataFrame([(i, *map(float, p), int(k)) for i, (p, k) in enumerate(zip(xyz, kind))], "point_id long, x double, y double, z double, kind int")
    sides = [df.where(F.col("kind") != k).withColumn("pair", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("reach", F.element_at(F.array(F.lit(1.5), F.lit(4.0)), F.col("pair") + 1)) for k in (0, 1)]
    got = {(r["pair"], r["point_id"]): (r["dist"], r["n_id"], r["n_kind"], r["x"]) for r in neighbours.nearest_within(
        *sides, "reach", equal=("pair",), carry=("kind",), keep=("x",), tile_rows=tile_rows).collect()}
    want = {}
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    right = np.flatnonzero(kind != 1)
    for pair, r in enumerate((1.5, 4.0)):
        for i in np.flatnonzero(kind != 0):
            j = right[np.lexsort((right, d2[i, right]))[0]]
            if d2[i, j] < r * r:
                want[pair, int(i)] = (np.sqrt(d2[i, j]), int(j), int(kind[j]), xyz[i, 0])
    assert got.keys() == want.keys()
    assert all(got[k][1:] == want[k][1:] and abs(got[k][0] - want[k][0]) < 1e-12 for k in want)


def test_nothing_in_reach(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 3.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    a, b = df.where("point_id = 1"), df.where("point_id = 2")
    assert neighbours.nearest_within(a, b, 3.0).collect() == []  # strictly within
    assert [tuple(r) for r in neighbours.nearest_within(a, b, 3.5).collect()] == [(1, 3.0, 2)]
    assert neighbours.nearest_within(a, b.limit(0), 3.5).collect() == [] and neighbours.nearest_within(a.limit(0), b, 3.5).collect() == []
