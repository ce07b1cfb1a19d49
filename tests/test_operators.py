"""Operators against brute force and hand-made scenes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointstrata.functions.eigen import moments, with_covariance, with_eigen3
from pointstrata.operators import cells, cluster, findings, ground, learning, noise, railway, raster, rules, shapes, smoothing
from pointstrata.operators import neighbours as nb
from pointstrata.sources import las


def frame(spark, xyz, cls=1, **extra):
    xyz = np.asarray(xyz, float)
    cls = np.broadcast_to(cls, len(xyz))
    cols = {"red": 0.5, "green": 0.47, "blue": 0.5, "intensity": 0.5} | extra
    rows = [(int(i), 0, *map(float, p), *[float(np.broadcast_to(v, len(xyz))[i]) for v in cols.values()], int(c))
            for i, (p, c) in enumerate(zip(xyz, cls))]
    return spark.createDataFrame(rows, "point_id long, chunk_id long, x double, y double, z double, "
                                 + ", ".join(f"{k} double" for k in cols) + ", classification int")


def brute(x, q, k, skip_self):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    o = np.lexsort((np.arange(len(x)), d))
    return [i for i in o if not (skip_self and i == q)][:k]


def check_knn(spark, x, k, **kw):
    p = frame(spark, x)
    got = {r.point_id: r for r in nb.nearest(p, p, k, exclude_self=True, **kw).collect()}
    assert len(got) == len(x)
    for q in range(0, len(x), max(1, len(x) // 60)):
        want = brute(np.asarray(x), q, k, True)
        assert list(got[q].nid) == want
        assert np.allclose(got[q].nd, np.sqrt(((x[want] - x[q]) ** 2).sum(1)))


def test_nearest_uniform(spark):
    check_knn(spark, np.random.default_rng(1).uniform(0, 100, (1000, 3)), 7)


def test_nearest_third_of_rows_are_copies(spark):
    x = np.random.default_rng(2).uniform(0, 50, (900, 3))
    x[::3] = (7.0, 7.0, 7.0)
    check_knn(spark, x, 5, tile_rows=100)


def test_nearest_hot_cell(spark):
    x = np.random.default_rng(3).uniform(0, 50, (900, 3))
    x[::3] = 20 + np.random.default_rng(4).uniform(0, 0.01, (300, 3))
    check_knn(spark, x, 5, tile_rows=100)


def test_nearest_fewer_rows_than_k(spark):
    p = frame(spark, [(0, 0, 0), (1, 0, 0), (5, 5, 5)])
    assert sorted(len(r.nid) for r in nb.nearest(p, p, 10, exclude_self=True).collect()) == [2, 2, 2]


def test_radius_count_with_copies(spark):
    x = np.random.default_rng(5).uniform(0, 10, (400, 3))
    x[::4] = (5, 5, 5)
    got = dict(nb.radius_count(frame(spark, x), frame(spark, x), 1.5).select("point_id", "n_near").collect())
    want = (((x[:, None] - x[None]) ** 2).sum(2) <= 1.5 ** 2).sum(1)
    assert [got[i] for i in range(len(x))] == want.tolist()


def brute_dbscan(x, eps, m):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= m
    lab = np.full(len(x), -1)
    for i in np.nonzero(core)[0]:
        if lab[i] >= 0:
            continue
        stack, lab[i] = [i], i
        while stack:
            j = stack.pop()
            for t in np.nonzero(near[j] & core & (lab < 0))[0]:
                lab[t] = i
                stack.append(t)
    for i in np.nonzero(~core)[0]:
        c = lab[near[i] & core]
        lab[i] = c.min() if len(c) else -1
    return lab


@pytest.mark.parametrize("dims", [("x", "y"), ("x", "y", "z")])
def test_dbscan(spark, dims):
    r = np.random.default_rng(6)
    x = np.vstack([r.normal((10, 10, 2), 0.4, (150, 3)), r.normal((13, 10, 2), 0.5, (100, 3)), r.uniform(0, 25, (150, 3)),
                   np.tile((20.0, 20.0, 2.0), (100, 1)), 5 + r.uniform(0, 0.05, (100, 3))])
    got = dict(cluster.dbscan(frame(spark, x), 0.9, 5, dims).select("point_id", "cluster").collect())
    want = brute_dbscan(x[:, : len(dims)], 0.9, 5)
    assert {i: int(v) for i, v in enumerate(want) if v >= 0} == got


def test_chain_just_below_and_above_eps(spark):
    x = np.array([(i * 0.99, 0, 0) for i in range(30)] + [(100 + i * 1.01, 0, 0) for i in range(30)])
    c = cluster.dbscan(frame(spark, x), 1.0, 2)
    assert c.count() == 30 and c.select("cluster").distinct().count() == 1


def test_components_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    v = spark.createDataFrame([(i,) for i in [*range(201), 500, 501, 900]], "v long")
    got = dict(cluster.connected_components(e, v).collect())
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and got[900] == 900


def test_order_statistics(spark):
    v = np.concatenate([np.random.default_rng(7).normal(0, 1, 500), np.full(300, 0.25), [1e9, -1e9]])
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    qs = [0.0, 0.05, 0.3, 0.5, 0.9, 1.0]
    assert np.allclose(cells.quantiles(df, "v", qs), np.quantile(v, qs))


def test_eigen_against_numpy(spark):
    r = np.random.default_rng(8)
    groups = [r.normal(0, s, (40, 3)) @ np.linalg.qr(r.normal(size=(3, 3)))[0] for s in [(3, 2, 1), (5, 1, 0.1), (1, 1, 0.01)]]
    rows = [(g, *map(float, p)) for g, pts in enumerate(groups) for p in pts]
    df = spark.createDataFrame(rows, "g int, x double, y double, z double")
    e = with_eigen3(with_covariance(df.groupBy("g").agg(*moments("x", "y", "z"))), axis=True)
    for row in e.collect():
        w, v = np.linalg.eigh(np.cov(groups[row.g].T, bias=True))
        assert np.allclose([row.l3, row.l2, row.l1], w, rtol=1e-6)
        assert abs(np.dot((row.nx, row.ny, row.nz), v[:, 0])) > 1 - 1e-6
        assert abs(np.dot((row.ax, row.ay, row.az), v[:, 2])) > 1 - 1e-6


def test_gap_fill(spark):
    known = {(i, j): float(i + j) for i in range(8) for j in range(8) if not (2 <= i < 6 and 2 <= j < 6)}
    k = spark.createDataFrame([(i, j, v) for (i, j), v in known.items()], "ix long, iy long, ground_z double")
    w = spark.createDataFrame([(i, j) for i in range(8) for j in range(8)], "ix long, iy long")
    got = {(r.ix, r.iy): r.ground_z for r in raster.fill_gaps(k, w, 8, 8).collect()}
    g = np.full((8, 8), np.nan)
    for (i, j), v in known.items():
        g[i, j] = v
    while np.isnan(g).any():
        f = g.copy()
        for i, j in zip(*np.nonzero(np.isnan(g))):
            n = g[max(i - 1, 0): i + 2, max(j - 1, 0): j + 2]
            if not np.isnan(n).all():
                f[i, j] = np.nanmean(n)
        g = f
    assert all(abs(got[i, j] - g[i, j]) < 1e-9 for i in range(8) for j in range(8))


def test_gaussian_tiny_grid(spark):
    z = np.random.default_rng(9).normal(size=(3, 6))
    df = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(3) for j in range(6)], "ix long, iy long, height double")
    w = raster.gaussian_weights(1.0)
    pad = np.pad(z, 4, mode="symmetric")
    want = np.zeros_like(z)
    for a, wa in w:
        for b, wb in w:
            want += wa * wb * pad[4 + a: 7 + a, 4 + b: 10 + b]
    got = {(r.ix, r.iy): r.height for r in raster.gaussian(df, 1.0, 3, 6).collect()}
    assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(3) for j in range(6))


def test_two_rails(spark):
    x = np.arange(0, 60, 0.1)
    left = np.column_stack([x, np.zeros_like(x), np.full_like(x, 100.0)])
    right = np.column_stack([x, np.full_like(x, 1.435), np.full_like(x, 100.04)])
    t = railway.track_segments(frame(spark, np.vstack([left, right]), 18)).orderBy("segment").collect()
    assert abs(t[0].gauge - 1.435) < 1e-9 and abs(abs(t[0].cant) - 40) < 1e-6 and t[0].geometry_type == "straight"
    assert 49 < t[0].length < 50.1


def test_pole_with_plate(spark):
    z = np.arange(0, 8, 0.05)
    shaft = np.vstack([np.column_stack([dx + 0 * z, 0 * z, 100 + z]) for dx in (0.0, 0.1)])
    plate = np.array([(v, 0, 104 + h) for v in np.linspace(-0.3, 0.3, 7) for h in (0.0, 0.05, 0.1)])
    rail = np.column_stack([np.arange(20.0), np.full(20, 3.0), np.full(20, 100.0)])
    p = frame(spark, np.vstack([shaft, plate, rail]), [20] * (len(shaft) + len(plate)) + [18] * 20)
    pole, = railway.poles(p).collect()
    assert pole.pole_type == "catenary" and 7.9 < pole.height < 8
    s = railway.signals_on_poles(p).collect()
    assert s and all(r.signal_type == "main_signal" and abs(r.height - 4.1) < 0.4 for r in s)


def test_gable_roof(spark):
    g = [(x, y, 105 + math.tan(math.radians(15)) * (5 - abs(x - 5))) for x in np.arange(0, 10.01, 0.25) for y in np.arange(0, 12, 0.5)]
    r, = shapes.roofs(frame(spark, g, 6).withColumn("k", F.lit(1)), "k").collect()
    assert r.roof_type == "gable" and 5 < r.roof_slope_deg <= 15.5


def test_cut_fill_box(spark):
    g = [(x, y, 10.0) for x in np.arange(0, 10.5, 0.5) for y in np.arange(0, 10.5, 0.5)]
    p = frame(spark, g, 2)
    e = cells.extent(p)
    t, s = raster.dtm(p, 1.0, ext=e), raster.dsm(p, 1.0, ext=e)
    square = [(1.5, 1.5), (8.5, 1.5), (8.5, 8.5), (1.5, 8.5)]
    v = raster.area_volume(t, s, e, square, 9.0).first()
    assert abs(v.cut_volume_m3 - 49) < 1e-6 and v.fill_volume_m3 == 0 and abs(v.max_cut_depth_m - 1) < 1e-9
    axis = spark.createDataFrame([(0, 0, 0.0, 5.0), (0, 1, 10.0, 5.0)], "axis_id int, seq int, x double, y double")
    c = raster.corridor_volume(raster.cross_sections(axis, t, s, e, 4.0, 5.0, 0.5), [11.0], 4.0).first()
    assert c.cut_volume_m3 == 0 and abs(c.fill_volume_m3 - 9 * 0.5 * 5) < 1e-6


def test_clash_pair(spark):
    wire = np.column_stack([np.arange(0, 10, 0.5), np.zeros(20), np.full(20, 8.0)])
    tree = np.array([(2 + 0.1 * i, 1.5, 8.0) for i in range(5)])
    house = np.array([(5 + 0.1 * i, 2.9, 8.0) for i in range(5)])
    c = findings.clashes(frame(spark, np.vstack([wire, tree, house]), [19] * 20 + [5] * 5 + [6] * 5))
    got = {(r.element_a, r.element_b): (r.clash_type, r.severity) for r in c.collect()}
    assert got[("high_vegetation", "wire")] == ("clearance", "info") and got[("building", "wire")] == ("clearance", "info")
    assert ("wire", "high_vegetation") in got


def test_deduplicate_chain(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.7), (2, 0.4, 0.0, 0.0, 0.7), (3, 0.8, 0.0, 0.0, 0.5), (4, 5.0, 0.0, 0.0, 0.5)],
                              "signal_id long, x double, y double, z double, confidence double")
    assert sorted(r.signal_id for r in railway.deduplicate(s).collect()) == [1, 3, 4]


def test_ground_mask_removes_a_house(spark):
    g = [(x, y, 100 + 0.02 * x) for x in np.arange(0, 40, 1.0) for y in np.arange(0, 40, 1.0) if not (15 <= x < 22 and 15 <= y < 22)]
    h = [(x, y, 106.0) for x in np.arange(15, 22, 1.0) for y in np.arange(15, 22, 1.0)]
    p = ground.ground_mask(frame(spark, g + h, [2] * len(g) + [6] * len(h)), ground.GroundParams(1.0, 3, 0.5))
    wrong = p.where((F.col("classification") == 2) != F.col("is_ground")).count()
    assert wrong == 0


def test_noise_detectors(spark):
    r = np.random.default_rng(10)
    x = np.vstack([r.uniform(0, 10, (600, 3)) * (1, 1, 0.1), [(50, 50, 50), (-30, 5, 9)]])
    p = frame(spark, x)
    for df in (noise.sor(p, 10), noise.radius_noise(p, 2.0, 5), noise.voxel_sor(p, 1.0, 5)):
        assert {600, 601} <= {q.point_id for q in df.where("is_noise").collect()}


def test_smoothing_flips_a_lone_label(spark):
    x = np.array([(i % 10, i // 10, 0) for i in range(100)], float)
    cls = np.full(100, 6)
    cls[55] = 5
    out = {r.point_id: r.new_class for r in smoothing.smooth(frame(spark, x, cls), 8, iterations=3).collect()}
    assert out[55] == 6 and set(out.values()) == {6}


def test_las_round_trip(spark, tmp_path):
    r = np.random.default_rng(11)
    x = r.uniform(0, 100, (1000, 3))
    spark.dataSource.register(las.LasDataSource)
    for top in (12, 68):
        folder = str(tmp_path / f"c{top}")
        p = frame(spark, x, r.integers(0, top, 1000)).coalesce(1)
        p.drop("point_id", "chunk_id").write.format("las").mode("append").save(folder)
        back = spark.read.format("las").load(folder).orderBy("point_id").toPandas()
        src = p.orderBy("point_id").toPandas()
        assert np.abs(back[["x", "y", "z"]].to_numpy() - src[["x", "y", "z"]].to_numpy()).max() < 0.01
        assert (back.classification.to_numpy() == src.classification.to_numpy()).all()
        assert np.allclose(back.red, 0.5, atol=1e-4)
        info = las.file_info(spark, folder).first()
        assert info.n_points == 1000 and info.version == ("1.4" if top > 31 else "1.2")


def test_hull_of_large_object_is_split(spark, monkeypatch):
    monkeypatch.setattr(shapes, "HULL_CHUNK", 50)
    x = np.random.default_rng(12).normal(size=(600, 3))
    h = shapes.polygon_measures(shapes.hulls(frame(spark, x).withColumn("k", F.lit(7)), "k"), "k").first()
    v = shapes._chain(x[:, :2])
    a = 0.5 * abs(sum(v[i][0] * v[(i + 1) % len(v)][1] - v[(i + 1) % len(v)][0] * v[i][1] for i in range(len(v))))
    assert h.n_vertices == len(v) and abs(h.area_m2 - a) < 1e-9


def test_user_rule(spark):
    try:
        rules.register(99, "tall", 0)(lambda c: c.z > 5)
        p = frame(spark, [(0, 0, 9), (0, 0, 1)]).withColumns({k: F.lit(0.0) for k in ("planarity", "linearity", "sphericity", "verticality", "horizontality", "roughness", "height_variance", "density")})
        got = p.withColumn("zone", F.lit("B")).select(rules.classify().alias("c")).collect()
        assert got[0].c == 99 and got[1].c != 99
    finally:
        rules.load_defaults()


def test_parameter_grids():
    assert learning.spaced(2, 10, 5, integer=True) == [2, 4, 6, 8, 10]
    assert np.allclose(learning.spaced(1, 100, 3, log=True), [1, 10, 100])
    assert learning.grid_search({"n_estimators": [1, 2], "max_features": ["sqrt"]}) == [
        {"numTrees": 1, "featureSubsetStrategy": "sqrt"}, {"numTrees": 2, "featureSubsetStrategy": "sqrt"}]
    assert learning.random_search({"max_depth": (2, 9)}, 3) == learning.random_search({"max_depth": (2, 9)}, 3)
