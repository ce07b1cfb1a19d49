"""Neighbour joins, noise, terrain, objects, findings and classification plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes
from ..operators import cells, evaluation, features, findings, ground, landcover, lod, noise, planes, railway, raster, rules, sampling, shapes, tracks
from ..operators import neighbours as nb
from ..plans import classify as plan
from ..plans import inventory
from ..session import cut, work_folder
from ..sources import reports
from ..sources.scene import winding_tracks
from .registry import MASKS, PRECEDENCE, add, cte, dbscan_ctes, names_sql

# ---- neighbour lists in SQL: 8 m buckets, noise points against everything --
cte("b8", "SELECT *, CAST(floor(x / 8) AS BIGINT) AS bx, CAST(floor(y / 8) AS BIGINT) AS by_ FROM scene", "scene")
cte("ring", "SELECT ox, oy FROM (VALUES (-1), (0), (1)) AS a(ox), (VALUES (-1), (0), (1)) AS b(oy)")
_key = lambda d2: f"CAST(({d2}) * 1048576 AS BIGINT) * 1048576"  # noqa: E731  exact: coordinates are multiples of 1/1024
_d3 = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)"
_d2 = "(a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)"
cte("cand", f"SELECT a.point_id, b.point_id AS nid, b.x AS bx, b.y AS by_, b.z AS bz, b.classification AS bc, {_key(_d3)} + b.point_id AS key FROM "
    "(SELECT b8.*, bx + ox AS jx, by_ + oy AS jy FROM b8, ring WHERE classification <> 7) a JOIN b8 b ON a.jx = b.bx AND a.jy = b.by_ WHERE a.point_id <> b.point_id "
    f"UNION ALL SELECT a.point_id, b.point_id, b.x, b.y, b.z, b.classification, {_key(_d3)} + b.point_id FROM scene a JOIN scene b ON a.point_id <> b.point_id WHERE a.classification = 7", "b8", "ring", "scene")
_dist = lambda k: f"sqrt(({k} // 1048576) / 1048576e0)"
cte("near30", "SELECT point_id, min(key, 30) AS keys FROM cand GROUP BY point_id", "cand")
cte("mean30", f"SELECT point_id, list_sum(list_transform(keys, lambda k: {_dist('k')})) / len(keys) AS mean_dist FROM near30", "near30")
cte("sor", "SELECT point_id, mean_dist, mean_dist > (SELECT avg(mean_dist) + 2 * stddev_pop(mean_dist) FROM mean30) AS is_noise FROM mean30", "mean30")

add("J01_A11_mean_knn_distance", "point_id:i mean_dist:d", lambda p: noise.mean_distance(p, 30), "SELECT * FROM mean30", "mean30")
add("M01_statistical_noise", "point_id:i mean_dist:d is_noise:b", lambda p: noise.sor(p, 30, 2.0), "SELECT * FROM sor", "sor")
add("A19_noise_statistics", "n_points:i n_noise:i n_valid:i noise_pct:d noise_z_mean:d noise_z_std:d", lambda p: noise.noise_statistics(noise.detect(p), F.col("is_noise")),
    "SELECT count(*) AS n_points, count(*) FILTER (is_noise) AS n_noise, count(*) FILTER (NOT is_noise) AS n_valid, count(*) FILTER (is_noise) * 100e0 / count(*) AS noise_pct, avg(z) FILTER (is_noise) AS noise_z_mean, stddev_pop(z) FILTER (is_noise) AS noise_z_std FROM sor JOIN scene USING (point_id)", "sor", "scene")
cte("b1", "SELECT *, CAST(floor(x) AS BIGINT) AS bx, CAST(floor(y) AS BIGINT) AS by_, CAST(floor(z) AS BIGINT) AS bz FROM scene", "scene")
cte("ring3", "SELECT ox, oy, oz FROM (VALUES (-1), (0), (1)) AS a(ox), (VALUES (-1), (0), (1)) AS b(oy), (VALUES (-1), (0), (1)) AS c(oz)")
cte("within1", f"SELECT a.point_id, b.point_id AS nid, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, b.classification AS bc FROM (SELECT b1.*, bx + ox AS jx, by_ + oy AS jy, bz + oz AS jz FROM b1, ring3) a "
    f"JOIN b1 b ON a.jx = b.bx AND a.jy = b.by_ AND a.jz = b.bz WHERE {_d3} <= 1", "b1", "ring3")
cte("count1", "SELECT point_id, count(*) AS n_near FROM within1 GROUP BY point_id", "within1")
add("J02_radius_count", "point_id:i n_near:i", lambda p: nb.radius_count(p, p, 1.0), "SELECT * FROM count1", "count1")
add("A09_local_density", "point_id:i density:d", lambda p: features.local_density(p), "SELECT point_id, n_near / CAST((SELECT max(n_near) FROM count1) AS DOUBLE) AS density FROM count1", "count1")
add("M02a_radius_noise", "point_id:i is_noise:b", lambda p: noise.radius_noise(p, 1.0, 5), "SELECT point_id, n_near - 1 < 5 AS is_noise FROM count1", "count1")
# voxel centroids: one per occupied 4 m voxel, brute force over voxels
cte("vox", "SELECT floor(x / 4) AS vx, floor(y / 4) AS vy, floor(z / 4) AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z, min(point_id) AS vid FROM scene GROUP BY 1, 2, 3", "scene")
cte("voxmean", f"SELECT vid, list_avg(ds) AS m FROM (SELECT a.vid, min(sqrt({_d3}), 12) AS ds FROM vox a JOIN vox b ON a.vid <> b.vid GROUP BY a.vid)", "vox")
add("M02b_J05_voxel_noise", "point_id:i is_noise:b", lambda p: noise.voxel_sor(p, 4.0, 12, 2.0),
    "SELECT point_id, m > (SELECT avg(m) + 2 * stddev_pop(m) FROM voxmean) AS is_noise FROM scene s JOIN vox v ON floor(s.x / 4) = v.vx AND floor(s.y / 4) = v.vy AND floor(s.z / 4) = v.vz JOIN voxmean USING (vid)", "scene", "vox", "voxmean")
add("M02c_cell_density_noise", "point_id:i is_noise:b", lambda p: noise.grid_density_noise(p, 0.5, 3),
    "SELECT point_id, count(*) OVER (PARTITION BY floor(x / 0.5e0), floor(y / 0.5e0), floor(z / 0.5e0)) < 3 AS is_noise FROM scene", "scene")

# ---- ground joins ---------------------------------------------------------
cte("gnear", f"SELECT a.point_id, any_value(a.z) AS z, min({_key(_d2)} + b.point_id, 10) AS keys, arg_min(b.z, {_key(_d2)} + b.point_id, 10) AS zs FROM (SELECT b8.*, bx + ox AS jx, by_ + oy AS jy FROM b8, ring) a "
    "JOIN b8 b ON a.jx = b.bx AND a.jy = b.by_ AND b.classification = 2 GROUP BY a.point_id", "b8", "ring")
_gr = lambda p: p.where("classification = 2")
add("J03_M07_nearest_ground", "point_id:i height_above_ground:d", lambda p: features.hag_nearest(p, _gr(p)), "SELECT point_id, greatest(z - zs[1], 0) AS height_above_ground FROM gnear", "gnear")
add("M07_without_ground", "point_id:i height_above_ground:d", lambda p: features.hag_nearest(p, None), "SELECT point_id, greatest(z - (SELECT quantile_cont(z, 0.05) FROM scene), 0) AS height_above_ground FROM scene", "scene")
add("J04_M06_idw_ground", "point_id:i hag:d", lambda p: raster.hag_idw(p, _gr(p), 10),
    f"SELECT point_id, z - list_sum(list_transform(list_zip(zs, keys), lambda t: t[1] / ({_dist('t[2]')} + 1e-10))) / list_sum(list_transform(keys, lambda k: 1 / ({_dist('k')} + 1e-10))) AS hag FROM gnear", "gnear")
add("J09_class_lookup", "class_id:i name:s", lambda p: evaluation.class_histogram(p).select("class_id", reports.report_name(F.col("class_id")).alias("name")),
    "SELECT DISTINCT classification AS class_id, " + names_sql(classes.REPORT_NAMES, "classification", "'Klasa_' || classification") + " AS name FROM scene", "scene")

# ---- HAG and gap filling --------------------------------------------------
add("M04_height_above_ground", "point_id:i hag:d", raster.height_above_ground, "SELECT point_id, hag FROM hag", "hag")
cte("g_all", "SELECT ix, iy FROM ext, generate_series(0, CAST(ceil(x1 - x0) AS BIGINT)) AS a(ix), generate_series(0, CAST(ceil(y1 - y0) AS BIGINT)) AS b(iy)", "ext")
cte("g0", "SELECT a.ix, a.iy, g.gz FROM g_all a LEFT JOIN (SELECT CAST(floor(x - x0) AS BIGINT) AS ix, CAST(floor(y - y0) AS BIGINT) AS iy, min(z) AS gz FROM scene, ext WHERE classification = 18 GROUP BY ALL) g USING (ix, iy)", "g_all", "scene", "ext")
for _i in range(1, 11):
    cte(f"g{_i}", f"SELECT a.ix, a.iy, coalesce(any_value(a.gz), avg(b.gz)) AS gz FROM g{_i - 1} a LEFT JOIN (SELECT ix + ox AS ix, iy + oy AS iy, gz FROM g{_i - 1}, ring WHERE gz IS NOT NULL) b ON a.ix = b.ix AND a.iy = b.iy AND a.gz IS NULL GROUP BY a.ix, a.iy", f"g{_i - 1}", "ring")
add("M05_gap_filled_height", "point_id:i hag:d", lambda p: raster.height_above_ground(p, is_ground=F.col("classification") == 18),
    "SELECT point_id, z - coalesce(gz, (SELECT min(gz) FROM g10)) AS hag FROM (SELECT scene.*, CAST(floor(x - x0) AS BIGINT) AS ix, CAST(floor(y - y0) AS BIGINT) AS iy FROM scene, ext) JOIN g10 USING (ix, iy)", "scene", "ext", "g10")
_M03 = ground.GroundParams(1.0, 2, 0.5, 16.0)
cte("gs0", "SELECT CAST(floor(x - x0) AS BIGINT) AS ix, CAST(floor(y - y0) AS BIGINT) AS iy, min(z) AS h FROM scene, ext GROUP BY 1, 2", "scene", "ext")
for _k, (_before, _reach) in enumerate(((0, 1), (1, 2), (2, 4), (4, 8))):  # windows double until they span 16 m
    _near = f"FROM {{t}}{_k} g, range(-{_reach}, {_reach + 1}) a(ox), range(-{_reach}, {_reach + 1}) b(oy) JOIN {{t}}{_k} n ON n.ix = g.ix + ox AND n.iy = g.iy + oy GROUP BY g.ix, g.iy"
    cte(f"ge{_k}", "SELECT g.ix, g.iy, min(n.h) AS h " + _near.format(t="gs"), f"gs{_k}")
    cte(f"gd{_k}", "SELECT g.ix, g.iy, max(n.h) AS h " + _near.format(t="ge"), f"ge{_k}")
    _step = _M03.slope * (_reach - _before) * 2 * _M03.resolution + _M03.threshold
    cte(f"gs{_k + 1}", f"SELECT g.ix, g.iy, CASE WHEN g.h - d.h > {_step}e0 THEN d.h ELSE g.h END AS h FROM gs{_k} g JOIN gd{_k} d USING (ix, iy)", f"gs{_k}", f"gd{_k}")
add("M03_ground_mask", "point_id:i is_ground:b", lambda p: ground.ground_mask(p, _M03),
    f"SELECT point_id, z - h <= {_M03.threshold}e0 AS is_ground FROM scene, ext JOIN gs4 ON ix = CAST(floor(x - x0) AS BIGINT) AND iy = CAST(floor(y - y0) AS BIGINT)", "scene", "ext", "gs4")
add("M03_ground_counts", "classification:i is_ground:b n:i", lambda p: ground.ground_mask(p).groupBy("classification", "is_ground").agg(F.count("*").alias("n")))

# ---- rasters at 4 m nodes -------------------------------------------------
_R = 4.0
cte("nodes", "SELECT ix, iy, x0 + ix * 4e0 AS x, y0 + iy * 4e0 AS y, ix * ny + iy AS node, nx, ny FROM (SELECT *, CAST(ceil((x1 - x0 + 4) / 4) AS BIGINT) AS nx, CAST(ceil((y1 - y0 + 4) / 4) AS BIGINT) AS ny FROM ext), "
    "generate_series(0, nx - 1) AS a(ix), generate_series(0, ny - 1) AS b(iy)", "ext")
cte("raw_dtm", f"SELECT ix, iy, CASE WHEN keys[1] < 1048576 THEN list_avg(list_transform(list_filter(list_zip(zs, keys), lambda t: t[2] < 1048576), lambda t: t[1])) ELSE "
    "list_sum(list_transform(list_zip(zs, keys), lambda t: t[1] / CAST(t[2] // 1048576 AS DOUBLE))) / list_sum(list_transform(keys, lambda k: 1e0 / (k // 1048576))) END AS height FROM "
    f"(SELECT ix, iy, min(k, 4) AS keys, arg_min(z, k, 4) AS zs FROM (SELECT a.ix, a.iy, b.z, {_key(_d2)} + b.point_id AS k FROM nodes a, (SELECT * FROM scene WHERE classification = 2) b) GROUP BY ix, iy)", "nodes", "scene")
_W = raster.gaussian_weights(1.0)
cte("taps", "SELECT * FROM (VALUES " + ", ".join(f"({o}, {w!r})" for o, w in _W) + ") AS t(o, w)")
_mir = lambda v, n: f"CASE WHEN ({v}) < 0 THEN -1 - ({v}) WHEN ({v}) >= {n} THEN 2 * {n} - 1 - ({v}) ELSE ({v}) END"
cte("dims", "SELECT DISTINCT nx, ny FROM nodes", "nodes")
cte("gx", f"SELECT a.ix, a.iy, sum(b.height * w) AS height FROM (SELECT r.ix, r.iy, w, {_mir('r.ix + o', 'nx')} AS jx FROM raw_dtm r, taps, dims) a JOIN raw_dtm b ON a.jx = b.ix AND a.iy = b.iy GROUP BY a.ix, a.iy", "raw_dtm", "taps", "dims")
cte("dtm", f"SELECT a.ix, a.iy, sum(b.height * w) AS height FROM (SELECT r.ix, r.iy, w, {_mir('r.iy + o', 'ny')} AS jy FROM gx r, taps, dims) a JOIN gx b ON a.ix = b.ix AND a.jy = b.iy GROUP BY a.ix, a.iy", "gx", "taps", "dims")
cte("top", "SELECT least(CAST(floor((x - x0) / 4) AS BIGINT), nx - 1) AS ix, least(CAST(floor((y - y0) / 4) AS BIGINT), ny - 1) AS iy, max(z) AS height FROM scene, ext, dims WHERE classification IN (2,3,4,5,6,17,18,19,20,21,30,40,41) GROUP BY 1, 2", "scene", "ext", "dims")
cte("dsm", "SELECT * FROM top UNION ALL SELECT n.ix, n.iy, arg_min(t.height, ((n.ix - t.ix) * (n.ix - t.ix) + (n.iy - t.iy) * (n.iy - t.iy)) * 1048576 + t.ix * n.ny + t.iy) AS height FROM nodes n, top t WHERE (n.ix, n.iy) NOT IN (SELECT (ix, iy) FROM top) GROUP BY n.ix, n.iy", "nodes", "top")


def _models(p: DataFrame):
    e = cells.extent(p)
    return e, cut(raster.dtm(p, _R, ext=e)), cut(raster.dsm(p, _R, ext=e))


_AX = [(0, 0, 4.0, 4.0), (0, 1, 100.0, 4.0), (0, 2, 100.0, 64.0)]
_axis = lambda p: p.sparkSession.createDataFrame(_AX, "axis_id int, seq int, x double, y double")
add("M08_M10_terrain_model", "ix:i iy:i height:d", lambda p: raster.dtm(p, _R), "SELECT * FROM dtm", "dtm")
add("M09_surface_model", "ix:i iy:i height:d", lambda p: raster.dsm(p, _R), "SELECT * FROM dsm", "dsm")
add("M11_canopy_model", "ix:i iy:i height:d", lambda p: raster.chm(*_models(p)[1:]), "SELECT ix, iy, greatest(s.height - t.height, 0) AS height FROM dsm s JOIN dtm t USING (ix, iy)", "dsm", "dtm")
add("A49_raster_statistics", "lo:d hi:d mean:d", lambda p: raster.dsm(p, _R).agg(F.min("height").alias("lo"), F.max("height").alias("hi"), F.avg("height").alias("mean")),
    "SELECT min(height) AS lo, max(height) AS hi, avg(height) AS mean FROM dsm", "dsm")
_look = lambda src, t, n: (f"SELECT s.*, g.height AS {n} FROM {src} s CROSS JOIN ext CROSS JOIN dims LEFT JOIN {t} g ON s.x BETWEEN x0 AND x1 AND s.y BETWEEN y0 AND y1 AND g.ix = least(CAST(floor((s.x - x0) / 4) AS BIGINT), nx - 1) "  # noqa: E731
                           "AND g.iy = least(CAST(floor((s.y - y0) / 4) AS BIGINT), ny - 1)")
add("J13_M12_height_lookup", "point_id:i h:d", lambda p: (lambda m: raster.lookup(p.select("point_id", "x", "y"), m[2], m[0], _R, "h"))(_models(p)),
    "SELECT point_id, h FROM (" + _look("(SELECT point_id, x, y FROM scene)", "dsm", "h") + ")", "scene", "dsm", "ext", "dims")
# axis 96 m east, then 60 m north
cte("stations", "SELECT j * 8e0 AS station, 4 + j * 8e0 AS cx, 4e0 AS cy, 1e0 AS dx, 0e0 AS dy FROM generate_series(0, 11) AS a(j) UNION ALL SELECT 96 + j * 8e0, 100e0, 4 + j * 8e0, 0e0, 1e0 FROM generate_series(0, 6) AS a(j)")
cte("offsets", "SELECT station, d, cx - d * dy AS x, cy + d * dx AS y FROM stations, (SELECT -20 + i * 0.5e0 AS d FROM generate_series(0, 80) AS a(i))", "stations")
cte("sections", "SELECT a.station, a.d, terrain_h, surface_h FROM (" + _look("offsets", "dtm", "terrain_h") + ") a JOIN (" + _look("offsets", "dsm", "surface_h") + ") b ON a.station = b.station AND a.d = b.d", "offsets", "dtm", "dsm", "ext", "dims")
_sections = lambda p: (lambda m: raster.cross_sections(_axis(p), m[1], m[2], m[0], 40.0, 8.0, 0.5, _R))(_models(p))
add("M13_cross_sections", "station:d d:d terrain_h:d surface_h:d", _sections, "SELECT * FROM sections", "sections")
cte("profpts", "SELECT j * 5e0 AS station, 4 + j / 19e0 * 96 AS x, 4e0 AS y FROM generate_series(0, 18) AS a(j) UNION ALL SELECT 96 + j * 5e0, 100e0, 4 + j / 12e0 * 60 FROM generate_series(0, 11) AS a(j)")
add("M14_longitudinal_profile", "n:i min_height:d max_height:d elevation_change:d", lambda p: (lambda m: raster.profile_summary(raster.longitudinal_profile(_axis(p), m[1], m[2], m[0], 5.0, _R)))(_models(p)),
    "SELECT count(*) AS n, min(h) AS min_height, max(h) AS max_height, max(h) - min(h) AS elevation_change FROM (" + _look("profpts", "dtm", "h") + ")", "profpts", "dtm", "ext", "dims")
_DH = [100.0, 101.0, 99.5]
cte("secarea", "SELECT station, 0.5e0 * coalesce(sum(greatest(diff, 0)), 0) AS cut, 0.5e0 * coalesce(sum(greatest(-diff, 0)), 0) AS fill, 0.5e0 * coalesce(sum(surface_h - terrain_h) FILTER (surface_h - terrain_h > 0.5e0), 0) AS veg, max(greatest(diff, 0)) AS mc, max(greatest(-diff, 0)) AS mf FROM "
    "(SELECT *, terrain_h - CASE WHEN abs(d) <= 10 THEN dh ELSE greatest(least(CASE WHEN terrain_h < dh THEN dh - (abs(d) - 10) / 2 ELSE dh + (abs(d) - 10) / 2 END, terrain_h + 10), terrain_h - 10) END AS diff FROM "
    "(SELECT *, [100e0, 101e0, 99.5e0][1 + CAST(floor(station / 144e0 * 2) AS BIGINT)] AS dh FROM sections)) GROUP BY station", "sections")
cte("corridor", "SELECT sum(cut * dx) AS cut_volume_m3, sum(fill * dx) AS fill_volume_m3, sum(veg * dx) AS vegetation_volume_m3, sum(dx) * 20 AS area_m2, coalesce(avg(mc) FILTER (cut > 0), 0) AS avg_cut_depth_m, coalesce(avg(mf) FILTER (fill > 0), 0) AS avg_fill_height_m, "
    "max(mc) AS max_cut_depth_m, max(mf) AS max_fill_height_m, sum(cut * dx) - sum(fill * dx) AS net_volume_m3 FROM (SELECT *, coalesce(station - lag(station) OVER (ORDER BY station), 0) AS dx FROM secarea)", "secarea")
_VOL = "cut_volume_m3:d fill_volume_m3:d vegetation_volume_m3:d area_m2:d avg_cut_depth_m:d avg_fill_height_m:d max_cut_depth_m:d max_fill_height_m:d net_volume_m3:d"
_corridor = lambda p: raster.corridor_volume(_sections(p), _DH, 20.0, 2.0, 0.5)
add("M15_J18_corridor_volume", _VOL, _corridor, "SELECT * FROM corridor", "corridor")
_POLY = [(8.0, 8.0), (120.0, 8.0), (90.0, 100.0), (8.0, 60.0)]
_cross = " + ".join(f"CASE WHEN (({y1}e0 > y) <> ({y2}e0 > y)) AND x < ({x2 - x1}e0) * (y - {y1}e0) / ({y2 - y1}e0) + {x1}e0 THEN 1 ELSE 0 END"
                    for (x1, y1), (x2, y2) in zip(_POLY, _POLY[1:] + _POLY[:1]) if y1 != y2)
add("J10_M16_area_volume", _VOL, lambda p: (lambda m: raster.area_volume(m[1], m[2], m[0], _POLY, 100.5, _R))(_models(p)),
    "SELECT c AS cut_volume_m3, f AS fill_volume_m3, v AS vegetation_volume_m3, a AS area_m2, CASE WHEN a > 0 AND c > 0 THEN c / a ELSE 0 END AS avg_cut_depth_m, CASE WHEN a > 0 AND f > 0 THEN f / a ELSE 0 END AS avg_fill_height_m, mc AS max_cut_depth_m, mf AS max_fill_height_m, c - f AS net_volume_m3 FROM "
    "(SELECT coalesce(sum(greatest(t - 100.5e0, 0)) * 16, 0) AS c, coalesce(sum(greatest(100.5e0 - t, 0)) * 16, 0) AS f, coalesce(sum(s - t) FILTER (s - t > 0.5e0) * 16, 0) AS v, count(*) * 16 AS a, coalesce(max(greatest(t - 100.5e0, 0)), 0) AS mc, coalesce(max(greatest(100.5e0 - t, 0)), 0) AS mf FROM "
    f"(SELECT t.height AS t, s.height AS s, x0 + ix * 4e0 AS x, y0 + iy * 4e0 AS y FROM dtm t JOIN dsm s USING (ix, iy), ext) WHERE ({_cross}) % 2 = 1)", "dtm", "dsm", "ext")
add("S29_volume_report", "cut_volume_m3:d balance:s total_cost:d area_ha:d", lambda p: raster.volume_report(_corridor(p)),
    "SELECT round(cut_volume_m3, 1) AS cut_volume_m3, CASE WHEN net_volume_m3 > 0 THEN 'surplus' ELSE 'deficit' END AS balance, round(cut_volume_m3 * 25 + fill_volume_m3 * 35 + vegetation_volume_m3 * 15, 0) AS total_cost, round(area_m2 / 10000, 2) AS area_ha FROM corridor", "corridor")
add("S23_terrain_element", "ix:i iy:i height:d step:i", lambda p: reports.terrain_element(raster.dsm(p, _R), 250), "SELECT ix, iy, height, 2 AS step FROM dsm WHERE ix % 2 = 0 AND iy % 2 = 0", "dsm")

# ---- PCA ------------------------------------------------------------------
def eigen_cte(name: str, source: str) -> None:
    """Adds l1, l2, l3 to a source that has cxx .. cyz (trigonometric form)."""
    cte(f"{name}_q", f"SELECT *, (cxx + cyy + czz) / 3 AS qm, sqrt(((cxx - (cxx+cyy+czz)/3)**2 + (cyy - (cxx+cyy+czz)/3)**2 + (czz - (cxx+cyy+czz)/3)**2 + 2 * (cxy**2 + cxz**2 + cyz**2)) / 6) AS qp FROM {source}", source)
    det = "(cxx-qm)*((cyy-qm)*(czz-qm)-cyz*cyz) - cxy*(cxy*(czz-qm)-cyz*cxz) + cxz*(cxy*cyz-(cyy-qm)*cxz)"
    cte(f"{name}_f", f"SELECT *, acos(greatest(-1e0, least(1e0, ({det}) / 2 / greatest(qp*qp*qp, 1e-30)))) / 3 AS phi FROM {name}_q", f"{name}_q")
    cte(f"{name}_l", f"SELECT *, qm + 2 * qp * cos(phi) AS l1, greatest(qm + 2 * qp * cos(phi + 2 * pi() / 3), 0) AS l3 FROM {name}_f", f"{name}_f")
    cte(name, f"SELECT *, greatest(3 * qm - l1 - l3, 0) AS l2 FROM {name}_l", f"{name}_l")


_pop = lambda a, b: f"greatest(sum(d{a}*d{b})/count(*) - sum(d{a})/count(*)*(sum(d{b})/count(*)), {'0' if a == b else '-1e300'}) AS c{a}{b}"
cte("cov1", "SELECT point_id, count(*) AS n, " + ", ".join(_pop(a, b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")) + " FROM within1 GROUP BY point_id HAVING count(*) >= 10", "within1")
eigen_cte("eig1", "cov1")
_r4 = lambda *cs: [F.round(c, 4).alias(c) for c in cs]
add("A06_neighbourhood_shape", "point_id:i planarity:d linearity:d sphericity:d height_variance:d density:d", lambda p: features.radius_features(p, 1.0).select(
    "point_id", *_r4("planarity", "linearity", "sphericity", "height_variance", "density")),
    "SELECT point_id, coalesce(round((l2 - l3) / (l1 + 1e-8), 4), 0) AS planarity, coalesce(round((l1 - l2) / (l1 + 1e-8), 4), 0) AS linearity, coalesce(round(l3 / (l1 + 1e-8), 4), 0) AS sphericity, coalesce(round(sqrt(czz), 4), 0) AS height_variance, coalesce(round(n / (4e0 / 3 * pi()), 4), 0) AS density "
    "FROM scene LEFT JOIN eig1 USING (point_id)", "scene", "eig1")
add("A06_normals_and_roughness", "classification:i n:i verticality:d roughness:d", lambda p: features.radius_features(p, 1.0).groupBy("classification").agg(F.count("*").alias("n"), F.avg("verticality").alias("verticality"), F.avg("roughness").alias("roughness")))
add("A08_default_fill", "point_id:i horizontality:d planarity:d", lambda p: features.default_fill(p.withColumns({"horizontality": F.col("intensity"), "planarity": F.col("red")}), F.col("z") > 104, 4.0),
    "SELECT point_id, CASE WHEN z > 104 THEN intensity ELSE 0.5e0 END AS horizontality, CASE WHEN z > 104 THEN red ELSE 0.3e0 END AS planarity FROM scene", "scene")
cte("near30p", "SELECT point_id, unnest(arg_min(bx, key, 30)) AS x, unnest(arg_min(by_, key, 30)) AS y, unnest(arg_min(bz, key, 30)) AS z FROM cand GROUP BY point_id", "cand")
_samp = ", ".join([f"greatest(var_samp({a}), 0) AS c{a}{a}" for a in "xyz"] + [f"covar_samp({a}, {b}) AS c{a}{b}" for a, b in ("xy", "xz", "yz")])
cte("cov30", f"SELECT point_id, greatest(var_pop(z), 0) AS z_var, {_samp} FROM near30p GROUP BY point_id", "near30p")
eigen_cte("eig30", "cov30")
add("A07_A10_knn_shape", "point_id:i linearity:d planarity:d sphericity:d z_var:d", lambda p: features.knn_shape(p, 30).select("point_id", *_r4("linearity", "planarity", "sphericity", "z_var")),
    "SELECT point_id, round((greatest(l1, 1e-10) - greatest(l2, 1e-10)) / greatest(l1, 1e-10), 4) AS linearity, round((greatest(l2, 1e-10) - greatest(l3, 1e-10)) / greatest(l1, 1e-10), 4) AS planarity, round(greatest(l3, 1e-10) / greatest(l1, 1e-10), 4) AS sphericity, round(z_var, 4) AS z_var FROM eig30", "eig30")
add("A48_surface_roughness", "roughness:d", lambda p: features.surface_roughness(p.where("classification = 2"), 10))
cte("chunkcov", f"SELECT chunk_id, count(*) AS n, {_samp} FROM scene WHERE classification = 6 GROUP BY chunk_id", "scene")
eigen_cte("chunkeig", "chunkcov")
add("A31_A32_oriented_boxes", "chunk_id:i l1:d l2:d l3:d planarity:d sphericity:d", lambda p: shapes.shape_ratios(shapes.oriented_boxes(p.where("classification = 6"), "chunk_id")).select("chunk_id", *_r4("l1", "l2", "l3", "planarity", "sphericity")),
    "SELECT chunk_id, round(l1, 4) AS l1, round(l2, 4) AS l2, round(l3, 4) AS l3, round((l2 - l3) / l2, 4) AS planarity, round(l3 / l1, 4) AS sphericity FROM chunkeig", "chunkeig")
add("D41_shape_metrics", "chunk_id:i point_count:i volume:d elongation:d", lambda p: shapes.shape_metrics(p.where("classification = 6"), "chunk_id").select("chunk_id", "point_count", "volume", *_r4("elongation")),
    "SELECT chunk_id, n AS point_count, v AS volume, round(sqrt(l1 / l3), 4) AS elongation FROM chunkeig JOIN (SELECT chunk_id, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS v FROM scene WHERE classification = 6 GROUP BY 1) USING (chunk_id)", "chunkeig", "scene")
add("A35_A37_hull_and_footprint", "chunk_id:i n_vertices:i area_m2:d perimeter_m:d centroid_x:d is_rectangular:b", lambda p: shapes.polygon_measures(shapes.hulls(p.where("classification = 2"), "chunk_id"), "chunk_id"),
    "SELECT chunk_id, 4 AS n_vertices, w * h AS area_m2, 2 * (w + h) AS perimeter_m, c AS centroid_x, true AS is_rectangular FROM (SELECT chunk_id, max(x) - min(x) AS w, max(y) - min(y) AS h, (max(x) + min(x)) / 2 AS c FROM scene WHERE classification = 2 GROUP BY 1)", "scene")
add("A38_roof_symmetry", "chunk_id:i is_symmetric:b", lambda p: shapes.roof_symmetry(p.where("classification = 6"), "chunk_id"),
    "SELECT chunk_id, count(*) FILTER (x < m) >= 10 AND count(*) FILTER (x >= m) >= 10 AND abs(avg(z) FILTER (x < m) - avg(z) FILTER (x >= m)) < 0.5e0 AS is_symmetric FROM scene JOIN (SELECT chunk_id, avg(x) AS m FROM scene WHERE classification = 6 GROUP BY 1) USING (chunk_id) WHERE classification = 6 GROUP BY chunk_id", "scene")

# ---- rules ----------------------------------------------------------------
_FE = {"planarity": (37, 64), "linearity": (53, 64), "sphericity": (11, 64), "verticality": (29, 64), "roughness": (7, 128), "height_variance": (13, 32), "density": (5, 4)}


def _rule_input(p: DataFrame) -> DataFrame:
    t = sampling.tile_key(p, cells.extent(p), 50.0)
    t = t.join(plan.zone_thresholds(t), "tile_id")
    zone = plan.height_zone(F.col("z"), F.col("z_ground"), F.col("z_low"), F.col("z_high"))
    t = t.withColumns({k: F.pmod(F.col("point_id") * a, F.lit(64)) / F.lit(float(b)) for k, (a, b) in _FE.items()})
    return t.withColumns({"zone": zone, "horizontality": F.lit(1.0) - F.col("verticality")})


cte("rulein", "SELECT *, (green - red) / (green + red + 1e-8) AS ndvi, (red + green + blue) / 3 AS bright, sqrt(((red-(red+green+blue)/3e0)**2 + (green-(red+green+blue)/3e0)**2 + (blue-(red+green+blue)/3e0)**2) / 3e0) AS sat, 1 - ((point_id * 29) % 64) / 64e0 AS ho, "
    + ", ".join(f"((point_id * {a}) % 64) / {b}e0 AS {k}" for k, (a, b) in _FE.items()) + " FROM zoned", "zoned")
_z = lambda s: "zone IN (" + ",".join(f"'{c}'" for c in s) + ")"
RULE_SQL = {
    17: f"{_z('CD')} AND planarity > 0.75 AND roughness < 0.12", 6: f"{_z('BCD')} AND planarity > 0.6 AND roughness < 0.2",
    30: f"{_z('BC')} AND planarity > 0.85 AND roughness < 0.08 AND ho > 0.95 AND intensity > 0.4 AND sat < 0.12", 18: f"{_z('BC')} AND linearity > 0.7 AND ho > 0.85",
    41: f"{_z('CD')} AND planarity > 0.75", 2: f"{_z('AB')} AND planarity > 0.8 AND roughness < 0.15 AND ho > 0.9 AND ndvi < 0.1", 32: f"{_z('B')} AND linearity > 0.75",
    21: f"{_z('BC')} AND planarity > 0.8 AND ho > 0.9", 31: f"{_z('B')} AND planarity > 0.8 AND roughness < 0.12 AND ho > 0.9", 19: f"{_z('D')} AND linearity > 0.95",
    20: f"{_z('CD')} AND linearity > 0.8 AND verticality > 0.85", 34: f"{_z('CD')} AND linearity > 0.8 AND verticality > 0.85", 9: f"{_z('A')} AND planarity > 0.85 AND roughness < 0.05 AND intensity < 0.2 AND bright < 0.3",
    35: f"{_z('BC')} AND planarity > 0.65 AND intensity > 0.7 AND sat > 0.3", 38: f"{_z('CD')} AND linearity > 0.75 AND verticality > 0.8", 22: f"{_z('BC')} AND planarity > 0.6 AND intensity > 0.6",
    36: f"{_z('BC')} AND linearity > 0.65", 3: f"{_z('B')} AND ndvi > 0.1 AND roughness > 0.1 AND roughness < 0.4", 4: f"{_z('BC')} AND ndvi > 0.15 AND roughness > 0.2 AND height_variance > 0.5",
    5: f"{_z('CD')} AND ndvi > 0.15 AND roughness > 0.3 AND height_variance > 1", 33: f"{_z('B')} AND roughness > 0.2 AND ndvi > 0.15", 23: f"{_z('BC')} AND linearity > 0.6 AND verticality > 0.7",
    37: f"{_z('B')} AND planarity > 0.75", 40: "planarity > 0.7 AND verticality > 0.8", 42: f"{_z('AB')} AND planarity > 0.7", 43: "linearity > 0.85 AND verticality > 0.9 AND sphericity > 0.5", 44: "linearity > 0.8 AND ho > 0.8",
    45: "sphericity > 0.6 AND linearity > 0.7", 46: "false", 47: "linearity > 0.6", 64: f"{_z('CD')} AND linearity > 0.8 AND verticality > 0.85", 65: f"{_z('A')} AND sphericity > 0.7 AND linearity > 0.75",
    66: "planarity < 0.5 AND height_variance > 0.5", 67: "false", 7: "density < 5", 1: "false",
}
add("R01_R67_rule_masks", " ".join(f"r{k}:i" for k in sorted(RULE_SQL)), lambda p: _rule_input(p).agg(*[F.count(F.when(c, 1)).alias(f"r{k}") for k, c in rules.masks().items()]),
    "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS r{k}" for k, c in RULE_SQL.items()) + " FROM rulein", "rulein")
_first = lambda ids: "CASE " + " ".join(f"WHEN {RULE_SQL[k]} THEN {k}" for k in ids) + " ELSE 1 END"
add("X01_first_matching_rule", "point_id:i new_class:i", lambda p: _rule_input(p).select("point_id", rules.classify().alias("new_class")), f"SELECT point_id, {_first(RULE_SQL)} AS new_class FROM rulein", "rulein")
add("W14_enabled_rules_only", "point_id:i new_class:i", lambda p: _rule_input(p).select("point_id", rules.classify(enabled=[2, 6, 41, 47]).alias("new_class")), f"SELECT point_id, {_first([6, 41, 2, 47])} AS new_class FROM rulein", "rulein")
add("T00b_tile_rules", "classification:i new_class:i n:i", lambda p: plan.classify_by_rules(p, 50.0).groupBy("classification", "new_class").agg(F.count("*").alias("n")))

# ---- clusters and poles ---------------------------------------------------
cte("polesrc", "SELECT * FROM scene WHERE classification = 20", "scene")
dbscan_ctes("polec", "polesrc", 1.5, 5)
add("D01_density_clusters", "point_id:i cluster:i", lambda p: railway.pole_clusters(p).select("point_id", "cluster"), "SELECT point_id, cluster FROM polec", "polec")
add("A30_cluster_extents", "cluster:i n_points:i x_range:d y_range:d z_range:d x_mean:d z_min:d", lambda p: railway.cluster_extents(railway.pole_clusters(p)),
    "SELECT cluster, count(*) AS n_points, max(x) - min(x) AS x_range, max(y) - min(y) AS y_range, max(z) - min(z) AS z_range, avg(x) AS x_mean, min(z) AS z_min FROM polec GROUP BY cluster", "polec")
_pt = lambda h, w: f"CASE WHEN {h} BETWEEN 6 AND 12 THEN 'catenary' WHEN {h} > 8 THEN 'lighting' WHEN {h} BETWEEN 3 AND 8 THEN 'signal' WHEN {w} > 1 AND {h} > 5 THEN 'gantry' ELSE 'unknown' END"
cte("poles", f"SELECT cluster AS pole_id, x, y, z, height, width, {_pt('z + height - g', 'width')} AS pole_type, least(1e0, n / 50e0) AS confidence FROM (SELECT cluster, count(*) AS n, avg(x) AS x, avg(y) AS y, min(z) AS z, max(z) - min(z) AS height, greatest(max(x) - min(x), max(y) - min(y)) AS width FROM polec GROUP BY cluster), "
    "(SELECT avg(z) AS g FROM scene WHERE classification = 2) WHERE n >= 5 AND height >= 3 AND width <= 2 AND width > 0 AND height / width >= 2", "polec", "scene")
add("D30_poles", "pole_id:i x:d y:d z:d height:d width:d pole_type:s confidence:d", railway.poles, "SELECT * FROM poles", "poles")
cte("axis", "SELECT chunk_id AS seq, avg(x) AS x, avg(y) AS y FROM scene WHERE classification = 18 GROUP BY 1", "scene")
cte("axiskm", "SELECT seq, x, y, sum(coalesce(d, 0)) OVER (ORDER BY x, y) / 1000 AS km FROM (SELECT *, sqrt((x - lag(x) OVER (ORDER BY x, y))**2 + (y - lag(y) OVER (ORDER BY x, y))**2) AS d FROM axis)", "axis")
_axis_of = lambda p: p.where("classification = 18").groupBy(F.col("chunk_id").alias("seq")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).withColumn("axis_id", F.lit(0))
add("N02_axis_chainage", "seq:i km:d", lambda p: railway.axis_chainage(_axis_of(p)), "SELECT seq, km FROM axiskm", "axiskm")
add("J07_D31_pole_positions", "pole_id:i km_position:d side:s", lambda p: railway.pole_positions(railway.poles(p), _axis_of(p)),
    "SELECT pole_id, km AS km_position, CASE WHEN s < -1 THEN 'left' WHEN s > 1 THEN 'right' ELSE 'center' END AS side FROM (SELECT pole_id, km, (px - x) * -uy + (py - y) * ux AS s FROM (SELECT pole_id, px, py, a.x AS x, a.y AS y, a.km AS km FROM (SELECT p.pole_id, p.x AS px, p.y AS py, arg_min(a, (p.x - a.x)**2 + (p.y - a.y)**2) AS a FROM poles p, axiskm a GROUP BY 1, 2, 3)), "
    "(SELECT (e.x - s.x) / n AS ux, (e.y - s.y) / n AS uy FROM (SELECT e, s, sqrt((e.x - s.x)**2 + (e.y - s.y)**2) AS n FROM (SELECT max({x: x, y: y}) AS e, min({x: x, y: y}) AS s FROM axis))))", "poles", "axiskm", "axis")
cte("spacing", "SELECT coalesce(avg(d), 0) AS avg_spacing_m FROM (SELECT sqrt((x - lag(x) OVER w)**2 + (y - lag(y) OVER w)**2) AS d FROM poles WINDOW w AS (ORDER BY x, pole_id))", "poles")
add("N01_pole_spacing", "avg_spacing_m:d", lambda p: railway.pole_spacing(railway.poles(p)), "SELECT * FROM spacing", "spacing")
add("A42_pole_statistics", "total_count:i catenary_count:i avg_height_m:d max_height_m:d avg_spacing_m:d", lambda p: railway.pole_statistics(railway.poles(p)),
    "SELECT count(*) AS total_count, count(*) FILTER (pole_type = 'catenary') AS catenary_count, avg(height) AS avg_height_m, max(height) AS max_height_m, (SELECT avg_spacing_m FROM spacing) AS avg_spacing_m FROM poles", "poles", "spacing")

# ---- catenary -------------------------------------------------------------
_lvl = "(SELECT avg(z) AS lvl FROM scene WHERE classification = 18)"
cte("wiresrc", f"SELECT s.*, t.wire_type, z - lvl AS h FROM scene s, {_lvl}, (VALUES ('contact', 5e0, 5.5e0), ('messenger', 6e0, 7.5e0), ('return', 6.5e0, 8e0)) AS t(wire_type, lo, hi) WHERE classification = 19 AND z - lvl BETWEEN lo AND hi", "scene")
dbscan_ctes("wirec", "wiresrc", 2.0, 3, ("x", "y"), "wire_type")
cte("wires", "SELECT wire_type, cluster AS wire_id, count(*) AS n_points, min(x) AS start_x, max(x) AS end_x, arg_min(z, x) AS start_z, sqrt((max(x) - min(x))**2 + (arg_max(z, x) - arg_min(z, x))**2) AS length, avg(h) AS height_above_track, max(z) - min(z) AS sag, least(1e0, count(*) / 100e0) AS confidence FROM wirec GROUP BY ALL HAVING count(*) >= 5 AND max(x) - min(x) >= 10", "wirec")
add("J12_wire_bands", "wire_type:s point_id:i", lambda p: railway.wire_points(p, railway.reference_level(p)), "SELECT wire_type, point_id FROM wiresrc", "wiresrc")
add("D10_N12_wire_segments", "wire_type:s wire_id:i n_points:i start_x:d end_x:d start_z:d length:d height_above_track:d sag:d confidence:d", railway.wire_segments, "SELECT * FROM wires", "wires")
add("D11_droppers", "n_points:i length:d xy_range:d", railway.droppers,
    f"SELECT count(*) AS n_points, max(z) - min(z) AS length, sqrt((max(x) - min(x))**2 + (max(y) - min(y))**2) AS xy_range FROM scene, {_lvl}, (SELECT min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM scene WHERE classification = 19) WHERE classification = 19 AND z - lvl BETWEEN 5 AND 7.5e0 "
    "AND x < a + ceil((c - a) / 0.5e0) * 0.5e0 AND y < b + ceil((d - b) / 0.5e0) * 0.5e0 GROUP BY floor((x - a) / 0.5e0), floor((y - b) / 0.5e0) HAVING count(*) >= 3 AND max(z) - min(z) > 0.5e0 AND sqrt((max(x) - min(x))**2 + (max(y) - min(y))**2) < 0.3e0", "scene")
cte("span", "SELECT coalesce(median(g), 50) AS span_length FROM (SELECT x - lag(x) OVER (ORDER BY x) AS g FROM scene WHERE classification = 19) WHERE g > 5", "scene")
add("D12_N04_span_length", "span_length:d", railway.span_length, "SELECT * FROM span", "span")
cte("catstat", "SELECT count(*) FILTER (wire_type = 'contact') AS contact_wires, count(*) FILTER (wire_type = 'messenger') AS messenger_wires, sum(length) AS total_length, max(height_above_track) AS system_height, avg(sag) FILTER (wire_type = 'contact') AS avg_sag, (SELECT span_length FROM span) AS span_length FROM wires", "wires", "span")
add("A40_D13_catenary_system", "contact_wires:i messenger_wires:i total_length:d system_height:d avg_sag:d span_length:d", railway.catenary_system, "SELECT * FROM catstat", "catstat")

# ---- tracks ---------------------------------------------------------------
cte("rails", "SELECT *, CAST(floor((x - mn) / 50) AS BIGINT) AS segment FROM scene, (SELECT min(x) AS mn, max(x) AS mx FROM scene WHERE classification = 18) WHERE classification = 18 AND floor((x - mn) / 50) < ceil((mx - mn) / 50)", "scene")
cte("sided", "SELECT r.*, CASE WHEN y - my < 0 THEN 'left' ELSE 'right' END AS side FROM rails r JOIN (SELECT segment, avg(y) AS my, count(*) AS n FROM rails GROUP BY 1 HAVING count(*) >= 50) USING (segment)", "rails")
cte("axes", "SELECT * FROM sided WHERE segment IN (SELECT segment FROM sided GROUP BY 1 HAVING count(*) FILTER (side = 'left') > 20 AND count(*) FILTER (side = 'right') > 20)", "sided")
_E = (1.0, 0.0)
cte("railcov", f"SELECT {_samp} FROM scene WHERE classification = 18", "scene")
eigen_cte("raileig", "railcov")
add("D20_main_direction", "dx:d dy:d", lambda p: p.sparkSession.createDataFrame([tuple(abs(v) for v in railway.main_direction(p.where("classification = 18"), flat=True))], "dx double, dy double"),
    "SELECT abs(cos(0.5e0 * atan2(2 * cxy, cxx - cyy))) AS dx, abs(sin(0.5e0 * atan2(2 * cxy, cxx - cyy))) AS dy FROM railcov", "railcov")
add("D21_D22_rail_sides", "segment:i side:s n:i", lambda p: railway.track_points(p, _E).groupBy("segment", "side").agg(F.count("*").alias("n")), "SELECT segment, side, count(*) AS n FROM sided GROUP BY ALL", "sided")
add("D25_U02_rail_axes", "point_id:i side:s", lambda p: railway.rail_axes(p, direction=_E), "SELECT point_id, side FROM axes", "axes")
_pairs = lambda d: f"SELECT a.segment, a.point_id, min({_key(d)} + b.point_id) AS key, arg_min(b, {_key(d)} + b.point_id) AS r, any_value(a) AS l FROM axes a JOIN axes b ON a.segment = b.segment AND a.side = 'left' AND b.side = 'right' AND b.x BETWEEN a.x - 3 AND a.x + 3 AND {d} < 2.87e0 * 2.87e0 GROUP BY a.segment, a.point_id"
cte("pair3", _pairs(_d3), "axes")
cte("pair2", _pairs(_d2), "axes")
add("J08_rail_pairs", "segment:i point_id:i n_point_id:i", lambda p: railway.rail_pairs(railway.rail_axes(p, direction=_E), True), "SELECT segment, point_id, r.point_id AS n_point_id FROM pair2", "pair2")
cte("cline", "SELECT segment, point_id, (l.x + r.x) / 2 AS x, (l.y + r.y) / 2 AS y, (l.z + r.z) / 2 AS z FROM pair3 WHERE segment IN (SELECT segment FROM pair3 GROUP BY 1 HAVING count(*) >= 10) UNION ALL SELECT segment, point_id, x, y, z FROM axes WHERE segment NOT IN (SELECT segment FROM pair3 GROUP BY 1 HAVING count(*) >= 10)", "pair3", "axes")
cte("csteps", "SELECT segment, lead(x) OVER w - x AS sx, lead(y) OVER w - y AS sy, lead(z) OVER w - z AS sz, x, y, point_id FROM cline WINDOW w AS (PARTITION BY segment ORDER BY x, y, point_id)", "cline")
cte("cturn", "SELECT segment, sqrt(sx*sx + sy*sy + sz*sz) AS d3, sqrt(sx*sx + sy*sy) AS d, abs(lead(atan2(sy, sx)) OVER (PARTITION BY segment ORDER BY x, y, point_id) - atan2(sy, sx)) AS turn FROM csteps WHERE sx IS NOT NULL", "csteps")
cte("tracks", "SELECT segment, length, coalesce(g, 1.435e0) AS gauge, coalesce(c, 0) AS cant, curvature, CASE WHEN curvature < 0.0001e0 THEN 'straight' WHEN curvature < 0.001e0 THEN 'transition' ELSE 'curve' END AS geometry_type, dz FROM "
    "(SELECT segment, sum(d3) AS length, CASE WHEN count(*) >= 9 AND sum(d) FILTER (turn IS NOT NULL) > 0 THEN sum(turn) / sum(d) FILTER (turn IS NOT NULL) ELSE 0 END AS curvature FROM cturn GROUP BY 1) LEFT JOIN (SELECT segment, median(sqrt((key // 1048576) / 1048576e0)) AS g, median(l.z - r.z) * 1000 AS c FROM pair2 GROUP BY 1) USING (segment) "
    "JOIN (SELECT segment, arg_max(z, point_id) - arg_min(z, point_id) AS dz FROM cline GROUP BY 1) USING (segment)", "cturn", "pair2", "cline")
_tr = lambda p: railway.track_segments(p, _E)
add("D23_N05_track_segments", "segment:i length:d gauge:d cant:d curvature:d geometry_type:s", _tr, "SELECT * FROM tracks", "tracks")
add("D24_N03_track_geometry", "segment:i horizontal_radius:d gradient:d km_start:d km_end:d", lambda p: railway.track_geometry(_tr(p)),
    "SELECT segment, CASE WHEN curvature > 0 THEN 1 / curvature END AS horizontal_radius, CASE WHEN length > 0 THEN dz / length * 1000 ELSE 0 END AS gradient, (sum(length) OVER (ORDER BY segment) - length) / 1000 AS km_start, sum(length) OVER (ORDER BY segment) / 1000 AS km_end FROM tracks", "tracks")
add("A41_track_statistics", "segments:i total_length_m:d avg_gauge_m:d max_cant_mm:d straight_ratio:d", lambda p: railway.track_statistics(_tr(p)),
    "SELECT count(*) AS segments, sum(length) AS total_length_m, avg(gauge) AS avg_gauge_m, max(abs(cant)) AS max_cant_mm, coalesce(sum(length) FILTER (geometry_type = 'straight'), 0) / sum(length) AS straight_ratio FROM tracks", "tracks")

# tracks that wind: each in its own frame
def _frames(p: DataFrame) -> DataFrame:
    got = tracks.along_track(p).join(p.select("point_id", "line", "truth"), "point_id")
    right = F.count(F.when(F.col("side") == F.col("truth"), 1))
    return got.groupBy("line").agg(F.count("*").alias("n"), F.countDistinct("track").alias("tracks"), F.countDistinct("segment").alias("segments"),
                                   F.least(right, F.count("*") - right).alias("wrong_sides"))


def _frame_segments(p: DataFrame) -> DataFrame:
    keys = ("track", "segment")
    axes = cut(railway.two_sided(tracks.along_track(p), keys, 50))
    seg = railway.track_segments(p, axes=axes, keys=keys, order=("chainage",))
    line = axes.join(p.select("point_id", "line"), "point_id").groupBy("track").agg(F.min("line").alias("line"))
    whole = seg.join(line, "track").where("length > 48")
    return whole.groupBy("line").agg(F.round(F.avg("gauge"), 3).alias("gauge"), F.round(F.max(F.abs("cant")), 0).alias("cant"),
                                     F.round(F.max("curvature") * 300).alias("bend"), (F.round(F.avg("length") / 5) * 5).alias("length"))


cte("windstep", "SELECT line, sqrt((u - lag(u) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM (SELECT o_orderkey % 2 AS line, (o_orderkey // 2) * 0.5e0 AS u, 60 * sin((o_orderkey // 2) * 0.5e0 / 150) AS y FROM orders) WINDOW w AS (PARTITION BY line ORDER BY u)")
add("D21_N05_track_frames", "line:i n:i tracks:i segments:i wrong_sides:i", _frames,
    "SELECT line, 2 * count(*) AS n, 1 AS tracks, CAST(floor(sum(step) / 50) AS BIGINT) + 1 AS segments, 0 AS wrong_sides FROM windstep GROUP BY line", "windstep", source=winding_tracks)
add("D23_track_frame_segments", "line:i gauge:d cant:d bend:d length:d", _frame_segments,
    "SELECT line, 1.435e0 AS gauge, 0 AS cant, round(60e0 / 150 / 150 * 300) AS bend, 50 AS length FROM windstep GROUP BY line", "windstep", source=winding_tracks)

# ---- signals --------------------------------------------------------------
_sg = lambda h: f"CASE WHEN {h} BETWEEN 3.5 AND 6 THEN 'main_signal' WHEN {h} BETWEEN 2.5 AND 4.5 THEN 'distant_signal' WHEN {h} BETWEEN 1.5 AND 3 THEN 'speed_limit' WHEN {h} BETWEEN 0.5 AND 1.5 THEN 'km_post' ELSE 'unknown' END"
cte("profile", "SELECT cluster, least(CAST(floor((z - lo) / ((hi - lo) / 19)) AS BIGINT), 18) AS bin, count(*) AS n_points, greatest(max(x) - min(x), max(y) - min(y)) AS width FROM polec JOIN (SELECT cluster, min(z) AS lo, max(z) AS hi FROM polec GROUP BY 1) USING (cluster) WHERE z < hi GROUP BY 1, 2", "polec")
add("N08_width_profile", "cluster:i bin:i n_points:i width:d", lambda p: railway.width_profile(railway.pole_clusters(p)), "SELECT * FROM profile", "profile")
add("D32_signals_on_poles", "cluster:i bin:i", lambda p: railway.signals_on_poles(p).select(F.floor(F.col("signal_id") / 100).alias("cluster"), (F.col("signal_id") % 100).alias("bin")),
    "SELECT cluster, bin FROM profile JOIN (SELECT cluster, min(bin) AS b0, arg_min(width, bin) AS w0 FROM profile WHERE n_points >= 3 GROUP BY 1) USING (cluster) WHERE n_points >= 3 AND bin > b0 AND width > w0 * 1.5e0 AND width > 0.3e0", "profile")
cte("sigsrc", f"SELECT s.*, z - lvl AS h FROM scene s, {_lvl} WHERE classification NOT IN (18, 2) AND z - lvl BETWEEN 0.5e0 AND 6", "scene")
dbscan_ctes("sigc", "sigsrc", 0.5, 3, ("x", "y", "z"))
cte("signals", f"SELECT cluster * 100 + 99 AS signal_id, x, y, z, {_sg('h')} AS signal_type, h AS height, w AS width FROM (SELECT cluster, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(h) AS h, greatest(max(x) - min(x), max(y) - min(y)) AS w, max(z) - min(z) AS zr FROM sigc GROUP BY 1) WHERE w < 0.5e0 AND zr < 2", "sigc")
add("D33_standalone_signals", "signal_id:i x:d y:d z:d signal_type:s height:d width:d", railway.standalone_signals, "SELECT * FROM signals", "signals")
add("D34_J15_all_signals", "signal_id:i signal_type:s height:d", railway.signals, "SELECT signal_id, signal_type, height FROM signals", "signals")
add("A43_signal_statistics", "total_count:i avg_height_m:d main_signals:i speed_limits:i km_posts:i", lambda p: railway.signal_statistics(railway.signals(p)),
    "SELECT count(*) AS total_count, avg(height) AS avg_height_m, count(*) FILTER (signal_type = 'main_signal') AS main_signals, count(*) FILTER (signal_type = 'speed_limit') AS speed_limits, count(*) FILTER (signal_type = 'km_post') AS km_posts FROM signals", "signals")
add("S18_object_features", "kind:s id:i type:s", lambda p: reports.object_features(railway.poles(p), railway.standalone_signals(p)),
    "SELECT 'pole' AS kind, pole_id AS id, pole_type AS type FROM poles UNION ALL SELECT 'signal', signal_id, signal_type FROM signals", "poles", "signals")
add("S19_pole_placemarks", "kind:s id:i ok:b", lambda p: (lambda q: reports.placemarks(q, q.select(F.col("pole_id").alias("signal_id"), "x", "y", "z", F.lit("km_post").alias("signal_type"), "height")))(cut(railway.poles(p))).withColumn("ok", F.col("placemark").startswith("<Placemark>")),
    "SELECT kind, pole_id AS id, true AS ok FROM poles, (VALUES ('pole'), ('signal')) AS v(kind)", "poles")


def _csv(p: DataFrame) -> DataFrame:
    path = work_folder(p.sparkSession, "poles")
    reports.write_csv(railway.poles(p), path)
    return p.sparkSession.read.option("header", True).csv(path)


add("S20_pole_csv", "pole_id:i height:d pole_type:s", _csv, "SELECT pole_id, height, pole_type FROM poles", "poles")
add("S21_infrastructure_summary", "catenary_contact_wires:i catenary_total_length:d poles_total_count:i signals_total_count:i", lambda p: inventory.summary(inventory.inventory(p)),
    "SELECT contact_wires AS catenary_contact_wires, total_length AS catenary_total_length, (SELECT count(*) FROM poles) AS poles_total_count, (SELECT count(*) FROM signals) AS signals_total_count FROM catstat", "catstat", "poles", "signals")

# ---- clearance and clashes ------------------------------------------------
_hw = "CASE WHEN h >= 5.3e0 THEN 0.75e0 " + " ".join(f"WHEN h <= {b}e0 THEN {wa}e0 + (h - {a}e0) / ({b}e0 - {a}e0) * ({wb}e0 - {wa}e0)" for (a, wa), (b, wb) in zip(findings.PROFILE, findings.PROFILE[1:])) + " END"
cte("viol", f"SELECT *, CASE WHEN violation > 0.3e0 THEN 'critical' WHEN violation > 0.1e0 THEN 'warning' ELSE 'minor' END AS severity FROM (SELECT *, {_hw} - 0.1e0 - distance AS violation FROM (SELECT s.*, z - lv AS h, abs((x - mx) * -sin(th) + (y - my) * cos(th)) AS distance FROM scene s, "
    "(SELECT avg(x) AS mx, avg(y) AS my, quantile_cont(z, 0.1) AS lv FROM scene WHERE classification = 18), (SELECT 0.5e0 * atan2(2 * cxy, cxx - cyy) AS th FROM railcov) WHERE classification IN (3,4,5,6,17,19,20,35,36)) WHERE h BETWEEN 0 AND 6) WHERE violation > 0", "scene", "railcov")
add("D35_P14_clearance_violations", "point_id:i distance:d height:d violation:d severity:s", findings.clearance_violations, "SELECT point_id, distance, h AS height, violation, severity FROM viol", "viol")
add("L01_worst_violations", "point_id:i violation:d", lambda p: findings.worst_violations(findings.clearance_violations(p)), "SELECT point_id, violation FROM viol ORDER BY round(violation, 6) DESC, point_id LIMIT 10", "viol")
add("S28_clearance_report", "status:s total:i critical:i", lambda p: reports.clearance_report(findings.clearance_violations(p)).select(
    *[F.get_json_object("json", f"$.{k}").alias(n) for k, n in (("status", "status"), ("summary.total", "total"), ("summary.critical", "critical"))]),
    "SELECT CASE WHEN count(*) > 0 THEN 'VIOLATIONS_FOUND' ELSE 'OK' END AS status, count(*) AS total, count(*) FILTER (severity = 'critical') AS critical FROM viol", "viol")
add("A45_clearance_summary", "severity:s classification:i n:i", lambda p: findings.clearance_summary(findings.clearance_violations(p)), "SELECT severity, classification, count(*) AS n FROM viol GROUP BY GROUPING SETS ((severity), (classification), ())", "viol")
add("D36_axis_violations", "point_id:i vertex:i dist:d distance:d", lambda p: findings.axis_violations(p, _axis_of(p).withColumn("allowed", 10.0 + F.col("seq") % 3)),
    "SELECT point_id, vertex, dist, dist - 10 - vertex % 3 AS distance FROM (SELECT s.point_id, arg_min(a.seq, (s.x - a.x)**2 + (s.y - a.y)**2) AS vertex, sqrt(min((s.x - a.x)**2 + (s.y - a.y)**2)) AS dist FROM scene s, axis a WHERE s.classification IN (5, 6) GROUP BY 1) WHERE dist < 10 + vertex % 3", "scene", "axis")
_CUSTOM = {(6, 19): 10.0, (5, 19): 12.5, (6, 18): 9.0, (5, 20): 14.0, (19, 5): 12.5, (6, 20): 12.0}
_PAIRS = [(a, b, _CUSTOM[a, b]) for a, b, _ in findings.CLASH_PAIRS]
cte("collide", " UNION ALL ".join(f"SELECT {i} AS pair, a.point_id, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.z) AS z, sqrt(min({_d3})) AS dist FROM b16 a JOIN (SELECT b16.*, bx + ox AS jx, by_ + oy AS jy FROM b16, ring) b ON a.bx = b.jx AND a.by_ = b.jy AND a.classification = {a} AND b.classification = {b} WHERE {_d3} < {d * d}e0 GROUP BY a.point_id" for i, (a, b, d) in enumerate(_PAIRS)), "b16", "ring")
cte("b16", "SELECT *, CAST(floor(x / 16) AS BIGINT) AS bx, CAST(floor(y / 16) AS BIGINT) AS by_ FROM scene WHERE classification IN (5, 6, 18, 19, 20)", "scene")
for _i, (_a, _b, _d) in enumerate(_PAIRS):
    cte(f"col{_i}", f"SELECT * FROM collide WHERE pair = {_i}", "collide")
    dbscan_ctes(f"clash{_i}", f"col{_i}", _d, 3, ("x", "y", "z"))
_nm = classes.CLASH_NAMES
cte("clashes", " UNION ALL ".join(f"SELECT {i} AS pair, cluster, count(*) AS points_involved, avg(x) AS x, avg(y) AS y, avg(z) AS z, min(dist) AS distance, CASE WHEN min(dist) < 0.1e0 THEN 'hard' WHEN min(dist) < {d}e0 * 0.5e0 THEN 'soft' ELSE 'clearance' END AS clash_type, "
    f"CASE WHEN min(dist) < 0.1e0 THEN 'critical' WHEN min(dist) < {d}e0 * 0.3e0 THEN 'major' WHEN min(dist) < {d}e0 * 0.7e0 THEN 'minor' ELSE 'info' END AS severity, '{_nm[a]}' AS element_a, '{_nm[b]}' AS element_b FROM clash{i} GROUP BY cluster" for i, (a, b, d) in enumerate(_PAIRS)), *[f"clash{i}" for i in range(6)])
add("J06_collision_points", "pair:i point_id:i dist:d", lambda p: findings.collision_points(p, _PAIRS), "SELECT pair, point_id, dist FROM collide", "collide")
_cl = lambda p: findings.clashes(p, _PAIRS)
add("D37_clashes", "pair:i cluster:i points_involved:i x:d y:d z:d distance:d clash_type:s severity:s element_a:s element_b:s", _cl, "SELECT * FROM clashes", "clashes")
add("A45_clash_counts", "kind:s name:s n:i", lambda p: findings.clash_counts(_cl(p)),
    "SELECT 'severity' AS kind, severity AS name, count(*) AS n FROM clashes GROUP BY 2 UNION ALL SELECT 'type', clash_type, count(*) FROM clashes GROUP BY 2 UNION ALL SELECT 'elements', element_a || '-' || element_b, count(*) FROM clashes GROUP BY 2", "clashes")
add("L05_S27_capped_clash_report", "pos:i ok:b", lambda p: reports.clash_items(findings.clashes(p, _PAIRS, max_clashes=5)).withColumn("ok", F.col("line").startswith("<div")),
    "SELECT row_number() OVER (ORDER BY pair, cluster) - 1 AS pos, true AS ok FROM clashes ORDER BY pair, cluster LIMIT 5", "clashes")
add("D38_object_clearance", "clash_type:s severity:s distance:d points_involved:i", lambda p: findings.object_clearance(p.where("classification = 6"), p.where("classification = 19"), 10.0),
    "SELECT CASE WHEN min(dist) < 0.5e0 THEN 'hard' WHEN min(dist) < 5 THEN 'soft' ELSE 'clearance' END AS clash_type, CASE WHEN min(dist) < 0.5e0 THEN 'critical' WHEN min(dist) < 5 THEN 'major' ELSE 'minor' END AS severity, min(dist) AS distance, count(*) AS points_involved FROM collide WHERE pair = 0", "collide")

# ---- buildings, planes, LOD ----------------------------------------------
cte("bsrc", "SELECT * FROM scene WHERE classification = 6", "scene")
dbscan_ctes("bc", "bsrc", 2.0, 20)
cte("blds", "SELECT *, a * height AS volume_m3, greatest(1, CAST(floor(height / 3e0 + 0.5e0) AS BIGINT)) AS floor_count FROM (SELECT cluster AS building_id, count(*) AS n_points, (max(x) - min(x)) * (max(y) - min(y)) AS a, 2 * (max(x) - min(x) + max(y) - min(y)) AS p, max(z) - g AS height, least(1e0, count(*) / 500e0) AS confidence FROM bc, (SELECT avg(z) AS g FROM scene WHERE classification = 2) GROUP BY cluster, g) WHERE a >= 20 AND height >= 2.5e0", "bc", "scene")
add("D40_buildings", "building_id:i n_points:i area_m2:d perimeter_m:d height:d roof_type:s volume_m3:d floor_count:i confidence:d", shapes.buildings,
    "SELECT building_id, n_points, a AS area_m2, p AS perimeter_m, height, 'flat' AS roof_type, volume_m3, floor_count, confidence FROM blds", "blds")
add("A44_building_statistics", "total_count:i total_area_m2:d total_volume_m3:d avg_height_m:d roof_flat:i rectangular_count:i total_floors:i", lambda p: shapes.building_totals(shapes.buildings(p)),
    "SELECT count(*) AS total_count, sum(a) AS total_area_m2, sum(volume_m3) AS total_volume_m3, avg(height) AS avg_height_m, count(*) AS roof_flat, count(*) AS rectangular_count, sum(floor_count) AS total_floors FROM blds", "blds")
add("S23_building_elements", "name:s element_type:s", lambda p: reports.building_elements(shapes.buildings(p)), "SELECT 'Building_' || building_id AS name, 'IfcBuilding' AS element_type FROM blds", "blds")
add("D03_J17_best_plane", "chunk_id:i inliers:i nz:d", lambda p: planes.best_planes(p.where("classification = 6"), "chunk_id", 40).select("chunk_id", "inliers", F.round(F.abs("nz"), 4).alias("nz")),
    "SELECT chunk_id, count(*) AS inliers, 1e0 AS nz FROM scene WHERE classification = 6 AND z = 106 GROUP BY 1", "scene")
add("D42_cloud_lod", "lod:i overall_score:d confidence:d tips:s", lambda p: lod.cloud_lod(p).withColumn("tips", F.concat_ws(",", "recommendations")),
    "SELECT CASE WHEN s >= 90 THEN 500 WHEN s >= 75 THEN 400 WHEN s >= 60 THEN 350 WHEN s >= 45 THEN 300 WHEN s >= 30 THEN 200 ELSE 100 END AS lod, s AS overall_score, least(1e0, s / 100) AS confidence, concat_ws(',', CASE WHEN ds < 50 THEN 'low_density' END, CASE WHEN cs < 70 THEN 'incomplete_coverage' END, CASE WHEN es < 50 THEN 'limited_classes' END, CASE WHEN ns < 80 THEN 'noisy' END, "
    "CASE WHEN ds >= 50 AND cs >= 70 AND es >= 50 AND ns >= 80 THEN 'good_quality' END) AS tips FROM (SELECT *, ds * 0.4e0 + cs * 0.3e0 + es * 0.2e0 + ns * 0.1e0 AS s FROM (SELECT CASE WHEN d < 1 THEN 10 WHEN d < 5 THEN 30 WHEN d < 20 THEN 50 ELSE 70 END AS ds, cs, es, ns FROM (SELECT n / ((x1 - x0) * (y1 - y0)) AS d FROM ext), "
    "(SELECT (SELECT count(*) FROM (SELECT DISTINCT least(floor((x - x0) / 10), nx - 1), least(floor((y - y0) / 10), ny - 1) FROM scene, lodgrid)) * 100e0 / (SELECT nx * ny FROM lodgrid) AS cs, least(100e0, least(30e0, k * 3e0) + CASE WHEN b > 100 THEN 20 ELSE 0 END + 10 * i + 5 * v) AS es, greatest(0e0, 100 - n7 * 500e0 / n) AS ns FROM "
    "(SELECT count(*) AS n, count(DISTINCT classification) AS k, count(*) FILTER (classification = 6) AS b, count(*) FILTER (classification = 7) AS n7, count(DISTINCT classification) FILTER (classification IN (18, 19, 20)) AS i, count(DISTINCT classification) FILTER (classification IN (3, 4, 5)) AS v FROM scene))))", "scene", "ext", "lodgrid")
add("D43_element_lod", "chunk_id:i lod:i point_density:d edge_quality:d confidence:d", lambda p: lod.element_lod(p.where("classification = 6"), "chunk_id"),
    "SELECT chunk_id, CASE WHEN s >= 90 THEN 500 WHEN s >= 75 THEN 400 WHEN s >= 60 THEN 350 WHEN s >= 45 THEN 300 WHEN s >= 30 THEN 200 ELSE 100 END AS lod, d AS point_density, q AS edge_quality, least(1e0, n / 200e0) AS confidence FROM (SELECT *, least(100e0, d * 2) * 0.5e0 + q * 50 AS s FROM "
    "(SELECT chunk_id, n, n / greatest(a, 1) AS d, CASE WHEN n < 20 THEN 0.3e0 WHEN 4e0 / n BETWEEN 0.1 AND 0.3 THEN 0.9e0 WHEN 4e0 / n BETWEEN 0.05 AND 0.4 THEN 0.7e0 ELSE 0.5e0 END AS q FROM (SELECT chunk_id, count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS a FROM scene WHERE classification = 6 GROUP BY 1)))", "scene")

# ---- plans ----------------------------------------------------------------
add("T00_slice", "point_id:i hag:d new_class:i", plan.classify_given_ground, "SELECT point_id, hag, new_class FROM slice", "slice")
add("T00_slice_histogram", "new_class:i n:i", lambda p: plan.classify_given_ground(p).groupBy("new_class").agg(F.count("*").alias("n")), "SELECT new_class, count(*) AS n FROM slice GROUP BY 1", "slice")
add("T00_step_statistics", "n_points:i noise:i ground:i vegetation:i infrastructure:i unclassified:i hag_min:d hag_max:d hag_mean:d", lambda p: plan.step_statistics(plan.classify_given_ground(p)),
    "SELECT count(*) AS n_points, count(*) FILTER (new_class = 7) AS noise, count(*) FILTER (new_class = 2) AS ground, count(*) FILTER (new_class IN (3, 4, 5)) AS vegetation, count(*) FILTER (new_class IN (9,17,18,19,20,21,30,32,35,36)) AS infrastructure, count(*) FILTER (new_class = 1) AS unclassified, min(hag) AS hag_min, max(hag) AS hag_max, avg(hag) AS hag_mean FROM slice", "slice")
