"""The six-step classification from raw points to classes, with its SQL.

The SQL restates every step: noise from neighbour distances, the opened surface
of cell minima, ground heights, strata, building planes, infrastructure masks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, features, ground, landcover, planes, raster, sampling
from ..operators.cells import Extent
from ..plans import classify as plan
from .registry import MASKS, PRECEDENCE, add, clone, cte
from .spatial import _d3, eigen_cte

#: The scene without its noise: one point a square metre at most, less than 20 m deep.
PARAMS = ground.auto_params(Extent(600_000, 0.0, 1000.0, 0.0, 1000.0, 100.0, 110.0))
_CANDIDATE = ("hag BETWEEN 2.5e0 AND 50 AND NOT ((green - red) / (green + red + 1e-8) > 0.12e0 OR (green > red AND green > blue AND green > 0.3e0) "
              "OR sqrt(((red-(red+green+blue)/3e0)**2 + (green-(red+green+blue)/3e0)**2 + (blue-(red+green+blue)/3e0)**2) / 3e0) > 0.15e0)")


def surface_ctes(name: str, source: str, p: ground.GroundParams) -> str:
    """CTEs of the opened minimum surface of ``source``; returns the last one (ix, iy, h)."""
    r = p.resolution
    cte(f"{name}s0", f"SELECT CAST(floor((x - x0) / {r}e0) AS BIGINT) AS ix, CAST(floor((y - y0) / {r}e0) AS BIGINT) AS iy, min(z) AS h FROM {source}, ext GROUP BY 1, 2", source, "ext")
    k, reach, before = 0, 1, 0
    while True:
        near = f"FROM {{t}} g, range(-{reach}, {reach + 1}) a(ox), range(-{reach}, {reach + 1}) b(oy) JOIN {{t}} n ON n.ix = g.ix + ox AND n.iy = g.iy + oy GROUP BY g.ix, g.iy"
        cte(f"{name}e{k}", "SELECT g.ix, g.iy, min(n.h) AS h " + near.format(t=f"{name}s{k}"), f"{name}s{k}")
        cte(f"{name}d{k}", "SELECT g.ix, g.iy, max(n.h) AS h " + near.format(t=f"{name}e{k}"), f"{name}e{k}")
        step = p.slope * (reach - before) * 2 * r + p.threshold
        cte(f"{name}s{k + 1}", f"SELECT g.ix, g.iy, CASE WHEN g.h - d.h > {step}e0 THEN d.h ELSE g.h END AS h FROM {name}s{k} g JOIN {name}d{k} d USING (ix, iy)", f"{name}s{k}", f"{name}d{k}")
        if (2 * reach + 1) * r >= p.max_window:
            return f"{name}s{k + 1}"
        k, before, reach = k + 1, reach, reach * 2


def plan_ctes(name: str, noise: str, height_cell: float, surface: str = "CAST(NULL AS BIGINT)", *deps: str) -> None:
    """CTE ``{name}`` (point_id, hag, new_class): all steps after the noise mask ``noise`` (point_id, is_noise).

    ``surface`` is the class of a building surface over the columns of the features.
    """
    r, h, t = PARAMS.resolution, height_cell, PARAMS.threshold
    cte(f"{name}_raw", f"SELECT scene.*, is_noise FROM scene JOIN {noise} USING (point_id)", "scene", noise)
    cte(f"{name}_valid", f"SELECT * FROM {name}_raw WHERE NOT is_noise", f"{name}_raw")
    top = surface_ctes(f"{name}_", f"{name}_valid", PARAMS)
    cte(f"{name}_mask", f"SELECT p.*, NOT is_noise AND coalesce(z - h <= {t}e0, false) AS is_ground, CAST(floor((x - x0) / {h}e0) AS BIGINT) AS hx, CAST(floor((y - y0) / {h}e0) AS BIGINT) AS hy, "
        "least(CAST(floor((x - x0) / 0.5e0) AS BIGINT), greatest(1, CAST(ceil((x1 - x0) / 0.5e0) AS BIGINT)) - 1) AS cx, least(CAST(floor((y - y0) / 0.5e0) AS BIGINT), greatest(1, CAST(ceil((y1 - y0) / 0.5e0) AS BIGINT)) - 1) AS cy "
        f"FROM {name}_raw p CROSS JOIN ext LEFT JOIN {top} s ON s.ix = CAST(floor((x - x0) / {r}e0) AS BIGINT) AND s.iy = CAST(floor((y - y0) / {r}e0) AS BIGINT)", f"{name}_raw", "ext", top)
    cte(f"{name}_known", f"SELECT hx, hy, min(z) AS gz FROM {name}_mask WHERE is_ground GROUP BY 1, 2", f"{name}_mask")
    cte(f"{name}_cell", f"SELECT cx, cy, greatest(sum(z * z) / count(*) - (sum(z) / count(*)) * (sum(z) / count(*)), 0e0) AS z_variance, max(z) - min(z) AS z_range, count(*) / 0.25e0 AS density FROM {name}_mask GROUP BY cx, cy", f"{name}_mask")
    cte(f"{name}_hag", f"SELECT m.*, coalesce(z - gz, 0e0) AS hag, (red + green + blue) / 3e0 AS bright, sqrt(((red-(red+green+blue)/3e0)**2 + (green-(red+green+blue)/3e0)**2 + (blue-(red+green+blue)/3e0)**2) / 3e0) AS sat FROM {name}_mask m LEFT JOIN {name}_known USING (hx, hy)", f"{name}_mask", f"{name}_known")
    cte(f"{name}_feat", "SELECT *, CASE WHEN NOT (((green-red)/(green+red+1e-8) > 0.05e0) OR (green/(red+green+blue+1e-8) > 0.33e0)) OR is_ground OR hag <= 0 THEN NULL WHEN hag <= 0.5e0 THEN 3 WHEN hag <= 3e0 THEN 4 ELSE 5 END AS stratum "
        f"FROM {name}_hag JOIN {name}_cell USING (cx, cy)", f"{name}_hag", f"{name}_cell")
    cte(name, f"SELECT point_id, hag, CASE WHEN is_noise THEN 7 WHEN is_ground THEN 2 WHEN stratum IS NOT NULL THEN stratum WHEN {surface} IS NOT NULL THEN {surface} "
        + " ".join(f"WHEN {MASKS[n]} THEN {c}" for n, c in PRECEDENCE) + f" ELSE 1 END AS new_class FROM {name}_feat", f"{name}_feat", *deps)


# ---- the whole plan -------------------------------------------------------
#: Roofs of the scene lie in one plane; within 2 cm no other plane of it has as many points.
cte("roofplane", f"SELECT count(*) AS n FROM hag WHERE z = 106 AND {_CANDIDATE}", "hag")
add("D04_A23_plane_extraction", "n_points:i building:i roof:i wall:i roof_hag_mean:d", lambda p: (lambda h: planes.building_statistics(h, planes.extract_planes(
    h.where(landcover.building_candidates(F.col("hag"))), cells.extent(h), 64.0, max_planes=1, min_points=500, threshold=0.02)))(raster.height_above_ground(p)),
    f"SELECT (SELECT count(*) FROM scene) AS n_points, count(*) AS building, count(*) AS roof, 0 AS wall, avg(hag) AS roof_hag_mean FROM hag, roofplane WHERE z = 106 AND {_CANDIDATE} AND n >= 500", "scene", "hag", "roofplane")
plan_ctes("whole", "sor", 1.0)
add("T00_full_classification", "new_class:i n:i", lambda p: plan.classify(p).groupBy("new_class").agg(F.count("*").alias("n")), "SELECT new_class, count(*) AS n FROM whole GROUP BY 1", "whole")
plan_ctes("roofed", "sor", 1.0, "CASE WHEN z = 106 AND hag BETWEEN 2.5e0 AND 50 AND (SELECT count(*) FROM roofed_feat WHERE z = 106 AND hag BETWEEN 2.5e0 AND 50) >= 500 THEN 41 END")
add("T00_full_one_roof_plane", "point_id:i hag:d new_class:i", lambda p: plan.classify(p, plan.Config(planes={"max_planes": 1, "min_points": 500, "threshold": 0.02})), "SELECT * FROM roofed", "roofed")

# fast preset: statistics of centroids of 1 m voxels, 2 m height cells, no buildings
cte("vox1", "SELECT floor(x) AS vx, floor(y) AS vy, floor(z) AS vz, avg(x) AS x, avg(y) AS y, avg(z) AS z, min(point_id) AS vid, bool_and(classification = 7) AS alone FROM scene GROUP BY 1, 2, 3", "scene")
cte("vox1b", "SELECT *, CAST(floor(x / 8) AS BIGINT) AS bx, CAST(floor(y / 8) AS BIGINT) AS by_ FROM vox1", "vox1")
cte("vox1near", f"SELECT a.vid, min(sqrt({_d3}), 15) AS ds FROM (SELECT vox1b.*, bx + ox AS jx, by_ + oy AS jy FROM vox1b, ring WHERE NOT alone) a JOIN vox1b b ON a.jx = b.bx AND a.jy = b.by_ AND a.vid <> b.vid GROUP BY a.vid "
    f"UNION ALL SELECT a.vid, min(sqrt({_d3}), 15) FROM vox1 a JOIN vox1 b ON a.vid <> b.vid WHERE a.alone GROUP BY a.vid", "vox1b", "vox1", "ring")
cte("vox1mean", "SELECT vid, list_avg(ds) AS m FROM vox1near", "vox1near")
cte("fastnoise", "SELECT point_id, m > (SELECT avg(m) + 2 * stddev_pop(m) FROM vox1mean) AS is_noise FROM scene s JOIN vox1 v ON floor(s.x) = v.vx AND floor(s.y) = v.vy AND floor(s.z) = v.vz JOIN vox1mean USING (vid)", "scene", "vox1", "vox1mean")
plan_ctes("fast", "fastnoise", 2.0)
add("T00_fast_preset", "new_class:i n:i", lambda p: plan.classify(p, plan.preset("fast")).groupBy("new_class").agg(F.count("*").alias("n")), "SELECT new_class, count(*) AS n FROM fast GROUP BY 1", "fast")
add("T00_fast_points", "point_id:i hag:d new_class:i", lambda p: plan.classify(p, plan.preset("fast")), "SELECT * FROM fast", "fast")

# three squares of 40 m as a cloud of their own
cte("sqscene", "SELECT scene.* FROM scene, (SELECT *, greatest(1, CAST(ceil((x1 - x0) / 40) AS BIGINT)) AS nc, greatest(1, CAST(ceil((y1 - y0) / 40) AS BIGINT)) AS nr FROM ext) "
    "WHERE least(CAST(floor((y - y0) / 40) AS BIGINT), nr - 1) * nc + least(CAST(floor((x - x0) / 40) AS BIGINT), nc - 1) + 1 IN (1, 2, 9)", "scene", "ext")
clone("sq_", ("ext", "ground_cell", "hag", "keyed", "cell", "feat", "slice"), "sqscene")


def _selected_squares(p):
    e = cells.extent(p)
    keep = sampling.square_key(p, e, 40.0).where(F.col("square_id").isin(1, 2, 9)).drop("square_id")
    return plan.classify_given_ground(keep).groupBy("new_class").agg(F.count("*").alias("n"))


add("F08_selected_squares_only", "new_class:i n:i", _selected_squares, "SELECT new_class, count(*) AS n FROM sq_slice GROUP BY 1", "sq_slice")

# planarity of the 30 nearest points, the point among them
cte("near30s", "SELECT point_id, unnest(arg_min(bx, key, 29)) AS x, unnest(arg_min(by_, key, 29)) AS y, unnest(arg_min(bz, key, 29)) AS z FROM cand WHERE point_id IN (SELECT point_id FROM hag WHERE hag >= 2) GROUP BY point_id "
    "UNION ALL SELECT point_id, x, y, z FROM hag WHERE hag >= 2", "cand", "hag")
cte("covs30", "SELECT point_id, count(*) AS n, " + ", ".join([f"greatest(var_pop({a}), 0) AS c{a}{a}" for a in "xyz"] + [f"covar_pop({a}, {b}) AS c{a}{b}" for a, b in ("xy", "xz", "yz")]) + " FROM near30s GROUP BY point_id", "near30s")
eigen_cte("eigs30", "covs30")
add("D05_planar_surfaces", "is_planar:b n:i", lambda p: features.planarity_mask(raster.height_above_ground(p), 30).groupBy("is_planar").agg(F.count("*").alias("n")),
    "SELECT (l2 - l3) * n / (l1 * n + 1e-8) > 0.7e0 AS is_planar, count(*) AS n FROM eigs30 GROUP BY 1", "eigs30")
