"""Scans, projections, filters, aggregates, windows, sorts, set operations, sampling."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from ..functions import classes, colour
from ..functions import height as H
from ..operators import active, cells, evaluation, features, findings, ground, landcover, learning, lod, noise, railway, raster, rules, sampling, shapes, smoothing
from ..plans import classify as plan
from ..sources import las, points as pts, reports
from ..sources.scene import predictions
from .registry import MASKS, add, cte, hash_sql, names_sql

REPORT = names_sql(classes.REPORT_NAMES, "classification", "'Klasa_' || classification")
PT = "point_id:i x:d y:d z:d classification:i"


def _las(p):
    p.sparkSession.dataSource.register(las.LasDataSource)
    folder = tempfile.mkdtemp(prefix="spark-")
    p.drop("file_id", "chunk_id", "point_id").coalesce(4).write.format("las").mode("append").save(folder)
    return p.sparkSession.read.format("las").load(folder), folder


# ---- S: scans and sinks ---------------------------------------------------
add("S01_las_round_trip", "classification:i n:i", lambda p: _las(p)[0].groupBy("classification").agg(F.count("*").alias("n")),
    "SELECT classification, count(*) AS n FROM scene GROUP BY classification", "scene")
add("S02_sampled_scan", PT, lambda p: sampling.hash_sample(p, 1000, 3),
    f"SELECT * FROM scene ORDER BY {hash_sql('point_id', 3)}, point_id LIMIT 1000", "scene")
add("S03_subset_by_bounds", PT, lambda p: pts.subset(p, {"x": (10, 60), "y": (0, 40), "z": (100, 106)}),
    "SELECT * FROM scene WHERE x BETWEEN 10 AND 60 AND y BETWEEN 0 AND 40 AND z BETWEEN 100 AND 106", "scene")
add("S04_chunks_with_progress", "chunk:i start_idx:i end_idx:i progress:d n:i",
    lambda p: pts.chunks(p, 7000).groupBy("chunk", "start_idx", "end_idx", "progress").agg(F.count("*").alias("n")),
    "SELECT point_id // 7000 AS chunk, (point_id // 7000) * 7000 AS start_idx, least((point_id // 7000 + 1) * 7000, n) AS end_idx, "
    "least((point_id // 7000 + 1) * 7000, n) * 100e0 / n AS progress, count(*) AS n FROM scene, (SELECT n FROM ext) GROUP BY ALL", "scene", "ext")
add("S05_file_metadata", "n_points:i x_min:d x_max:d y_min:d y_max:d z_min:d z_max:d has_rgb:b", pts.metadata,
    "SELECT n AS n_points, x0 AS x_min, x1 AS x_max, y0 AS y_min, y1 AS y_max, z0 AS z_min, z1 AS z_max, true AS has_rgb FROM ext", "ext")
add("S05_las_header", "version:s has_rgb:b n_points:i", lambda p: (lambda f: las.file_info(p.sparkSession, f).groupBy("version", "has_rgb").agg(F.sum("n_points").alias("n_points")))(_las(p)[1]))
add("S06_file_discovery", "n_files:i all_positive:b", lambda p: (lambda f: pts.discover(p.sparkSession, f).agg(
    F.count("*").alias("n_files"), (F.min("length") > 0).alias("all_positive")))(_las(p)[1]))


def _tiles_written(p):
    folder = tempfile.mkdtemp(prefix="spark-")
    ext = cells.extent(p)
    pts.write_tiles(sampling.tile_key(p, ext, 50.0), folder)
    return p.sparkSession.read.parquet(folder).groupBy("tile_id", "classification").agg(F.count("*").alias("n"))


cte("tiled", "SELECT scene.*, least(CAST(floor((x - x0) / 50) AS BIGINT), CAST(ceil((x1 - x0) / 50) AS BIGINT) - 1) * CAST(ceil((y1 - y0) / 50) AS BIGINT) + "
    "least(CAST(floor((y - y0) / 50) AS BIGINT), CAST(ceil((y1 - y0) / 50) AS BIGINT) - 1) AS tile_id FROM scene, ext", "scene", "ext")
add("S07_write_by_tile", "tile_id:i classification:i n:i", _tiles_written,
    "SELECT tile_id, classification, count(*) AS n FROM tiled GROUP BY ALL", "tiled")
_new = lambda p: p.select("point_id", F.when(F.col("z") > 105, 6).otherwise(F.col("classification")).alias("new_class"))
add("S08_replace_classes", PT, lambda p: pts.replace_classes(p, _new(p)),
    "SELECT point_id, x, y, z, CASE WHEN z > 105 THEN 6 ELSE classification END AS classification FROM scene", "scene")
add("S09_scatter_selected_squares", "classification:i n:i",
    lambda p: pts.scatter_classes(p, p.where("x < 40").select("point_id", F.when(F.col("z") > 105, 6).otherwise(F.col("classification")).alias("new_class"))).groupBy("classification").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN x >= 40 THEN 1 WHEN z > 105 THEN 6 ELSE classification END AS classification, count(*) AS n FROM scene GROUP BY 1", "scene")
cte("hist", "SELECT classification AS class_id, count(*) AS count, count(*) * 100e0 / (SELECT n FROM ext) AS percentage FROM scene GROUP BY 1", "scene", "ext")
add("S10_class_report_text", "pos:i line:s", reports.class_report,
    "SELECT class_id + 100 AS pos, '  [' || lpad(CAST(class_id AS VARCHAR), 2, ' ') || '] ' || rpad("
    + names_sql(classes.REPORT_NAMES, "class_id", "'Nieznana klasa ' || class_id") + ", 30, ' ') || ' ' || lpad(format('{:,}', count), 12, ' ') || ' (' || printf('%5.2f', percentage) || '%)' AS line FROM hist "
    "UNION ALL SELECT pos, line FROM (SELECT unnest([0,1,2,3,4,5,6,7,100000]) AS pos, unnest([repeat('=',60), 'RAPORT KLASYFIKACJI CHMURY PUNKTÓW', repeat('=',60), "
    "'Całkowita liczba punktów: ' || format('{:,}', n), 'Liczba wykrytych klas: ' || (SELECT count(*) FROM hist), '', 'Rozkład klasyfikacji:', repeat('-',60), repeat('=',60)]) AS line FROM ext)", "hist", "ext")
add("S11_class_report_sorted", "class_id:i count:i percentage:d", lambda p: evaluation.class_histogram(p).orderBy("class_id"),
    "SELECT * FROM hist ORDER BY class_id", "hist")
add("S12_json_report", "total:i classified:i ground:i", lambda p: reports.json_report(p).select(
    F.get_json_object("json", "$.statistics.total_points").alias("total"), F.get_json_object("json", "$.statistics.classified_points").alias("classified"),
    F.get_json_object("json", "$.classification.2.count").alias("ground")),
    "SELECT count(*) AS total, count(*) FILTER (classification <> 1) AS classified, count(*) FILTER (classification = 2) AS ground FROM scene", "scene")
add("S13_extended_rows", "class_id:i name:s description:s count:i percentage:d asprs_standard:b", reports.extended_rows,
    "SELECT class_id, " + names_sql({k: v[0] for k, v in classes.EXTENDED.items()}, "class_id", "'Klasa ' || class_id") + " AS name, "
    + names_sql({k: v[1] for k, v in classes.EXTENDED.items()}, "class_id", "''") + " AS description, count, round(percentage, 4) AS percentage, class_id <= 31 AS asprs_standard FROM hist", "hist")
add("S13_extended_json", "score:d diversity:i", lambda p: reports.extended_report(p, 150000).select(
    F.get_json_object("json", "$.quality_metrics.overall_score").alias("score"), F.get_json_object("json", "$.quality_metrics.class_diversity").alias("diversity")),
    "SELECT round(least(100e0, count(*) FILTER (classification <> 1) * 100e0 / count(*) * 0.4e0 + least((count(DISTINCT classification) FILTER (classification <> 1)) / 10e0, 1e0) * 30 + 0.75e0 * 30), 1) AS score, "
    "count(DISTINCT classification) FILTER (classification <> 1) AS diversity FROM scene", "scene")
add("S14_multi_square_counts", "class_id:i count:i percentage:d",
    lambda p: evaluation.merge_counts(p.groupBy("chunk_id", F.col("classification").alias("class_id")).agg(F.count("*").alias("count"))), "SELECT * FROM hist", "hist")
add("S15_bounds_feature", "width_m:d height_m:d elevation_range_m:d corners:i", lambda p: reports.bounds_feature(p).select(
    "feature.properties.*", F.size(F.element_at("feature.geometry.coordinates", 1)).alias("corners")),
    "SELECT round(x1 - x0, 2) AS width_m, round(y1 - y0, 2) AS height_m, round(z1 - z0, 2) AS elevation_range_m, 5 AS corners FROM ext", "ext")
add("S16_class_centroids", "class_id:i class_name:s point_count:i percentage:d x:d y:d centroid_z:d z_min:d z_max:d", reports.class_centroids,
    f"SELECT classification AS class_id, {REPORT} AS class_name, count(*) AS point_count, round(count(*) * 100e0 / n, 2) AS percentage, avg(x) AS x, avg(y) AS y, round(avg(z), 2) AS centroid_z, "
    "round(min(z), 2) AS z_min, round(max(z), 2) AS z_max FROM scene, (SELECT n FROM ext) GROUP BY classification, n", "scene", "ext")
add("S17_geojson_collection", "features:i total:i", lambda p: reports.geojson(p).select(
    F.size(F.from_json(F.get_json_object("json", "$.features"), "array<string>")).alias("features"), F.get_json_object("json", "$.properties.total_points").alias("total")),
    "SELECT count(DISTINCT classification) + 1 AS features, count(*) AS total FROM scene", "scene")
add("S22_class_boxes", "class_id:i ifc_type:s name:s count:i percentage:d x_min:d x_max:d x_center:d z_center:d", reports.class_boxes,
    "SELECT classification AS class_id, " + names_sql({k: v[0] for k, v in classes.IFC_TYPES.items()}, "classification", "'IfcBuildingElementProxy'") + " AS ifc_type, "
    + names_sql({k: v[2] for k, v in classes.IFC_TYPES.items()}, "classification", "'Class ' || classification") + " AS name, count(*) AS count, count(*) * 100e0 / (SELECT n FROM ext) AS percentage, "
    "min(x) AS x_min, max(x) AS x_max, avg(x) AS x_center, avg(z) AS z_center FROM scene GROUP BY classification", "scene", "ext")
add("S22_step_entities", "entities:i elements:i", lambda p: reports.step_lines(reports.class_boxes(p)).agg(
    F.count("*").alias("entities"), F.count(F.when(F.col("line").contains("IFCBUILDINGELEMENTPROXY"), 1)).alias("elements")),
    "SELECT count(DISTINCT classification) * 9 AS entities, count(DISTINCT classification) AS elements FROM scene", "scene")
add("S23_infrastructure_elements", "name:s element_type:s x:d y:d z:d", lambda p: reports.infrastructure_elements(p.where("classification = 20"), "chunk_id", "pole"),
    "SELECT 'pole_' || chunk_id AS name, 'IfcColumn' AS element_type, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM scene WHERE classification = 20 GROUP BY chunk_id", "scene")
add("S23_cloud_element", PT, lambda p: reports.cloud_element(p, 0.1, 1),
    f"SELECT * FROM scene ORDER BY {hash_sql('point_id', 1)}, point_id LIMIT (SELECT CAST(floor(n * 0.1e0) AS BIGINT) FROM ext)", "scene", "ext")


def _elements_json(p):
    folder = tempfile.mkdtemp(prefix="spark-")
    e = reports.infrastructure_elements(p.where("classification = 20"), "chunk_id", "pole")
    reports.write_json(e, folder + "/j")
    reports.write_xml(e.drop("properties"), folder + "/x")
    s = p.sparkSession
    a = reports.element_summary(s.read.json(folder + "/j")).withColumn("format", F.lit("json"))
    return a.unionByName(reports.element_summary(s.read.format("xml").option("rowTag", "Element").load(folder + "/x")).withColumn("format", F.lit("xml")))


add("S24_element_files", "format:s element_type:s n:i", _elements_json,
    "SELECT format, 'IfcColumn' AS element_type, count(DISTINCT chunk_id) AS n FROM scene, (VALUES ('json'), ('xml')) AS f(format) WHERE classification = 20 GROUP BY format", "scene")
add("S25_element_summary", "element_type:s n:i", lambda p: reports.element_summary(
    reports.infrastructure_elements(p.where("classification = 20"), "chunk_id", "pole").unionByName(reports.infrastructure_elements(p.where("classification = 5"), "chunk_id", "vegetation"))),
    "SELECT 'IfcColumn' AS element_type, count(DISTINCT chunk_id) AS n FROM scene WHERE classification = 20 UNION ALL SELECT 'IfcGeographicElement', count(DISTINCT chunk_id) FROM scene WHERE classification = 5", "scene")
add("S26_viewer_payload", "point_id:i x:d y:d z:d classification:i", lambda p: reports.viewer_points(p, 20_000, 2),
    "SELECT point_id, (x - mx) / s AS x, (y - my) / s AS y, (z - mz) / s AS z, classification FROM few, (SELECT mx, my, mz, max(greatest(abs(x - mx), abs(y - my), abs(z - mz))) AS s FROM few, "
    "(SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM few) GROUP BY mx, my, mz)", "few")
cte("few", f"SELECT * FROM scene ORDER BY {hash_sql('point_id', 2)}, point_id LIMIT 20000", "scene")
add("S26_viewer_classes", "class_id:i name:s colour:s count:i percentage:d", reports.viewer_classes,
    "SELECT class_id, " + names_sql(classes.REPORT_NAMES, "class_id", "'Klasa_' || class_id") + " AS name, " + names_sql(classes.VIEWER_COLOURS, "class_id", "'#888888'")
    + " AS colour, count, round(percentage, 2) AS percentage FROM hist", "hist")
add("S33_tile_map_rows", "tile_id:i corners:i first_x:d density:d is_empty:b", lambda p: sampling.map_rows(sampling.tiles(p, 50.0)).select(
    "tile_id", F.size("corners_x").alias("corners"), F.element_at("corners_x", 1).alias("first_x"), "density", "is_empty"),
    "SELECT g.tile_id, 5 AS corners, x0 + gx * 50e0 AS first_x, coalesce(k, 0) / 2500e0 AS density, coalesce(k, 0) = 0 AS is_empty FROM grid50 g LEFT JOIN "
    "(SELECT tile_id, count(*) AS k FROM tiled GROUP BY 1) USING (tile_id), ext", "grid50", "tiled", "ext")
cte("grid50", "SELECT gx, gy, gx * CAST(ceil((y1 - y0) / 50) AS BIGINT) + gy AS tile_id FROM ext, generate_series(0, CAST(ceil((x1 - x0) / 50) AS BIGINT) - 1) AS a(gx), "
    "generate_series(0, CAST(ceil((y1 - y0) / 50) AS BIGINT) - 1) AS b(gy)", "ext")

# ---- P: projections -------------------------------------------------------
_C = lambda: (F.col("red"), F.col("green"), F.col("blue"))
add("P01_P02_normalise_scan", "point_id:i red:d intensity:d", lambda p: pts.normalise(
    p.withColumns({"red": (F.col("red") * 65535).cast("int"), "green": (F.col("green") * 65535).cast("int"), "blue": (F.col("blue") * 65535).cast("int"),
                   "intensity": (F.col("intensity") * 40000).cast("int")}), "chunk_id"),
    "SELECT point_id, CAST(floor(red * 65535) AS BIGINT) / 65535e0 AS red, intensity * 40000 / 30000e0 AS intensity FROM scene", "scene")
add("P03_P07_colour_indices", "point_id:i ndvi:d green_ratio:d excess_green:d brightness:d saturation:d", lambda p: p.select(
    "point_id", colour.ndvi(*_C()[:2]).alias("ndvi"), colour.green_ratio(*_C()).alias("green_ratio"), colour.excess_green(*_C()).alias("excess_green"),
    colour.brightness(*_C()).alias("brightness"), colour.saturation(*_C()).alias("saturation")),
    "SELECT point_id, (green - red) / (green + red + 1e-8) AS ndvi, green / (red + green + blue + 1e-8) AS green_ratio, 2 * green - red - blue AS excess_green, bright AS brightness, sat AS saturation FROM feat", "feat")
add("P08_P09_normalised_coordinates", "point_id:i zn:d x:d y:d z:d", lambda p: (lambda e: features.normalised_coordinates(
    p.withColumn("zn", (F.col("z") - F.lit(e.z_min)) / F.lit(e.depth + 1e-6)), e))(cells.extent(p)),
    "SELECT point_id, (z - z0) / (z1 - z0 + 1e-6) AS zn, 2 * (x - x0) / (x1 - x0) - 1 AS x, 2 * (y - y0) / (y1 - y0) - 1 AS y, 2 * (z - z0) / (z1 - z0) - 1 AS z FROM scene, ext", "scene", "ext")
add("P10_augmented_blocks", "n:i close:b", lambda p: features.augment(p).agg(F.count("*").alias("n"), (F.avg("z") > 80).alias("close")),
    "SELECT count(*) AS n, true AS close FROM scene", "scene")
add("P11_P12_projection_and_plane", "point_id:i u:d v:d plane_distance:d", lambda p: shapes.projection(p, "x").join(
    shapes.plane_section(p, (0, 0, 103), (0, 0.6, 0.8), 5.0).select("point_id", "plane_distance"), "point_id"),
    "SELECT point_id, y AS u, z AS v, y * 0.6e0 + (z - 103) * 0.8e0 AS plane_distance FROM scene WHERE abs(y * 0.6e0 + (z - 103) * 0.8e0) < 5", "scene")
add("P13_P15_track_offsets", "point_id:i along:d across:d above:d", lambda p: (lambda r: p.select(
    "point_id", (F.col("x") * 0.8 + F.col("y") * 0.6).alias("along"), F.abs(F.col("x") * -0.6 + F.col("y") * 0.8).alias("across"), (F.col("z") - F.lit(r)).alias("above")))(railway.reference_level(p)),
    "SELECT point_id, x * 0.8e0 + y * 0.6e0 AS along, abs(y * 0.8e0 - x * 0.6e0) AS across, z - (SELECT avg(z) FROM scene WHERE classification = 18) AS above FROM scene", "scene")
add("P16_octants", "classification:i octant:i n:i", lambda p: p.join(F.broadcast(p.groupBy("classification").agg(*[F.avg(a).alias(f"g{a}") for a in "xyz"])), "classification").groupBy(
    "classification", sum((F.when(F.col(a) >= F.col(f"g{a}"), w).otherwise(0) for a, w in zip("xyz", (1, 2, 4))), F.lit(0)).alias("octant")).agg(F.count("*").alias("n")),
    "SELECT classification, CASE WHEN x >= gx THEN 1 ELSE 0 END + CASE WHEN y >= gy THEN 2 ELSE 0 END + CASE WHEN z >= gz THEN 4 ELSE 0 END AS octant, count(*) AS n FROM scene JOIN "
    "(SELECT classification, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz FROM scene GROUP BY 1) USING (classification) GROUP BY ALL", "scene")
add("P17_hag_zones", "zone:s n:i", lambda p: raster.height_above_ground(p).groupBy(H.hag_zone(F.col("hag")).alias("zone")).agg(F.count("*").alias("n")),
    "SELECT CASE WHEN hag < 0 THEN 'below_ground' WHEN hag < 0.15e0 THEN 'ground_level' WHEN hag < 0.5e0 THEN 'low_vegetation' WHEN hag < 3 THEN 'medium_vegetation' WHEN hag < 10 THEN 'high_vegetation' ELSE 'very_high' END AS zone, count(*) AS n FROM hag GROUP BY 1", "hag")
cte("zoned", "SELECT t.*, CASE WHEN z >= q90 THEN 'D' WHEN z >= q30 THEN 'C' WHEN z < q05 THEN 'A' ELSE 'B' END AS zone FROM tiled t JOIN (SELECT tile_id, quantile_cont(z, 0.05) AS q05, "
    "quantile_cont(z, 0.3) AS q30, quantile_cont(z, 0.9) AS q90 FROM tiled GROUP BY 1) USING (tile_id)", "tiled")
add("P18_height_zones", "tile_id:i zone:s n:i", lambda p: (lambda t: t.join(plan.zone_thresholds(t), "tile_id").groupBy(
    "tile_id", H.height_zone(F.col("z"), F.col("z_ground"), F.col("z_low"), F.col("z_high")).alias("zone")).agg(F.count("*").alias("n")))(sampling.tile_key(p, cells.extent(p), 50.0)),
    "SELECT tile_id, zone, count(*) AS n FROM zoned GROUP BY ALL", "zoned")
_prof = "CASE WHEN h <= 0 THEN 1.575e0 WHEN h >= 5.3e0 THEN 0.75e0 " + " ".join(
    f"WHEN h <= {b}e0 THEN {wa}e0 + (h - {a}e0) / ({b}e0 - {a}e0) * ({wb}e0 - {wa}e0)" for (a, wa), (b, wb) in zip(findings.PROFILE, findings.PROFILE[1:])) + " END"
add("P19_J11_clearance_width", "point_id:i half_width:d", lambda p: p.select("point_id", H.piecewise_linear(F.col("z") - 100, findings.PROFILE).alias("half_width")),
    f"SELECT point_id, {_prof} AS half_width FROM (SELECT point_id, z - 100 AS h FROM scene)", "scene")
add("P20_P29_severity_bands", "point_id:i clearance:s clash:s severity:s", lambda p: p.select(
    "point_id", findings.clearance_severity(F.col("intensity")).alias("clearance"), findings.clash_type(F.col("intensity"), F.lit(0.8)).alias("clash"),
    findings.clash_severity(F.col("intensity"), F.lit(0.8)).alias("severity")),
    "SELECT point_id, CASE WHEN intensity > 0.3e0 THEN 'critical' WHEN intensity > 0.1e0 THEN 'warning' ELSE 'minor' END AS clearance, CASE WHEN intensity < 0.1e0 THEN 'hard' WHEN intensity < 0.4e0 THEN 'soft' ELSE 'clearance' END AS clash, "
    "CASE WHEN intensity < 0.1e0 THEN 'critical' WHEN intensity < 0.8e0 * 0.3e0 THEN 'major' WHEN intensity < 0.8e0 * 0.7e0 THEN 'minor' ELSE 'info' END AS severity FROM scene", "scene")
add("P21_P24_object_types", "point_id:i pole:s single:s signal:s", lambda p: p.select(
    "point_id", railway.pole_type(F.col("z") - 98, F.col("red") * 2).alias("pole"), railway.single_pole_type(F.col("z") - 98, F.col("red") * 2).alias("single"),
    railway.signal_type(F.col("z") - 100).alias("signal")),
    "SELECT point_id, CASE WHEN z - 98 BETWEEN 6 AND 12 THEN 'catenary' WHEN z - 98 > 8 THEN 'lighting' WHEN z - 98 BETWEEN 3 AND 8 THEN 'signal' WHEN red * 2 > 1 AND z - 98 > 5 THEN 'gantry' ELSE 'unknown' END AS pole, "
    "CASE WHEN z - 98 BETWEEN 6 AND 12 THEN 'catenary' WHEN z - 98 > 12 THEN 'lighting' WHEN z - 98 BETWEEN 3 AND 8 THEN 'signal' WHEN red * 2 > 1 THEN 'gantry' ELSE 'unknown' END AS single, "
    "CASE WHEN z - 100 BETWEEN 3.5e0 AND 6 THEN 'main_signal' WHEN z - 100 BETWEEN 2.5e0 AND 4.5e0 THEN 'distant_signal' WHEN z - 100 BETWEEN 1.5e0 AND 3 THEN 'speed_limit' WHEN z - 100 BETWEEN 0.5e0 AND 1.5e0 THEN 'km_post' ELSE 'unknown' END AS signal FROM scene", "scene")
add("P23_signal_type_by_colour", "classification:i kind:s", lambda p: p.groupBy("classification").agg(*[F.avg(c).alias(c) for c in ("red", "green", "blue")]).select(
    "classification", railway.signal_type_by_colour(F.lit("km_post"), F.col("red") * 1.6, F.col("green") * 0.9, F.col("blue") * 0.5).alias("kind")),
    "SELECT classification, CASE WHEN r > 150 AND g < 100 AND b < 100 THEN 'main_signal' WHEN r > 150 AND g > 150 AND b < 100 THEN 'warning_board' WHEN (r + g + b) / 3 > 200 THEN 'whistle_board' ELSE 'km_post' END AS kind "
    "FROM (SELECT classification, avg(red) * 1.6e0 * 255 AS r, avg(green) * 0.9e0 * 255 AS g, avg(blue) * 0.5e0 * 255 AS b FROM scene GROUP BY 1)", "scene")
add("P25_P27_roof_and_floors", "point_id:i roof:s kind:s floors:i confidence:d", lambda p: p.select(
    "point_id", shapes.roof_type((F.col("z") - 100) * 2, F.col("intensity") > 0.3).alias("roof"), landcover.surface_kind(F.col("intensity")).alias("kind"),
    shapes.floors(F.col("z") - 100).alias("floors"), H.capped_ratio((F.col("z") - 100) * 10, 50).alias("confidence")),
    "SELECT point_id, CASE WHEN s < 5 THEN 'flat' WHEN s < 25 THEN CASE WHEN intensity > 0.3e0 THEN 'gable' ELSE 'shed' END WHEN s < 45 THEN 'hip' ELSE 'complex' END AS roof, CASE WHEN intensity > 0.8e0 THEN 'roof' WHEN intensity < 0.2e0 THEN 'wall' ELSE 'sloped_roof' END AS kind, "
    "greatest(1, CAST(floor((z - 100) / 3e0 + 0.5e0) AS BIGINT)) AS floors, least(1e0, (z - 100) * 10 / 50e0) AS confidence FROM (SELECT *, (z - 100) * 2 AS s FROM scene)", "scene")
add("P30_P31_lod_levels", "point_id:i density_score:d lod:i min_density:i accuracy_m:d geometry:s uses:s", lambda p: lod.with_requirements(p.select(
    "point_id", lod.density_score(F.col("z") - 100).alias("density_score"), lod.level_of((F.col("z") - 100) * 8).alias("lod"))).withColumn("uses", F.concat_ws("|", "use_cases")),
    "SELECT point_id, CASE WHEN d < 1 THEN 10 WHEN d < 5 THEN 30 WHEN d < 20 THEN 50 WHEN d < 50 THEN 70 WHEN d < 100 THEN 85 ELSE least(100e0, 85 + (d - 100) / 10) END AS density_score, lod, "
    "CASE lod WHEN 100 THEN 1 WHEN 200 THEN 5 WHEN 300 THEN 20 WHEN 350 THEN 50 WHEN 400 THEN 100 ELSE 200 END AS min_density, CASE lod WHEN 100 THEN 1e0 WHEN 200 THEN 0.5e0 WHEN 300 THEN 0.15e0 WHEN 350 THEN 0.05e0 WHEN 400 THEN 0.02e0 ELSE 0.01e0 END AS accuracy_m, "
    + names_sql({r[0]: r[4] for r in lod.REQUIREMENTS}, "lod", "NULL") + " AS geometry, " + names_sql({r[0]: "|".join(r[5]) for r in lod.REQUIREMENTS}, "lod", "NULL") + " AS uses "
    "FROM (SELECT point_id, z - 100 AS d, CASE WHEN (z - 100) * 8 >= 90 THEN 500 WHEN (z - 100) * 8 >= 75 THEN 400 WHEN (z - 100) * 8 >= 60 THEN 350 WHEN (z - 100) * 8 >= 45 THEN 300 WHEN (z - 100) * 8 >= 30 THEN 200 ELSE 100 END AS lod FROM scene)", "scene")
add("P32_recommendations", "tips:s", lambda p: reports.quality_row(p, 1.0).select(F.concat_ws(",", "recommendations").alias("tips")),
    "SELECT CASE WHEN count(DISTINCT classification) FILTER (classification <> 1) < 5 THEN 'few_classes' ELSE 'no_remarks' END AS tips FROM scene", "scene")
add("P33_P34_slope_orientation", "point_id:i slope:d", lambda p: p.select("point_id", shapes.slope_degrees(F.col("intensity")).alias("slope")),
    "SELECT point_id, degrees(acos(least(1e0, abs(intensity)))) AS slope FROM scene", "scene")
_PR = lambda: F.array(
    F.col("red") / (F.col("red") + F.col("green") + F.col("blue")), F.col("green") / (F.col("red") + F.col("green") + F.col("blue")), F.col("blue") / (F.col("red") + F.col("green") + F.col("blue")))
cte("probs", "SELECT point_id, intensity AS confidence, classification, red / (red + green + blue) AS p1, green / (red + green + blue) AS p2, blue / (red + green + blue) AS p3 FROM scene", "scene")
add("P35_entropy_margin", "point_id:i entropy:d margin:d", lambda p: p.select("point_id", active.entropy(_PR()).alias("entropy"), active.margin(_PR()).alias("margin")),
    "SELECT point_id, -(p1 * ln(p1 + 1e-10) + p2 * ln(p2 + 1e-10) + p3 * ln(p3 + 1e-10)) AS entropy, greatest(p1, p2, p3) - (p1 + p2 + p3 - greatest(p1, p2, p3) - least(p1, p2, p3)) AS margin FROM probs", "probs")
add("P36_P37_P39_size_rules", "resolution:d rigidness:i threshold:d tile:i square:d voxel:d detector:s", lambda p: (lambda e, g: p.sparkSession.createDataFrame(
    [(g.resolution, g.rigidness, g.threshold, sampling.optimal_tile_size(e, 20_000), float(sampling.square_size(e, 3000)), sampling.voxel_size_for(e, 5000), noise.choose_detector(e.n))],
    "resolution double, rigidness int, threshold double, tile int, square double, voxel double, detector string"))(*(lambda e: (e, ground.auto_params(e)))(cells.extent(p))),
    "SELECT CASE WHEN d > 100 THEN 0.5e0 WHEN d > 20 THEN 1 ELSE 2 END AS resolution, CASE WHEN z1 - z0 > 50 THEN 1 WHEN z1 - z0 > 20 THEN 2 ELSE 3 END AS rigidness, CASE WHEN d > 50 THEN 0.3e0 ELSE 0.5e0 END AS threshold, "
    "greatest(5, least(300, CASE WHEN ts < 20 THEN greatest(5, round_even(ts / 5e0, 0) * 5) ELSE round_even(ts / 10e0, 0) * 10 END)) AS tile, CASE WHEN sq < 10 THEN greatest(2, round_even(sq, 0)) WHEN sq < 50 THEN round_even(sq / 5, 0) * 5 ELSE round_even(sq / 10, 0) * 10 END AS square, "
    "greatest(pow((x1 - x0) * (y1 - y0) * (z1 - z0) / 5000e0, 1e0 / 3) * 0.7e0, sqrt((x1 - x0) * (y1 - y0) / n) * sqrt(5000e0 / n), 0.1e0) AS voxel, 'sor' AS detector "
    "FROM (SELECT *, n / greatest(x1 - x0, y1 - y0)**2 AS d, floor(sqrt(20000e0 / (n / ((x1 - x0) * (y1 - y0))))) AS ts, sqrt(3000e0 / (n / ((x1 - x0) * (y1 - y0)))) AS sq FROM ext)", "ext")

# ---- W: filters -----------------------------------------------------------
add("W01_class_filter", "classification:i n:i", lambda p: p.where(F.col("classification").isin(findings.OBSTACLE_CLASSES)).groupBy("classification").agg(F.count("*").alias("n")),
    "SELECT classification, count(*) AS n FROM scene WHERE classification IN (3,4,5,6,17,19,20,35,36) GROUP BY 1", "scene")
add("W02_square_crop", PT, lambda p: sampling.crop_square(p, 60.0, 60.0, 40.0), "SELECT * FROM scene WHERE x BETWEEN 40 AND 80 AND y BETWEEN 40 AND 80", "scene")
cte("cheb", "SELECT greatest(abs(x - cx), abs(y - cy)) AS d FROM scene, (SELECT median(x) AS cx, median(y) AS cy FROM scene)", "scene")
cte("side", "SELECT least(2 * CASE WHEN a = b THEN coalesce((SELECT max(d) FROM cheb WHERE d < a), 0e0) ELSE a END, 1.2e0 * sqrt(3000 / (n / ((x1 - x0) * (y1 - y0))))) AS side FROM "
    "(SELECT max(d) FILTER (rn = 3000) AS a, max(d) FILTER (rn = 3001) AS b FROM (SELECT d, row_number() OVER (ORDER BY d) AS rn FROM cheb)), ext", "cheb", "ext")
add("W03_W04_select_area", "area_side:d n:i", lambda p: (lambda a: a[0].agg(F.count("*").alias("n")).withColumn("area_side", F.lit(a[1]["area_side"])))(sampling.select_area(p, 3000)),
    "SELECT side AS area_side, count(*) FILTER (d <= side / 2) AS n FROM cheb, side GROUP BY side", "cheb", "side")
add("W05_sections", "point_id:i plane_distance:d", lambda p: shapes.horizontal_slice(p, 106.0, 0.1).select("point_id", "plane_distance"),
    "SELECT point_id, z - 106 AS plane_distance FROM scene WHERE abs(z - 106) < 0.1e0", "scene")
add("W06_height_band", PT, lambda p: p.where((F.col("classification") == 19) & H.band(F.col("z") - 100.0703125, 5.0, 5.5)),
    "SELECT * FROM scene WHERE classification = 19 AND z - 100.0703125e0 BETWEEN 5 AND 5.5e0", "scene")
add("W07_building_candidates", "classification:i n:i", lambda p: raster.height_above_ground(p).where(landcover.building_candidates(F.col("hag"))).groupBy("classification").agg(F.count("*").alias("n")),
    "SELECT classification, count(*) AS n FROM feat WHERE hag BETWEEN 2.5e0 AND 50 AND NOT ((green - red) / (green + red + 1e-8) > 0.12e0 OR (green > red AND green > blue AND green > 0.3e0) OR sat > 0.15e0) GROUP BY 1", "feat")
add("W08_roof_points", "chunk_id:i n:i", lambda p: shapes.roof_points(p.where("classification = 6"), "chunk_id").groupBy("chunk_id").agg(F.count("*").alias("n")),
    "SELECT chunk_id, count(*) AS n FROM (SELECT *, max(z) OVER w - 0.3e0 * (max(z) OVER w - min(z) OVER w) AS t FROM scene WHERE classification = 6 WINDOW w AS (PARTITION BY chunk_id)) WHERE z >= t GROUP BY 1", "scene")
add("W09_impute_missing", "point_id:i intensity:d", lambda p: learning.impute(
    p.select("point_id", F.when(F.col("point_id") % 5 != 0, F.col("intensity")).alias("intensity")), ["intensity"]),
    "SELECT point_id, CASE WHEN point_id % 5 <> 0 THEN intensity ELSE (SELECT avg(intensity) FROM scene WHERE point_id % 5 <> 0) END AS intensity FROM scene", "scene")
add("W10_minimum_group_size", "classification:i n:i", lambda p: p.groupBy("classification").agg(F.count("*").alias("n")).where("n >= 2000"),
    "SELECT classification, count(*) AS n FROM scene GROUP BY 1 HAVING count(*) >= 2000", "scene")
add("W11_low_confidence", "model:s n:i", lambda p: predictions(p).where("confidence < 0.3").groupBy("model").agg(F.count("*").alias("n")),
    "SELECT model, count(*) AS n FROM pred WHERE confidence < 0.3e0 GROUP BY 1", "pred")
cte("squared", "SELECT scene.*, least(CAST(floor((y - y0) / 20) AS BIGINT), CAST(ceil((y1 - y0) / 20) AS BIGINT) - 1) * CAST(ceil((x1 - x0) / 20) AS BIGINT) + "
    "least(CAST(floor((x - x0) / 20) AS BIGINT), CAST(ceil((x1 - x0) / 20) AS BIGINT) - 1) + 1 AS square_id FROM scene, ext", "scene", "ext")
add("W12_squares_by_id", "square_id:i n:i", lambda p: sampling.square_key(p, cells.extent(p), 20.0).where(F.col("square_id").isin(1, 2, 30)).groupBy("square_id").agg(F.count("*").alias("n")),
    "SELECT square_id, count(*) AS n FROM squared WHERE square_id IN (1, 2, 30) GROUP BY 1", "squared")
add("W13_vegetation_strata", "classification:i stratum:i n:i", lambda p: raster.height_above_ground(p).withColumn(
    "stratum", landcover.vegetation_stratum(F.col("hag"), F.col("classification") == 2)).groupBy("classification", "stratum").agg(F.count("*").alias("n")),
    "SELECT classification, stratum, count(*) AS n FROM feat GROUP BY ALL", "feat")


def _ready(p):
    f = plan.with_height_and_cells(p.withColumn("is_ground", F.col("classification") == 2), cells.extent(p), 1.0, 0.5)
    return f.withColumn("is_veg", landcover.vegetation_stratum(F.col("hag"), F.col("is_ground")).isNotNull())


_m = landcover.infrastructure_masks
add("W15_W25_infrastructure_masks", " ".join(f"{k}:i" for k in MASKS), lambda p: _ready(p).agg(*[F.count(F.when(c, 1)).alias(k) for k, c in _m().items()]),
    "SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in MASKS.items()) + " FROM feat", "feat")
for _i, (_k, _n) in enumerate(zip(MASKS, range(15, 25))):
    add(f"W{_n}_{_k}", "point_id:i", lambda p, k=_k: _ready(p).where(_m()[k]).select("point_id"), f"SELECT point_id FROM feat WHERE {MASKS[_k]}", "feat")

# ---- A: aggregates --------------------------------------------------------
add("A01_class_histogram", "class_id:i count:i percentage:d", evaluation.class_histogram, "SELECT * FROM hist", "hist")
add("A02_classified_summary", "classified_count:i classified_percentage:d unclassified_count:i unclassified_percentage:d", evaluation.classified_summary,
    "SELECT count(*) FILTER (classification <> 1) AS classified_count, count(*) FILTER (classification <> 1) * 100e0 / count(*) AS classified_percentage, count(*) FILTER (classification = 1) AS unclassified_count, count(*) FILTER (classification = 1) * 100e0 / count(*) AS unclassified_percentage FROM scene", "scene")
add("A03_extent_and_density", "n_points:i x_min:d x_max:d y_min:d y_max:d z_min:d z_max:d area_m2:d density:d", cells.extent_frame,
    "SELECT n AS n_points, x0 AS x_min, x1 AS x_max, y0 AS y_min, y1 AS y_max, z0 AS z_min, z1 AS z_max, (x1 - x0) * (y1 - y0) AS area_m2, n / ((x1 - x0) * (y1 - y0)) AS density FROM ext", "ext")
add("A04_voxel_centroids", "vx:i vy:i vz:i n:i x:d y:d z:d", lambda p: cells.voxel_centroids(p, 0.5),
    "SELECT CAST(floor(x / 0.5e0) AS BIGINT) AS vx, CAST(floor(y / 0.5e0) AS BIGINT) AS vy, CAST(floor(z / 0.5e0) AS BIGINT) AS vz, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM scene GROUP BY 1, 2, 3", "scene")
add("A05_cell_statistics", "cx:i cy:i cell_count:i z_mean:d z_variance:d z_range:d density:d", lambda p: cells.cell_stats(
    cells.with_cell(p, cells.extent(p), 0.5, names=("cx", "cy")), 0.5, ("cx", "cy")), "SELECT * FROM cell", "cell")
add("A12_reference_level", "rail:d ground:d none:d", lambda p: p.sparkSession.createDataFrame([(railway.reference_level(p), railway.reference_level(p, (2,)), railway.reference_level(p, (99,)))], "rail double, ground double, none double"),
    "SELECT avg(z) FILTER (classification = 18) AS rail, avg(z) FILTER (classification = 2) AS ground, min(z) AS none FROM scene", "scene")
add("A13_A14_exact_quantiles", "q05:d q10:d q30:d q50:d q90:d", lambda p: p.sparkSession.createDataFrame([tuple(cells.quantiles(p, "z", [0.05, 0.1, 0.3, 0.5, 0.9]))], "q05 double, q10 double, q30 double, q50 double, q90 double"),
    "SELECT " + ", ".join(f"quantile_cont(z, {q}) AS q{n}" for q, n in ((0.05, "05"), (0.1, "10"), (0.3, "30"), (0.5, "50"), (0.9, "90"))) + " FROM scene", "scene")
add("A15_distinct_classes", "n_classes:i", lambda p: p.agg(F.countDistinct("classification").alias("n_classes")), "SELECT count(DISTINCT classification) AS n_classes FROM scene", "scene")
add("A16_entropy_cells", "i:i j:i n:i z_std:d center_x:d center_y:d", lambda p: sampling.high_entropy_cells(p, cells.extent(p), 10, 500),
    "SELECT i, j, count(*) AS n, stddev_pop(z) AS z_std, x0 + (i + 0.5e0) * sx AS center_x, y0 + (j + 0.5e0) * sy AS center_y FROM (SELECT *, CAST(floor((x - x0) / sx) AS BIGINT) AS i, CAST(floor((y - y0) / sy) AS BIGINT) AS j "
    "FROM scene, (SELECT *, (x1 - x0) / 10 AS sx, (y1 - y0) / 10 AS sy FROM ext)) WHERE i < 10 AND j < 10 GROUP BY i, j, x0, y0, sx, sy HAVING count(*) >= 500", "scene", "ext")
add("A17_height_by_class", "class_id:i n:i z_min:d z_max:d z_mean:d z_std:d", evaluation.height_by_class,
    "SELECT classification AS class_id, count(*) AS n, min(z) AS z_min, max(z) AS z_max, avg(z) AS z_mean, stddev_pop(z) AS z_std FROM scene GROUP BY 1", "scene")
add("A18_height_histogram", "bin:i n:i lower:d", lambda p: (lambda e: evaluation.histogram(p, "z", e.z_min, e.z_max, 50))(cells.extent(p)),
    "SELECT least(CAST(floor((z - z0) / ((z1 - z0) / 50)) AS BIGINT), 49) AS bin, count(*) AS n, z0 + least(CAST(floor((z - z0) / ((z1 - z0) / 50)) AS BIGINT), 49) * ((z1 - z0) / 50) AS lower FROM scene, ext GROUP BY 1, 3", "scene", "ext")
add("A20_ground_statistics", "n_points:i n_ground:i n_non_ground:i ground_pct:d ground_z_min:d ground_z_max:d ground_z_mean:d", lambda p: ground.ground_statistics(p, F.col("classification") == 2),
    "SELECT count(*) AS n_points, count(*) FILTER (classification = 2) AS n_ground, count(*) FILTER (classification <> 2) AS n_non_ground, count(*) FILTER (classification = 2) * 100e0 / count(*) AS ground_pct, "
    "min(z) FILTER (classification = 2) AS ground_z_min, max(z) FILTER (classification = 2) AS ground_z_max, avg(z) FILTER (classification = 2) AS ground_z_mean FROM scene", "scene")
add("A21_hag_statistics", "n_points:i n_ground:i hag_min:d hag_max:d hag_mean:d hag_std:d hag_median:d below_ground_pct:d",
    lambda p: ground.hag_statistics(raster.height_above_ground(p), F.count(F.when(F.col("classification") == 2, 1))),
    "SELECT count(*) AS n_points, count(*) FILTER (classification = 2) AS n_ground, min(hag) AS hag_min, max(hag) AS hag_max, avg(hag) AS hag_mean, stddev_pop(hag) AS hag_std, median(hag) AS hag_median, count(*) FILTER (hag < 0) * 100e0 / count(*) AS below_ground_pct FROM hag", "hag")
add("A22_vegetation_statistics", "name:s count:i percentage:d hag_mean:d", lambda p: landcover.vegetation_statistics(
    raster.height_above_ground(p), landcover.vegetation_stratum(F.col("hag"), F.col("classification") == 2)),
    "SELECT name, count(f.point_id) AS count, count(f.point_id) * 100e0 / (SELECT n FROM ext) AS percentage, coalesce(avg(hag), 0e0) AS hag_mean FROM (VALUES (3, 'low_vegetation'), (4, 'medium_vegetation'), (5, 'high_vegetation')) AS v(s, name) LEFT JOIN feat f ON f.stratum = v.s GROUP BY name", "feat", "ext")
add("A24_grid_statistics", "total:i non_empty:i empty:i total_points:i avg_points:d min_points:i max_points:i", lambda p: sampling.grid_statistics(sampling.tiles(p, 50.0)),
    "SELECT count(*) AS total, count(k) AS non_empty, count(*) - count(k) AS empty, sum(k) AS total_points, avg(k) AS avg_points, min(k) AS min_points, max(k) AS max_points FROM grid50 LEFT JOIN (SELECT tile_id, count(*) AS k FROM tiled GROUP BY 1) USING (tile_id)", "grid50", "tiled")
add("A25_sampling_statistics", "original_points:i sampled_points:i sampling_ratio:d", lambda p: sampling.random_sample(p, 5000).agg(F.count("*").alias("sampled_points")).withColumn(
    "original_points", F.lit(p.count())).withColumn("sampling_ratio", F.col("sampled_points") / F.col("original_points")),
    "SELECT n AS original_points, least(n, 5000) AS sampled_points, least(n, 5000) / CAST(n AS DOUBLE) AS sampling_ratio FROM ext", "ext")
add("A26_chunk_merge", "class_id:i count:i percentage:d", lambda p: evaluation.merge_counts(p.groupBy("chunk_id", F.col("classification").alias("class_id")).agg(F.count("*").alias("count"))), "SELECT * FROM hist", "hist")
add("A28_reclassification_delta", "n_points:i changed:i changed_pct:d", lambda p: smoothing.delta(p.join(_new(p), "point_id")),
    "SELECT count(*) AS n_points, count(*) FILTER (z > 105 AND classification <> 6) AS changed, count(*) FILTER (z > 105 AND classification <> 6) * 100e0 / count(*) AS changed_pct FROM scene", "scene")
add("A29_quality_score", "class_diversity:i classified_percentage:d overall_score:d", lambda p: reports.quality_row(p, 100000),
    "SELECT d AS class_diversity, c AS classified_percentage, least(100e0, c * 0.4e0 + least(d / 10e0, 1e0) * 30 + 15) AS overall_score FROM (SELECT count(DISTINCT classification) FILTER (classification <> 1) AS d, count(*) FILTER (classification <> 1) * 100e0 / count(*) AS c FROM scene)", "scene")
add("A31_A39_boxes", "chunk_id:i point_count:i size_x:d size_y:d size_z:d center_x:d volume:d surface_area:d", lambda p: shapes.boxes(p, "chunk_id"),
    "SELECT chunk_id, n AS point_count, a AS size_x, b AS size_y, c AS size_z, m AS center_x, a * b * c AS volume, 2 * (a * b + b * c + c * a) AS surface_area FROM (SELECT chunk_id, count(*) AS n, max(x) - min(x) AS a, max(y) - min(y) AS b, max(z) - min(z) AS c, (max(x) + min(x)) / 2 AS m FROM scene GROUP BY 1)", "scene")
add("A39_merged_box", "size_x:d size_y:d size_z:d volume:d", lambda p: shapes.merge_boxes(shapes.boxes(p, "chunk_id")),
    "SELECT x1 - x0 AS size_x, y1 - y0 AS size_y, z1 - z0 AS size_z, (x1 - x0) * (y1 - y0) * (z1 - z0) AS volume FROM ext", "ext")
add("A33_octant_uniformity", "chunk_id:i density_uniformity:d", lambda p: shapes.octant_uniformity(p, "chunk_id"),
    "SELECT chunk_id, greatest(0e0, 1 - sqrt(list_aggregate(list_transform([o0,o1,o2,o3,o4,o5,o6,o7], lambda v: (v - n / 8e0) * (v - n / 8e0)), 'sum') / 8e0) / (n / 8e0)) AS density_uniformity FROM (SELECT chunk_id, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (o = {i}) AS o{i}" for i in range(8)) + " FROM (SELECT s.chunk_id, CASE WHEN x >= gx THEN 1 ELSE 0 END + CASE WHEN y >= gy THEN 2 ELSE 0 END + CASE WHEN z >= gz THEN 4 ELSE 0 END AS o FROM scene s JOIN (SELECT chunk_id, avg(x) AS gx, avg(y) AS gy, avg(z) AS gz FROM scene GROUP BY 1) USING (chunk_id)) GROUP BY 1)", "scene")
add("A34_compactness", "chunk_id:i compactness:d", lambda p: shapes.compactness(p, "chunk_id", 0.5),
    "SELECT chunk_id, least(1e0, v * 0.125e0 / vol) AS compactness FROM (SELECT chunk_id, count(*) AS v FROM (SELECT DISTINCT chunk_id, floor(x / 0.5e0), floor(y / 0.5e0), floor(z / 0.5e0) FROM scene) GROUP BY 1) JOIN "
    "(SELECT chunk_id, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS vol FROM scene GROUP BY 1) USING (chunk_id)", "scene")
add("A46_A47_lod_scores", "completeness_score:d detail_score:d noise_score:d class_count:i", lambda p: cells.beside(lod.completeness(p), lod.detail_and_noise(p)),
    "SELECT (SELECT count(*) FROM (SELECT DISTINCT least(floor((x - x0) / 10), nx - 1), least(floor((y - y0) / 10), ny - 1) FROM scene, lodgrid)) * 100e0 / (SELECT nx * ny FROM lodgrid) AS completeness_score, "
    "least(100e0, least(30e0, k * 3e0) + CASE WHEN b > 100 THEN 20 ELSE 0 END + 10 * i + 5 * v) AS detail_score, greatest(0e0, 100 - n7 * 500e0 / n) AS noise_score, k AS class_count FROM "
    "(SELECT count(*) AS n, count(DISTINCT classification) AS k, count(*) FILTER (classification = 6) AS b, count(*) FILTER (classification = 7) AS n7, count(DISTINCT classification) FILTER (classification IN (18, 19, 20)) AS i, count(DISTINCT classification) FILTER (classification IN (3, 4, 5)) AS v FROM scene)", "scene", "lodgrid")
cte("lodgrid", "SELECT *, greatest(1, floor((x1 - x0) / 10)) AS nx, greatest(1, floor((y1 - y0) / 10)) AS ny FROM ext", "ext")

# ---- N, L, U: windows, sorts, sets ---------------------------------------
add("N06_first_per_cell", PT, lambda p: sampling.first_per_cell(cells.with_voxel(p, 2.0), ["vx", "vy", "vz"]),
    "SELECT * FROM scene WHERE point_id IN (SELECT min(point_id) FROM scene GROUP BY floor(x / 2), floor(y / 2), floor(z / 2))", "scene")
add("N09_top2_margin", "point_id:i margin:d", lambda p: p.select("point_id", active.margin(_PR()).alias("margin")),
    "SELECT point_id, greatest(p1, p2, p3) - (p1 + p2 + p3 - greatest(p1, p2, p3) - least(p1, p2, p3)) AS margin FROM probs", "probs")
add("N10_sequential_ids", "square_id:i row:i col:i point_count:i", lambda p: sampling.squares(p, 3000),
    "SELECT row * nc + col + 1 AS square_id, row, col, coalesce(k, 0) AS point_count FROM sqgrid LEFT JOIN (SELECT least(CAST(floor((y - y0) / s) AS BIGINT), nr - 1) AS row, least(CAST(floor((x - x0) / s) AS BIGINT), nc - 1) AS col, count(*) AS k FROM scene, sqsize GROUP BY 1, 2) USING (row, col)", "scene", "sqgrid", "sqsize")
cte("sqsize", "SELECT *, CAST(ceil((x1 - x0) / s) AS BIGINT) AS nc, CAST(ceil((y1 - y0) / s) AS BIGINT) AS nr FROM (SELECT *, CASE WHEN sq < 10 THEN greatest(2, round_even(sq, 0)) WHEN sq < 50 THEN round_even(sq / 5, 0) * 5 ELSE round_even(sq / 10, 0) * 10 END AS s FROM (SELECT *, sqrt(3000e0 / (n / ((x1 - x0) * (y1 - y0)))) AS sq FROM ext))", "ext")
cte("sqgrid", "SELECT row, col, nc FROM sqsize, generate_series(0, nr - 1) AS a(row), generate_series(0, nc - 1) AS b(col)", "sqsize")
add("N11_class_cap", "classification:i n:i", lambda p: learning.balanced_sample(p, 3000, 300).groupBy("classification").agg(F.count("*").alias("n")),
    "SELECT classification, least(count(*), 3000) AS n FROM scene GROUP BY 1 HAVING count(*) >= 300", "scene")
add("L01_L06_top_and_lexicographic", "point_id:i z:d", lambda p: p.orderBy(F.desc("z"), "x", "y", "point_id").limit(50).select("point_id", "z"),
    "SELECT point_id, z FROM scene ORDER BY z DESC, x, y, point_id LIMIT 50", "scene")
add("L02_classes_by_count", "class_id:i count:i", lambda p: evaluation.class_histogram(p).orderBy(F.desc("count"), "class_id"), "SELECT class_id, count FROM hist ORDER BY count DESC, class_id", "hist")
add("U01_union_of_detections", "kind:s n:i", lambda p: p.where("classification = 20").select(F.lit("pole").alias("kind"), "x").unionByName(
    p.where("classification = 19").select(F.lit("wire").alias("kind"), "y"), allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n")),
    "SELECT CASE classification WHEN 20 THEN 'pole' ELSE 'wire' END AS kind, count(*) AS n FROM scene WHERE classification IN (19, 20) GROUP BY 1", "scene")
add("U02_union_of_masks", "n:i", lambda p: p.agg(F.count(F.when((F.col("classification") == 5) | (F.col("z") > 105), 1)).alias("n")), "SELECT count(*) FILTER (classification = 5 OR z > 105) AS n FROM scene", "scene")
add("U03_J14_difference", "n:i", lambda p: p.join(sampling.hash_sample(p, 1000).select("point_id"), "point_id", "left_anti").agg(F.count("*").alias("n")), "SELECT n - least(n, 1000) AS n FROM ext", "ext")
add("U04_classes_true_or_predicted", "class_id:i", lambda p: (lambda q: q.select(F.col("y_true").alias("class_id")).union(q.select("y_pred")).distinct())(predictions(p)), "SELECT y_true AS class_id FROM pred UNION SELECT y_pred FROM pred", "pred")

# ---- F: sampling and tiling ----------------------------------------------
add("F01_tiles", "tile_id:i x_min:d x_max:d y_min:d center_x:d center_y:d point_count:i", lambda p: sampling.tiles(p, 50.0),
    "SELECT tile_id, x0 + gx * 50e0 AS x_min, x0 + gx * 50e0 + 50 AS x_max, y0 + gy * 50e0 AS y_min, x0 + gx * 50e0 + 25 AS center_x, y0 + gy * 50e0 + 25 AS center_y, coalesce(k, 0) AS point_count FROM grid50 LEFT JOIN (SELECT tile_id, count(*) AS k FROM tiled GROUP BY 1) USING (tile_id), ext", "grid50", "tiled", "ext")
add("F02_squares", "square_id:i x_min:d y_min:d area_m2:d point_count:i", lambda p: sampling.squares(p, 3000),
    "SELECT row * g.nc + col + 1 AS square_id, x0 + col * s AS x_min, y0 + row * s AS y_min, s * s AS area_m2, coalesce(k, 0) AS point_count FROM sqgrid g LEFT JOIN (SELECT least(CAST(floor((y - y0) / s) AS BIGINT), nr - 1) AS row, least(CAST(floor((x - x0) / s) AS BIGINT), nc - 1) AS col, count(*) AS k FROM scene, sqsize GROUP BY 1, 2) USING (row, col), sqsize", "scene", "sqgrid", "sqsize")
cte("vsize", "SELECT *, least(greatest(greatest(pow((x1 - x0) * (y1 - y0) * (z1 - z0) / 5000e0, 1e0 / 3) * 0.7e0, sqrt((x1 - x0) * (y1 - y0) / n) * sqrt(5000e0 / n), 0.1e0), 0.1e0), 50e0) AS v FROM ext", "ext")
add("F03_voxel_sample", "x:d y:d z:d red:d", lambda p: sampling.voxel_sample(p, 5000),
    "SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(red) AS red FROM scene, vsize GROUP BY floor((x - (x0 - v / 2)) / v), floor((y - (y0 - v / 2)) / v), floor((z - (z0 - v / 2)) / v)", "scene", "vsize")
add("F04_random_sample", PT, lambda p: sampling.random_sample(p, 2500, 9), f"SELECT * FROM scene ORDER BY {hash_sql('point_id', 9)}, point_id LIMIT 2500", "scene")
add("F05_grid_sample", "point_id:i", lambda p: sampling.grid_sample(p, 5000, 4).select("point_id"),
    f"SELECT point_id FROM (SELECT min(point_id) AS point_id FROM scene, vsize GROUP BY floor((x - x0) / (v * 0.8e0)), floor((y - y0) / (v * 0.8e0)), floor((z - z0) / (v * 0.8e0))) ORDER BY {hash_sql('point_id', 4)}, point_id LIMIT 5000", "scene", "vsize")
add("F06_adaptive_sample", "x:d y:d z:d", lambda p: sampling.adaptive_sample(p, 5000).select("x", "y", "z"),
    "SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM scene, vsize GROUP BY floor((x - (x0 - v / 2)) / v), floor((y - (y0 - v / 2)) / v), floor((z - (z0 - v / 2)) / v)", "scene", "vsize")
add("F07_fixed_blocks", "chunk_id:i block:i n:i labels:i padded:i", lambda p: sampling.fixed_blocks(p, 300).select(
    "chunk_id", "block", "n", F.size("labels").alias("labels"), F.size(F.filter("labels", lambda v: v == -1)).alias("padded")),
    "SELECT chunk_id, (point_id % 1000) // 300 AS block, count(*) AS n, 300 AS labels, 300 - count(*) AS padded FROM scene GROUP BY 1, 2", "scene")
