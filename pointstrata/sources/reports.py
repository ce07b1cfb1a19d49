"""Text, JSON, GeoJSON, KML, CSV, HTML, element and viewer exports.

Each function returns a small DataFrame (lines or JSON rows) derived from
aggregates; ``write_text`` / ``write_json`` are the sinks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes
from ..operators import cells, evaluation
from ..operators.sampling import hash_sample


def write_text(lines: DataFrame, path: str) -> None:
    """Lines (columns pos, line) as text files whose parts, one after the other by name, are the text.

    The sort deals ranges of ``pos`` to the parts in their order, so a long export
    is written by many tasks; a report of a few hundred lines has one part.
    """
    lines.orderBy("pos").select("line").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_xml(df: DataFrame, path: str, row: str = "Element") -> None:
    df.write.mode("overwrite").format("xml").option("rowTag", row).option("rootTag", "Elements").save(path)


def report_name(key: Column) -> Column:
    return classes.name_of(classes.REPORT_NAMES, key, F.concat(F.lit("Klasa_"), key.cast("string")))


def _thousands(col: Column) -> Column:
    return F.format_number(col, 0)


# ---- class reports --------------------------------------------------------

def class_report(points: DataFrame) -> DataFrame:
    """Lines of the text report, classes ascending."""
    h = evaluation.class_histogram(points)
    name = classes.name_of(classes.REPORT_NAMES, F.col("class_id"), F.concat(F.lit("Nieznana klasa "), F.col("class_id").cast("string")))
    pct = F.format_string("%5.2f", F.col("percentage"))
    body = h.select((F.col("class_id") + 100).cast("long").alias("pos"), F.concat(
        F.lit("  ["), F.lpad(F.col("class_id").cast("string"), 2, " "), F.lit("] "), F.rpad(name, 30, " "), F.lit(" "),
        F.lpad(_thousands(F.col("count")), 12, " "), F.lit(" ("), pct, F.lit("%)")).alias("line"))
    t = h.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"))
    rule, thin = F.lit("=" * 60), F.lit("-" * 60)
    head = F.array(rule, F.lit("RAPORT KLASYFIKACJI CHMURY PUNKTÓW"), rule, F.concat(F.lit("Całkowita liczba punktów: "), _thousands(F.col("n"))),
                   F.concat(F.lit("Liczba wykrytych klas: "), F.col("k").cast("string")), F.lit(""), F.lit("Rozkład klasyfikacji:"), thin)
    top = t.select(F.posexplode(head).alias("pos", "line")).select(F.col("pos").cast("long"), "line")
    foot = t.select(F.lit(100_000).cast("long").alias("pos"), rule.alias("line"))
    return top.unionByName(body).unionByName(foot)


def json_report(points: DataFrame) -> DataFrame:
    """One JSON document: statistics and per-class counts."""
    h = evaluation.class_histogram(points)
    entry = F.struct(F.col("class_id").cast("string").alias("key"), F.struct("count", F.round("percentage", 4).alias("percentage")).alias("value"))
    m = h.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("classification"))  # one entry per class
    s = evaluation.classified_summary(points)
    j = cells.beside(s, m)
    return j.select(F.to_json(F.struct(
        F.struct((F.col("classified_count") + F.col("unclassified_count")).alias("total_points"), F.col("classified_count").alias("classified_points"),
                 F.col("unclassified_count").alias("unclassified_points"), F.round("classified_percentage", 4).alias("classified_percentage")).alias("statistics"),
        "classification")).alias("json"))


def extended_rows(points: DataFrame) -> DataFrame:
    """Per class: name, description, count, share, standard flag."""
    h = evaluation.class_histogram(points)
    name = classes.name_of({k: v[0] for k, v in classes.EXTENDED.items()}, F.col("class_id"), F.concat(F.lit("Klasa "), F.col("class_id").cast("string")))
    desc = classes.name_of({k: v[1] for k, v in classes.EXTENDED.items()}, F.col("class_id"), F.lit(""))
    return h.select("class_id", name.alias("name"), desc.alias("description"), "count", F.round("percentage", 4).alias("percentage"),
                    (F.col("class_id") <= 31).alias("asprs_standard"))


def quality_row(points: DataFrame, points_per_second: float) -> DataFrame:
    """Coverage, diversity, score and advice (one row)."""
    k = points.where("classification <> 1").agg(F.countDistinct("classification").alias("class_diversity"))
    s = cells.beside(evaluation.classified_summary(points), k)
    q = evaluation.quality_score(s, F.col("class_diversity"), F.lit(float(points_per_second)))
    return q.withColumn("recommendations", evaluation.quality_advice(F.col("classified_percentage"), F.col("class_diversity")))


def extended_report(points: DataFrame, points_per_second: float) -> DataFrame:
    e = extended_rows(points)
    item = F.struct(F.col("class_id").cast("string").alias("key"), F.struct("name", "description", "count", "percentage", "asprs_standard").alias("value"))
    m = e.agg(F.map_from_entries(F.array_sort(F.collect_list(item))).alias("classification"))
    q = quality_row(points, points_per_second)
    return cells.beside(q, m).select(F.to_json(F.struct(
        F.struct(F.round("overall_score", 1).alias("overall_score"), F.round("classified_percentage", 2).alias("classification_coverage"),
                 "class_diversity", "recommendations").alias("quality_metrics"), "classification")).alias("json"))


# ---- GeoJSON / KML --------------------------------------------------------

def bounds_feature(points: DataFrame, precision: int = 6) -> DataFrame:
    b = cells.extent_frame(points)
    r = lambda c, p=precision: F.round(c, p)
    pt = lambda x, y: F.array(r(x), r(y))
    ring = F.array(pt("x_min", "y_min"), pt("x_max", "y_min"), pt("x_max", "y_max"), pt("x_min", "y_max"), pt("x_min", "y_min"))
    props = F.struct(F.lit("bounding_box").alias("feature_type"), *[r(f"{a}_{n}").alias(f"{a}_{n}") for a in "xyz" for n in ("min", "max")],
                     r(F.col("x_max") - F.col("x_min"), 2).alias("width_m"), r(F.col("y_max") - F.col("y_min"), 2).alias("height_m"),
                     r(F.col("z_max") - F.col("z_min"), 2).alias("elevation_range_m"))
    return b.select(F.lit("bounds").alias("id"), F.struct(F.lit("Feature").alias("type"), F.lit("bounds").alias("id"), F.struct(
        F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), props.alias("properties")).alias("feature"))


def class_centroids(points: DataFrame, precision: int = 6) -> DataFrame:
    """Count, share, z range and centroid per class."""
    n = points.groupBy("classification").agg(F.count(F.lit(1)).alias("point_count"), F.min("z").alias("z_min"), F.max("z").alias("z_max"),
                                             *[F.avg(a).alias(f"c{a}") for a in "xyz"])
    total = F.sum("point_count").over(Window.partitionBy(F.lit(0)))
    return n.withColumn("_t", total).select(
        F.col("classification").alias("class_id"), report_name(F.col("classification")).alias("class_name"), "point_count",
        F.round(F.col("point_count") / F.col("_t") * 100, 2).alias("percentage"), F.round("cx", precision).alias("x"), F.round("cy", precision).alias("y"),
        F.round("cz", 2).alias("centroid_z"), F.round("z_min", 2).alias("z_min"), F.round("z_max", 2).alias("z_max"))


def geojson(points: DataFrame, crs: str = "EPSG:2180") -> DataFrame:
    """One feature collection: bounds polygon and class centroids (about twenty features)."""
    c = class_centroids(points)
    feat = F.to_json(F.struct(F.lit("Feature").alias("type"), F.concat(F.lit("class_"), F.col("class_id").cast("string")).alias("id"),
                              F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"),
                              F.struct(F.lit("class_centroid").alias("feature_type"), "class_id", "class_name", "point_count", "percentage",
                                       "centroid_z", "z_min", "z_max").alias("properties")))
    rows = bounds_feature(points).select(F.lit(-1).alias("o"), F.to_json("feature").alias("f")).unionByName(c.select(F.col("class_id").alias("o"), feat.alias("f")))
    one = rows.agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("o", "f"))), lambda s: s["f"])).alias("features"))
    s = evaluation.classified_summary(points)
    return cells.beside(one, s).select(F.format_string(
        '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"%s"}},"properties":{"total_points":%d,"classified_points":%d},"features":[%s]}',
        F.lit(crs), F.col("classified_count") + F.col("unclassified_count"), F.col("classified_count"), F.col("features")).alias("json"))


def object_features(poles: DataFrame, signals: DataFrame) -> DataFrame:
    """One GeoJSON feature per pole and signal (row per feature; write as text)."""
    p = poles.select(F.lit("pole").alias("kind"), F.col("pole_id").alias("id"), "x", "y", "z", F.col("pole_type").alias("type"), "height")
    s = signals.select(F.lit("signal").alias("kind"), F.col("signal_id").alias("id"), "x", "y", "z", F.col("signal_type").alias("type"), "height")
    u = p.unionByName(s)
    f = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")).alias("geometry"),
                 F.struct(F.col("kind").alias("type"), F.col("type").alias("object_type"), "height").alias("properties"))
    return u.withColumn("feature", F.to_json(f))


def placemarks(poles: DataFrame, signals: DataFrame) -> DataFrame:
    """One KML placemark per object."""
    u = object_features(poles, signals)
    return u.select("kind", "id", F.format_string(
        "<Placemark><name>%s: %s</name><description>Height: %.1fm</description><styleUrl>#%sStyle</styleUrl>"
        "<Point><coordinates>%s,%s,%s</coordinates></Point></Placemark>", F.initcap("kind"), F.col("type"), F.col("height"), F.col("kind"),
        F.col("x").cast("string"), F.col("y").cast("string"), F.col("z").cast("string")).alias("placemark"))


# ---- building-model elements ----------------------------------------------

def class_boxes(points: DataFrame) -> DataFrame:
    """Box, centre, share and element type per class."""
    g = points.groupBy(F.col("classification").alias("class_id")).agg(
        F.count(F.lit(1)).alias("count"), *[f(a).alias(f"{a}_{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "center"))])
    part = lambda i, d: classes.name_of({k: v[i] for k, v in classes.IFC_TYPES.items()}, F.col("class_id"), d)
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    return g.withColumns({"percentage": F.col("count") / total * 100, "ifc_type": part(0, F.lit("IfcBuildingElementProxy")),
                          "predefined": part(1, F.lit("USERDEFINED")), "name": part(2, F.concat(F.lit("Class "), F.col("class_id").cast("string")))})


def step_lines(boxes: DataFrame, first_id: int = 100) -> DataFrame:
    """STEP entities: placement, box, proxy element and property set per class (ids are sequential)."""
    b = boxes.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("class_id")) - 1)  # a row per class
    base = F.col("_i") * 9 + F.lit(first_id)
    guid = F.upper(F.substring(F.md5(F.concat_ws("_", F.lit("element"), F.col("class_id").cast("string"))), 1, 22))
    size = {a: F.greatest(F.col(f"{a}_max") - F.col(f"{a}_min"), F.lit(0.1)) for a in "xyz"}
    ref = lambda k: (base + k).cast("int")
    lines = F.array(
        F.format_string("#%d=IFCCARTESIANPOINT((%.3f,%.3f,%.3f));", ref(0), F.col("x_center"), F.col("y_center"), F.col("z_center")),
        F.format_string("#%d=IFCAXIS2PLACEMENT3D(#%d,$,$);", ref(1), ref(0)),
        F.format_string("#%d=IFCLOCALPLACEMENT($,#%d);", ref(2), ref(1)),
        F.format_string("#%d=IFCBOUNDINGBOX(#%d,%.3f,%.3f,%.3f);", ref(3), ref(0), size["x"], size["y"], size["z"]),
        F.format_string("#%d=IFCSHAPEREPRESENTATION($,'Body','BoundingBox',(#%d));", ref(4), ref(3)),
        F.format_string("#%d=IFCPRODUCTDEFINITIONSHAPE($,$,(#%d));", ref(5), ref(4)),
        F.format_string("#%d=IFCBUILDINGELEMENTPROXY('%s',$,'Class_%d_%s','%d points',$,#%d,#%d,$,$);", ref(6), guid, F.col("class_id"),
                        F.replace("name", F.lit(" "), F.lit("_")), F.col("count"), ref(2), ref(5)),
        F.format_string("#%d=IFCPROPERTYSINGLEVALUE('PointCount',$,IFCINTEGER(%d),$);", ref(7), F.col("count")),
        F.format_string("#%d=IFCPROPERTYSINGLEVALUE('Percentage',$,IFCREAL(%.2f),$);", ref(8), F.col("percentage")))
    return b.select("class_id", F.posexplode(lines).alias("k", "line")).select(
        (F.col("class_id") * 100 + F.col("k")).cast("long").alias("pos"), "line")


def building_elements(b: DataFrame) -> DataFrame:
    return b.select(F.concat(F.lit("Building_"), F.col("building_id").cast("string")).alias("name"), F.lit("IfcBuilding").alias("element_type"),
                    F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), F.col("height_min").alias("z"), F.to_json(F.struct(
                        F.lit("extrusion").alias("type"), F.round("height", 6).alias("height"), F.col("height_min").alias("base_elevation"))).alias("geometry"),
                    F.create_map(F.lit("roof_type"), F.col("roof_type"), F.lit("floor_count"), F.col("floor_count").cast("string")).alias("properties"))


def terrain_element(grid: DataFrame, nx: int, size: float = 1.0) -> DataFrame:
    """Grid nodes thinned to about 100 steps along x."""
    step = max(1, nx // 100)
    return grid.where((F.col("ix") % step == 0) & (F.col("iy") % step == 0)).select("ix", "iy", "height", F.lit("IfcSite").alias("element_type"), F.lit(step).alias("step"))


def infrastructure_elements(points: DataFrame, key: str, kind: str) -> DataFrame:
    g = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{a}_{n}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))])
    box = F.struct(F.array("x_min", "y_min", "z_min").alias("min"), F.array("x_max", "y_max", "z_max").alias("max"))
    return g.select(F.concat(F.lit(f"{kind}_"), F.col(key).cast("string")).alias("name"), F.lit(classes.ELEMENT_TYPES.get(kind, "IfcBuildingElementProxy")).alias("element_type"),
                    F.col("x_mean").alias("x"), F.col("y_mean").alias("y"), F.col("z_mean").alias("z"),
                    F.to_json(F.struct(F.lit("point_cloud").alias("type"), F.col("n").alias("point_count"), box.alias("bounds"))).alias("geometry"),
                    F.create_map(F.lit("points"), F.col("n").cast("string")).alias("properties"))


def cloud_element(points: DataFrame, rate: float = 0.1, seed: int = 0, n: int | None = None) -> DataFrame:
    """Hash sample of the cloud as an element (points stay rows)."""
    n = points.count() if n is None else n
    return hash_sample(points.select("point_id", "x", "y", "z", "classification"), int(n * rate), seed).withColumn("element_type", F.lit("IfcPointCloud"))


def element_summary(elements: DataFrame) -> DataFrame:
    return elements.groupBy("element_type").agg(F.count(F.lit(1)).alias("n"))


# ---- viewer payload, HTML -------------------------------------------------

def viewer_points(points: DataFrame, max_points: int = 500_000, seed: int = 0, n: int | None = None) -> DataFrame:
    """Sampled positions, centred and scaled by the largest absolute coordinate."""
    n = points.count() if n is None else n
    p = hash_sample(points.select("point_id", "x", "y", "z", "classification"), max_points, seed) if n > max_points else points.select("point_id", "x", "y", "z", "classification")
    c = p.agg(*[F.avg(a).alias(a) for a in "xyz"], *[f(a).alias(f"{a}{k}") for a in "xyz" for f, k in ((F.min, 0), (F.max, 1))]).first()
    scale = max(abs(c[f"{a}{k}"] - c[a]) for a in "xyz" for k in (0, 1)) or 1.0
    return p.select("point_id", *[((F.col(a) - F.lit(c[a])) / F.lit(scale)).alias(a) for a in "xyz"], "classification")


def viewer_classes(points: DataFrame) -> DataFrame:
    h = evaluation.class_histogram(points)
    return h.select("class_id", report_name(F.col("class_id")).alias("name"), classes.name_of(classes.VIEWER_COLOURS, F.col("class_id"), F.lit("#888888")).alias("colour"),
                    "count", F.round("percentage", 2).alias("percentage"))


def clash_items(rows: DataFrame) -> DataFrame:
    """HTML list items of the clash report."""
    return rows.select(F.col("clash_id").cast("long").alias("pos"), F.format_string(
        "<div class='clash-%s'>#%d [%s] %s vs %s (%.1f, %.1f, %.1f) %.2fm %d points</div>", "severity", "clash_id", F.upper("clash_type"),
        F.col("element_a"), F.col("element_b"), F.col("x"), F.col("y"), F.col("z"), F.col("distance"), F.col("points_involved")).alias("line"))


def clearance_report(violations: DataFrame, n: int = 10) -> DataFrame:
    """Summary, counts per class and the worst ``n`` as one JSON document."""
    by = violations.groupBy("classification").agg(F.count(F.lit(1)).alias("k"))
    by = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("classification").cast("string"), "k")))).alias("by_class"))
    s = violations.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("severity") == v, 1)).alias(v) for v in ("critical", "warning", "minor")])
    w = violations.orderBy(F.desc("violation"), "point_id").limit(n)
    item = F.struct((-F.col("violation")).alias("o"), "point_id", F.array("x", "y", "z").alias("position"), F.col("classification").alias("class"),
                    F.round("violation", 3).alias("violation_distance_m"), F.round("height", 2).alias("height_above_rail_m"), "severity")
    worst = w.agg(F.transform(F.array_sort(F.collect_list(item)), lambda i: F.struct(
        i["position"].alias("position"), i["class"].alias("class"), i["violation_distance_m"].alias("violation_distance_m"),
        i["height_above_rail_m"].alias("height_above_rail_m"), i["severity"].alias("severity"))).alias("worst_violations"))
    return cells.beside(s, by, worst).select(F.to_json(F.struct(
        F.when(F.col("total") > 0, "VIOLATIONS_FOUND").otherwise("OK").alias("status"),
        F.struct("total", "critical", "warning", "minor").alias("summary"), "by_class", "worst_violations")).alias("json"))
