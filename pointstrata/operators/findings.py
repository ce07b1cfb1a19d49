"""Clearance violations and clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classes
from ..functions.height import piecewise_linear
from ..session import cut
from . import cells
from .cluster import dbscan
from .neighbours import XYZ, nearest, nearest_within
from .railway import main_direction

# fixed values: half width of the clearance profile by height over rail, in metres
PROFILE = [(0.0, 1.575), (0.4, 1.575), (0.55, 1.645), (1.1, 1.645), (3.5, 1.575), (4.65, 1.435), (5.3, 0.75)]
OBSTACLE_CLASSES = [3, 4, 5, 6, 17, 19, 20, 35, 36]
# fixed values: (class a, class b, smallest allowed distance), in reporting order
CLASH_PAIRS = [(6, 19, 3.0), (5, 19, 2.0), (6, 18, 5.0), (5, 20, 1.0), (19, 5, 2.0), (6, 20, 2.0)]


# ---- clearance ------------------------------------------------------------

def clearance_severity(depth: Column) -> Column:
    return F.when(depth > 0.3, "critical").when(depth > 0.1, "warning").otherwise("minor")


def clearance_violations(points: DataFrame, profile=PROFILE, margin: float = 0.1,
                         direction: tuple[float, float] | None = None) -> DataFrame:
    """Obstacle points inside the clearance profile of the (straight) track axis."""
    rails = points.where(F.col("classification") == 18)
    o = rails.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).first()
    obstacles = points.where(F.col("classification").isin(OBSTACLE_CLASSES))
    if not o.n:
        obstacles, o, level, direction = obstacles.where(F.lit(False)), None, 0.0, (1.0, 0.0)
    else:
        level = cells.quantiles(rails, "z", [0.1], o.n)[0]
        direction = direction or main_direction(rails, flat=True)
    cx, cy = (o.x, o.y) if o else (0.0, 0.0)
    dx, dy = direction
    v = obstacles.withColumns({
        "distance": F.abs((F.col("x") - F.lit(cx)) * F.lit(-dy) + (F.col("y") - F.lit(cy)) * F.lit(dx)),
        "height": F.col("z") - F.lit(level)}).where(F.col("height").between(0.0, 6.0))
    allowed = piecewise_linear(F.col("height"), list(profile)) - F.lit(margin)
    v = v.withColumn("violation", allowed - F.col("distance")).where(F.col("violation") > 0)
    return v.select("point_id", "x", "y", "z", "classification", "distance", "height", "violation", clearance_severity(F.col("violation")).alias("severity"))


def clearance_summary(violations: DataFrame) -> DataFrame:
    """Totals per severity, per class and of all (0 without a violation) in one pass."""
    by = cut(violations.groupBy("severity", "classification").agg(F.count(F.lit(1)).alias("n")))
    parts = by.groupingSets([["severity"], ["classification"]], "severity", "classification").agg(F.sum("n").alias("n"))
    return parts.unionByName(by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), allowMissingColumns=True)


def worst_violations(violations: DataFrame, n: int = 10) -> DataFrame:
    # rounded to a micrometre, so equal depths tie and the id decides
    return violations.orderBy(F.desc(F.round("violation", 6)), "point_id").limit(n)


def axis_violations(points: DataFrame, axis: DataFrame) -> DataFrame:
    """Vegetation and building points closer to the nearest axis vertex than its ``allowed`` distance (a column of the axis)."""
    p = points.where(F.col("classification").isin(5, 6)).select("point_id", "x", "y", "z", "classification")
    near = nearest(p, axis.withColumn("vid", F.col("seq").cast("long")), 1, dims=("x", "y"), data_id="vid", carry=("allowed",))
    near = near.select("point_id", F.element_at("nid", 1).cast("int").alias("vertex"), F.element_at("nd", 1).alias("dist"),
                       F.element_at("n_allowed", 1).alias("allowed"))
    return p.join(near, "point_id").where(F.col("dist") < F.col("allowed")).withColumns({
        "clash_type": F.lit("clearance"), "severity": F.lit("major"), "distance": F.col("dist") - F.col("allowed")})


# ---- clashes --------------------------------------------------------------

def clash_type(dist: Column, limit: Column) -> Column:
    return F.when(dist < 0.1, "hard").when(dist < limit * 0.5, "soft").otherwise("clearance")


def clash_severity(dist: Column, limit: Column) -> Column:
    return F.when(dist < 0.1, "critical").when(dist < limit * 0.3, "major").when(dist < limit * 0.7, "minor").otherwise("info")


def clash_pair_dim(spark: SparkSession, pairs=CLASH_PAIRS) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pair int, class_a int, class_b int, min_distance double")


def collision_points(points: DataFrame, pairs=CLASH_PAIRS) -> DataFrame:
    """Points of class a with the nearest class-b point closer than the allowed distance, per pair.

    All pairs go through one search, each with its own distance; a point takes
    part in as many as its class has.
    """
    p = points.select("point_id", *XYZ, "classification")

    def sides(which: int, keep: tuple[str, ...]) -> DataFrame:
        of = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(pair[which]).alias("class"), F.lit(float(pair[2])).alias("reach")) for i, pair in enumerate(pairs)])
        mine = F.filter(of, lambda s: s["class"] == F.col("classification"))
        return p.withColumn("_p", F.explode(mine)).select(*keep, "_p.pair", "_p.reach")

    hit = nearest_within(sides(0, ("point_id", *XYZ)), sides(1, ("point_id", *XYZ)), "reach", equal=("pair",), keep=XYZ)
    return hit.select("pair", "point_id", *XYZ, "dist")


def clashes(points: DataFrame, pairs=CLASH_PAIRS, include_soft: bool = True, max_clashes: int | None = None,
            custom: dict[tuple[int, int], float] | None = None) -> DataFrame:
    """Clash clusters per class pair; a report may ask for the first ``max_clashes`` in pair order, numbered."""
    if custom:
        pairs = [(a, b, custom.get((a, b), d)) for a, b, d in pairs]
    spark = points.sparkSession
    col = cut(collision_points(points, pairs))
    # all pairs are clustered together, each with its own distance
    reach = F.element_at(F.array(*[F.lit(float(d)) for _, _, d in pairs]), F.col("pair") + 1)
    g = dbscan(col.withColumn("eps", reach), "eps", 3, XYZ, within=("pair",))
    g = g.groupBy("pair", "cluster").agg(
        F.count(F.lit(1)).alias("points_involved"), *[F.avg(a).alias(a) for a in "xyz"], F.min("dist").alias("distance"))
    g = g.join(F.broadcast(clash_pair_dim(spark, pairs)), "pair")
    limit = F.col("min_distance")
    name = lambda c: classes.name_of(classes.CLASH_NAMES, F.col(c), F.concat(F.lit("class_"), F.col(c).cast("string")))
    g = g.withColumns({"clash_type": clash_type(F.col("distance"), limit), "severity": clash_severity(F.col("distance"), limit),
                       "element_a": name("class_a"), "element_b": name("class_b")})
    if not include_soft:
        g = g.where("clash_type <> 'soft'")
    g = g.withColumn("overlap_volume", F.col("points_involved") * F.lit(0.001))
    if max_clashes is None:
        return g
    g = g.orderBy("pair", "cluster").limit(max_clashes)
    w = Window.partitionBy(F.lit(0)).orderBy("pair", "cluster")  # the capped report only
    return g.withColumn("clash_id", F.row_number().over(w) - 1)


def clash_counts(rows: DataFrame) -> DataFrame:
    """Counts by severity, type and element pair in one grouping-sets pass."""
    r = rows.withColumn("pair_name", F.concat_ws("-", "element_a", "element_b"))
    g = r.groupingSets([["severity"], ["clash_type"], ["pair_name"]], "severity", "clash_type", "pair_name").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("severity").isNotNull(), "severity").when(F.col("clash_type").isNotNull(), "type").otherwise("elements")
    return g.select(kind.alias("kind"), F.coalesce("severity", "clash_type", "pair_name").alias("name"), "n")


def object_clearance(a: DataFrame, b: DataFrame, min_clearance: float = 5.0) -> DataFrame:
    """Closest approach of two objects; no row when they keep the clearance."""
    near = nearest_within(a, b, min_clearance, keep=XYZ)
    s = near.agg(F.min(F.struct("dist", "point_id", "x", "y", "z")).alias("b"), F.count(F.lit(1)).alias("points_involved"))
    d = F.col("b.dist")
    kind = F.when(d < 0.5, "hard").when(d < F.lit(min_clearance * 0.5), "soft").otherwise("clearance")
    sev = F.when(d < 0.5, "critical").when(d < F.lit(min_clearance * 0.5), "major").otherwise("minor")
    return s.where("points_involved > 0").select(
        kind.alias("clash_type"), sev.alias("severity"), F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.z").alias("z"),
        d.alias("distance"), "points_involved", (F.col("points_involved") * F.lit(0.001)).alias("overlap_volume"))
