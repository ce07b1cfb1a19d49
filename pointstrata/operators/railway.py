"""Catenary wires, tracks, poles and signals."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.eigen import direction2, moments, with_covariance, with_eigen3
from ..functions.height import band, capped_ratio
from ..session import cut
from .cells import beside
from .cluster import dbscan
from .neighbours import XYZ, nearest, radius_pairs

GAUGE = 1.435

# fixed values: height bands above the track, in metres (they overlap on purpose)
WIRE_BANDS = (("contact", 5.0, 5.5), ("messenger", 6.0, 7.5), ("return", 6.5, 8.0))


def reference_level(points: DataFrame, classes=(18, 2)) -> float:
    """Mean z of the first class that occurs, else the lowest z."""
    aggs = [F.avg(F.when(F.col("classification") == c, F.col("z"))).alias(f"c{c}") for c in classes]
    r = points.agg(F.coalesce(*[F.avg(F.when(F.col("classification") == c, F.col("z"))) for c in classes], F.min("z")).alias("level")).first()
    return r.level


# ---- catenary -------------------------------------------------------------

def wire_bands(spark: SparkSession, bands=WIRE_BANDS) -> DataFrame:
    return spark.createDataFrame(list(bands), "wire_type string, min_h double, max_h double")


def wire_points(points: DataFrame, level: float, bands=WIRE_BANDS) -> DataFrame:
    """Wire points with the band(s) they fall in; a point can serve two bands."""
    w = points.where(F.col("classification") == 19).withColumn("h", F.col("z") - F.lit(level))
    tags = F.array(*[F.when(band(F.col("h"), lo, hi), F.lit(name)) for name, lo, hi in bands])
    return w.withColumn("wire_type", F.explode(F.filter(tags, lambda t: t.isNotNull())))


def wire_segments(points: DataFrame, min_length: float = 10.0, eps: float = 2.0, level: float | None = None,
                  bands=WIRE_BANDS) -> DataFrame:
    """One row per wire: type, ends, length, height, sag and confidence."""
    level = reference_level(points) if level is None else level
    w = cut(wire_points(points, level, bands).select("point_id", "x", "y", "z", "wire_type"))
    enough = w.groupBy("wire_type").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 10)
    w = w.join(F.broadcast(enough.select("wire_type")), "wire_type", "left_semi")
    c = cut(dbscan(w, eps, 3, ("x", "y"), within=("wire_type",)))
    key = ["wire_type", "cluster"]
    # moments relative to a corner of the cluster keep the covariance exact
    lo = c.groupBy(*key).agg(*[F.min(a).alias(f"o{a}") for a in "xyz"], F.count(F.lit(1)).alias("n_points"),
                             F.avg("z").alias("mz"), F.max("z").alias("hz")).where(F.col("n_points") >= 5)
    rel = c.join(lo, key).withColumns({f"r{a}": F.col(a) - F.col(f"o{a}") for a in "xyz"})
    axis = with_eigen3(with_covariance(rel.groupBy(*key).agg(*moments("rx", "ry", "rz")), sample=True), normal=False, axis=True)
    flip = F.when((F.col("ax") < 0) | ((F.col("ax") == 0) & (F.col("ay") < 0)), F.lit(-1.0)).otherwise(F.lit(1.0))
    axis = axis.select(*key, *[(F.col(a) * flip).alias(a) for a in ("ax", "ay", "az")])
    proj = rel.join(axis, key).withColumn("_p", F.col("rx") * F.col("ax") + F.col("ry") * F.col("ay") + F.col("rz") * F.col("az"))
    ends = proj.groupBy(*key).agg(F.min(F.struct("_p", "point_id", "x", "y", "z")).alias("s"),
                                  F.max(F.struct("_p", (-F.col("point_id")).alias("i"), "x", "y", "z")).alias("e"))
    seg = ends.join(lo, key)
    length = F.sqrt(sum(((F.col(f"e.{a}") - F.col(f"s.{a}")) * (F.col(f"e.{a}") - F.col(f"s.{a}")) for a in "xyz"), F.lit(0.0)))
    seg = seg.select(
        "wire_type", F.col("cluster").alias("wire_id"), "n_points",
        *[F.col(f"s.{a}").alias(f"start_{a}") for a in "xyz"], *[F.col(f"e.{a}").alias(f"end_{a}") for a in "xyz"],
        length.alias("length"), (F.col("mz") - F.lit(level)).alias("height_above_track"), (F.col("hz") - F.col("oz")).alias("sag"),
        capped_ratio(F.col("n_points"), 100).alias("confidence"))
    return seg.where(F.col("length") >= min_length)


def droppers(points: DataFrame, level: float | None = None, size: float = 0.5) -> DataFrame:
    """Upright members between contact and messenger wire, per half-metre cell."""
    level = reference_level(points) if level is None else level
    w = points.where((F.col("classification") == 19) & band(F.col("z") - F.lit(level), WIRE_BANDS[0][1], WIRE_BANDS[1][2]))
    w = cut(w.select("point_id", "x", "y", "z"))
    o = w.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    if o.n < 10:
        o_x, o_y, w = 0.0, 0.0, w.where(F.lit(False))
        nx = ny = 1
    else:
        o_x, o_y = o.x0, o.y0
        # cells start below the maximum, so a point on a last full edge has none
        nx, ny = (math.ceil((hi - lo) / size) for lo, hi in ((o.x0, o.x1), (o.y0, o.y1)))
    g = w.withColumns({"ix": F.floor((F.col("x") - F.lit(o_x)) / F.lit(size)), "iy": F.floor((F.col("y") - F.lit(o_y)) / F.lit(size))})
    g = g.where((F.col("ix") < nx) & (F.col("iy") < ny))
    wide = F.sqrt((F.max("x") - F.min("x")) * (F.max("x") - F.min("x")) + (F.max("y") - F.min("y")) * (F.max("y") - F.min("y")))
    return g.groupBy("ix", "iy").agg(
        F.count(F.lit(1)).alias("n_points"), (F.max("z") - F.min("z")).alias("length"), wide.alias("xy_range"),
        (F.avg("z") - F.lit(level)).alias("height_above_track"), F.avg("x").alias("x"), F.avg("y").alias("y"),
    ).where((F.col("n_points") >= 3) & (F.col("length") > 0.5) & (F.col("xy_range") < 0.3)).withColumn("confidence", F.lit(0.7))


def gaps_along_x(points: DataFrame, min_gap: float = 5.0) -> DataFrame:
    """Gaps between consecutive x values that exceed ``min_gap``.

    Points are reduced to buckets no wider than the gap: a larger gap can only
    lie between two occupied buckets, so only bucket minima and maxima are
    ordered, in chunks whose first rows meet the last of the former chunk.
    """
    size = min_gap / 2
    b = points.groupBy(F.floor(F.col("x") / F.lit(size)).cast("long").alias("b")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = b.withColumn("c", F.floor(F.col("b") / F.lit(4096)).cast("long"))
    w = Window.partitionBy("c").orderBy("b")
    inner = b.withColumn("gap", F.col("lo") - F.lag("hi").over(w)).where("gap is not null").select("gap")
    chunk = b.groupBy("c").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    outer = chunk.withColumn("gap", F.col("lo") - F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("c"))).where("gap is not null")
    return inner.unionByName(outer.select("gap")).where(F.col("gap") > min_gap)


def span_length(points: DataFrame, default: float = 50.0) -> DataFrame:
    """Median of the large gaps of the wire points along x (one row)."""
    return gaps_along_x(points.where(F.col("classification") == 19)).agg(F.coalesce(F.median("gap"), F.lit(default)).alias("span_length"))


def catenary_statistics(segments: DataFrame, drop: DataFrame, span: DataFrame) -> DataFrame:
    t = F.col("wire_type")
    n = lambda k: F.count(F.when(t == k, 1)).alias(f"{k}_wires")
    s = segments.agg(n("contact"), n("messenger"), n("return"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("total_length"),
                     F.coalesce(F.max("height_above_track"), F.lit(0.0)).alias("system_height"),
                     F.coalesce(F.avg(F.when(t == "contact", F.col("sag"))), F.lit(0.0)).alias("avg_sag"),
                     F.count(F.lit(1)).alias("n_wires"))
    d = drop.agg(F.count(F.lit(1)).alias("droppers"))
    out = beside(s, d, span)
    return out.withColumn("span_length", F.when(F.col("n_wires") > 1, F.col("span_length")).otherwise(F.lit(0.0))).drop("n_wires")


def catenary_system(points: DataFrame, level: float | None = None) -> DataFrame:
    level = reference_level(points) if level is None else level
    return catenary_statistics(wire_segments(points, level=level), droppers(points, level), span_length(points))


# ---- tracks ---------------------------------------------------------------

def main_direction(points: DataFrame, flat: bool = False, sample: bool = True) -> tuple[float, float]:
    """Unit vector of the main direction in XY (3-D PCA with z zeroed, or plain 2-D PCA)."""
    o = points.agg(*[F.min(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n")).first()
    if not o.n or (flat and o.n < 10):
        return 1.0, 0.0
    rel = points.select(*[(F.col(a) - F.lit(o[a])).alias(f"r{a}") for a in "xyz"])
    cov = with_covariance(rel.agg(*moments("rx", "ry", "rz")), sample=sample)
    if flat:
        dx, dy = direction2(F.col("cxx"), F.col("cyy"), F.col("cxy"))
        r = cov.select(dx.alias("dx"), dy.alias("dy")).first()
    else:
        r = with_eigen3(cov, normal=False, axis=True).select(F.col("ax").alias("dx"), F.col("ay").alias("dy")).first()
    norm = math.hypot(r.dx, r.dy) or 1.0
    dx, dy = r.dx / norm, r.dy / norm
    return (dx, dy) if dx > 0 or (dx == 0 and dy > 0) else (-dx, -dy)


def track_points(points: DataFrame, direction: tuple[float, float] | None = None, segment: float = 50.0,
                 min_points: int = 50) -> DataFrame:
    """Rail points with segment number along the direction and the side of the rail."""
    rails = points.where(F.col("classification") == 18).select("point_id", "x", "y", "z")
    dx, dy = direction or main_direction(rails)
    rails = rails.withColumn("along", F.col("x") * F.lit(dx) + F.col("y") * F.lit(dy))
    lo, hi = rails.agg(F.min("along"), F.max("along")).first()
    if lo is None:
        lo, hi = 0.0, 0.0
    count = max(math.ceil((hi - lo) / segment), 0)
    rails = rails.withColumn("segment", F.floor((F.col("along") - F.lit(lo)) / F.lit(segment)).cast("int")).where(F.col("segment") < count)
    # the first point of a segment is its origin, so the mean offset stays exact
    mid = rails.groupBy("segment").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    rails = rails.join(F.broadcast(mid) if count <= 10_000 else mid, "segment")
    across = (F.col("x") - F.col("mx")) * F.lit(-dy) + (F.col("y") - F.col("my")) * F.lit(dx)
    return rails.withColumn("side", F.when(across < 0, "left").otherwise("right")).drop("mx", "my", "_n")


def rail_axes(points: DataFrame, **kw) -> DataFrame:
    """Left and right rail points of the segments that have more than 20 of each."""
    return two_sided(track_points(points, **kw))


def two_sided(t: DataFrame, keys: tuple[str, ...] = ("segment",), min_points: int = 0) -> DataFrame:
    """Rail points of the segments with more than 20 points on either side."""
    ok = t.groupBy(*keys).agg(F.count(F.when(F.col("side") == "left", 1)).alias("l"), F.count(F.when(F.col("side") == "right", 1)).alias("r"))
    return t.join(ok.where((F.col("l") > 20) & (F.col("r") > 20) & (F.col("l") + F.col("r") >= min_points)).select(*keys), list(keys), "left_semi")


def rail_pairs(axes: DataFrame, flat: bool, gauge: float = GAUGE, keys: tuple[str, ...] = ("segment",)) -> DataFrame:
    """Nearest right-rail point of every left-rail point of the segment within twice the gauge."""
    dims = ("x", "y") if flat else XYZ
    left, right = axes.where("side = 'left'"), axes.where("side = 'right'")
    pairs = radius_pairs(left, right, 2 * gauge, dims, left_cols=("point_id", *XYZ), right_cols=("point_id", *XYZ),
                         strict=True, equal=keys)
    best = F.min(F.struct("d2", "n_point_id", "x", "y", "z", "n_x", "n_y", "n_z")).alias("b")
    return pairs.groupBy(*keys, "point_id").agg(best).select(*keys, "point_id", "b.*")


def track_segments(points: DataFrame, direction: tuple[float, float] | None = None, gauge: float = GAUGE,
                   axes: DataFrame | None = None, keys: tuple[str, ...] = ("segment",), order: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Metrics per 50 m segment: gauge, cant, curvature, length and geometry type.

    A segment is 50 m of rail, so ordering its centre line stays local.  ``keys``
    name a segment (track and segment in the frame of each track), ``order`` is
    the order of its left-rail points along the line.
    """
    axes = cut(axes if axes is not None else rail_axes(points, direction=direction))
    centre = rail_pairs(axes, flat=False, gauge=gauge, keys=keys)
    line = centre.select(*keys, *[((F.col(a) + F.col(f"n_{a}")) / 2).alias(a) for a in "xyz"], "point_id")
    n = line.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    thin = axes.join(n.where(F.col("_n") >= 10), list(keys), "left_anti").select(*keys, *XYZ, "point_id")
    line = line.join(n.where(F.col("_n") >= 10).select(*keys), list(keys), "left_semi").unionByName(thin)
    extra = [c for c in order if c not in line.columns]
    if extra:
        line = line.join(axes.select(*keys, "point_id", *extra), [*keys, "point_id"])
    w = Window.partitionBy(*keys).orderBy(*order, "point_id")
    step = line.withColumns({f"s{a}": F.lead(a).over(w) - F.col(a) for a in "xyz"}).where("sx is not null")
    step = step.withColumns({
        "d": F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")),
        "d3": F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz")),
        "angle": F.atan2("sy", "sx")})
    w2 = Window.partitionBy(*keys).orderBy(*order, "point_id")
    step = step.withColumn("turn", F.abs(F.lead("angle").over(w2) - F.col("angle")))
    step = step.withColumn("turn", F.least("turn", F.lit(2 * math.pi) - F.col("turn")))  # a line may head any way
    shape = step.groupBy(*keys).agg(
        F.sum("d3").alias("length"), F.sum("turn").alias("_t"), F.sum(F.when(F.col("turn").isNotNull(), F.col("d"))).alias("_d"),
        F.count(F.lit(1)).alias("_m"))
    place = F.struct(*extra, "point_id")
    ends = line.groupBy(*keys).agg(F.min_by("z", place).alias("z_first"), F.max_by("z", place).alias("z_last"))
    flat = rail_pairs(axes, flat=True, gauge=gauge, keys=keys)
    gc = flat.groupBy(*keys).agg(F.median(F.sqrt("d2")).alias("gauge"), (F.median(F.col("z") - F.col("n_z")) * 1000).alias("cant"))
    out = shape.join(ends, list(keys)).join(gc, list(keys), "left")
    out = out.withColumn("curvature", F.when((F.col("_m") >= 9) & (F.col("_d") > 0), F.col("_t") / F.col("_d")).otherwise(F.lit(0.0)))
    kind = F.when(F.col("curvature") < 0.0001, "straight").when(F.col("curvature") < 0.001, "transition").otherwise("curve")
    return out.select(*keys, "length", F.coalesce("gauge", F.lit(gauge)).alias("gauge"),
                      (F.coalesce("gauge", F.lit(gauge)) - F.lit(gauge)).alias("gauge_deviation"),
                      F.coalesce("cant", F.lit(0.0)).alias("cant"), "curvature", kind.alias("geometry_type"),
                      (F.col("z_last") - F.col("z_first")).alias("dz"))


def track_geometry(segments: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Radius, cant, gradient and running kilometre per segment (NULL radius = straight); ``within`` counts kilometres per track.

    Segments are 50 m, so even a continental network is a few million rows; the
    running sum is taken over chunk totals first.
    """
    s = segments.withColumn("_c", F.floor(F.col("segment") / F.lit(10_000)).cast("int"))
    w = Window.partitionBy(*within, "_c").orderBy("segment")
    part = s.groupBy(*within, "_c").agg(F.sum("length").alias("_l"))
    before = part.withColumn("_b", F.coalesce(F.sum("_l").over(
        Window.partitionBy(*(within or (F.lit(0),))).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_l")
    run = s.join(before if within else F.broadcast(before), [*within, "_c"]).withColumn("_end", F.col("_b") + F.sum("length").over(w))
    return run.select(
        *within, "segment", F.when(F.col("curvature") > 0, F.lit(1.0) / F.col("curvature")).alias("horizontal_radius"), "cant",
        F.when(F.col("length") > 0, F.col("dz") / F.col("length") * 1000).otherwise(F.lit(0.0)).alias("gradient"),
        ((F.col("_end") - F.col("length")) / 1000).alias("km_start"), (F.col("_end") / 1000).alias("km_end"))


def track_statistics(segments: DataFrame, gauge: float = GAUGE) -> DataFrame:
    kind = F.col("geometry_type")
    total = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("length"))), F.lit(0.0))
    s = segments.agg(
        F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("total_length_m"),
        F.avg("gauge").alias("avg_gauge_m"), F.max(F.abs("cant")).alias("max_cant_mm"), F.max("curvature").alias("max_curvature"),
        total("straight").alias("straight_length_m"), total("curve").alias("curve_length_m"), total("transition").alias("transition_length_m"))
    return s.withColumns({
        "detected": F.col("segments") > 0, "gauge_deviation_mm": (F.col("avg_gauge_m") - F.lit(gauge)) * 1000,
        "min_radius_m": F.when(F.col("max_curvature") > 0, F.lit(1.0) / F.col("max_curvature")),
        "straight_ratio": F.when(F.col("total_length_m") > 0, F.col("straight_length_m") / F.col("total_length_m")).otherwise(F.lit(0.0))})


# ---- poles ----------------------------------------------------------------

def pole_type(height: Column, width: Column) -> Column:
    return (F.when(band(height, 6.0, 12.0), "catenary").when(height > 8.0, "lighting").when(band(height, 3.0, 8.0), "signal")
            .when((width > 1.0) & (height > 5.0), "gantry").otherwise("unknown"))


def single_pole_type(height: Column, width: Column) -> Column:
    """Variant used for one given cluster."""
    return (F.when(band(height, 6.0, 12.0), "catenary").when(height > 12.0, "lighting").when(band(height, 3.0, 8.0), "signal")
            .when(width > 1.0, "gantry").otherwise("unknown"))


def cluster_extents(clustered: DataFrame, key: str = "cluster") -> DataFrame:
    """Count, mean position, ranges and z limits of every cluster."""
    rng = lambda a: (F.max(a) - F.min(a)).alias(f"{a}_range")
    return clustered.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_points"), *[F.avg(a).alias(f"{a}_mean") for a in "xyz"], *[rng(a) for a in "xyz"],
        F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def pole_clusters(points: DataFrame, eps: float = 1.5, min_samples: int = 5) -> DataFrame:
    p = points.where(F.col("classification") == 20).select("point_id", "x", "y", "z")
    return dbscan(p, eps, min_samples, ("x", "y"))


def poles(points: DataFrame, min_height: float = 3.0, max_width: float = 2.0, clusters: DataFrame | None = None) -> DataFrame:
    """One row per pole with position, height, width, type and confidence."""
    level = reference_level(points, classes=(2,))
    e = cluster_extents(clusters if clusters is not None else pole_clusters(points))
    e = e.withColumn("width", F.greatest("x_range", "y_range"))
    e = e.where((F.col("n_points") >= 5) & (F.col("z_range") >= min_height) & (F.col("width") <= max_width) & (F.col("width") > 0))
    e = e.where(F.col("z_range") / F.col("width") >= 2)
    above = F.col("z_max") - F.lit(level)
    return e.select(F.col("cluster").alias("pole_id"), F.col("x_mean").alias("x"), F.col("y_mean").alias("y"), F.col("z_min").alias("z"),
                    F.col("z_max").alias("top_z"), F.col("z_range").alias("height"), "width",
                    pole_type(above, F.col("width")).alias("pole_type"), capped_ratio(F.col("n_points"), 50).alias("confidence"))


def axis_chainage(axis: DataFrame) -> DataFrame:
    """Axis vertices in x, y order with chainage in km (one axis: a bounded vertex list)."""
    w = Window.partitionBy("axis_id").orderBy("x", "y")
    a = axis.withColumn("_d", F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2))
    return a.withColumn("km", F.sum(F.coalesce("_d", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) / 1000).drop("_d")


def pole_positions(pole_rows: DataFrame, axis: DataFrame) -> DataFrame:
    """Chainage of the nearest axis vertex and the side of the axis (1 m dead band)."""
    a = cut(axis_chainage(axis).withColumn("vid", F.col("seq").cast("long")))
    ends = a.agg(F.min(F.struct("x", "y")).alias("s"), F.max(F.struct("x", "y")).alias("e")).first()
    dx, dy = ends.e.x - ends.s.x, ends.e.y - ends.s.y
    norm = math.hypot(dx, dy) or 1.0
    near = nearest(pole_rows, a, 1, dims=("x", "y"), query_id="pole_id", data_id="vid", carry=("x", "y", "km"))
    near = near.select("pole_id", *[F.element_at(f"n_{c}", 1).alias(f"_{c}") for c in ("x", "y", "km")])
    across = (F.col("x") - F.col("_x")) * F.lit(-dy / norm) + (F.col("y") - F.col("_y")) * F.lit(dx / norm)
    side = F.when(across < -1, "left").when(across > 1, "right").otherwise("center")
    return pole_rows.join(near, "pole_id").withColumns({"km_position": F.col("_km"), "side": side}).drop("_x", "_y", "_km")


def pole_spacing(pole_rows: DataFrame) -> DataFrame:
    """Mean XY distance of consecutive poles in x order (one row).

    Poles are range-partitioned by (x, pole_id), so no stretch of the line is too
    crowded for a task; each part adds up its own steps and tells its first and
    last pole, and only these meet to bridge the parts.
    """
    def run(batches):
        total, n, first, last = 0.0, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            xy = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y")])
            if last is None:
                first = xy[0]
            else:
                xy = np.concatenate((last[None], xy))
            total += float(np.hypot(*np.diff(xy, axis=0).T).sum())
            n, last = n + len(xy) - 1, xy[-1]
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (total, n, *map(float, (*first, *last)))], names=["total", "n", "fx", "fy", "lx", "ly"])

    p = pole_rows.select("x", "y", "pole_id")
    parts = p.repartitionByRange("x", "pole_id").sortWithinPartitions("x", "pole_id").mapInArrow(
        run, "total double, n long, fx double, fy double, lx double, ly double").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy(F.lit(0)).orderBy("part")  # one row a part
    dx, dy = F.col("fx") - F.lag("lx").over(w), F.col("fy") - F.lag("ly").over(w)
    parts = parts.withColumn("bridge", F.sqrt(dx * dx + dy * dy))
    steps = F.sum("n") + F.count("bridge")
    mean = (F.sum("total") + F.coalesce(F.sum("bridge"), F.lit(0.0))) / F.when(steps > 0, steps)
    return parts.agg(F.coalesce(mean, F.lit(0.0)).alias("avg_spacing_m"))


def pole_statistics(pole_rows: DataFrame) -> DataFrame:
    t = F.col("pole_type")
    n = lambda k: F.count(F.when(t == k, 1)).alias(f"{k}_count")
    s = pole_rows.agg(F.count(F.lit(1)).alias("total_count"), n("catenary"), n("lighting"), n("signal"), F.avg("height").alias("avg_height_m"),
                      F.min("height").alias("min_height_m"), F.max("height").alias("max_height_m"))
    return beside(s, pole_spacing(pole_rows))


# ---- signals --------------------------------------------------------------

def signal_type(height: Column) -> Column:
    return (F.when(band(height, 3.5, 6.0), "main_signal").when(band(height, 2.5, 4.5), "distant_signal")
            .when(band(height, 1.5, 3.0), "speed_limit").when(band(height, 0.5, 1.5), "km_post").otherwise("unknown"))


def signal_type_by_colour(kind: Column, red: Column, green: Column, blue: Column) -> Column:
    """Refines the type by the mean colour (channels in [0, 1], thresholds given on 0-255)."""
    r, g, b = red * 255, green * 255, blue * 255
    return (F.when((r > 150) & (g < 100) & (b < 100), "main_signal").when((r > 150) & (g > 150) & (b < 100), "warning_board")
            .when((r + g + b) / 3 > 200, "whistle_board").otherwise(kind))


def width_profile(clusters: DataFrame, bins: int = 19) -> DataFrame:
    """Count, width, depth and mean position of every height bin of every pole."""
    lim = clusters.groupBy("cluster").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    c = clusters.join(lim, "cluster").withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    c = c.where((F.col("step") > 0) & (F.col("z") < F.col("hi")))  # the top edge is open
    c = c.withColumn("bin", F.least(F.floor((F.col("z") - F.col("lo")) / F.col("step")), F.lit(bins - 1)).cast("int"))
    xr, yr = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    return c.groupBy("cluster", "bin", "lo", "step").agg(
        F.count(F.lit(1)).alias("n_points"), F.greatest(xr, yr).alias("width"), F.least(xr, yr).alias("depth"),
        F.avg("x").alias("x"), F.avg("y").alias("y"))


def signals_on_poles(points: DataFrame, level: float | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """Height bins clearly wider than the first usable bin of the pole."""
    level = reference_level(points) if level is None else level
    prof = width_profile(clusters if clusters is not None else pole_clusters(points)).where(F.col("n_points") >= 3)
    base = prof.groupBy("cluster").agg(F.min(F.struct("bin", "width")).alias("b"))
    s = prof.join(base, "cluster").where((F.col("bin") > F.col("b.bin")) & (F.col("width") > F.col("b.width") * 1.5) & (F.col("width") > 0.3))
    z = F.col("lo") + (F.col("bin") + F.lit(0.5)) * F.col("step")
    s = s.withColumns({"z": z, "height": z - F.lit(level)})
    return s.select((F.col("cluster") * 100 + F.col("bin")).alias("signal_id"), "x", "y", "z", signal_type(F.col("height")).alias("signal_type"),
                    "height", "width", "depth", F.lit(0.7).alias("confidence"), "n_points")


def standalone_signals(points: DataFrame, level: float | None = None) -> DataFrame:
    """Small free-standing clusters between 0.5 and 6 m over the track."""
    level = reference_level(points) if level is None else level
    p = points.where(~F.col("classification").isin(18, 2) & band(F.col("z") - F.lit(level), 0.5, 6.0)).select("point_id", "x", "y", "z")
    e = cluster_extents(dbscan(p, 0.5, 3, XYZ))
    wide = F.greatest("x_range", "y_range")
    e = e.where((wide < 0.5) & (F.col("z_range") < 2.0)).withColumn("height", F.col("z_mean") - F.lit(level))
    return e.select((F.col("cluster") * 100 + 99).alias("signal_id"), F.col("x_mean").alias("x"), F.col("y_mean").alias("y"),
                    F.col("z_mean").alias("z"), signal_type(F.col("height")).alias("signal_type"), "height", wide.alias("width"),
                    F.least("x_range", "y_range").alias("depth"), F.lit(0.5).alias("confidence"), "n_points")


def deduplicate(signals: DataFrame, min_distance: float = 0.5) -> DataFrame:
    """Drops a signal closer than ``min_distance`` to a better surviving one.

    Better = higher confidence, then smaller id.  Rounds: whoever has no better
    undecided neighbour stays, its neighbours go; same result as the scan in
    list order.
    """
    s = cut(signals)
    pairs = radius_pairs(s, s, min_distance, left_cols=("signal_id", "confidence"), right_cols=("signal_id", "confidence"), strict=True)
    better = (F.col("n_confidence") > F.col("confidence")) | ((F.col("n_confidence") == F.col("confidence")) & (F.col("n_signal_id") < F.col("signal_id")))
    beaten = cut(pairs.where((F.col("signal_id") != F.col("n_signal_id")) & better).select("signal_id", F.col("n_signal_id").alias("by")))
    open_ids, dropped = s.select("signal_id"), None
    while not beaten.isEmpty():
        keep = open_ids.join(beaten, "signal_id", "left_anti")
        out = beaten.join(keep.select(F.col("signal_id").alias("by")), "by", "left_semi").select("signal_id").distinct()
        out = cut(out)
        dropped = out if dropped is None else dropped.unionByName(out)
        open_ids = cut(open_ids.join(keep, "signal_id", "left_anti").join(out, "signal_id", "left_anti"))
        beaten = cut(beaten.join(out, "signal_id", "left_anti").join(out.withColumnRenamed("signal_id", "by"), "by", "left_anti")
                     .join(open_ids, "signal_id", "left_semi"))
    return s if dropped is None else s.join(dropped, "signal_id", "left_anti")


def signals(points: DataFrame, level: float | None = None) -> DataFrame:
    level = reference_level(points) if level is None else level
    return deduplicate(signals_on_poles(points, level).unionByName(standalone_signals(points, level)))


def signal_statistics(rows: DataFrame) -> DataFrame:
    t = F.col("signal_type")
    n = lambda k, name: F.count(F.when(t == k, 1)).alias(name)
    return rows.agg(F.count(F.lit(1)).alias("total_count"), F.avg("height").alias("avg_height_m"), n("main_signal", "main_signals"),
                    n("distant_signal", "distant_signals"), n("speed_limit", "speed_limits"), n("km_post", "km_posts"))
