"""Terrain rasters on sparse cell tables: gap fill, DTM, DSM, CHM, profiles, volumes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import cells
from .cells import Extent, extent
from .neighbours import XY, nearest

# fixed values: classes that make up the surface model
SURFACE_CLASSES = [2, 3, 4, 5, 6, 17, 18, 19, 20, 21, 30, 40, 41]
GROUND_CLASSES = [2]

_RING = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def _pairs(offsets) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets])


def fill_gaps(known: DataFrame, wanted: DataFrame, nx: int, ny: int, value: str = "ground_z",
              rounds: int = 10) -> DataFrame:
    """Value of every wanted cell.

    Up to ``rounds`` synchronous passes give an empty cell the mean of its known
    neighbours (3x3); what is still empty takes the smallest known value.  Only
    cells near the wanted ones are ever created, and the loop ends as soon as no
    wanted cell is empty.
    """
    missing = wanted.join(known, ["ix", "iy"], "left_anti").select("ix", "iy").distinct()
    missing = cut(missing)
    if missing.isEmpty():
        return known
    grid = known.select("ix", "iy", value)
    for step in range(rounds):
        # a cell farther than the remaining passes from every missing cell cannot matter
        reach = rounds - step
        block = missing.select(F.floor(F.col("ix") / reach).alias("bx"), F.floor(F.col("iy") / reach).alias("by")).distinct()
        zone = block.select(F.explode(_pairs(_RING + [(0, 0)])).alias("o"), "bx", "by").select(
            (F.col("bx") + F.col("o.dx")).alias("bx"), (F.col("by") + F.col("o.dy")).alias("by")).distinct()
        spread = grid.select(F.explode(_pairs(_RING)).alias("o"), "ix", "iy", value).select(
            (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), value)
        spread = spread.where(F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1))
        spread = spread.withColumns({"bx": F.floor(F.col("ix") / reach), "by": F.floor(F.col("iy") / reach)})
        fresh = (spread.join(zone, ["bx", "by"], "left_semi").groupBy("ix", "iy").agg(F.avg(value).alias(value))
                 .join(grid, ["ix", "iy"], "left_anti"))
        grid = cut(grid.unionByName(fresh))
        missing = cut(missing.join(grid, ["ix", "iy"], "left_anti"))
        if missing.isEmpty():
            return grid
    low = grid.agg(F.min(value)).first()[0]
    return grid.unionByName(missing.withColumn(value, F.lit(low)))


def ground_cells(points: DataFrame, ext: Extent, size: float = 1.0, is_ground: Column | None = None) -> DataFrame:
    """Lowest ground height per cell."""
    is_ground = F.col("classification") == 2 if is_ground is None else is_ground
    return cells.with_cell(points.where(is_ground).select("x", "y", "z"), ext, size, extra=1).groupBy("ix", "iy").agg(
        F.min("z").alias("ground_z"))


def height_above_ground(points: DataFrame, size: float = 1.0, is_ground: Column | None = None,
                        ext: Extent | None = None) -> DataFrame:
    """Adds ``hag`` = z minus the ground height of the cell; with < 10 ground points, z minus the lowest z."""
    ext = ext or extent(points)
    is_ground = F.col("classification") == 2 if is_ground is None else is_ground
    enough = points.where(is_ground).limit(10).count() >= 10
    if not enough:
        return points.withColumn("hag", F.col("z") - F.lit(ext.z_min))
    nx, ny = cells.cells_along(ext.width, size, 1), cells.cells_along(ext.height, size, 1)
    keyed = cells.with_cell(points, ext, size, extra=1)
    known = cut(ground_cells(points, ext, size, is_ground))
    grid = fill_gaps(known, keyed.select("ix", "iy").distinct(), nx, ny)
    return keyed.join(grid, ["ix", "iy"], "left").withColumn(
        "hag", F.coalesce(F.col("z") - F.col("ground_z"), F.lit(0.0))).drop("ix", "iy", "ground_z")


def hag_idw(points: DataFrame, ground: DataFrame, k: int = 10) -> DataFrame:
    """Adds ``hag`` over the inverse-distance mean of the k nearest ground points in XY."""
    near = nearest(points, ground, k, dims=XY, carry=("z",))
    w = F.transform("nd", lambda d: F.lit(1.0) / (d + F.lit(1e-10)))
    near = near.withColumn("w", w)
    num = F.aggregate(F.zip_with("w", "n_z", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    den = F.aggregate("w", F.lit(0.0), lambda a, b: a + b)
    return points.join(near.select("point_id", (num / den).alias("ground_z")), "point_id").withColumn(
        "hag", F.col("z") - F.col("ground_z")).drop("ground_z")


# ---- DTM / DSM ------------------------------------------------------------

def nodes(ext: Extent, size: float) -> tuple[int, int]:
    """Number of grid nodes along x and y (start to end inclusive, one beyond)."""
    return (int(math.ceil((ext.width + size) / size)), int(math.ceil((ext.height + size) / size)))


def node_frame(spark, ext: Extent, size: float) -> DataFrame:
    nx, ny = nodes(ext, size)
    return spark.range(nx * ny).select(
        F.floor(F.col("id") / F.lit(ny)).cast("long").alias("ix"), (F.col("id") % ny).alias("iy"),
        F.col("id").alias("node")).withColumns({
            "x": F.lit(ext.x_min) + F.col("ix") * F.lit(float(size)),
            "y": F.lit(ext.y_min) + F.col("iy") * F.lit(float(size))})


def dtm(points: DataFrame, size: float = 1.0, smooth: bool = True, sigma: float = 1.0, k: int = 4,
        ext: Extent | None = None) -> DataFrame:
    """Terrain height per grid node: inverse-distance mean of the k nearest ground points, then smoothing.

    The reference triangulates; the mean needs no global solver and honours a
    ground point that falls on the node.
    """
    ext = ext or extent(points)
    ground = points.where(F.col("classification").isin(GROUND_CLASSES))
    if ground.isEmpty():
        z10 = cells.quantiles(points, "z", [0.1], ext.n)[0]
        ground = points.where(F.col("z") < F.lit(z10))
    grid = node_frame(points.sparkSession, ext, size)
    near = nearest(grid, ground, k, dims=XY, query_id="node", carry=("z",))
    # weights relative to the nearest distance: an exact hit takes the whole weight
    first = F.element_at("nd", 1)
    w = F.transform("nd", lambda d: F.when(first == 0, F.when(d == 0, 1.0).otherwise(0.0)).otherwise((first / d) * (first / d)))
    near = near.withColumn("w", w)
    num = F.aggregate(F.zip_with("w", "n_z", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    den = F.aggregate("w", F.lit(0.0), lambda a, b: a + b)
    h = grid.join(near.select("node", (num / den).alias("height")), "node").select("ix", "iy", "height")
    nx, ny = nodes(ext, size)
    return gaussian(h, sigma, nx, ny) if smooth else h


def gaussian_weights(sigma: float) -> list[tuple[int, float]]:
    radius = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(raw)
    return [(i - radius, v / total) for i, v in enumerate(raw)]


def gaussian(grid: DataFrame, sigma: float, nx: int, ny: int, value: str = "height") -> DataFrame:
    """Separable Gaussian smoothing of a full grid with mirrored edges.

    Every cell sends weighted copies to the cells it influences, also through
    the mirror, and each target sums what arrives.
    """
    kernel = gaussian_weights(sigma)
    radius = kernel[-1][0]
    for axis, n in (("ix", nx), ("iy", ny)):
        taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in kernel])
        other = "iy" if axis == "ix" else "ix"
        # targets t with mirror(t + o) = i: t + o in {i, -1-i, 2n-1-i} plus further periods for tiny grids
        period = 2 * n
        turns = range(-(radius // period + 1), radius // period + 2)
        images = F.array(*[F.col(axis) + F.lit(t * period) for t in turns],
                         *[F.lit(t * period - 1) - F.col(axis) for t in (*turns, max(turns) + 1)])
        img = grid.select(other, value, F.explode(images).alias("_p"))
        img = img.where(F.col("_p").between(-radius, n - 1 + radius))
        sent = img.select(other, value, "_p", F.explode(taps).alias("_t")).select(
            other, (F.col("_p") - F.col("_t.o")).cast("long").alias(axis), (F.col(value) * F.col("_t.w")).alias(value))
        grid = sent.where(F.col(axis).between(0, n - 1)).groupBy("ix", "iy").agg(F.sum(value).alias(value))
    return grid


def dsm(points: DataFrame, size: float = 1.0, ext: Extent | None = None, fill: bool = True) -> DataFrame:
    """Highest surface point per cell; an empty cell takes the nearest filled cell (in cell units)."""
    ext = ext or extent(points)
    surface = points.where(F.col("classification").isin(SURFACE_CLASSES))
    if surface.isEmpty():
        surface = points
    nx, ny = nodes(ext, size)
    top = surface.select(
        cells.index("x", ext.x_min, size, nx).alias("ix"), cells.index("y", ext.y_min, size, ny).alias("iy"), "z"
    ).groupBy("ix", "iy").agg(F.max("z").alias("height"))
    if not fill:
        return top
    top = cut(top)
    grid = node_frame(points.sparkSession, ext, size)
    empty = grid.join(top, ["ix", "iy"], "left_anti")
    src = top.withColumn("cell", F.col("ix") * F.lit(ny) + F.col("iy"))
    near = nearest(empty, src, 1, dims=("ix", "iy"), query_id="node", data_id="cell", carry=("height",))
    filled = near.select(F.floor(F.col("node") / F.lit(ny)).cast("long").alias("ix"), (F.col("node") % ny).alias("iy"),
                         F.element_at("n_height", 1).alias("height"))
    return top.unionByName(filled)


def chm(terrain: DataFrame, surface: DataFrame) -> DataFrame:
    t = terrain.withColumnRenamed("height", "_t")
    return surface.join(t, ["ix", "iy"]).select(
        "ix", "iy", F.greatest(F.col("height") - F.col("_t"), F.lit(0.0)).alias("height"))


def lookup(where: DataFrame, grid: DataFrame, ext: Extent, size: float, name: str) -> DataFrame:
    """Adds the raster height at (x, y); outside the bounds it is NULL."""
    nx, ny = nodes(ext, size)
    inside = F.col("x").between(F.lit(ext.x_min), F.lit(ext.x_max)) & F.col("y").between(F.lit(ext.y_min), F.lit(ext.y_max))
    keyed = where.withColumns({
        "_ix": F.when(inside, cells.index("x", ext.x_min, size, nx)),
        "_iy": F.when(inside, cells.index("y", ext.y_min, size, ny))})
    g = grid.select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), F.col("height").alias(name))
    return keyed.join(g, ["_ix", "_iy"], "left").drop("_ix", "_iy")


# ---- axis sections and profiles ------------------------------------------

def axis_segments(axis: DataFrame) -> DataFrame:
    """Consecutive vertex pairs with length and start chainage (per axis, vertices only)."""
    w = Window.partitionBy("axis_id").orderBy("seq")
    seg = axis.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)}).where("x2 is not null")
    seg = seg.withColumn("len", F.sqrt((F.col("x2") - F.col("x")) ** 2 + (F.col("y2") - F.col("y")) ** 2))
    return seg.withColumn("start", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1))).na.fill(0.0, ["start"])


def section_points(axis: DataFrame, width: float, interval: float, resolution: float) -> DataFrame:
    """Sample positions of the cross sections: one row per (station, offset)."""
    seg = axis_segments(axis).withColumn("n", F.floor(F.col("len") / F.lit(float(interval))).cast("int"))
    st = seg.where("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    count = int(math.ceil((width + resolution) / resolution))
    dx, dy = (F.col("x2") - F.col("x")) / F.col("len"), (F.col("y2") - F.col("y")) / F.col("len")
    along = F.col("j") * F.lit(float(interval))
    st = st.select("axis_id", "seq", "j", (F.col("start") + along).alias("station"), dx.alias("dx"), dy.alias("dy"),
                   (F.col("x") + dx * along).alias("cx"), (F.col("y") + dy * along).alias("cy"))
    st = st.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    d = F.lit(-width / 2) + F.col("i") * F.lit(float(resolution))
    return st.select("axis_id", "station", "cx", "cy", d.alias("d"),
                     (F.col("cx") - d * F.col("dy")).alias("x"), (F.col("cy") + d * F.col("dx")).alias("y"))


def cross_sections(axis: DataFrame, terrain: DataFrame, surface: DataFrame, ext: Extent, width: float = 50.0,
                   interval: float = 10.0, resolution: float = 0.5, size: float = 1.0) -> DataFrame:
    pts = section_points(axis, width, interval, resolution)
    return lookup(lookup(pts, terrain, ext, size, "terrain_h"), surface, ext, size, "surface_h")


def longitudinal_profile(axis: DataFrame, terrain: DataFrame, surface: DataFrame, ext: Extent,
                         interval: float = 1.0, size: float = 1.0) -> DataFrame:
    seg = axis_segments(axis).withColumn("n", F.floor(F.col("len") / F.lit(float(interval))).cast("int"))
    st = seg.where("n > 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("j") / F.col("n")
    pts = st.select("axis_id", (F.col("start") + F.col("j") * F.lit(float(interval))).alias("station"),
                    (F.col("x") + t * (F.col("x2") - F.col("x"))).alias("x"),
                    (F.col("y") + t * (F.col("y2") - F.col("y"))).alias("y"))
    return lookup(lookup(pts, terrain, ext, size, "terrain_h"), surface, ext, size, "surface_h")


def profile_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("axis_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("terrain_h").alias("min_height"), F.max("terrain_h").alias("max_height"),
        (F.max("terrain_h") - F.min("terrain_h")).alias("elevation_change"))


# ---- volumes --------------------------------------------------------------

def design_heights(axis_rows: int, heights: list[float]) -> list[float]:
    """Heights stretched to one per axis vertex by linear interpolation."""
    m = len(heights)
    if m == axis_rows or axis_rows < 2:
        return list(heights)
    out = []
    for i in range(axis_rows):
        p = i / (axis_rows - 1) * (m - 1)
        a = min(int(p), m - 2) if m > 1 else 0
        out.append(heights[a] + (heights[min(a + 1, m - 1)] - heights[a]) * (p - a))
    return out


def section_areas(sections: DataFrame, heights: list[float], width: float, side_slopes: float,
                  resolution: float = 0.5) -> DataFrame:
    """Cut, fill and vegetation area per station against the design height of the station."""
    last = sections.groupBy("axis_id").agg(F.max("station").alias("_last"))
    s = sections.join(last, "axis_id")
    t = F.when(F.col("_last") > 0, F.col("station") / F.col("_last")).otherwise(F.lit(0.0))
    idx = F.least(F.floor(t * F.lit(len(heights) - 1)), F.lit(len(heights) - 1)).cast("int")
    s = s.withColumn("design_h", F.element_at(F.array(*[F.lit(float(h)) for h in heights]), idx + 1))
    half, d, th = width / 2, F.abs(F.col("d")), F.col("terrain_h")
    s = s.where((d <= F.lit(half + 20)) & th.isNotNull())
    batter = (d - F.lit(half)) / F.lit(float(side_slopes))
    slope = F.when(th < F.col("design_h"), F.col("design_h") - batter).otherwise(F.col("design_h") + batter)
    proj = F.when(d <= F.lit(half), F.col("design_h")).otherwise(F.greatest(F.least(slope, th + 10), th - 10))
    s = s.withColumns({"diff": th - proj, "veg": F.col("surface_h") - th})
    w = F.lit(float(resolution))
    cutd, fill = F.greatest("diff", F.lit(0.0)), F.greatest(-F.col("diff"), F.lit(0.0))
    return s.groupBy("axis_id", "station").agg(
        (F.sum(cutd) * w).alias("cut_area"), (F.sum(fill) * w).alias("fill_area"),
        (F.coalesce(F.sum(F.when(F.col("veg") > 0.5, F.col("veg"))), F.lit(0.0)) * w).alias("veg_area"),
        F.max(cutd).alias("max_cut"), F.max(fill).alias("max_fill"))


def corridor_volume(sections: DataFrame, heights: list[float], width: float = 20.0, side_slopes: float = 2.0,
                    resolution: float = 0.5) -> DataFrame:
    """Volumes per axis; a section's area counts for the step that ends at it."""
    stations = sections.select("axis_id", "station").distinct()
    a = stations.join(section_areas(sections, heights, width, side_slopes, resolution), ["axis_id", "station"], "left").na.fill(0.0)
    w = Window.partitionBy("axis_id").orderBy("station")  # stations of one axis: a few thousand rows
    a = a.withColumn("dx", F.coalesce(F.col("station") - F.lag("station").over(w), F.lit(0.0)))
    dx = F.col("dx")
    return a.groupBy("axis_id").agg(
        F.sum(F.col("cut_area") * dx).alias("cut_volume_m3"), F.sum(F.col("fill_area") * dx).alias("fill_volume_m3"),
        F.sum(F.col("veg_area") * dx).alias("vegetation_volume_m3"), (F.sum(dx) * F.lit(float(width))).alias("area_m2"),
        F.coalesce(F.avg(F.when(F.col("cut_area") > 0, F.col("max_cut"))), F.lit(0.0)).alias("avg_cut_depth_m"),
        F.coalesce(F.avg(F.when(F.col("fill_area") > 0, F.col("max_fill"))), F.lit(0.0)).alias("avg_fill_height_m"),
        F.coalesce(F.max("max_cut"), F.lit(0.0)).alias("max_cut_depth_m"),
        F.coalesce(F.max("max_fill"), F.lit(0.0)).alias("max_fill_height_m"),
    ).withColumn("net_volume_m3", F.col("cut_volume_m3") - F.col("fill_volume_m3"))


def inside_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Ray-crossing parity against a short vertex list; the edges become literals of one expression."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1]):
        if y1 == y2:
            continue
        hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x2 - x1) * (y - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1))
        crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def area_volume(terrain: DataFrame, surface: DataFrame, ext: Extent, polygon: list[tuple[float, float]],
                design_height: float, size: float = 1.0) -> DataFrame:
    """Cut and fill of the grid nodes inside a polygon against one design height."""
    g = terrain.withColumnRenamed("height", "t").join(surface.withColumnRenamed("height", "s"), ["ix", "iy"], "left")
    x = F.lit(ext.x_min) + F.col("ix") * F.lit(float(size))
    y = F.lit(ext.y_min) + F.col("iy") * F.lit(float(size))
    g = g.where(inside_polygon(x, y, polygon)).withColumn("diff", F.col("t") - F.lit(float(design_height)))
    a = F.lit(float(size) ** 2)
    zero = F.lit(0.0)
    veg = F.when(F.col("s") - F.col("t") > 0.5, F.col("s") - F.col("t")).otherwise(zero)
    v = g.agg(
        F.coalesce(F.sum(F.greatest("diff", zero)) * a, zero).alias("cut_volume_m3"),
        F.coalesce(F.sum(F.greatest(-F.col("diff"), zero)) * a, zero).alias("fill_volume_m3"),
        F.coalesce(F.sum(veg) * a, zero).alias("vegetation_volume_m3"), (F.count(F.lit(1)) * a).alias("area_m2"),
        F.coalesce(F.max(F.greatest("diff", zero)), zero).alias("max_cut_depth_m"),
        F.coalesce(F.max(F.greatest(-F.col("diff"), zero)), zero).alias("max_fill_height_m"))
    per = lambda c: F.when((F.col("area_m2") > 0) & (F.col(c) > 0), F.col(c) / F.col("area_m2")).otherwise(zero)
    return v.withColumns({"net_volume_m3": F.col("cut_volume_m3") - F.col("fill_volume_m3"),
                          "avg_cut_depth_m": per("cut_volume_m3"), "avg_fill_height_m": per("fill_volume_m3")})


def volume_report(volume: DataFrame, cut_price: float = 25.0, fill_price: float = 35.0, veg_price: float = 15.0) -> DataFrame:
    """Rounded volumes and a unit-price cost estimate."""
    c = F.col
    cost = {"cut_cost": c("cut_volume_m3") * cut_price, "fill_cost": c("fill_volume_m3") * fill_price,
            "veg_cost": c("vegetation_volume_m3") * veg_price}
    out = volume.select(
        F.bround("cut_volume_m3", 1).alias("cut_volume_m3"), F.bround("fill_volume_m3", 1).alias("fill_volume_m3"),
        F.bround("net_volume_m3", 1).alias("net_volume_m3"),
        F.when(c("net_volume_m3") > 0, "surplus").otherwise("deficit").alias("balance"),
        F.bround(F.abs("net_volume_m3"), 1).alias("balance_volume_m3"),
        F.bround("vegetation_volume_m3", 1).alias("vegetation_volume_m3"),
        F.bround("area_m2", 1).alias("area_m2"), F.bround(c("area_m2") / 10000, 2).alias("area_ha"),
        F.bround("avg_cut_depth_m", 2).alias("avg_cut_m"), F.bround("max_cut_depth_m", 2).alias("max_cut_m"),
        F.bround("avg_fill_height_m", 2).alias("avg_fill_m"), F.bround("max_fill_height_m", 2).alias("max_fill_m"),
        *[F.bround(v, 0).alias(k) for k, v in cost.items()],
        F.bround(cost["cut_cost"] + cost["fill_cost"] + cost["veg_cost"], 0).alias("total_cost"))
    return out
