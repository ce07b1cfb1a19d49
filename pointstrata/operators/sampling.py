"""Tiles, squares, voxel and hash sampling, area selection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from . import cells
from .cells import Extent, extent


#: Samples up to so many rows are kept in the heap of every task; larger ones are cut at a hash that is found by counting.
TOP = 1000
#: Bits of a hash inside one bucket of the counts (4096 buckets).
BUCKET_BITS = 19


def hash_sample(df: DataFrame, n: int, seed: int = 0, id_col: str = "point_id") -> DataFrame:
    """The n rows with the smallest hash (ties: smallest id).

    A few rows are a per-partition top-n and a merge.  For many, the last row of
    the sample is found by counts (of hash buckets, then of the keys in one of
    them), and the sample is a filter: no task holds or sorts it.
    """
    key = hash_key(F.col(id_col), seed)
    if n <= TOP:
        return df.orderBy(key, id_col).limit(n)
    h, b = key.alias("h"), F.coalesce(F.shiftright(key, BUCKET_BITS), F.lit(-1)).alias("b")  # null ids come first
    before, bucket = 0, None
    for r in sorted(df.groupBy(b).agg(F.count(F.lit(1)).alias("k")).collect()):
        if before + r.k >= n:
            bucket = r.b
            break
        before += r.k
    if bucket is None:
        return df
    keys = df.select(h, b, F.col(id_col).alias("i")).where(F.col("b") == bucket).groupBy("h", "i").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.partitionBy(F.lit(0)).orderBy("h", "i"))  # a 4096th of the keys
    last = keys.withColumn("upto", upto + F.lit(before)).where(F.col("upto") >= n).orderBy("h", "i").first()
    if last.h is None:
        return df.where(F.col(id_col).isNull()).limit(n)
    lower = key.isNull() | (key < last.h) | ((key == last.h) & (F.col(id_col) < last.i))
    same = F.coalesce(F.col(id_col) == last.i, F.lit(False))
    if last.upto == n:
        return df.where(lower | same)
    return df.where(lower).unionByName(df.where(same).limit(n - (last.upto - last.k)))


def hash_sample_per_group(df: DataFrame, group: str, n: int, seed: int = 0, id_col: str = "point_id") -> DataFrame:
    """At most n rows per group.

    Few rows: ``row_number() <= n`` is cut per task before the shuffle, so a hot
    group moves at most n rows per task.  Spark does so up to a limit; for more
    rows, hash buckets are counted per group and rows behind the bucket of the
    n-th row stay where they are, so a group sorts little more than its sample.
    """
    key = hash_key(F.col(id_col), seed)
    w = Window.partitionBy(group).orderBy(key, F.col(id_col))
    if n > TOP:
        b = F.coalesce(F.shiftright(key, BUCKET_BITS), F.lit(-1))
        c = df.groupBy(F.col(group).alias("_g"), b.alias("_b")).agg(F.count(F.lit(1)).alias("_k"))
        upto = F.sum("_k").over(Window.partitionBy("_g").orderBy("_b"))
        c = c.withColumn("_upto", upto).groupBy("_g").agg(F.min(F.when(F.col("_upto") >= n, F.col("_b"))).alias("_last"))
        inside = F.col(group).eqNullSafe(F.col("_g")) & (b <= F.coalesce("_last", F.lit((1 << 31 - BUCKET_BITS))))
        df = df.join(F.broadcast(c), inside).select(*df.columns)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


# ---- size rules -----------------------------------------------------------

def optimal_tile_size(ext: Extent, target: int = 500_000) -> int:
    side = int(math.sqrt(target / ext.density))
    side = max(5, round(side / 5) * 5) if side < 20 else round(side / 10) * 10
    return max(5, min(300, side))


def square_size(ext: Extent, target: int) -> float:
    side = math.sqrt(target / (ext.density or 1.0))
    if side < 10:
        return max(2, round(side))
    if side < 50:
        return round(side / 5) * 5
    return round(side / 10) * 10


def voxel_size_for(ext: Extent, target: int) -> float:
    volume = max(ext.width * ext.height * ext.depth, 1.0)
    area = max(ext.area, 1.0)
    by_volume = (volume / target) ** (1 / 3) * 0.7
    by_density = math.sqrt(area / ext.n) * math.sqrt(target / ext.n)
    return max(by_volume, by_density, 0.1)


# ---- tiles and squares ----------------------------------------------------

def _full_grid(spark, nx: int, ny: int) -> DataFrame:
    return spark.range(nx * ny).select(
        F.floor(F.col("id") / F.lit(ny)).cast("long").alias("gx"), (F.col("id") % ny).alias("gy")
    )


def tile_key(points: DataFrame, ext: Extent, size: float) -> DataFrame:
    """Adds tile_id = ix * ny + iy."""
    nx, ny = cells.cells_along(ext.width, size), cells.cells_along(ext.height, size)
    return points.withColumn(
        "tile_id", cells.index("x", ext.x_min, size, nx) * F.lit(ny) + cells.index("y", ext.y_min, size, ny)
    )


def tiles(points: DataFrame, size: float | None = None, target: int = 500_000, ext: Extent | None = None) -> DataFrame:
    """All tiles of the cloud with bounds, centre and point count (empty ones too)."""
    ext = ext or extent(points)
    size = size or optimal_tile_size(ext, target)
    nx, ny = cells.cells_along(ext.width, size), cells.cells_along(ext.height, size)
    counts = tile_key(points.select("x", "y"), ext, size).groupBy("tile_id").agg(F.count(F.lit(1)).alias("n"))
    grid = _full_grid(points.sparkSession, nx, ny).withColumn("tile_id", F.col("gx") * F.lit(ny) + F.col("gy"))
    x0 = F.lit(ext.x_min) + F.col("gx") * F.lit(float(size))
    y0 = F.lit(ext.y_min) + F.col("gy") * F.lit(float(size))
    return grid.join(counts, "tile_id", "left").select(
        "tile_id",
        x0.alias("x_min"), (x0 + F.lit(float(size))).alias("x_max"),
        y0.alias("y_min"), (y0 + F.lit(float(size))).alias("y_max"),
        (x0 + F.lit(size / 2.0)).alias("center_x"), (y0 + F.lit(size / 2.0)).alias("center_y"),
        F.coalesce("n", F.lit(0)).cast("long").alias("point_count"),
    )


def square_key(points: DataFrame, ext: Extent, size: float) -> DataFrame:
    """Adds the 1-based square_id = row * n_cols + col + 1."""
    nc, nr = cells.cells_along(ext.width, size), cells.cells_along(ext.height, size)
    return points.withColumn(
        "square_id",
        cells.index("y", ext.y_min, size, nr) * F.lit(nc) + cells.index("x", ext.x_min, size, nc) + F.lit(1),
    )


def squares(points: DataFrame, target: int, ext: Extent | None = None) -> DataFrame:
    ext = ext or extent(points)
    size = float(square_size(ext, target))
    nc, nr = cells.cells_along(ext.width, size), cells.cells_along(ext.height, size)
    counts = square_key(points.select("x", "y"), ext, size).groupBy("square_id").agg(F.count(F.lit(1)).alias("n"))
    grid = points.sparkSession.range(nc * nr).select(
        (F.col("id") + 1).alias("square_id"),
        F.floor(F.col("id") / F.lit(nc)).cast("long").alias("row"), (F.col("id") % nc).alias("col"),
    )
    x0 = F.lit(ext.x_min) + F.col("col") * F.lit(size)
    y0 = F.lit(ext.y_min) + F.col("row") * F.lit(size)
    return grid.join(counts, "square_id", "left").select(
        "square_id", "row", "col",
        x0.alias("x_min"), (x0 + F.lit(size)).alias("x_max"),
        y0.alias("y_min"), (y0 + F.lit(size)).alias("y_max"),
        (x0 + F.lit(size / 2)).alias("center_x"), (y0 + F.lit(size / 2)).alias("center_y"),
        F.lit(size * size).alias("area_m2"),
        F.coalesce("n", F.lit(0)).cast("long").alias("point_count"),
    )


def grid_statistics(grid: DataFrame) -> DataFrame:
    """Totals, empties and point counts of a tile or square table."""
    filled = F.col("point_count") > 0
    return grid.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(F.when(filled, 1)).alias("non_empty"),
        F.count(F.when(~filled, 1)).alias("empty"),
        F.sum("point_count").cast("long").alias("total_points"),
        F.avg(F.when(filled, F.col("point_count"))).alias("avg_points"),
        F.min(F.when(filled, F.col("point_count"))).alias("min_points"),
        F.max(F.when(filled, F.col("point_count"))).alias("max_points"),
    )


def map_rows(grid: DataFrame) -> DataFrame:
    """Corner polygons, density and the empty flag for map display."""
    c = F.col
    return grid.select(
        "*",
        F.array("x_min", "x_max", "x_max", "x_min", "x_min").alias("corners_x"),
        F.array("y_min", "y_min", "y_max", "y_max", "y_min").alias("corners_y"),
        (c("point_count") / ((c("x_max") - c("x_min")) * (c("y_max") - c("y_min")))).alias("density"),
        (c("point_count") == 0).alias("is_empty"),
    )


# ---- samplers -------------------------------------------------------------

def random_sample(points: DataFrame, target: int, seed: int = 0, n: int | None = None) -> DataFrame:
    n = points.count() if n is None else n
    return points if n <= target else hash_sample(points, target, seed)


def voxel_sample(points: DataFrame, target: int, low: float = 0.1, high: float = 50.0,
                 ext: Extent | None = None) -> DataFrame:
    """Mean position and colour per voxel, the voxel sized for about ``target`` rows."""
    ext = ext or extent(points)
    cols = ["x", "y", "z", "red", "green", "blue"]
    size = min(max(voxel_size_for(ext, target), low), high)
    # voxel corners sit half a voxel below the lower corner of the cloud
    keyed = points.withColumns(
        {f"v{a}": cells.index(a, o - size / 2, size) for a, o in zip("xyz", (ext.x_min, ext.y_min, ext.z_min))}
    )
    return keyed.groupBy("vx", "vy", "vz").agg(*[F.avg(c).alias(c) for c in cols]).select(*cols)


def first_per_cell(points: DataFrame, keys: list[str], id_col: str = "point_id") -> DataFrame:
    """Row with the smallest id of every cell; a map-side-combined aggregate."""
    rest = [c for c in points.columns if c not in keys]
    return points.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(id_col)).alias("_r")).select(*keys, "_r.*")


def grid_sample(points: DataFrame, target: int, seed: int = 0, ext: Extent | None = None) -> DataFrame:
    ext = ext or extent(points)
    if ext.n <= target:
        return points
    size = voxel_size_for(ext, target) * 0.8
    keyed = points.withColumns(
        {f"v{a}": cells.index(a, o, size) for a, o in zip("xyz", (ext.x_min, ext.y_min, ext.z_min))}
    )
    return hash_sample(first_per_cell(keyed, ["vx", "vy", "vz"]).select(*points.columns), target, seed)


def adaptive_sample(points: DataFrame, target: int, method: str = "voxel", seed: int = 0) -> DataFrame:
    """About ``target`` rows: voxel means for quality, or single rows for speed; the method does not follow the size."""
    return random_sample(points, target, seed) if method == "random" else voxel_sample(points, target)


def fixed_blocks(points: DataFrame, size: int = 4096) -> DataFrame:
    """Blocks of ``size`` points per chunk; the last block of a chunk is padded with label -1.

    The position inside a chunk comes from ids that are dense per chunk, so no
    global window is needed; a block is at most ``size`` rows.
    """
    first = points.groupBy("chunk_id").agg(F.min("point_id").alias("_first"))
    blk = points.join(first, "chunk_id").withColumn("_pos", F.col("point_id") - F.col("_first"))
    blk = blk.withColumn("block", F.floor(F.col("_pos") / F.lit(size)).cast("long"))
    packed = blk.groupBy("chunk_id", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("_pos", "x", "y", "z", F.col("classification").alias("label")))).alias("rows"),
    )
    pad = F.array_repeat(F.lit(-1), (F.lit(size) - F.col("n")).cast("int"))
    return packed.select(
        "chunk_id", "block", "n",
        F.transform("rows", lambda r: F.array(r["x"], r["y"], r["z"])).alias("coords"),
        F.concat(F.transform("rows", lambda r: r["label"].cast("int")), pad).alias("labels"),
    )


# ---- area selection -------------------------------------------------------

def crop_square(points: DataFrame, cx: float, cy: float, side: float) -> DataFrame:
    h = side / 2
    return points.where(
        F.col("x").between(F.lit(cx - h), F.lit(cx + h)) & F.col("y").between(F.lit(cy - h), F.lit(cy + h))
    )


def largest_square(points: DataFrame, cx: float, cy: float, max_points: int, ext: Extent | None = None) -> float:
    """Side of the largest centred square with at most ``max_points`` points.

    Exact: half the side is the order statistic of the Chebyshev distance, not
    more than 1.2 times the side expected from the mean density.
    """
    ext = ext or extent(points)
    limit = 1.2 * math.sqrt(max_points / ext.density)
    if ext.n <= max_points:
        return limit
    d = points.select(F.greatest(F.abs(F.col("x") - F.lit(cx)), F.abs(F.col("y") - F.lit(cy))).alias("d"))
    inside, outside = cells.order_statistics(d, "d", [max_points - 1, max_points])
    if inside == outside:
        # ties straddle the budget: fall back to the next smaller distance
        below = d.where(F.col("d") < F.lit(inside)).agg(F.max("d")).first()[0]
        inside = below if below is not None else 0.0
    return min(2 * inside, limit)


def high_entropy_cells(points: DataFrame, ext: Extent, grid: int = 10, min_points: int = 1000) -> DataFrame:
    """Height spread of every sufficiently full cell of a grid x grid partition."""
    sx, sy = ext.width / grid, ext.height / grid
    keyed = points.select(cells.index("x", ext.x_min, sx).alias("i"), cells.index("y", ext.y_min, sy).alias("j"), "z")
    keyed = keyed.where((F.col("i") < grid) & (F.col("j") < grid))
    return (
        keyed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("z").alias("z_std"))
        .where(F.col("n") >= min_points)
        .withColumns({
            "center_x": F.lit(ext.x_min) + (F.col("i") + 0.5) * F.lit(sx),
            "center_y": F.lit(ext.y_min) + (F.col("j") + 0.5) * F.lit(sy),
        })
    )


def select_area(points: DataFrame, max_points: int, strategy: str = "center",
                custom: tuple[float, float] | None = None) -> tuple[DataFrame, dict]:
    ext = extent(points)
    if strategy == "custom":
        if custom is None:
            raise ValueError("custom needs a centre")
        cx, cy = custom
    elif strategy in ("center", "high_entropy"):
        cx, cy = (cells.quantiles(points, a, [0.5], ext.n)[0] for a in ("x", "y"))
        if strategy == "high_entropy":
            best = high_entropy_cells(points, ext).orderBy(F.desc("z_std"), "i", "j").first()
            if best is not None:
                cx, cy = best.center_x, best.center_y
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    side = largest_square(points, cx, cy, max_points, ext)
    area = crop_square(points, cx, cy, side)
    return area, {
        "strategy": strategy, "center_x": cx, "center_y": cy, "area_side": side, "area_m2": side * side,
        "total_points": ext.n,
    }
