"""Classification plans: the six-step plan, its slice on a given ground class, the tile rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.height import height_zone
from ..operators import cells, features, ground, landcover, noise, planes, raster, rules, sampling
from ..operators.cells import Extent, extent
from ..session import cut


STEPS = ("noise", "ground", "vegetation", "buildings", "infrastructure")
#: Side of the tiles in which building planes are searched, whatever the size of the cloud.
PLANE_TILE = 64.0


@dataclass(frozen=True)
class Config:
    """The steps to run and the settings of each, as keyword arguments of its operator."""

    steps: tuple[str, ...] = STEPS
    noise: dict = field(default_factory=lambda: {"method": "sor", "k": 30, "std_ratio": 2.0})
    ground: ground.GroundParams | None = None  # None: derived from density and height range
    height_cell: float = 1.0
    strata: tuple = landcover.STRATA
    building_heights: tuple[float, float] = (2.5, 50.0)
    planes: dict = field(default_factory=lambda: {"max_planes": 15, "min_points": 10_000, "threshold": 0.1, "trials": 500, "seed": 0})
    ranges: dict = field(default_factory=lambda: landcover.RANGES)


def preset(name: str) -> Config:
    """Quality presets; each names its noise method."""
    return {
        "fast": Config(steps=tuple(x for x in STEPS if x != "buildings"), noise={"method": "voxel_sor", "voxel": 1.0, "k": 15, "std_ratio": 2.0}, height_cell=2.0),
        "standard": Config(noise={"method": "voxel_sor", "voxel": 0.5, "k": 30, "std_ratio": 2.0}),
        "high": Config(noise={"method": "sor", "k": 50, "std_ratio": 2.0}, height_cell=0.5),
    }[name]


def presets(spark: SparkSession) -> DataFrame:
    rows = [(n, "buildings" in c.steps, c.noise["method"] == "voxel_sor", c.noise.get("voxel", 0.5), c.noise["k"], c.height_cell)
            for n in ("fast", "standard", "high") for c in [preset(n)]]
    return spark.createDataFrame(rows, "preset string, buildings boolean, fast_noise boolean, noise_voxel double, "
                                       "noise_k int, hag_cell double")


def with_height_and_cells(points: DataFrame, ext: Extent, hag_cell: float, stat_cell: float) -> DataFrame:
    """Adds hag and the cell statistics with one join of the points.

    ``is_ground`` must exist.  Statistics and ground heights are joined on the
    (small) table of cells first, so the points are shuffled once.
    """
    gx, gy = cells.cells_along(ext.width, hag_cell, 1), cells.cells_along(ext.height, hag_cell, 1)
    keyed = cells.with_cell(points, ext, hag_cell, extra=1, names=("ix", "iy"))
    keyed = cells.with_cell(keyed, ext, stat_cell, names=("cx", "cy"))
    parts = keyed.groupBy("cx", "cy", "ix", "iy").agg(
        F.count(F.lit(1)).alias("n"), F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("ss"),
        F.min("z").alias("lo"), F.max("z").alias("hi"), F.min(F.when(F.col("is_ground"), F.col("z"))).alias("g"),
        F.count(F.when(F.col("is_ground"), 1)).alias("ng"))
    parts = cut(parts)
    known = cut(parts.where("g is not null").groupBy("ix", "iy").agg(F.min("g").alias("ground_z"), F.sum("ng").alias("ng")))
    n_ground = known.agg(F.sum("ng")).first()[0] or 0
    stats = parts.groupBy("cx", "cy").agg(
        F.sum("n").alias("cell_count"), (F.sum("s") / F.sum("n")).alias("_m"), (F.sum("ss") / F.sum("n")).alias("_mm"),
        (F.max("hi") - F.min("lo")).alias("z_range"))
    stats = stats.select(
        "cx", "cy", "z_range", (F.col("cell_count") / F.lit(stat_cell * stat_cell)).alias("density"),
        F.when(F.col("cell_count") > 1, F.greatest(F.col("_mm") - F.col("_m") * F.col("_m"), F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("z_variance"))
    cell = parts.select("cx", "cy", "ix", "iy").join(stats, ["cx", "cy"])
    if n_ground >= 10:
        grid = raster.fill_gaps(known.select("ix", "iy", "ground_z"), parts.select("ix", "iy").distinct(), gx, gy)
        cell = cell.join(grid.select("ix", "iy", "ground_z"), ["ix", "iy"], "left")
        hag = F.coalesce(F.col("z") - F.col("ground_z"), F.lit(0.0))
    else:
        cell = cell.withColumn("ground_z", F.lit(ext.z_min))
        hag = F.col("z") - F.lit(ext.z_min)
    return keyed.join(cell, ["cx", "cy", "ix", "iy"]).withColumn("hag", hag).drop("cx", "cy", "ix", "iy", "ground_z")


def assign_infrastructure(points: DataFrame, base: Column, cfg: Config, has_intensity: bool, has_colour: bool) -> Column:
    masks = landcover.infrastructure_masks(cfg.ranges, has_intensity, has_colour)
    return F.when(base == 1, landcover.infrastructure_class(masks, F.lit(1))).otherwise(base)


def classify_given_ground(points: DataFrame, cfg: Config = Config(), ext: Extent | None = None) -> DataFrame:
    """Steps 3, 4 and 6 where class 2 is the ground and class 7 the noise: adds hag and new_class."""
    ext = ext or extent(points)
    p = points.withColumn("is_ground", F.col("classification") == 2)
    p = with_height_and_cells(p, ext, cfg.height_cell, landcover.STAT_CELL)
    p = p.withColumn("_stratum", landcover.vegetation_stratum(F.col("hag"), F.col("is_ground"), cfg.strata))
    p = p.withColumn("is_veg", F.col("_stratum").isNotNull())
    base = (F.when(F.col("classification") == 7, F.lit(7)).when(F.col("is_ground"), F.lit(2))
            .otherwise(F.coalesce(F.col("_stratum"), F.lit(1))))
    return p.withColumn("new_class", assign_infrastructure(p, base, cfg, True, True).cast("int")).drop("_stratum")


def classify(points: DataFrame, cfg: Config = Config(), has_colour: bool = True, has_intensity: bool = True,
             plane_tile: float = PLANE_TILE) -> DataFrame:
    """The six-step plan: noise, ground, height, vegetation, buildings, infrastructure.

    Adds hag and new_class.  Building planes are searched per tile of ``plane_tile``.
    """
    ext = extent(points)
    if "noise" in cfg.steps:
        # once for the ground, the cell statistics and the result
        p = cut(noise.detect(points, **cfg.noise))
    else:
        p = points.withColumn("is_noise", F.lit(False))
    if "ground" not in cfg.steps:
        return p.withColumns({"hag": F.lit(None).cast("double"),
                              "new_class": F.when(F.col("is_noise"), 7).otherwise(1)}).drop("is_noise")
    valid = ~F.col("is_noise")
    params = cfg.ground or ground.auto_params(extent(p.where(valid)) if "noise" in cfg.steps else ext)
    p = ground.ground_mask(p, params, ext, valid)
    p = with_height_and_cells(p, ext, cfg.height_cell, landcover.STAT_CELL)
    stratum = landcover.vegetation_stratum(F.col("hag"), F.col("is_ground"), cfg.strata, has_colour=has_colour)
    p = p.withColumn("_stratum", stratum if "vegetation" in cfg.steps else F.lit(None).cast("int"))
    p = p.withColumn("is_veg", F.col("_stratum").isNotNull())
    base = (F.when(F.col("is_noise"), F.lit(7)).when(F.col("is_ground"), F.lit(2))
            .otherwise(F.coalesce(F.col("_stratum"), F.lit(1))))
    p = p.withColumn("_base", base)
    if "buildings" in cfg.steps:
        cand = p.where(landcover.building_candidates(F.col("hag"), *cfg.building_heights, has_colour=has_colour))
        found = planes.extract_planes(cand, ext, plane_tile, **cfg.planes)
        kind = found.select("point_id", "kind")
        p = p.join(kind, "point_id", "left")
        surface = F.when(F.col("kind") == "wall", 40).when(F.col("kind").isNotNull(), 41)
        p = p.withColumn("_base", F.when(F.col("_base") == 1, F.coalesce(surface, F.lit(1))).otherwise(F.col("_base"))).drop("kind")
    new = F.col("_base")
    if "infrastructure" in cfg.steps:
        new = assign_infrastructure(p, F.col("_base"), cfg, has_intensity, has_colour)
    return p.withColumn("new_class", new.cast("int")).drop("_stratum", "_base")


def step_statistics(classified: DataFrame) -> DataFrame:
    """Counts per step of a classified cloud (one row)."""
    c = F.col("new_class")
    n = lambda cond: F.count(F.when(cond, 1))
    return classified.agg(
        F.count(F.lit(1)).alias("n_points"), n(c == 7).alias("noise"), n(c == 2).alias("ground"),
        n(c.isin(3, 4, 5)).alias("vegetation"), n(c.isin(6, 40, 41)).alias("buildings"),
        n(c.isin(9, 17, 18, 19, 20, 21, 30, 32, 35, 36)).alias("infrastructure"), n(c == 1).alias("unclassified"),
        F.min("hag").alias("hag_min"), F.max("hag").alias("hag_max"), F.avg("hag").alias("hag_mean"))


def zone_thresholds(points: DataFrame, key: str = "tile_id") -> DataFrame:
    """5th, 30th and 90th percentile of z per tile.

    ``percentile`` keeps one counter per distinct height of a tile and merges
    map-side; heights are millimetre-coded, so a tile's state stays small.
    """
    q = points.groupBy(key).agg(F.percentile("z", [0.05, 0.3, 0.9]).alias("_q"))
    return q.select(key, *[F.col("_q")[i].alias(c) for i, c in enumerate(("z_ground", "z_low", "z_high"))])


def classify_by_rules(points: DataFrame, tile: float | None = None, radius: float = 1.0, enabled=None,
                      same_tile: bool = True, ext: Extent | None = None) -> DataFrame:
    """Tile rule classification: features, height zones, first matching rule."""
    ext = ext or extent(points)
    size = tile or float(sampling.optimal_tile_size(ext))
    p = sampling.tile_key(points, ext, size)
    f = features.radius_features(p, radius, within=("tile_id",) if same_tile else ())
    f = f.join(zone_thresholds(p), "tile_id").withColumn(
        "zone", height_zone(F.col("z"), F.col("z_ground"), F.col("z_low"), F.col("z_high")))
    return f.withColumn("new_class", rules.classify(enabled=enabled).cast("int"))
