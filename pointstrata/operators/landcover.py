"""Vegetation, infrastructure and building predicates as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour


# Upper heights of the lower strata, the two colour indices of green points.
STRATA = ((0.5, 3), (3.0, 4))
GREEN = {"ndvi": 0.05, "green_ratio": 0.33}


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("red"), F.col("green"), F.col("blue")


def vegetation_stratum(hag: Column, is_ground: Column, strata=STRATA, green=GREEN, has_colour: bool = True) -> Column:
    """3 / 4 / 5 by height for green points that are not ground, else NULL; without colours every point counts as green."""
    r, g, b = _rgb()
    leafy = (colour.ndvi(r, g) > green["ndvi"]) | (colour.green_ratio(r, g, b) > green["green_ratio"]) if has_colour else F.lit(True)
    height = F.when(hag <= 0, None)
    for top, stratum in strata:
        height = height.when(hag <= top, stratum)
    return F.when(leafy & ~is_ground, height.otherwise(5))


#: Side of the cells whose statistics the masks read.
STAT_CELL = 0.5

# Class by class, the inclusive range of each quantity (None: open); a point must be free of vegetation,
# and of ground where ``bare`` stands; ``grey`` is the highest colour deviation, with the open range of brightness after it.
RANGES = {
    "powerlines": {"class": 19, "bare": True, "hag": (6.0, None), "z_variance": (0.3, None), "density": (None, 50.0)},
    "poles": {"class": 20, "bare": True, "hag": (3.0, 20.0), "z_range": (5.0, None), "density": (None, 200.0)},
    "rails": {"class": 18, "bare": True, "hag": (0.0, 0.15), "intensity": (0.5, None), "z_variance": (None, 0.02), "grey": (0.1, 0.2, 0.7)},
    "roads": {"class": 30, "hag": (None, 0.15), "z_variance": (None, 0.05), "density": (100.0, None), "grey": (0.15,)},
    "curbs": {"class": 32, "bare": True, "hag": (0.05, 0.25), "z_variance": (None, 0.02), "intensity": (0.4, None), "grey": (0.1, 0.4, 0.8)},
    "signs": {"class": 35, "bare": True, "hag": (1.5, 4.0), "intensity": (0.7, None), "density": (None, 100.0)},
    "barriers": {"class": 36, "bare": True, "hag": (0.3, 1.2), "intensity": (0.5, None), "density": (20.0, 300.0), "grey": (0.12,)},
    "platforms": {"class": 21, "hag": (0.3, 1.5), "z_variance": (None, 0.03), "density": (150.0, None), "grey": (0.12, 0.3, 0.8)},
    "water": {"class": 9, "hag": (None, 0.1), "z_variance": (None, 0.01), "intensity": (None, 0.15), "density": (50.0, None), "wet": 0.4},
    "bridges": {"class": 17, "hag": (2.0, 30.0), "z_variance": (None, 0.05), "density": (100.0, None), "intensity": (0.3, None), "grey": (0.12, 0.3, 0.8)},
}
#: Masks that cannot be told without intensity; the others then ignore it.
NEED_INTENSITY = ("rails", "signs")
#: The strongest first: a point takes the class of the first mask that holds.
ORDER = ("bridges", "water", "platforms", "barriers", "signs", "curbs", "roads", "rails", "poles", "powerlines")


def infrastructure_masks(ranges: dict[str, dict] = RANGES, has_intensity: bool = True, has_colour: bool = True) -> dict[str, Column]:
    """One mask per row of ``ranges`` over hag, z_variance, z_range, density, intensity, colours, is_ground, is_veg."""
    r, g, b = _rgb()
    out = {}
    for name, row in ranges.items():
        mask = ~F.col("is_veg")
        if row.get("bare"):
            mask = mask & ~F.col("is_ground")
        for quantity in ("hag", "z_variance", "z_range", "density", "intensity"):
            low, high = row.get(quantity, (None, None))
            if quantity == "intensity" and not has_intensity:
                mask = F.lit(False) if name in NEED_INTENSITY else mask
                continue
            mask = mask if low is None else mask & (F.col(quantity) >= low)
            mask = mask if high is None else mask & (F.col(quantity) <= high)
        if has_colour and "grey" in row:
            spread, *light = row["grey"]
            mask = mask & (colour.saturation(r, g, b) < spread)
            if light:
                mask = mask & (colour.brightness(r, g, b) > light[0]) & (colour.brightness(r, g, b) < light[1])
        if has_colour and "wet" in row:
            mask = mask & (colour.brightness(r, g, b) < row["wet"]) & ((b > r) | (g > r))
        out[name] = mask
    return out


def infrastructure_class(masks: dict[str, Column], otherwise: Column) -> Column:
    """One CASE in effective precedence order."""
    return F.coalesce(*(F.when(masks[name], F.lit(RANGES[name]["class"])) for name in ORDER if name in masks), otherwise)


def building_candidates(hag: Column, min_height: float = 2.5, max_height: float = 50.0, green_index: float = 0.12,
                        max_spread: float = 0.15, has_colour: bool = True) -> Column:
    tall = (hag >= min_height) & (hag <= max_height)
    if not has_colour:
        return tall
    r, g, b = _rgb()
    leafy = (colour.ndvi(r, g) > green_index) | ((g > r) & (g > b) & (g > 0.3))
    return tall & ~(leafy | (colour.saturation(r, g, b) > max_spread))


def surface_kind(normal_z: Column) -> Column:
    """Roof, wall or sloped roof by the vertical part of the normal."""
    nz = F.abs(normal_z)
    return F.when(nz > 0.8, "roof").when(nz < 0.2, "wall").otherwise("sloped_roof")


def vegetation_statistics(points: DataFrame, stratum: Column) -> DataFrame:
    """Count, share and mean height of each stratum, zero rows included."""
    names = points.sparkSession.createDataFrame(
        [(3, "low_vegetation"), (4, "medium_vegetation"), (5, "high_vegetation")], "stratum int, name string")
    n_all = points.agg(F.count(F.lit(1)).alias("all_n"))
    per = points.where(stratum.isNotNull()).groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.avg("hag").alias("hag_mean"))
    joined = names.join(F.broadcast(per), "stratum", "left").withColumn("_one", F.lit(1))
    return joined.join(F.broadcast(n_all.withColumn("_one", F.lit(1))), "_one").select(
        "name", F.coalesce("n", F.lit(0)).cast("long").alias("count"),
        (F.coalesce("n", F.lit(0)) / F.col("all_n") * 100).alias("percentage"), F.coalesce("hag_mean", F.lit(0.0)).alias("hag_mean"))
