"""Colour and intensity expressions on channels scaled to [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-8


def from_uint16(col: Column) -> Column:
    return col / F.lit(65535.0)


def to_uint16(col: Column) -> Column:
    return F.floor(col * F.lit(65535.0)).cast("int")


def intensity_by_unit_max(intensity: Column, unit: Column) -> Column:
    """Divide by the maximum of the loaded unit; an all-zero unit stays raw."""
    top = F.max(intensity).over(Window.partitionBy(unit))
    return F.when(top > 0, intensity / top).otherwise(intensity.cast("double"))


def ndvi(red: Column, green: Column) -> Column:
    return (green - red) / (green + red + F.lit(EPS))


def green_ratio(red: Column, green: Column, blue: Column) -> Column:
    return green / (red + green + blue + F.lit(EPS))


def excess_green(red: Column, green: Column, blue: Column) -> Column:
    return F.lit(2.0) * green - red - blue


def brightness(red: Column, green: Column, blue: Column) -> Column:
    return (red + green + blue) / F.lit(3.0)


def saturation(red: Column, green: Column, blue: Column) -> Column:
    """Population standard deviation of the three channels."""
    mean = brightness(red, green, blue)
    var = ((red - mean) * (red - mean) + (green - mean) * (green - mean) + (blue - mean) * (blue - mean)) / F.lit(3.0)
    return F.sqrt(var)
