"""Height expressions: zones, interpolation, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: upper bounds of the height-above-ground zones, in metres
HAG_ZONES = (
    ("below_ground", 0.0),
    ("ground_level", 0.15),
    ("low_vegetation", 0.5),
    ("medium_vegetation", 3.0),
    ("high_vegetation", 10.0),
)


def hag_zone(hag: Column, zones=HAG_ZONES, last: str = "very_high") -> Column:
    expr = None
    for name, upper in zones:
        cond = hag < F.lit(upper)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(last))


def height_zone(z: Column, z_ground: Column, z_low: Column, z_high: Column) -> Column:
    """A below the 5th percentile, B to the 30th, C to the 90th, D above."""
    return (
        F.when(z >= z_high, "D")
        .when(z >= z_low, "C")
        .when(z < z_ground, "A")
        .otherwise("B")
    )


def piecewise_linear(h: Column, knots: list[tuple[float, float]]) -> Column:
    """Linear interpolation over (height, value) knots, clamped at both ends."""
    pts = sorted(knots)
    expr = F.when(h <= F.lit(pts[0][0]), F.lit(pts[0][1])).when(h >= F.lit(pts[-1][0]), F.lit(pts[-1][1]))
    for (h1, w1), (h2, w2) in zip(pts, pts[1:]):
        t = (h - F.lit(h1)) / F.lit(h2 - h1)
        expr = expr.when(h <= F.lit(h2), F.lit(w1) + t * F.lit(w2 - w1))
    return expr


def band(value: Column, low: float, high: float) -> Column:
    return value.between(F.lit(low), F.lit(high))


def capped_ratio(n: Column, full: float) -> Column:
    """Confidence min(1, n / full)."""
    return F.least(F.lit(1.0), n / F.lit(float(full)))
