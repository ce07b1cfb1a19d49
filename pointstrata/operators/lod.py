"""Level of detail of a cloud or of single objects."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cells, shapes
from .cells import Extent, beside, extent

# fixed values: level, smallest density (points per m2), accuracy (m)
REQUIREMENTS = [
    (100, 1, 1.0, "Masy i objetosci", "Bounding box lub prosta bryła", ["Studia koncepcyjne", "Analizy masy"]),
    (200, 5, 0.5, "Przyblizona geometria", "Uproszczone ksztalty z orientacja", ["Planowanie przestrzenne", "Wstepne koordynacja"]),
    (300, 20, 0.15, "Dokladna geometria", "Rzeczywiste ksztalty i wymiary", ["Dokumentacja projektowa", "Koordynacja 3D"]),
    (350, 50, 0.05, "Koordynacja z interfejsami", "Szczegolowa geometria + polaczenia", ["Koordynacja miedzybranzowa", "Clash detection"]),
    (400, 100, 0.02, "Fabrication", "Pelna szczegolowość produkcyjna", ["Prefabrykacja", "Produkcja"]),
    (500, 200, 0.01, "As-built", "Weryfikacja wykonania", ["Odbiory", "Dokumentacja powykonawcza", "FM"]),
]


def level_of(score: Column) -> Column:
    expr = None
    for low, level in ((90, 500), (75, 400), (60, 350), (45, 300), (30, 200)):
        expr = F.when(score >= low, level) if expr is None else expr.when(score >= low, level)
    return expr.otherwise(100)


def density_score(d: Column) -> Column:
    return (F.when(d < 1, 10.0).when(d < 5, 30.0).when(d < 20, 50.0).when(d < 50, 70.0).when(d < 100, 85.0)
            .otherwise(F.least(F.lit(100.0), F.lit(85.0) + (d - 100) / 10)))


def completeness(points: DataFrame, ext: Extent | None = None, size: float = 10.0) -> DataFrame:
    """Share of occupied cells in percent (one row)."""
    ext = ext or extent(points)
    if ext.width == 0 or ext.height == 0:
        return points.agg(F.lit(0.0).alias("completeness_score"))
    nx, ny = max(1, int(ext.width / size)), max(1, int(ext.height / size))
    used = points.select(cells.index("x", ext.x_min, size, nx).alias("i"), cells.index("y", ext.y_min, size, ny).alias("j")).distinct()
    return used.agg((F.count(F.lit(1)) / F.lit(float(nx * ny)) * 100).alias("completeness_score"))


def detail_and_noise(points: DataFrame) -> DataFrame:
    """Class-based detail score and noise score (one row)."""
    c = F.col("classification")
    n = lambda k: F.count(F.when(c == k, 1))
    g = points.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("classification").alias("class_count"), *[n(k).alias(f"n{k}") for k in (3, 4, 5, 6, 7, 18, 19, 20)])
    one = lambda k: F.when(F.col(f"n{k}") > 0, 1.0).otherwise(0.0)
    detail = (F.least(F.lit(30.0), F.col("class_count") * 3.0) + F.when(F.col("n6") > 100, 20.0).otherwise(0.0)
              + 10.0 * (one(18) + one(19) + one(20)) + 5.0 * (one(3) + one(4) + one(5)))
    noise = F.when(F.col("n7") > 0, F.greatest(F.lit(0.0), F.lit(100.0) - F.col("n7") / F.col("n") * 500)).otherwise(F.lit(100.0))
    return g.select("class_count", F.least(F.lit(100.0), detail).alias("detail_score"), noise.alias("noise_score"))


def advice(density: Column, complete: Column, detail: Column, noise: Column) -> Column:
    """Array of the recommendations that apply."""
    tips = F.array(F.when(density < 50, "low_density"), F.when(complete < 70, "incomplete_coverage"),
                   F.when(detail < 50, "limited_classes"), F.when(noise < 80, "noisy"))
    some = F.filter(tips, lambda t: t.isNotNull())
    return F.when(F.size(some) == 0, F.array(F.lit("good_quality"))).otherwise(some)


def cloud_lod(points: DataFrame, ext: Extent | None = None) -> DataFrame:
    ext = ext or extent(points)
    r = beside(completeness(points, ext), detail_and_noise(points))
    r = r.withColumns({"point_count": F.lit(ext.n), "area_m2": F.lit(ext.area), "point_density": F.lit(ext.density)})
    r = r.withColumn("density_score", density_score(F.col("point_density")))
    score = F.col("density_score") * 0.4 + F.col("completeness_score") * 0.3 + F.col("detail_score") * 0.2 + F.col("noise_score") * 0.1
    r = r.withColumn("overall_score", score)
    return r.withColumns({
        "lod": level_of(F.col("overall_score")), "confidence": F.least(F.lit(1.0), F.col("overall_score") / 100),
        "recommendations": advice(F.col("density_score"), F.col("completeness_score"), F.col("detail_score"), F.col("noise_score"))})


def edge_quality(share: Column, n: Column) -> Column:
    return (F.when(n < 20, 0.3).when(share.between(0.1, 0.3), 0.9).when(share.between(0.05, 0.4), 0.7).otherwise(0.5))


def element_lod(points: DataFrame, key: str) -> DataFrame:
    """Level per object from local density and the share of hull vertices."""
    b = shapes.boxes(points, key)
    v = shapes.hulls(points, key).groupBy(key).agg(F.count(F.lit(1)).alias("_v"))
    e = b.join(v, key).withColumn("footprint_area", F.greatest(F.col("size_x") * F.col("size_y"), F.lit(1.0)))
    e = e.withColumns({"point_density": F.col("point_count") / F.col("footprint_area"),
                       "edge_quality": edge_quality(F.col("_v") / F.col("point_count"), F.col("point_count"))})
    overall = F.least(F.lit(100.0), F.col("point_density") * 2) * 0.5 + F.col("edge_quality") * 50
    few = F.col("point_count") < 10
    return e.select(key, "point_count", F.when(few, 100).otherwise(level_of(overall)).alias("lod"),
                    F.when(few, 0.3).otherwise(F.least(F.lit(1.0), F.col("point_count") / 200)).alias("confidence"),
                    "point_density", "footprint_area", F.col("size_z").alias("height"), "edge_quality")


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUIREMENTS, "lod int, min_density int, accuracy_m double, description string, geometry string, use_cases array<string>")


def with_requirements(df: DataFrame) -> DataFrame:
    """Joins the requirements of each row's level; an unknown level gets those of 300."""
    known = [r[0] for r in REQUIREMENTS]
    return df.withColumn("_l", F.when(F.col("lod").isin(known), F.col("lod")).otherwise(300)).join(
        F.broadcast(requirements(df.sparkSession).withColumnRenamed("lod", "_l")), "_l").drop("_l")
