"""The point cloud that the registered queries run on.

No point cloud comes with the given tables, so one is derived from ``orders``:
every order yields four points whose position depends only on the order key.
The cloud grows with the table, block by block; all constants are multiples of
1/1024, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_PER_BLOCK = 1000
BLOCK_SIZE = 32
BLOCKS_PER_ROW = 8


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with columns file_id, chunk_id, point_id, x, y, z, colours, intensity, class."""
    pid = F.explode(F.array(*[F.col("o_orderkey") * 4 + j for j in range(4)]))
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(pid.alias("point_id"))
    df = df.withColumns(
        {"b": _div(F.col("point_id"), POINTS_PER_BLOCK), "r": F.col("point_id") % POINTS_PER_BLOCK}
    )
    r = F.col("r")

    # object table: first slot, last slot, u, v, z, class, rgb, intensity
    def obj(i):
        d, m = _div, lambda n: i % n
        return i, d, m

    i, d, m = obj(r)
    ground = (m(25) * 0.8125, d(i, 25).cast("double"), 100 + (7 * r) % 4 / 64)
    i, d, m = obj(r - 500)
    tree = (3 + m(6) / 4, 3 + (d(i, 6) % 5) / 4, 104 + d(i, 30) + (m(3)) / 8)
    i, d, m = obj(r - 620)
    roof = (11 + m(12) / 2, 2 + d(i, 12) / 2, F.lit(106.0))
    i, d, m = obj(r - 740)
    wall = (F.lit(11.0), 2 + m(10) / 2, 102 + d(i, 10).cast("double"))
    i, d, m = obj(r - 780)
    rail = (m(40) / 2, 15 + d(i, 40) * 1.4375, 100.0625 + d(i, 40) / 64)
    i, d, m = obj(r - 860)
    pole = (10 + m(2) / 4, 17.5 + (d(i, 2) % 2) / 4, 100.5 + d(i, 4) * 0.75)
    i, d, m = obj(r - 900)
    contact = (m(30) * 0.625, F.lit(15.71875), F.lit(105.3125))
    messenger = (m(30) * 0.625, F.lit(15.71875), 106.3125 + (m(30) - 15) * (m(30) - 15) / 1024)
    i, d, m = obj(r - 960)
    road = (1 + m(6) / 16, 8 + d(i, 6) / 16, F.lit(100.125))
    i, d, m = obj(r - 990)
    post = (5 + m(2) / 8, F.lit(17.0), 100.75 + d(i, 2) / 8)
    i, d, m = obj(r - 996)
    noise = (5.0 * i, 5.0 * i, 130 + 3.0 * i)

    grey, brown, green, dark, light = (
        (0.5, 0.46875, 0.5), (0.5, 0.375, 0.375), (0.25, 0.5, 0.1875), (0.25, 0.1875, 0.25), (0.75, 0.6875, 0.75),
    )
    objects = [
        (500, ground, 2, brown, 0.25), (620, tree, 5, green, 0.25), (740, roof, 6, grey, 0.375),
        (780, wall, 6, grey, 0.375), (860, rail, 18, grey, 0.75), (900, pole, 20, grey, 0.5),
        (930, contact, 19, dark, 0.5), (960, messenger, 19, dark, 0.5), (990, road, 30, grey, 0.25),
        (996, post, 1, light, 0.75), (1000, noise, 7, grey, 0.125),
    ]

    def pick(value) -> Column:
        expr = None
        for upper, *rest in objects:
            v = value(*rest)
            v = (v if isinstance(v, Column) else F.lit(v))
            expr = F.when(r < upper, v) if expr is None else expr.when(r < upper, v)
        return expr

    ox = (F.col("b") % BLOCKS_PER_ROW) * BLOCK_SIZE
    oy = _div(F.col("b"), BLOCKS_PER_ROW) * BLOCK_SIZE
    return df.select(
        F.lit("scene").alias("file_id"),
        F.col("b").alias("chunk_id"),
        "point_id",
        (ox + pick(lambda g, c, rgb, q: g[0].cast("double"))).cast("double").alias("x"),
        (oy + pick(lambda g, c, rgb, q: g[1].cast("double"))).cast("double").alias("y"),
        pick(lambda g, c, rgb, q: g[2].cast("double")).alias("z"),
        pick(lambda g, c, rgb, q: rgb[0]).alias("red"),
        pick(lambda g, c, rgb, q: rgb[1]).alias("green"),
        pick(lambda g, c, rgb, q: rgb[2]).alias("blue"),
        pick(lambda g, c, rgb, q: q).alias("intensity"),
        pick(lambda g, c, rgb, q: c).cast("int").alias("classification"),
    )


def winding_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rails of two parallel tracks that wind to and fro: every order yields a point on both rails of one track.

    ``line`` is the track, ``truth`` the side of the rail in the direction of growing keys.
    """
    k = F.col("o_orderkey").cast("long")
    u = F.floor(k / 2) * 0.5
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), u.alias("u"), (k % 2).alias("line"), (0.4 * F.cos(u / 150)).alias("slope"))
    df = df.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    off = F.col("side") * 0.7175 / F.sqrt(1 + F.col("slope") * F.col("slope"))
    return df.select(
        (F.col("k") * 2 + (F.col("side") + 1) / 2).cast("long").alias("point_id"), "line", (F.col("u") - off * F.col("slope")).alias("x"),
        (60 * F.sin(F.col("u") / 150) + 5.0 * F.col("line") + off).alias("y"), (100 + F.col("u") / 500).alias("z"), F.lit(18).alias("classification"),
        F.when(F.col("side") < 0, "left").otherwise("right").alias("truth"))


def predictions(points: DataFrame) -> DataFrame:
    """Evaluation rows of two models over a classified cloud (long form)."""
    pid, truth = F.col("point_id"), F.col("classification")
    confidence = (pid * 37) % 64 / F.lit(64.0)

    def model(name: str, modulus: int, conf: Column) -> DataFrame:
        return points.select(
            "point_id", F.lit(name).alias("model"), truth.alias("y_true"),
            F.when(pid % modulus == 0, F.lit(1)).otherwise(truth).cast("int").alias("y_pred"),
            conf.alias("confidence"),
        )

    return model("forest", 17, confidence).unionByName(model("boosted", 23, F.lit(1.0) - confidence))
