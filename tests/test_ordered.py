"""Order without one task: steps along a line, text in parts."""

import os

import numpy as np
from pyspark.sql import functions as F

from pointstrata.operators import railway
from pointstrata.sources import reports


def test_spacing_of_many_poles_in_one_kilometre(spark):
    rng = np.random.default_rng(1)
    xy = np.round(rng.uniform(0, 900, (3000, 2)), 3)
    xy[:1000, 0] = 450.0  # a third at one x
    df = spark.createDataFrame([(float(x), float(y), i) for i, (x, y) in enumerate(xy)], "x double, y double, pole_id long")
    order = np.lexsort((np.arange(3000), xy[:, 0]))
    want = np.hypot(*np.diff(xy[order], axis=0).T).mean()
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert abs(railway.pole_spacing(df.repartition(5)).first()[0] - want) < 1e-9
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert railway.pole_spacing(df.limit(1)).first()[0] == 0.0 and railway.pole_spacing(df.limit(0)).first()[0] == 0.0


def test_parts_of_a_text_are_the_text(spark, tmp_path):
    n = 5000
    lines = spark.range(n).select(((F.col("id") * 7919) % n).alias("pos")).withColumn("line", F.concat(F.lit("line "), F.col("pos").cast("string"), F.when(F.col("pos") % 9 == 0, "").otherwise(" x")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reports.write_text(lines.repartition(6), f"{tmp_path}/text")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(f for f in os.listdir(f"{tmp_path}/text") if f.startswith("part-"))
    want = [f"line {i}" + ("" if i % 9 == 0 else " x") for i in range(n)]
    assert len(parts) > 1 and "".join(open(f"{tmp_path}/text/{f}").read() for f in parts) == "\n".join(want) + "\n"
