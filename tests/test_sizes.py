"""Results and plans that must not change with the size of the tables."""

import numpy as np
from pyspark.sql import functions as F

from pointstrata.operators import findings, learning
from pointstrata.queries import QUERIES
from pointstrata.session import MEASURED, SMALL, STATIC, measured_joins


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_follow_measured_sizes(spark, tmp_path):
    """A file of a few kilobytes that holds megabytes of rows is not sent through the driver; a small table is."""
    own = spark.newSession()
    own.conf.set(STATIC, "10m")
    own.conf.unset(MEASURED)
    own.range(400_000).select(F.lit(0).alias("k"), *[F.lit(1.5).alias(c) for c in "abc"]).coalesce(1).write.parquet(f"{tmp_path}/packed")
    packed = own.read.parquet(f"{tmp_path}/packed")
    few = own.range(3).select(F.col("id").cast("int").alias("k"))
    measured_joins(own)
    assert own.conf.get(MEASURED) == str(SMALL)
    big = packed.groupBy("k", "a", (F.monotonically_increasing_id() % 200_000).alias("i")).agg(F.sum("b").alias("b"))
    got = big.join(big.withColumnRenamed("b", "c"), ["k", "a", "i"])
    assert got.count() == 200_000
    small = packed.join(few, "k")
    small.collect()
    assert "BroadcastHashJoin" not in _plan(got) and "BroadcastHashJoin" in _plan(small)
    own.conf.unset(STATIC)
    own.conf.unset(MEASURED)


def test_registered_queries_join_by_measured_sizes(spark, tmp_path):
    own = spark.newSession()
    own.conf.set(STATIC, "256k")
    own.range(2000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    QUERIES["A01_class_histogram"](own, str(tmp_path))
    assert own.conf.get(STATIC) == "-1" and own.conf.get(MEASURED) == str(256 << 10)


def test_clearance_summary_without_violations(spark):
    none = spark.createDataFrame([], "severity string, classification int")
    assert findings.clearance_summary(none).collect() == [(None, None, 0)]
    some = spark.createDataFrame([("minor", 5), ("minor", 6), ("critical", 5)], none.schema)
    assert sorted(findings.clearance_summary(some).collect(), key=str) == sorted(
        [("minor", None, 2), ("critical", None, 1), (None, 5, 2), (None, 6, 1), (None, None, 3)], key=str)


def test_committee_on_a_hash_sample(spark):
    """A sample drawn by small hash values still gives every member a bootstrap of about its size."""
    points = spark.range(40_000).select(F.col("id").alias("point_id"), (F.col("id") % 2 * 3 + 2).cast("int").alias("classification"), (F.col("id") % 2 + 0.0).alias("f"))
    sample = learning.balanced_sample(points, 150, 100)
    models = learning.committee(sample, ["f"], 3, base_trees=2, tree_step=0, base_depth=2, depth_step=0)
    assert learning.vote_entropy(learning.predict(models[0], sample, "a"), 10).count() == 10 and len(models) == 3


def test_thin_places_share_a_kernel(spark):
    """A search radius with a handful of rows around costs a row's work, not a kernel or a loop for each."""
    from pointstrata.operators import neighbours as nb

    rows = spark.range(20_000).select(F.col("id").alias("point_id"), *[(F.pmod(F.xxhash64("id", F.lit(a)), F.lit(limit * 64)) / 64.0).alias(a)
                                      for a, limit in (("x", 400), ("y", 400), ("z", 2))]).withColumn("_r", F.lit(1.0))
    q = rows.select(*[F.col(a).alias(f"_q{i}") for i, a in enumerate("xyz")], "_r")
    d = rows.select(*[F.col(a).alias(f"_d{i}") for i, a in enumerate("xyz")], "_r")
    left, right, keys, split = nb._within_tiles(q, d, 3, [], ["_q0"], ["_d0"], nb.TILE_ROWS)
    assert not split and left.count() == 20_000 and left.select(*keys).distinct().count() < 50 and right.count() < 30_000
    got = {r.point_id: r.n for r in nb.radius_count(rows, rows, 1.0, name="n").collect()}
    xyz = np.array(rows.orderBy("point_id").select(*"xyz").collect())
    for i in range(0, 20_000, 500):
        assert got[i] == (((xyz - xyz[i]) ** 2).sum(axis=1) <= 1).sum()


def test_parts_follow_the_density():
    from pointstrata.operators import neighbours as nb

    rng = np.random.default_rng(3)
    for n, wide in ((400, 30.0), (3000, 2.0)):
        x = rng.random((n, 3)) * wide
        side = nb._part_side(x, 0.25, 1.0)
        assert (side >= 2.0) == (wide > 10)
        far = rng.random((200, 3)) * wide
        best, pick = nb._closest(far, x, 1.0)
        d2 = ((far[:, None] - x) ** 2).sum(axis=2)
        assert ((pick >= 0) == (d2.min(axis=1) < 1)).all() and (pick[pick >= 0] == d2.argmin(axis=1)[pick >= 0]).all()
