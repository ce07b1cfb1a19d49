"""Samples and selections of a size that no task may hold: rows with null ids, copies, and a class with most of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pointstrata.functions.hashing import hash_key
from pointstrata.operators import learning, sampling


def _plan(df):
    return df._jdf.queryExecution().toString()


def _ids(spark):
    """Ids with a null, and one with 2000 copies."""
    ids = spark.range(9000).select(F.col("id").alias("point_id"))
    return ids.unionByName(spark.range(2000).select(F.lit(4321).cast("long").alias("point_id"))).unionByName(
        spark.range(1500).select(F.lit(None).cast("long").alias("point_id")))


@pytest.mark.parametrize("n", [1500, 9999, 20_000])
def test_large_sample_is_a_filter(spark, n):
    df = _ids(spark)
    got = sampling.hash_sample(df, n, 3)
    assert "TakeOrdered" not in _plan(got) and "Sort [" not in _plan(got)
    want = df.orderBy(hash_key(F.col("point_id"), 3), "point_id").limit(n)
    key = lambda d: sorted((-1 if r[0] is None else r[0]) for r in d.collect())
    assert key(got) == key(want)


def test_sample_ends_inside_copies(spark):
    df = _ids(spark)
    h = df.select(hash_key(F.col("point_id"), 3).alias("h"))
    at = h.where(F.col("h") < df.where("point_id = 4321").select(hash_key(F.col("point_id"), 3)).first()[0]).count() + 1500
    n = at + 700
    got = sampling.hash_sample(df, n, 3)
    assert got.count() == n and got.where("point_id = 4321").count() == 700 and got.where("point_id is null").count() == 1500


@pytest.mark.parametrize("n", [10, 2500])
def test_group_sample_sorts_little_more_than_it_keeps(spark, n):
    df = _ids(spark).withColumn("c", F.when(F.col("point_id") % 7 > 0, 2).when(F.col("point_id").isNotNull(), 5))
    got = sampling.hash_sample_per_group(df, "c", n, 3)
    w = Window.partitionBy("c").orderBy(hash_key(F.col("point_id"), 3), "point_id")
    want = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    key = lambda d: sorted(tuple(-1 if v is None else v for v in r) for r in d.collect())
    assert key(got) == key(want)


def test_group_sample_moves_its_rows_only(spark):
    """A class with all rows: what reaches the window is the sample and one bucket, not the class."""
    df = spark.range(200_000).select(F.col("id").alias("point_id"), F.lit(2).alias("c"))
    assert _window_rows(sampling.hash_sample_per_group(df, "c", 2000)) < 2200


def _window_rows(df):
    """Rows that the last window over the sample reads."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("Window"):
        plan = plan.children().apply(0)
    jvm = df.sparkSession._jvm
    return jvm.org.apache.spark.sql.classic.Dataset.ofRows(df.sparkSession._jsparkSession, plan.children().apply(0)).count()


def test_training_reads_the_cloud_for_its_sample_only(spark, tmp_path):
    """The fit and its scores read the stored sample."""
    spark.range(3000).select(F.col("id").alias("point_id"), (F.col("id") % 2).cast("int").alias("classification"),
                             (F.col("id") % 2 + F.col("id") / 1e5).alias("f")).write.parquet(f"{tmp_path}/cloud")
    model, scored = learning.train(spark.read.parquet(f"{tmp_path}/cloud"), ["f"], trees=2, depth=2)
    assert not any(f"{tmp_path}/cloud" in f for f in scored.inputFiles())
    assert scored.count() == 450 and scored.where("y_true <> y_pred").count() == 0
