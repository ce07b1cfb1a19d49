"""Queries that read the whole of their tables."""

from pyspark.sql import functions as F

from pointstrata.operators import learning
from pointstrata.queries import QUERIES


def test_committee_learns_from_and_scores_all_rows(spark, tmp_path, monkeypatch):
    """classes of more than 300 points and of fewer than 100 take part whole."""
    spark.range(1000).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    seen = []
    fit, score = learning.committee, learning.predict
    monkeypatch.setattr(learning, "committee", lambda df, *a, **b: (seen.append(df.count()), fit(df, *a, **b))[1])
    monkeypatch.setattr(learning, "predict", lambda m, df, *a: (seen.append(df.count()), score(m, df, *a))[1])
    assert QUERIES["C06_committee"](spark, str(tmp_path)).collect() == [(50,)]
    assert seen == [4000] * 4
