"""Graphs on long lines and in crowded cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointstrata.operators import cluster
from tests.test_limits import cloud


def test_components_of_a_line_with_rising_ids_need_few_rounds(spark, monkeypatch):
    n, calls, plain = 1500, [], cluster.cut
    monkeypatch.setattr(cluster, "cut", lambda df: calls.append(1) or plain(df))
    edges = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 999")
    got = cluster.connected_components(edges, spark.range(n + 1).select(F.col("id").alias("v"))).groupBy("component").count().collect()
    assert sorted(map(tuple, got)) == [(0, 1000), (1000, 500), (1500, 1)]
    assert len(calls) <= 2 * 13


def crowd(rng, n, gap):
    """Two crowds in neighbouring cells whose closest points are ``gap`` apart, all others farther."""
    a = rng.uniform(0, 0.3, (n, 2)) * [1, 1]
    b = rng.uniform(0, 0.3, (n, 2)) + [0.3 + gap + 0.05, 0]
    a[0], b[0] = [0.3, 0.15], [0.3 + gap, 0.15]
    a[1:, 0] = np.minimum(a[1:, 0], 0.28)
    return np.column_stack((np.concatenate((a, b)), np.zeros(2 * n)))


@pytest.mark.parametrize("gap,clusters", [(0.99, 1), (1.01, 2)])
def test_crowded_cells_are_decided_without_their_product(spark, monkeypatch, gap, clusters):
    seen, plain = [], cluster.cut
    monkeypatch.setattr(cluster, "cut", lambda df: seen.append(plain(df)) or seen[-1])
    p = cloud(spark, crowd(np.random.default_rng(1), 50_000, gap))
    got = cluster.dbscan(p, 1.0, 5).groupBy("cluster").count().collect()
    assert len(got) == clusters and sum(r["count"] for r in got) == 100_000
    assert max(df.count() for df in seen) <= 200_000  # a table of a round is never larger than the points


@pytest.mark.parametrize("leaf", [1, 4096])
def test_rounds_equal_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(cluster, "LEAF", leaf)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.25, (60, 3)) for c in rng.uniform(0, 6, (14, 3))]) * [1, 1, 0.3]
    got = dict(cluster.dbscan(cloud(spark, x), 0.8, 4).select("point_id", "cluster").collect())
    near = ((x[:, None, :2] - x[None, :, :2]) ** 2).sum(axis=2) <= 0.64
    core = np.flatnonzero(near.sum(axis=1) >= 4)
    label = {i: i for i in core.tolist()}
    while True:
        new = {i: min(label[j] for j in np.flatnonzero(near[i]).tolist() if j in label) for i in label}
        if new == label:
            break
        label = new
    for i in set(range(len(x))) - set(label):
        reach = [label[j] for j in np.flatnonzero(near[i]).tolist() if j in label]
        if reach:
            label[i] = min(reach)
    assert got == label
