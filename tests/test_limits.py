"""No caps, no size switches, no crowded groups, nothing lost in streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointstrata.functions.hashing import hash_key
from pointstrata.operators import findings, ground, neighbours, noise, sampling, smoothing
from pointstrata.sources.points import POINTS
from pointstrata.streaming import chunks


def cloud(spark, xyz, **cols):
    rows = [(i, *map(float, p)) for i, p in enumerate(xyz)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    return df.withColumns({k: v if not isinstance(v, (int, str)) else F.lit(v) for k, v in cols.items()})


def brute(q, d, k):
    dist = np.sqrt(((q[:, None] - d[None]) ** 2).sum(axis=2))
    return np.sort(dist, axis=1)[:, :k]


@pytest.mark.parametrize("crowd", [False, True])
def test_every_search_group_stays_small(spark, monkeypatch, crowd):
    rng = np.random.default_rng(1)
    pts = rng.uniform(0, 60, (3000, 3)) * [1, 1, 0.05]
    if crowd:  # a third of the rows within a centimetre
        pts[:1000] = [30, 30, 1] + rng.uniform(0, 0.01, (1000, 3))
    pts[-1] = [40, 40, 2900]  # one point far from all others
    sizes = []
    plain = neighbours._knn_kernel

    def watched(*args):
        run = plain(*args)
        folder = watched.folder

        def measured(left, right):
            import uuid
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{left.num_rows} {right.num_rows}")
            return run(left, right)
        return measured

    import os
    import tempfile
    watched.folder = tempfile.mkdtemp(prefix="spark-")
    monkeypatch.setattr(neighbours, "_knn_kernel", watched)
    df = cloud(spark, pts)
    got = {r["point_id"]: r["nd"] for r in neighbours.nearest(df, df, 5, tile_rows=400).collect()}
    want = brute(pts, pts, 5)
    assert len(got) == len(pts)
    assert all(np.allclose(got[i], want[i]) for i in range(len(pts)))
    for name in os.listdir(watched.folder):
        sizes.append(max(map(int, open(f"{watched.folder}/{name}").read().split())))
    assert max(sizes) <= 400


def test_axis_of_many_vertices(spark):
    axis = spark.createDataFrame([(i, 10.0 * i, 0.0, 3.0) for i in range(200)], "seq int, x double, y double, allowed double")
    df = cloud(spark, [(10.0 * i + 0.25, 1.0, 2.0) for i in range(200)], classification=5)
    rows = findings.axis_violations(df, axis).collect()
    assert sorted(r["vertex"] for r in rows) == list(range(200))
    assert all(abs(r["distance"] - (np.hypot(0.25, 1) - 3)) < 1e-9 for r in rows)


def test_more_than_a_thousand_clashes(spark):
    pairs = findings.CLASH_PAIRS
    rows = []
    for k, (a, b, d) in enumerate(pairs):
        for i in range(200):
            x, y = 100.0 * i, 1000.0 * k
            rows += [(a, x, y, 0.0), (a, x + 0.01, y, 0.0), (a, x, y + 0.01, 0.0), (b, x + d / 2, y, 0.0)]
    df = spark.createDataFrame([(i, *r[1:], r[0]) for i, r in enumerate(rows)], "point_id long, x double, y double, z double, classification int")
    found = findings.clashes(df).groupBy("pair").count().collect()
    assert {r["pair"]: r["count"] for r in found} == {k: 200 for k in range(len(pairs))}
    assert findings.clashes(df, max_clashes=7).count() == 7


def test_noise_method_is_named(spark):
    df = cloud(spark, np.random.default_rng(2).uniform(0, 5, (200, 3)))
    assert noise.detect(df, "sor", 8).count() == noise.detect(df, "voxel_sor", 8, voxel=0.5).count() == 200
    with pytest.raises(ValueError):
        noise.detect(df, "by size")


def test_growth_runs_to_its_end_or_raises(spark):
    line = cloud(spark, [(0.9 * i, 0.0, 0.0) for i in range(80)]).withColumn("classification", F.when(F.col("point_id") == 0, 30).otherwise(2))
    assert smoothing.grow_regions(line, 30, 2, 1.0).where("new_class = 30").count() == 80
    with pytest.raises(RuntimeError):
        smoothing.grow_regions(line, 30, 2, 1.0, max_rounds=5)


@pytest.mark.parametrize("reach", [1, 2, 3, 4, 8, 16])
def test_window_extremes(spark, reach):
    rng = np.random.default_rng(reach)
    cells = {(int(a), int(b)): float(h) for a, b, h in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.uniform(0, 9, 150))}
    grid = spark.createDataFrame([(*k, v) for k, v in cells.items()], "ix long, iy long, h double")
    got = {(r["ix"], r["iy"]): r["h"] for r in ground._extreme(grid, reach, True).collect()}
    assert got == {(a, b): min(h for (c, d), h in cells.items() if abs(a - c) <= reach and abs(b - d) <= reach) for a, b in cells}


def test_ids_of_two_files_get_keys_of_their_own(spark):
    ids = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") - 512 + (F.lit(1).cast("long") * (1 << 40))).alias("b"))
    same = ids.select((hash_key(F.col("a")) == hash_key(F.col("b"))).alias("s")).where("s").count()
    assert same == 0
    assert sampling.hash_sample(ids.select(F.col("b").alias("point_id")), 10).count() == 10


def test_chunk_in_parts_and_chunk_numbers_shared_by_files(spark, tmp_path):
    def part(file_id, chunk, ids):
        rows = [(file_id, chunk, i, float(i % 7), float(i % 5), 1.0, 0.5, 0.5, 0.5, 0.5, 2) for i in ids]
        names = "file_id string, chunk_id {}, point_id long, x double, y double, z double, red double, green double, blue double, intensity double, classification int"
        return spark.createDataFrame(rows, names.format(dict(spark.createDataFrame([], POINTS).dtypes)["chunk_id"])).select(*POINTS.names)

    src = str(tmp_path / "in")
    for name, df in (("a1", part("a", 0, range(0, 500))), ("a2", part("a", 0, range(500, 1000))), ("b", part("b", 0, range(300))), ("a3", part("a", 1, range(1000, 1100)))):
        df.coalesce(1).write.mode("append").parquet(src)
    seen = lambda df: df.withColumn("new_class", F.lit(1))
    chunks.classify_stream(chunks.chunk_stream(spark, src), str(tmp_path / "out"), str(tmp_path / "cp"), seen).awaitTermination()
    out = chunks.classified(spark, str(tmp_path / "out"))
    assert {(r["file_id"], r["chunk_id"]): r["count"] for r in out.groupBy("file_id", "chunk_id").count().collect()} == {("a", 0): 1000, ("b", 0): 300, ("a", 1): 100}
