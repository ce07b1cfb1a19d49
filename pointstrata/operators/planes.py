"""Plane search by hash-seeded three-point trials.

Trials come from a fixed hash order, so a retried task proposes the same
planes, and every trial is counted on all points of its group: points travel in
packed chunks of bounded size, each task keeps one counter array per group.

Planes of a whole cloud are searched tile by tile as patches.  Patches of
neighbouring tiles that lie in one plane are joined in a graph, and the limits
(least points, number of planes) hold for its components, not for a tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..session import cut
from .cells import Extent, beside, cells_along, extent, index
from .cluster import connected_components
from .landcover import surface_kind

#: Points in a packed chunk.
CHUNK = 50_000
#: A tile's number along x is shifted by so many bits, its number along y is the rest.
ALONG_X = 32


def packed(points: DataFrame, group: str, seed: int = 0, size: int = CHUNK) -> DataFrame:
    """(group, chunk, ids, xyz): points of a group in hash order, in chunks of about ``size``, as little-endian arrays."""
    sized = points.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("_chunks"))
    key = hash_key(F.col("point_id"), seed)
    rows = points.select(group, "point_id", "x", "y", "z", key.alias("_h")).join(sized, group)
    rows = rows.withColumn("chunk", F.pmod(hash_key(F.col("point_id"), seed + 7), F.col("_chunks")).cast("long"))

    def pack(table: pa.Table) -> pa.Table:
        h, ids = table.column("_h").to_numpy(), table.column("point_id").to_numpy()
        order = np.lexsort((ids, h))
        xyz = np.column_stack([table.column(c).to_numpy()[order] for c in "xyz"])
        return pa.table({group: table.column(group).slice(0, 1), "chunk": table.column("chunk").slice(0, 1),
                         "hashes": pa.array([h[order].tobytes()], pa.binary()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "xyz": pa.array([xyz.tobytes()], pa.binary())})

    return rows.groupBy(group, "chunk").applyInArrow(pack, f"{group} long, chunk long, hashes binary, ids binary, xyz binary")


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [batch.column(c)[k].as_py() for c in ("hashes", "ids", "xyz")]
    return np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], "<i8"), np.frombuffer(raw[2], "<f8").reshape(-1, 3)


def _proposals(chunks: DataFrame, group: str, trials: int) -> DataFrame:
    """(group, planes): normal and point of the planes through consecutive triples of the hash order."""

    def first(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                h, ids, xyz = (a[:3 * trials] for a in _arrays(batch, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), batch.column(group)[k].as_py())), pa.array(h), pa.array(ids), *map(pa.array, xyz.T.copy())],
                                                 names=[group, "h", "point_id", "x", "y", "z"])

    pool = chunks.select(group, "hashes", "ids", "xyz").mapInArrow(first, f"{group} long, h long, point_id long, x double, y double, z double")
    rank = F.row_number().over(Window.partitionBy(group).orderBy("h", "point_id"))
    pool = pool.withColumn("_r", rank).where(F.col("_r") <= 3 * trials)  # at most 3 * trials rows a group

    def build(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_r").to_numpy())[:table.num_rows // 3 * 3]
        t = np.column_stack([table.column(c).to_numpy()[order] for c in "xyz"]).reshape(-1, 3, 3)
        normal = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
        size = np.linalg.norm(normal, axis=1)
        good = size >= 1e-8
        planes = np.column_stack((normal[good] / size[good, None], t[good, 0]))
        return pa.table({group: table.column(group).slice(0, 1), "planes": pa.array([planes.tobytes()], pa.binary())})

    return pool.groupBy(group).applyInArrow(build, f"{group} long, planes binary")


def _inside(xyz: np.ndarray, planes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each point is closer to each plane than the threshold."""
    base = planes[0, 3:] if len(planes) else np.zeros(3)
    return np.abs((xyz - base) @ planes[:, :3].T - ((planes[:, 3:] - base) * planes[:, :3]).sum(axis=1)) < threshold


def _leaders(chunks: DataFrame, proposals: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, inliers, plane): the proposal with most points of its group (ties: the first), counted on all of them."""

    def count(batches):
        at, planes, total = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                key = batch.column(group)[k].as_py()
                if key != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=[group, "n"])
                    at, planes = key, np.frombuffer(batch.column("planes")[k].as_py(), "<f8").reshape(-1, 6)
                    total = np.zeros(len(planes), np.int64)
                xyz = _arrays(batch, k)[2]
                for lo in range(0, len(xyz), 4096):
                    total += _inside(xyz[lo:lo + 4096], planes, threshold).sum(axis=0)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=[group, "n"])

    counted = chunks.join(proposals, group).mapInArrow(count, f"{group} long, n array<long>")
    each = counted.select(group, F.posexplode("n").alias("trial", "n")).groupBy(group, "trial").agg(F.sum("n").alias("inliers"))
    best = each.groupBy(group).agg(F.max(F.struct("inliers", (-F.col("trial")).alias("t"))).alias("b"))
    plane = F.substring(F.col("planes"), (-F.col("b.t") * 48 + 1).cast("int"), F.lit(48))
    return best.join(proposals, group).select(group, F.col("b.inliers").alias("inliers"), plane.alias("plane"))


_AXES = ("x", "y", "z")
_SECOND = ("xx", "xy", "xz", "yy", "yz", "zz")
_MOMENTS = ("n", *(f"s{a}" for a in _AXES), *(f"s{a}" for a in _SECOND), *(f"{e}_{a}" for a in _AXES for e in ("lo", "hi")))


def _moments(xyz: np.ndarray) -> list[float]:
    """Count, sums, sums of products and box; nothing for the box without points."""
    prod = xyz.T @ xyz
    second = [prod[i, j] for i in range(3) for j in range(i, 3)]
    box = [v for a in range(3) for v in (xyz[:, a].min(), xyz[:, a].max())] if len(xyz) else [None] * 6
    return [float(len(xyz)), *xyz.sum(axis=0), *second, *box]


def _take(chunks: DataFrame, leaders: DataFrame, group: str, threshold: float) -> DataFrame:
    """The chunks without the inliers of their group's leader, whose moments (about a point of the plane) are added."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                h, ids, xyz = _arrays(batch, k)
                plane = np.frombuffer(batch.column("plane")[k].as_py(), "<f8").reshape(1, 6)
                hit = _inside(xyz, plane, threshold)[:, 0]
                left = [pa.array([x[~hit].tobytes()], pa.binary()) for x in (h, ids, xyz)]
                found = [pa.array([v], pa.float64()) for v in _moments(xyz[hit] - plane[0, 3:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in (group, "chunk")), *left, batch.column("plane").slice(k, 1), *found],
                                                 names=[group, "chunk", "hashes", "ids", "xyz", "plane", *_MOMENTS])

    schema = f"{group} long, chunk long, hashes binary, ids binary, xyz binary, plane binary, " + ", ".join(f"{m} double" for m in _MOMENTS)
    return chunks.select(group, "chunk", "hashes", "ids", "xyz").join(leaders.select(group, "plane"), group).mapInArrow(run, schema)


def best_planes(points: DataFrame, group: str, trials: int = 100, threshold: float = 0.1, seed: int = 0) -> DataFrame:
    """Plane with most inliers per group (ties: first trial), with its inlier count: nx, ny, nz, px, py, pz, inliers."""
    key = dict(points.dtypes)[group]
    keyed = points.select(F.col(group).cast("long").alias("_g"), "point_id", "x", "y", "z")
    chunks = cut(packed(keyed, "_g", seed))
    best = _leaders(chunks, cut(_proposals(chunks, "_g", trials)), "_g", threshold)

    def unpack(batches):
        for batch in batches:
            planes = np.frombuffer(b"".join(batch.column("plane").to_pylist()), "<f8").reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column("_g"), batch.column("inliers"), *map(pa.array, planes.T.copy())],
                                             names=["_g", "inliers", "nx", "ny", "nz", "px", "py", "pz"])

    out = best.mapInArrow(unpack, "_g long, inliers long, nx double, ny double, nz double, px double, py double, pz double")
    return out.withColumn(group, F.col("_g").cast(key)).drop("_g")


def tile_patches(chunks: DataFrame, group: str, rounds: int, least: int, threshold: float, trials: int) -> DataFrame:
    """Up to ``rounds`` planes of each group, each taken from what the former ones left.

    (patch, group, n, plane moments ...): normal from the moments of all inliers,
    centre, box.  A group leaves when its best plane has fewer than ``least`` points.
    """
    found: list[DataFrame] = []
    for k in range(rounds):
        leaders = cut(_leaders(chunks, cut(_proposals(chunks, group, trials)), group, threshold).where(F.col("inliers") >= least))
        if leaders.isEmpty():
            break
        chunks = cut(_take(chunks, leaders, group, threshold))
        found.append(chunks.groupBy(group, "plane").agg(
            *[F.sum(m).alias(m) for m in _MOMENTS[:10]], *[(F.min if m[:2] == "lo" else F.max)(m).alias(m) for m in _MOMENTS[10:]]).withColumn("round", F.lit(k)))
    if not found:
        return chunks.sparkSession.createDataFrame([], f"{group} long, " + PATCH)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)

    def fit(batches):
        for batch in batches:
            plane = np.frombuffer(b"".join(batch.column("plane").to_pylist()), "<f8").reshape(-1, 6)
            m = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _MOMENTS}
            mean = np.column_stack([m[f"s{a}"] for a in _AXES]) / m["n"][:, None]
            cov = np.empty((len(plane), 3, 3))
            for c, (i, j) in zip(_SECOND, [(i, j) for i in range(3) for j in range(i, 3)]):
                cov[:, i, j] = cov[:, j, i] = m[f"s{c}"] / m["n"] - mean[:, i] * mean[:, j]
            normal = np.linalg.eigh(cov)[1][:, :, 0]
            normal *= np.where((normal * plane[:, :3]).sum(axis=1) < 0, -1.0, 1.0)[:, None]
            centre = mean + plane[:, 3:]
            box = [m[f"{e}_{a}"] + plane[:, 3 + i] for i, a in enumerate(_AXES) for e in ("lo", "hi")]
            second = [cov[:, i, j].copy() for i in range(3) for j in range(i, 3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(group), batch.column("round"), pa.array(m["n"].astype(np.int64)), *map(pa.array, (*normal.T.copy(), *centre.T.copy(), *second, *box))],
                names=[group, *(c.split()[0] for c in PATCH.split(", "))])

    return rows.mapInArrow(fit, f"{group} long, " + PATCH)


PATCH = "round int, n long, nx double, ny double, nz double, cx double, cy double, cz double, " + ", ".join(
    f"{c} double" for c in (*(f"v{a}" for a in _SECOND), *_MOMENTS[10:]))


def _mean_square(normal: str, of: str) -> Column:
    """Mean square distance of the points of patch ``of`` from the plane of patch ``normal``."""
    n = [F.col(f"{normal}n{a}") for a in _AXES]
    off = sum(((F.col(f"{of}c{a}") - F.col(f"{normal}c{a}")) * m for a, m in zip(_AXES, n)), F.lit(0.0))
    out = off * off
    for c in _SECOND:
        i, j = (_AXES.index(a) for a in c)
        out = out + n[i] * n[j] * F.col(f"{of}v{c}") * F.lit(1.0 if i == j else 2.0)
    return out


def coplanar(patches: DataFrame, group: str, threshold: float, reach: float | None) -> DataFrame:
    """Pairs (a, b) of patches in neighbouring tiles whose points all lie in the plane of the larger one.

    ``reach`` is the largest gap between their boxes; None takes any in neighbouring tiles.
    """
    other = patches.select(*[F.col(c).alias(f"b_{c}") for c in patches.columns])
    half = F.array(*[F.lit((dx << ALONG_X) + dy) for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1))])
    moved = patches.withColumn("_d", F.explode(half)).withColumn("b_" + group, F.col(group) + F.col("_d")).drop("_d")
    pairs = moved.join(other, "b_" + group)
    larger = F.col("n") >= F.col("b_n")
    close = F.when(larger, _mean_square("", "b_")).otherwise(_mean_square("b_", "")) <= F.lit(threshold * threshold)
    if reach is not None:
        gap = sum((F.greatest(F.col(f"b_lo_{a}") - F.col(f"hi_{a}"), F.col(f"lo_{a}") - F.col(f"b_hi_{a}"), F.lit(0.0)) ** 2 for a in _AXES), F.lit(0.0))
        close = close & (gap <= F.lit(reach * reach))
    return pairs.where(close).select(F.col("patch").alias("a"), F.col("b_patch").alias("b"))


def merged_planes(patches: DataFrame, group: str, threshold: float, min_points: int, max_planes: int | None, reach: float | None) -> DataFrame:
    """Patches of the planes that are kept: adds plane_points and plane (0 for the largest; without ``max_planes`` the smallest patch)."""
    parts = connected_components(coplanar(patches, group, threshold, reach), patches.select(F.col("patch").alias("v")))
    named = patches.join(parts.withColumnRenamed("v", "patch"), "patch")
    total = named.groupBy("component").agg(F.sum("n").alias("plane_points")).where(F.col("plane_points") >= min_points)
    if max_planes is None:
        total = total.withColumn("plane", F.col("component"))
    else:
        size = Window.orderBy(F.desc("plane_points"), "component")  # at most max_planes rows
        total = total.orderBy(F.desc("plane_points"), "component").limit(max_planes).withColumn("plane", F.row_number().over(size).cast("long") - 1)
    return named.join(cut(total), "component").drop("component")


def extract_planes(points: DataFrame, ext: Extent | None = None, tile: float = 64.0, max_planes: int | None = 15, min_points: int = 10_000,
                   threshold: float = 0.1, trials: int = 500, seed: int = 0, min_patch: int = 100, reach: float | None = None, rounds: int = 15) -> DataFrame:
    """The ``max_planes`` largest planes of the cloud with at least ``min_points`` points.

    A plane is made of patches of ``tile`` metres (at least ``min_patch`` points,
    up to ``rounds`` in a tile) that are coplanar with one of a neighbouring tile.
    In the end every point takes the largest plane within the threshold that its
    own tile or a neighbouring one has a patch of, so no corner is too small.
    Returns (point_id, plane, normal_z, kind) for every inlier.
    """
    ext = ext or extent(points)
    nx, ny = cells_along(ext.width, tile), cells_along(ext.height, tile)
    key = F.shiftleft(index("x", ext.x_min, tile, nx).cast("long"), ALONG_X) + index("y", ext.y_min, tile, ny)
    chunks = cut(packed(points.withColumn("tile", key), "tile", seed))
    patches = tile_patches(chunks, "tile", rounds, min(min_patch, min_points), threshold, trials)
    patches = cut(patches.withColumn("patch", F.col("tile") * F.lit(rounds) + F.col("round")))
    kept = cut(merged_planes(patches, "tile", threshold, min_points, max_planes, reach))
    normal = kept.groupBy("plane").agg(F.max_by("nz", F.struct("n", "patch")).alias("normal_z"))
    around = F.array(*[F.lit((dx << ALONG_X) + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    fields = ("nx", "ny", "nz", "cx", "cy", "cz", *_MOMENTS[10:])
    order = F.struct((-F.col("plane_points")).alias("first"), "plane", *fields)
    near = kept.select(F.col("tile").alias("_t"), order.alias("p")).withColumn("_d", F.explode(around)).select((F.col("_t") + F.col("_d")).alias("tile"), "p")
    lists = near.groupBy("tile").agg(F.sort_array(F.collect_list("p")).alias("planes"))  # at most 9 * rounds

    def assign(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                _, ids, xyz = _arrays(batch, k)
                rows = batch.column("planes")[k].as_py()
                number, value = np.array([r["plane"] for r in rows], np.int64), np.array([[r[c] for c in fields] for r in rows])
                inside = _inside(xyz, value[:, :6], threshold)
                if reach is not None:  # a patch goes no farther than that beyond its box
                    gap = np.maximum(np.maximum(value[:, 6::2] - xyz[:, None], xyz[:, None] - value[:, 7::2]), 0.0)
                    inside &= (gap * gap).sum(axis=2) <= reach * reach
                hit = inside.any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(number[inside[hit].argmax(axis=1)])], names=["point_id", "plane"])

    found = chunks.select("tile", "hashes", "ids", "xyz").join(lists, "tile").mapInArrow(assign, "point_id long, plane long")
    return found.join(normal, "plane").select(
        "point_id", "plane", "normal_z", surface_kind(F.col("normal_z")).alias("kind"))


def building_statistics(points: DataFrame, planes: DataFrame) -> DataFrame:
    """Totals of building, roof and wall points."""
    n = points.agg(F.count(F.lit(1)).alias("n_points"))
    hits = planes.join(points.select("point_id", "hag"), "point_id")
    is_wall = F.col("kind") == "wall"
    s = hits.agg(F.count(F.lit(1)).alias("building"), F.count(F.when(~is_wall, 1)).alias("roof"),
                 F.count(F.when(is_wall, 1)).alias("wall"), F.avg(F.when(~is_wall, F.col("hag"))).alias("roof_hag_mean"))
    j = beside(n, s)
    return j.select("*", *[(F.col(c) / F.col("n_points") * 100).alias(f"{c}_pct") for c in ("building", "roof", "wall")])
