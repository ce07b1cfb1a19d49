"""Label post-processing: majority, growing, morphology, refinement, isolated points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import cells
from .cells import Extent, extent
from .neighbours import XYZ, nearest, positions, radius_moments, radius_pairs


def majority(votes: DataFrame, key: str, value: str, weight: Column | None = None) -> DataFrame:
    """Most frequent value per key (ties: smallest) with its count and the total."""
    w = F.lit(1) if weight is None else weight
    c = votes.groupBy(key, value).agg(F.sum(w).alias("_c"))
    best = F.max(F.struct(F.col("_c"), (-F.col(value)).alias("_v")))
    return c.groupBy(key).agg(best.alias("_b"), F.sum("_c").alias("total")).select(
        key, (-F.col("_b._v")).alias("majority"), F.col("_b._c").alias("votes"), "total")


def smooth(points: DataFrame, k: int = 15, min_agreement: float = 0.6, confidence: str | None = None,
           threshold: float = 0.3, iterations: int = 1, label: str = "classification") -> DataFrame:
    """Adds ``new_class`` and ``new_confidence`` by k-neighbour majority.

    The first vote reads the labels that the neighbour search carries along; later
    iterations vote on the labels of the one before over neighbour lists computed
    once, and the loop ends when nothing changes.
    """
    if iterations == 1:
        near = nearest(points, points.withColumn("_c", F.col(label).cast("int")), k, exclude_self=True, carry=("_c",))
        if confidence:
            near = near.join(points.where(F.col(confidence) < threshold).select("point_id"), "point_id", "left_semi")
        votes = F.transform(F.array_distinct("n__c"), lambda c: F.struct(
            F.size(F.filter("n__c", lambda x: x == c)).alias("votes"), (-c).alias("v")))
        near = near.where(F.size("n__c") > 0).select("point_id", F.array_max(votes).alias("_top"), F.size("n__c").alias("_of"))
        near = near.select("point_id", (-F.col("_top.v")).alias("_m"), (F.col("_top.votes") / F.col("_of")).alias("_share"))
        j = points.join(near, "point_id", "left")
        flip = F.coalesce((F.col("_m") != F.col(label)) & (F.col("_share") >= min_agreement), F.lit(False))
        old = F.col(confidence) if confidence else F.lit(1.0)
        return j.withColumns({"new_class": F.when(flip, F.col("_m")).otherwise(F.col(label)).cast("int"),
                              "new_confidence": F.when(flip, F.col("_share")).otherwise(old)}).drop("_m", "_share")
    near = nearest(points, points, k, exclude_self=True).select("point_id", "nid")
    pairs = cut(near.select("point_id", F.explode("nid").alias("n_id")))
    state = points.select("point_id", F.col(label).cast("int").alias("c"), (F.col(confidence) if confidence else F.lit(1.0)).alias("f"))
    for _ in range(iterations):
        cand = state.where(F.col("f") < threshold).select("point_id") if confidence else None
        p = pairs if cand is None else pairs.join(cand, "point_id", "left_semi")
        votes = p.join(state.select(F.col("point_id").alias("n_id"), "c"), "n_id")
        m = majority(votes, "point_id", "c").withColumn("share", F.col("votes") / F.col("total"))
        j = state.join(m, "point_id", "left")
        flip = F.coalesce((F.col("majority") != F.col("c")) & (F.col("share") >= min_agreement), F.lit(False))
        j = cut(j.select("point_id", F.when(flip, F.col("majority")).otherwise(F.col("c")).cast("int").alias("c"),
                         F.when(flip, F.col("share")).otherwise(F.col("f")).alias("f"), flip.alias("changed")))
        state = j.select("point_id", "c", "f")
        if iterations > 1 and j.where("changed").isEmpty():
            break
    return points.join(state.select("point_id", F.col("c").alias("new_class"), F.col("f").alias("new_confidence")), "point_id")


def grow_regions(points: DataFrame, seed_class: int, target_class: int, distance: float = 1.0, max_rounds: int | None = None,
                 label: str = "classification") -> DataFrame:
    """Adds ``new_class``: target points reached from the seed class in steps of ``distance``.

    A frontier advances over the distinct positions of target points, so copies
    are visited once and every round only joins what was reached last.  It runs
    until nothing is reached; a limit of rounds raises when it is hit.
    """
    target = points.where(F.col(label) == target_class).select(*XYZ).distinct()
    rest = cut(target)
    front = cut(points.where(F.col(label) == seed_class).select(*XYZ).distinct())
    reached: DataFrame | None = None
    rounds = 0
    while True:
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"growth goes on after {max_rounds} rounds")
        rounds += 1
        # the wave is copied to its neighbouring cells, the many points it has not reached stay single
        hit = radius_pairs(front, rest, distance, left_cols=(), right_cols=XYZ).select(*[F.col(f"n_{c}").alias(c) for c in XYZ]).distinct()
        hit = cut(hit)
        if hit.isEmpty():
            break
        reached = hit if reached is None else reached.unionByName(hit)
        rest = cut(rest.join(hit, list(XYZ), "left_anti"))
        front = hit
    if reached is None:
        return points.withColumn("new_class", F.col(label))
    grown = points.join(reached.withColumn("_g", F.lit(True)), list(XYZ), "left")
    take = F.coalesce(F.col("_g"), F.lit(False)) & (F.col(label) == target_class)
    return grown.withColumn("new_class", F.when(take, F.lit(seed_class)).otherwise(F.col(label)).cast("int")).drop("_g")


_SIX = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _spread(vox: DataFrame) -> DataFrame:
    offs = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("a", "b", "c"), o)]) for o in _SIX])
    s = vox.select("vx", "vy", "vz", F.explode(offs).alias("o"))
    return s.select((F.col("vx") + F.col("o.a")).alias("vx"), (F.col("vy") + F.col("o.b")).alias("vy"), (F.col("vz") + F.col("o.c")).alias("vz"))


def _inside(df: DataFrame, box: tuple[int, int, int]) -> DataFrame:
    cond = F.lit(True)
    for c, n in zip(("vx", "vy", "vz"), box):
        cond = cond & F.col(c).between(0, n - 1)
    return df.where(cond)


def _dilate(vox: DataFrame, box) -> DataFrame:
    return _inside(_spread(vox), box).distinct()


def _erode(vox: DataFrame) -> DataFrame:
    # a voxel stays when all seven contributions arrive; outside the box nothing does
    return _spread(vox).groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n")).where("n = 7").select("vx", "vy", "vz")


def morphology(points: DataFrame, target_class: int, operation: str, iterations: int = 1, voxel: float = 0.5,
               label: str = "classification", ext: Extent | None = None) -> DataFrame:
    """Adds ``new_class`` after erode / dilate / opening / closing of one class's voxels.

    A point takes the smallest class whose voxel is set, else keeps its own.
    """
    ext = ext or extent(points)
    low = {"x": ext.x_min, "y": ext.y_min, "z": ext.z_min}
    box = tuple(int(d / voxel) + 1 for d in (ext.width, ext.height, ext.depth))
    keyed = points.withColumns({f"v{a}": cells.index(a, low[a], voxel) for a in "xyz"})
    keys = ["vx", "vy", "vz"]
    table = cut(keyed.select(*keys, F.col(label).alias("cls")).distinct())
    vox = table.where(F.col("cls") == target_class).select(*keys)
    steps = {"erode": "e", "dilate": "d", "opening": "ed", "closing": "de"}[operation]
    for step in steps:
        for _ in range(iterations):
            vox = cut(_erode(vox) if step == "e" else _dilate(vox, box))
    after = table.where(F.col("cls") != target_class).unionByName(vox.withColumn("cls", F.lit(target_class)))
    first = after.groupBy(*keys).agg(F.min("cls").alias("_c"))
    return keyed.join(first, keys, "left").withColumn("new_class", F.coalesce("_c", F.col(label)).cast("int")).drop(*keys, "_c")


def refine(points: DataFrame, probabilities: str = "probabilities", k: int = 10, weight: float = 0.3, iterations: int = 5) -> DataFrame:
    """Mean-field refinement: own log score mixed with the mean neighbour probability.

    Adds ``best`` (0-based index of the strongest class) and ``new_confidence``.
    Scores travel as one array per point over neighbour lists computed once.
    """
    near = nearest(points, points, k, exclude_self=True).select("point_id", "nid")
    pairs = cut(near.select("point_id", F.explode("nid").alias("n_id")))
    q = cut(points.select("point_id", F.transform(probabilities, lambda p: F.log(p + F.lit(1e-10))).alias("q")))
    width = q.select(F.size("q")).first()[0]

    def softmax(c: str) -> Column:
        e = F.transform(c, lambda v: F.exp(v))
        return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    for _ in range(iterations):
        probs = q.select(F.col("point_id").alias("n_id"), softmax("q").alias("p"))
        msg = pairs.join(probs, "n_id").groupBy("point_id").agg(F.array(*[F.avg(F.col("p")[i]) for i in range(width)]).alias("m"))
        mixed = F.zip_with("q", "m", lambda a, b: F.lit(1 - weight) * a + F.lit(weight) * F.log(b + F.lit(1e-10)))
        q = cut(q.join(msg, "point_id", "left").select("point_id", F.when(F.col("m").isNull(), F.col("q")).otherwise(mixed).alias("q")))
    out = q.withColumn("p", softmax("q")).select(
        "point_id", (F.array_position("q", F.array_max("q")) - 1).cast("int").alias("best"), F.array_max("p").alias("new_confidence"))
    return points.join(out, "point_id")


def drop_isolated(points: DataFrame, target_class: int, min_cluster: int = 10, distance: float = 2.0, label: str = "classification") -> DataFrame:
    """Adds ``new_class``: target points with fewer than ``min_cluster`` of their class nearby take the majority of the others."""
    keyed = points.withColumn("_l", F.col(label).cast("int"))
    pos = cut(positions(keyed, XYZ, ("_l",)))
    target = pos.where(F.col("_l") == target_class).select(*XYZ, "_l")
    alone = cut(radius_moments(target, pos.where(F.col("_l") == target_class), distance, equal=("_l",)).where(F.col("m_n") < min_cluster).select(*XYZ))
    labels = [r["_l"] for r in pos.where(F.col("_l") != target_class).select("_l").distinct().collect()]  # as many as there are classes
    asked = alone.withColumn("_l", F.explode(F.array(*[F.lit(v) for v in labels]).cast("array<int>")))
    votes = radius_moments(asked, pos, distance, equal=("_l",)).where(F.col("m_n") > 0)
    change = votes.groupBy(*XYZ).agg(F.max(F.struct("m_n", (-F.col("_l")).alias("v"))).alias("b")).select(*XYZ, (-F.col("b.v")).alias("_new"))
    out = points.join(change, list(XYZ), "left")
    hit = F.col("_new").isNotNull() & (F.col(label) == target_class)
    return out.withColumn("new_class", F.when(hit, F.col("_new")).otherwise(F.col(label)).cast("int")).drop("_new")


def delta(df: DataFrame, before: str = "classification", after: str = "new_class") -> DataFrame:
    """Changed rows: count, total and percent."""
    n, ch = F.count(F.lit(1)), F.count(F.when(F.col(before) != F.col(after), 1))
    return df.agg(n.alias("n_points"), ch.alias("changed"), (ch / n * 100).alias("changed_pct"))


class PostProcessing:
    """Named steps ``DataFrame -> DataFrame`` (each adds new_class); counts the changes of every step."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def add_step(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> PostProcessing:
        self.steps.append((name, fn))
        return self

    def add_smoothing(self, k: int = 15, min_agreement: float = 0.6) -> PostProcessing:
        return self.add_step("smoothing", lambda d: smooth(d, k, min_agreement))

    def add_outlier_removal(self, target_class: int, min_cluster: int = 10) -> PostProcessing:
        return self.add_step(f"outlier_removal_{target_class}", lambda d: drop_isolated(d, target_class, min_cluster))

    def process(self, points: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        changes, cols = {}, points.columns
        for name, fn in self.steps:
            out = cut(fn(points).select(*cols, "new_class"))
            changes[name] = delta(out).first().changed
            points = out.withColumn("classification", F.col("new_class")).select(*cols)
        return points, changes
