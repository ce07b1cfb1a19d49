"""Connected components and density clustering.

DBSCAN works on cells of side eps / sqrt(d): all core points of one cell are
connected without looking at a single pair, so the graph has one vertex per
cell.  Two nearby cells are compared by tight boxes first, then by the boxes of
their halves, round by round, and points are compared only in parts that are
small.  A crowded cell therefore never meets another one pair by pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .neighbours import positions, radius_pairs

#: Pairs of positions in two parts of cells that are compared one by one.
LEAF = 4096


def connected_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(v, component) where component is the smallest vertex id of its component.

    Every round each vertex joins the neighbour that is first in an order drawn
    anew from hashes, and the graph is contracted.  The order does not follow
    the ids: on a line with rising ids "the smallest neighbour" would move every
    vertex by a few steps only, while in a drawn order descents are short and
    each round leaves less than half of the vertices that still have edges.
    """
    labels = vertices.select("v", F.col("v").alias("component"))
    steps: list[DataFrame] = []
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not e.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("id"))  # noqa: E731,B023
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(
            e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        f = both.groupBy("v").agg(F.min(order("u")).alias("_u")).select("v", F.least(order("v"), F.col("_u"))["id"].alias("f"))
        for _ in range(2):
            g = f.select(F.col("v").alias("f"), F.col("f").alias("g"))
            f = f.join(g, "f").select("v", F.col("g").alias("f"))
        f = cut(f)
        steps.append(f)
        e = e.join(f.select(F.col("v").alias("a"), F.col("f").alias("fa")), "a").join(
            f.select(F.col("v").alias("b"), F.col("f").alias("fb")), "b")
        e = cut(e.where("fa <> fb").select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct())
    for f in steps:  # a logarithmic number of rounds
        labels = labels.join(f.withColumnRenamed("v", "component"), "component", "left").select(
            "v", F.coalesce("f", "component").alias("component"))
    if not steps:
        return labels
    labels = cut(labels)
    smallest = labels.groupBy("component").agg(F.min("v").alias("_m"))
    return labels.join(smallest, "component").select("v", F.col("_m").alias("component"))


def _box(dims: Sequence[str]) -> list:
    return [a for d in dims for a in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"))]


def _gap2(dims, a="", b="b_"):
    expr = F.lit(0.0)
    for d in dims:
        g = F.greatest(F.col(f"{b}lo_{d}") - F.col(f"{a}hi_{d}"), F.col(f"{a}lo_{d}") - F.col(f"{b}hi_{d}"), F.lit(0.0))
        expr = expr + g * g
    return expr


def _far2(dims, a="", b="b_"):
    expr = F.lit(0.0)
    for d in dims:
        g = F.greatest(F.col(f"{b}hi_{d}") - F.col(f"{a}lo_{d}"), F.col(f"{a}hi_{d}") - F.col(f"{b}lo_{d}"))
        expr = expr + g * g
    return expr


def _close_cells(core: DataFrame, cells: DataFrame, open_: DataFrame, dims, keys, within, side, e2) -> DataFrame:
    """Of the undecided cell pairs those with two core points within eps.

    Both cells of a pair are halved along every axis, round by round.  Boxes of
    the halves decide most pairs of parts: too far, or so near that the cells are
    connected, which settles all other parts of the two cells.  Points are only
    compared where two parts have ``LEAF`` pairs of positions at most, so a
    crowded cell costs its border, not its square.
    """
    nd = len(dims)
    need = open_.select("vid").unionByName(open_.select(F.col("b_vid").alias("vid"))).distinct()
    at = cut(core.join(cells.select(*within, *keys, "vid"), within + keys).join(need, "vid", "left_semi").select(
        "vid", *dims, *[((F.col(d) - F.col(k) * side) / side).alias(f"_u{i}") for i, (k, d) in enumerate(zip(keys, dims))]).distinct())
    extra = [c for c in open_.columns if c not in ("vid", "b_vid")]
    pairs = open_.select("vid", "b_vid", *extra, F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("b_part"))
    found: list[DataFrame] = []
    level = 0
    while True:
        level += 1
        parts = at.withColumn("up", _part(level - 1, nd)).withColumn("part", _part(level, nd))
        boxes = cut(parts.groupBy("vid", "up", "part").agg(F.count(F.lit(1)).alias("n"), *_box(dims)))
        b_boxes = boxes.select(*[F.col(c).alias(f"b_{c}") for c in boxes.columns])
        below = pairs.select("vid", F.col("part").alias("up"), "b_vid", F.col("b_part").alias("b_up"), *extra)
        below = below.join(boxes, ["vid", "up"]).join(b_boxes, ["b_vid", "b_up"]).where(_gap2(dims) <= e2)
        below = cut(below.select("vid", "b_vid", "part", "b_part", *extra, (_far2(dims) <= e2).alias("_sure"), ((F.col("n") * F.col("b_n") <= LEAF) | F.lit(level >= 20)).alias("_leaf")))
        sure = cut(below.where("_sure").select("vid", "b_vid").distinct())
        rest = below.where("not _sure").join(sure, ["vid", "b_vid"], "left_anti")
        found.append(sure)
        pa_ = parts.select("vid", "part", *dims)
        pb_ = pa_.select(*[F.col(c).alias(f"b_{c}") for c in pa_.columns])
        d2 = None
        for d in dims:
            t = F.col(d) - F.col(f"b_{d}")
            d2 = t * t if d2 is None else d2 + t * t
        exact = cut(rest.where("_leaf").join(pa_, ["vid", "part"]).join(pb_, ["b_vid", "b_part"]).where(d2 <= e2).select("vid", "b_vid").distinct())
        found.append(exact)
        pairs = cut(rest.where("not _leaf").join(exact, ["vid", "b_vid"], "left_anti").select("vid", "b_vid", *extra, "part", "b_part"))
        if pairs.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _part(level: int, nd: int) -> Column:
    """Number of the part of its cell that a point lies in after ``level`` halvings along every axis."""
    wide = 1 << level
    expr = F.lit(0).cast("long")
    for i in range(nd):
        step = F.floor(F.col(f"_u{i}") * F.lit(float(wide))).cast("long")
        expr = expr * F.lit(wide) + F.least(F.greatest(step, F.lit(0)), F.lit(wide - 1))
    return expr


def dbscan(points: DataFrame, eps: float | str, min_samples: int, dims: Sequence[str] = ("x", "y"),
           id_col: str = "point_id", within: Sequence[str] = ()) -> DataFrame:
    """Clustered points: all input columns plus ``cluster`` (smallest core id); noise is dropped.

    ``min_samples`` counts the point itself.  A border point takes the smallest
    cluster in reach.  ``within`` clusters every combination of those columns
    separately in the same jobs; ``eps`` may name a column that is constant
    inside such a group.
    """
    nd, within = len(dims), list(within)
    if isinstance(eps, str):
        within = [*within, eps]
        reach = F.col(eps)
    else:
        reach = F.lit(float(eps))
    side = reach / F.lit(math.sqrt(nd))
    e2 = reach * reach
    keys = [f"_k{i}" for i in range(nd)]
    base = points.select(id_col, *dims, *within)
    celled = cut(base.withColumns({k: F.floor(F.col(d) / side).cast("long") for k, d in zip(keys, dims)}))
    full = celled.groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("_n"))
    sized = celled.join(full, within + keys)
    thin = sized.where(F.col("_n") < min_samples).drop("_n")
    # neighbours of points in thin cells, on weighted positions
    near = radius_pairs(thin.select(*dims, *within).distinct(), positions(base, dims, within), eps, dims,
                        left_cols=dims, right_cols=("w",), equal=within)
    dense = near.groupBy(*dims, *within).agg(F.sum("n_w").alias("_m")).where(F.col("_m") >= min_samples).drop("_m")
    core = sized.where(F.col("_n") >= min_samples).drop("_n").unionByName(
        thin.join(dense, list(dims) + within, "left_semi").select(*thin.columns))
    core = cut(core)

    # a vertex is the smallest core id of a cell, qualified by its group
    cells = core.groupBy(*within, *keys).agg(F.min(id_col).alias("vid"), *_box(dims))
    if within:
        cells = cells.withColumn("vid", F.struct(*within, F.col("vid").alias("id")))
    cells = cut(cells)
    half = [o for o in itertools.product(range(-2, 3), repeat=nd) if o > (0,) * nd]
    half = [o for o in half if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= nd]
    offs = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in half])
    other = cells.select(*within, *keys, *[F.col(c).alias(f"b_{c}") for c in cells.columns if c not in within + keys])
    moved = cells.withColumn("_o", F.explode(offs)).select(
        *within, *[(F.col(k) + F.col(f"_o.o{i}")).alias(k) for i, k in enumerate(keys)],
        *[c for c in cells.columns if c not in within + keys])
    pairs = moved.join(other, within + keys).where(_gap2(dims) <= e2).withColumn("_sure", _far2(dims) <= e2)
    pairs = cut(pairs.select("vid", "b_vid", "_sure", *([eps] if isinstance(eps, str) else [])))
    sure = pairs.where("_sure").select("vid", "b_vid")
    graph = sure
    if not pairs.where("not _sure").isEmpty():
        graph = sure.unionByName(_close_cells(core, cells, pairs.where("not _sure").drop("_sure"), dims, keys, within, side, e2))
    graph = graph.select(F.col("vid").alias("a"), F.col("b_vid").alias("b"))
    comp = connected_components(graph, cells.select(F.col("vid").alias("v")))
    named = cells.join(comp.withColumnRenamed("v", "vid"), "vid").select(*within, *keys, (F.col("component.id") if within else F.col("component")).alias("cluster"))
    core_l = core.join(named, within + keys).select(id_col, *dims, *within, "cluster")

    border = thin.join(core.select(id_col), id_col, "left_anti")
    targets = core_l.groupBy(*dims, *within).agg(F.min("cluster").alias("cluster"))
    reach = radius_pairs(border, targets, eps, dims, left_cols=(id_col,), right_cols=("cluster",), equal=within)
    border_l = reach.groupBy(id_col, *within).agg(F.min("n_cluster").alias("cluster"))
    member = core_l.select(id_col, *within, "cluster").unionByName(border_l.select(id_col, *within, "cluster"))
    return points.join(member, [id_col, *within])
