"""Tracks as lines of their own: which rails belong together, and where along the track a point lies.

One direction for the whole cloud suits a single straight line.  Here rails that
are closer than two tracks can be form a component; every stretch of it gets a
local direction and a node on its centre line; mutual neighbours ahead and
behind make chains of nodes, and the distance of a node from the end of its
chain follows by pointer doubling (a logarithmic number of joins over the nodes,
never a window or a walk along the line).  A point takes chainage, side and
50 m segment from its nearest node, so a curve, a parallel track or a second
line far away are measured each in their own frame.

A rail point without a node in reach (no second rail beside it) is on no track.
A chain that is broken by a gap, and each branch of a switch, is a track of its
own; a closed ring is opened at its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.eigen import direction2, moments, with_covariance
from ..session import cut
from .cluster import connected_components, dbscan
from .neighbours import XY, radius_pairs
from .railway import GAUGE

#: Rails nearer than this are of one track: more than the gauge, less than the gap between tracks.
JOIN = 1.9
CELL, MARGIN, STEP, LINK, REACH = 10.0, 2.0, 5.0, 12.0, 8.0


def _directions(rails: DataFrame) -> DataFrame:
    """(component, cx, cy, dx, dy): main direction of a component around each of its cells."""
    rel = rails.withColumns({"rx": F.col("x") - F.col("cx") * CELL, "ry": F.col("y") - F.col("cy") * CELL, "rz": F.lit(0.0)})
    m = rel.groupBy("component", "cx", "cy").agg(*moments("rx", "ry", "rz"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    m = m.withColumn("o", F.explode(around)).withColumns({"cx": F.col("cx") - F.col("o.a"), "cy": F.col("cy") - F.col("o.b"),
                                                         "ox": F.col("o.a") * CELL, "oy": F.col("o.b") * CELL})
    n, x, y, ox, oy = (F.col(c) for c in ("m_n", "m_x", "m_y", "ox", "oy"))
    m = m.select("component", "cx", "cy", "m_n", (x + n * ox).alias("m_x"), (y + n * oy).alias("m_y"), F.lit(0.0).alias("m_z"),
                 (F.col("m_xx") + 2 * ox * x + n * ox * ox).alias("m_xx"), (F.col("m_yy") + 2 * oy * y + n * oy * oy).alias("m_yy"),
                 (F.col("m_xy") + ox * y + oy * x + n * ox * oy).alias("m_xy"), *[F.lit(0.0).alias(c) for c in ("m_zz", "m_xz", "m_yz")])
    m = with_covariance(m.groupBy("component", "cx", "cy").agg(*[F.sum(c).alias(c) for c in m.columns[3:]]))
    dx, dy = direction2(F.col("cxx"), F.col("cyy"), F.col("cxy"))
    return m.select("component", "cx", "cy", dx.alias("dx"), dy.alias("dy"))


def centre_nodes(rails: DataFrame, gauge: float) -> DataFrame:
    """(node, component, x, y, dx, dy): points on the centre line where both rails are seen, about one per ``STEP``.

    A cell also sees the points just beyond its border, so a line that runs along
    the border keeps both rails; a node belongs to the cell that it lies in.
    """
    cell = lambda c, d=0.0: F.floor((F.col(c) + F.lit(d)) / CELL).cast("long")
    keyed = rails.withColumns({"cx": cell("x"), "cy": cell("y")})
    heads = _directions(keyed)
    wide = keyed.withColumns({"_ox": F.col("cx"), "_oy": F.col("cy"), "cx": F.explode(F.array_distinct(F.array(*[cell("x", d) for d in (-MARGIN, 0.0, MARGIN)])))})
    wide = wide.withColumn("cy", F.explode(F.array_distinct(F.array(*[cell("y", d) for d in (-MARGIN, 0.0, MARGIN)]))))
    wide = wide.join(heads, ["component", "cx", "cy"])
    rx, ry = F.col("x") - F.col("cx") * CELL, F.col("y") - F.col("cy") * CELL
    wide = wide.withColumns({"_a": rx * F.col("dx") + ry * F.col("dy"), "_c": ry * F.col("dx") - rx * F.col("dy")})
    # a point has one bin in each cell that sees it, so the smallest point and its place name the node
    name = F.min(F.col("point_id") * 16 + (F.col("_ox") - F.col("cx") + 1) * 3 + (F.col("_oy") - F.col("cy") + 1))
    n = wide.groupBy("component", "cx", "cy", "dx", "dy", F.floor(F.col("_a") / STEP).alias("bin")).agg(
        name.alias("node"), F.avg("_a").alias("_a"), F.min("_c").alias("lo"), F.max("_c").alias("hi"))
    n = n.where((F.col("hi") - F.col("lo")).between(0.8 * gauge, 1.6 * gauge)).withColumn("_c", (F.col("lo") + F.col("hi")) / 2)
    n = n.withColumns({"x": F.col("cx") * CELL + F.col("_a") * F.col("dx") - F.col("_c") * F.col("dy"), "y": F.col("cy") * CELL + F.col("_a") * F.col("dy") + F.col("_c") * F.col("dx")})
    return n.where((cell("x") == F.col("cx")) & (cell("y") == F.col("cy"))).select("node", "component", "x", "y", "dx", "dy")


def chain_edges(nodes: DataFrame) -> DataFrame:
    """(a, b, vx, vy): neighbours on a centre line, in both directions; b is a's nearest on one side and the other way round."""
    near = radius_pairs(nodes, nodes, LINK, XY, left_cols=("node", "dx", "dy"), right_cols=("node",), equal=("component",))
    vx, vy = F.col("n_x") - F.col("x"), F.col("n_y") - F.col("y")
    along, across = vx * F.col("dx") + vy * F.col("dy"), vy * F.col("dx") - vx * F.col("dy")
    near = near.where(F.col("node") != F.col("n_node")).withColumns({"_s": along, "_q": F.abs(across)})
    near = near.where((F.col("_s") != 0) & (F.col("_q") <= F.greatest(F.lit(1.0), F.abs("_s") / 2)))
    pick = near.groupBy("node", (F.col("_s") > 0).alias("ahead")).agg(F.min(F.struct("d2", "n_node", vx.alias("vx"), vy.alias("vy"))).alias("p"))
    pick = cut(pick.select(F.col("node").alias("a"), F.col("p.n_node").alias("b"), F.col("p.vx").alias("vx"), F.col("p.vy").alias("vy")).dropDuplicates(["a", "b"]))
    return pick.join(pick.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])


def _opened(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges without one of each closed ring, node and track = smallest node of its chain)."""
    chains = cut(connected_components(edges.select("a", "b"), nodes.select(F.col("node").alias("v"))).select(F.col("v").alias("node"), F.col("component").alias("track")))
    degree = edges.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("b").alias("_b"))
    ring = chains.join(degree, "node", "left").groupBy("track").agg(F.min(F.coalesce("_n", F.lit(0))).alias("least"))
    cuts = ring.where("least = 2").select("track").join(degree.select(F.col("node").alias("track"), F.col("_b").alias("other")), "track")
    gone = cuts.select(F.col("track").alias("a"), F.col("other").alias("b"))
    gone = gone.unionByName(gone.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return cut(edges.join(gone, ["a", "b"], "left_anti")), chains


def chainage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with track, chainage from the end with the smaller id, and the unit tangent (tx, ty) of growing chainage."""
    edges, chains = _opened(nodes, edges)
    out = edges.select(F.col("a").alias("b"), F.col("b").alias("w"))
    step = edges.join(out, "b").where("w <> a").select("a", "b", "w")
    arcs = edges.join(step, ["a", "b"], "left").select(
        "a", "b", "vx", "vy", F.when(F.col("w").isNotNull(), F.col("b")).alias("na"), F.col("w").alias("nb"),
        F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("dist"), F.col("b").alias("end"))
    arcs = cut(arcs)
    while not arcs.where("na is not null").isEmpty():  # every round doubles the stretch that an arc knows
        jump = arcs.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("_a"), F.col("nb").alias("_b"), F.col("dist").alias("_d"), F.col("end").alias("_e"))
        arcs = cut(arcs.join(jump, ["na", "nb"], "left").select(
            "a", "b", "vx", "vy", F.col("_a").alias("na"), F.col("_b").alias("nb"),
            (F.col("dist") + F.coalesce("_d", F.lit(0.0))).alias("dist"), F.coalesce("_e", "end").alias("end")))
    best = arcs.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("end", "dist", "vx", "vy")).alias("m"), F.count(F.lit(1)).alias("_n"))
    n = nodes.join(chains, "node").join(best, "node", "left")
    head = (F.coalesce("_n", F.lit(0)) < 2) & (F.col("m").isNull() | (F.col("node") < F.col("m.end")))
    toward = F.when(head, F.lit(1.0)).otherwise(F.lit(-1.0)) * (F.col("m.vx") * F.col("dx") + F.col("m.vy") * F.col("dy"))
    turn = F.when(toward < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return n.select("node", "component", "track", "x", "y", F.when(head, F.lit(0.0)).otherwise(F.col("m.dist")).alias("chainage"),
                    (F.col("dx") * turn).alias("tx"), (F.col("dy") * turn).alias("ty"))


def along_track(points: DataFrame, gauge: float = GAUGE, segment: float = 50.0) -> DataFrame:
    """Rail points with track, chainage, segment and side in the frame of their own track."""
    rails = points.where(F.col("classification") == 18).select("point_id", "x", "y", "z")
    rails = cut(dbscan(rails, JOIN, 3, XY).withColumnRenamed("cluster", "component"))
    nodes = cut(centre_nodes(rails, gauge))
    nodes = cut(chainage(nodes, cut(chain_edges(nodes))))
    near = radius_pairs(nodes, rails, REACH, XY, left_cols=("node", "track", "chainage", "tx", "ty"), right_cols=("point_id", "z"), equal=("component",))
    dx, dy = F.col("n_x") - F.col("x"), F.col("n_y") - F.col("y")
    near = near.groupBy(F.col("n_point_id").alias("point_id"), F.col("n_x").alias("px"), F.col("n_y").alias("py"), F.col("n_z").alias("pz")).agg(F.min(F.struct(
        "d2", "node", "track", (F.col("chainage") + dx * F.col("tx") + dy * F.col("ty")).alias("c"), (dy * F.col("tx") - dx * F.col("ty")).alias("across"))).alias("m"))
    placed = cut(near.select("point_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), "m.track", "m.c", "m.across"))
    start = placed.groupBy("track").agg(F.min("c").alias("_c0"), F.min("point_id").alias("_first"))
    return placed.join(start, "track").withColumn("chainage", F.col("c") - F.col("_c0")).select(
        "point_id", "x", "y", "z", F.col("_first").alias("track"), "chainage", F.floor(F.col("chainage") / F.lit(float(segment))).cast("int").alias("segment"),
        F.when(F.col("across") < 0, "left").otherwise("right").alias("side"))
