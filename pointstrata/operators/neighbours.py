"""Neighbour search as Spark joins.

``radius_pairs``  - equi-join on cells of side r, the probe side exploded to the
                    adjacent cells, exact distance filter.
``nearest``       - k nearest rows: points are shuffled to square tiles, every
                    tile also receives the rows of a margin around it, and a
                    short NumPy kernel ranks the candidates of each tile.  A
                    result is final when its k-th distance fits the margin;
                    the others go to the next round with a wider margin.

Hot places.  ``nearest`` counts rows per tile in every round.  When a tile is too
full at the start, at most k copies of one position stay as candidates, each
distinct position is asked once and the search starts with finer tiles; in any
round a tile that is too full is split into chunks whose partial results merge.
No tile is collected whole, and no row is dropped unless k nearer ones are
certain.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import hash_key
from ..session import cut

TILE_ROWS = 40_000
XYZ = ("x", "y", "z")
XY = ("x", "y")


# ---------------------------------------------------------------------------
# radius join
# ---------------------------------------------------------------------------

def distance2(a: Sequence[str], b: Sequence[str]) -> Column:
    expr = None
    for p, q in zip(a, b):
        d = F.col(p) - F.col(q)
        expr = d * d if expr is None else expr + d * d
    return expr


def _cell_cols(dims: Sequence[str], size: Column) -> list[Column]:
    return [F.floor(F.col(d) / size).cast("long") for d in dims]


def _offsets(ndim: int, reach: int = 1) -> Column:
    rng = range(-reach, reach + 1)
    return F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)])
                     for o in itertools.product(rng, repeat=ndim)])


def radius_pairs(left: DataFrame, right: DataFrame, r: float | str, dims: Sequence[str] = XYZ,
                 left_cols: Sequence[str] = ("point_id",), right_cols: Sequence[str] = ("point_id",),
                 strict: bool = False, salts: int = 1, equal: Sequence[str] = ()) -> DataFrame:
    """All (left, right) rows within distance r.

    Left columns keep their names; right columns get the prefix ``n_``; ``d2``
    is the squared distance.  The left side is replicated to 3^d cells, so it
    should be the smaller one.  ``equal`` names columns that must match too
    (class pair, tile); ``r`` may name one of them when every group has its own
    radius.  A hot cell of the right side is spread over ``salts``
    sub-keys; beyond that, adaptive execution splits the skewed partition.
    """
    nd = len(dims)
    keys = [f"_c{i}" for i in range(nd)]
    size = F.col(r) if isinstance(r, str) else F.lit(float(r))
    lsel = list(dict.fromkeys([*left_cols, *dims, *equal]))
    rsel = list(dict.fromkeys([*right_cols, *dims]))
    lft = left.select(*lsel, *[c.alias(f"_b{i}") for i, c in enumerate(_cell_cols(dims, size))],
                      F.explode(_offsets(nd)).alias("_o"))
    lft = lft.select(*lsel, *[(F.col(f"_b{i}") + F.col(f"_o.o{i}")).alias(k) for i, k in enumerate(keys)])
    rgt = right.select(*[F.col(c).alias(f"n_{c}") for c in rsel], *[F.col(c).alias(f"_e_{c}") for c in equal],
                       *[c.alias(k) for k, c in zip(keys, _cell_cols(dims, size))])
    on = list(keys)
    if salts > 1:
        lft = lft.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rgt = rgt.withColumn("_s", F.pmod(F.xxhash64(*[f"n_{c}" for c in rsel]), F.lit(salts)).cast("int"))
        on.append("_s")
    cond = None
    for k in on:
        e = lft[k] == rgt[k]
        cond = e if cond is None else cond & e
    for c in equal:
        cond = cond & (lft[c] == rgt[f"_e_{c}"])
    d2 = distance2(dims, [f"n_{d}" for d in dims])
    limit = lft[r] * lft[r] if isinstance(r, str) else F.lit(float(r) * float(r))
    out = lft.join(rgt, cond & ((d2 < limit) if strict else (d2 <= limit))).withColumn("d2", d2)
    return out.select(*lsel, *[f"n_{c}" for c in rsel], "d2")


def positions(df: DataFrame, dims: Sequence[str] = XYZ, extra: Sequence[str] = ()) -> DataFrame:
    """Distinct positions with their multiplicity ``w`` (copies merge map-side)."""
    return df.groupBy(*dims, *extra).agg(F.count(F.lit(1)).alias("w"))


def radius_count(queries: DataFrame, data: DataFrame, r: float, dims: Sequence[str] = XYZ,
                 name: str = "n_near") -> DataFrame:
    """Number of data rows within r of every query row (itself included if it is in data).

    Works on distinct positions with weights, so copies never multiply.
    """
    cnt = radius_moments(queries.select(*dims).distinct(), positions(data, dims), r, dims).select(*dims, F.col("m_n").cast("long").alias(name))
    return queries.join(cnt, list(dims), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))


# ---------------------------------------------------------------------------
# k nearest
# ---------------------------------------------------------------------------

def _knn_kernel(k: int, nd: int, carry: Sequence[str], out_schema: pa.Schema):
    """Ranks the candidates of one tile: blocked distance matrix, partial sort, tie-break by id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        nq, m = left.num_rows, right.num_rows
        if nq == 0:
            return out_schema.empty_table()
        q = np.column_stack([left.column(f"q{i}").to_numpy() for i in range(nd)])
        d = np.column_stack([right.column(f"d{i}").to_numpy() for i in range(nd)])
        ids = right.column("nid").to_numpy()
        order = np.argsort(ids, kind="stable")
        d, ids = d[order], ids[order]
        kk = min(k, m)
        dist = np.empty((nq, kk))
        pick = np.empty((nq, kk), dtype=np.int64)
        step = max(1, 4_000_000 // max(m, 1))
        for s in range(0, nq if m else 0, step):
            block = q[s:s + step]
            d2 = np.zeros((len(block), m))
            for i in range(nd):
                diff = block[:, i:i + 1] - d[:, i]
                d2 += diff * diff
            kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1:kk]
            # everything up to the k-th distance; ties are settled by id order
            rows, cols = np.nonzero(d2 <= kth)
            vals = d2[rows, cols]
            o = np.lexsort((cols, vals, rows))
            first = np.searchsorted(rows, np.arange(len(block)))
            take = o[first[:, None] + np.arange(kk)]
            pick[s:s + step] = cols[take]
            dist[s:s + step] = vals[take]
        offsets = pa.array(np.arange(nq + 1) * kk, pa.int32())
        flat = pick.ravel()
        cols = [left.column("qid").combine_chunks()] + [left.column(f"q{i}").combine_chunks() for i in range(nd)]
        cols.append(pa.ListArray.from_arrays(offsets, pa.array(np.sqrt(dist).ravel())))
        cols.append(pa.ListArray.from_arrays(offsets, pa.array(ids[flat])))
        for c in carry:
            vals = right.column(f"c_{c}").to_numpy(zero_copy_only=False)[order][flat]
            cols.append(pa.ListArray.from_arrays(offsets, pa.array(vals)))
        return pa.Table.from_arrays(
            [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=out_schema
        )

    return run


_PA = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _start_margin(data: DataFrame, dims: Sequence[str], k: int) -> tuple[float, float]:
    """Margin that holds about k rows at the mean density of occupied columns, and the largest extent."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for d in dims:
        aggs += [F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}")]
    s = data.agg(*aggs).first()
    if not s.n:
        return 1.0, 0.0
    spans = [s[f"hi_{d}"] - s[f"lo_{d}"] for d in dims]
    reach = max(max(spans), 1e-9)
    a, b = (max(v, reach * 1e-6) for v in spans[:2])
    unit = 4.0 * math.sqrt(a * b / s.n)
    used = data.select(*[F.floor(F.col(d) / F.lit(unit)) for d in dims[:2]]).distinct().count()
    return max(0.8 * unit * math.sqrt((k + 1) / max(s.n / used, 1e-9)), reach * 1e-6), reach


def nearest(queries: DataFrame, data: DataFrame, k: int, dims: Sequence[str] = XYZ,
            query_id: str = "point_id", data_id: str = "point_id", carry: Sequence[str] = (),
            exclude_self: bool = False, tile_rows: int = TILE_ROWS, margin: float | None = None) -> DataFrame:
    """The k nearest data rows of every query row.

    Returns query_id, ``nd`` (ascending distances), ``nid`` (ids, ties in id
    order) and one array per carried data column.  Fewer than k entries appear
    only when the data has fewer rows.
    """
    nd = len(dims)
    want = k + 1 if exclude_self else k
    types = dict(data.select(*carry).dtypes) if carry else {}
    qcols = [f"q{i}" for i in range(nd)]
    q = queries.select(F.col(query_id).cast("long").alias("qid"), *[F.col(d).cast("double").alias(c) for d, c in zip(dims, qcols)])
    dat = data.select(F.col(data_id).cast("long").alias("nid"),
                      *[F.col(d).cast("double").alias(f"d{i}") for i, d in enumerate(dims)],
                      *[F.col(c).alias(f"c_{c}") for c in carry])
    start, reach = _start_margin(data, dims, want)
    margin = margin or start
    lists = ["nd", "nid", *[f"a_{c}" for c in carry]]
    ddl = ", ".join(["qid bigint", *[f"{c} double" for c in qcols], "nd array<double>", "nid array<bigint>",
                     *[f"a_{c} array<{types[c]}>" for c in carry]])
    arrow = pa.schema(
        [("qid", pa.int64()), *[(c, pa.float64()) for c in qcols], ("nd", pa.list_(pa.float64())),
         ("nid", pa.list_(pa.int64())), *[(f"a_{c}", pa.list_(_PA[types[c]])) for c in carry]]
    )
    kernel = _knn_kernel(want, nd, carry, arrow)
    tkeys = [f"t{i}" for i in range(nd)]
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def to_tiles(df: DataFrame, cols: Sequence[str], side: float, halo: float) -> DataFrame:
        if halo == 0:
            return df.withColumns({t: F.floor(F.col(c) / F.lit(side)).cast("long") for t, c in zip(tkeys, cols)})
        for t, c in zip(tkeys, cols):
            low = F.floor((F.col(c) - F.lit(halo)) / F.lit(side)).cast("long")
            high = F.floor((F.col(c) + F.lit(halo)) / F.lit(side)).cast("long")
            df = df.withColumn(t, F.explode(F.sequence(low, high)))
        return df

    def load(dfq: DataFrame, dfd: DataFrame, side: float, halo: float, few: bool = False) -> DataFrame:
        nq = to_tiles(dfq, qcols, side, 0).groupBy(*tkeys).agg(F.count(F.lit(1)).alias("nq"))
        ndt = to_tiles(dfd, [f"d{i}" for i in range(nd)], side, halo)
        if few:  # only tiles that are still asked about
            ndt = ndt.join(nq.select(*tkeys), tkeys, "left_semi")
        ndt = ndt.groupBy(*tkeys).agg(F.count(F.lit(1)).alias("nd_"))
        return nq.join(ndt, tkeys, "left").na.fill(0, ["nd_"])

    def tile_side(mg: float) -> float:
        return 5.0 * mg

    def fullest(dfq, dfd, mg) -> int:
        r = load(dfq, dfd, tile_side(mg), mg).agg(F.max(F.greatest("nq", "nd_"))).first()[0]
        return r or 0

    hot = fullest(q, dat, margin) > tile_rows
    asked = q
    if hot:
        w = Window.partitionBy(*[f"d{i}" for i in range(nd)]).orderBy("nid")
        # row_number <= want is applied per task before the shuffle
        dat = cut(dat.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= want).drop("_rn"))
        asked = cut(q.groupBy(*qcols).agg(F.min("qid").alias("qid")).select("qid", *qcols))
        while fullest(asked, dat, margin) > tile_rows and margin > reach * 1e-6:
            margin /= 4.0
    done: list[DataFrame] = []
    todo = asked
    while True:
        side = tile_side(margin)
        last = margin >= reach
        lq = to_tiles(todo, qcols, side, 0)
        ld = to_tiles(dat, [f"d{i}" for i in range(nd)], side, margin)
        keys = list(tkeys)
        split = hot
        if hot or done:  # the margin has changed since the load was counted
            size = cut(load(todo, dat, side, margin, bool(done)))
            split = hot or (size.agg(F.max(F.greatest("nq", "nd_"))).first()[0] or 0) > tile_rows
        if split:
            if not last:
                size = size.where(F.col("nd_") >= want)  # too few candidates: wait for a wider margin
            # rows are dealt to chunks by a hash, so chunks are planned a little smaller than the limit
            size = size.select(*tkeys, F.ceil(F.col("nq") / F.lit(0.9 * tile_rows)).cast("int").alias("sq"),
                               F.greatest(F.ceil(F.col("nd_") / F.lit(0.9 * tile_rows)), F.lit(1)).cast("int").alias("sd"))
            lq = (lq.join(size, tkeys).withColumn("kq", F.pmod(hash_key(F.col("qid")), F.col("sq")).cast("int"))
                  .withColumn("kd", F.explode(F.sequence(F.lit(0), F.col("sd") - 1))).drop("sq", "sd"))
            ld = (ld.join(size, tkeys).withColumn("kd", F.pmod(hash_key(F.col("nid")), F.col("sd")).cast("int"))
                  .withColumn("kq", F.explode(F.sequence(F.lit(0), F.col("sq") - 1))).drop("sq", "sd"))
            keys += ["kq", "kd"]
        elif done:
            ld = ld.join(lq.select(*tkeys).distinct(), tkeys, "left_semi")
        # a fixed number of partitions: Python work is heavier than its bytes suggest
        lq, ld = lq.repartition(parts, *keys), ld.repartition(parts, *keys)
        found = lq.groupBy(*keys).cogroup(ld.groupBy(*keys)).applyInArrow(kernel, ddl)
        if split:
            packed = F.arrays_zip(*lists)
            found = (
                found.groupBy("qid", *qcols).agg(F.flatten(F.collect_list(packed)).alias("p"))
                .select("qid", *qcols, F.slice(F.array_sort("p"), 1, want).alias("p"))
                .select("qid", *qcols, *[F.col(f"p.{c}").alias(c) for c in lists])
            )
        found = cut(found)
        if last:
            done.append(found)
            break
        final = (F.size("nd") >= want) & (F.element_at("nd", -1) <= F.lit(margin))
        done.append(found.where(final))
        if split:
            todo = cut(todo.join(found.where(final).select("qid"), "qid", "left_anti"))
        else:
            todo = found.where(~final).select("qid", *qcols)
        if todo.isEmpty():
            break
        margin *= 3.0
    res = done[0]
    for part in done[1:]:
        res = res.unionByName(part)
    if hot:
        res = q.join(res.drop("qid"), qcols)
    res = res.drop(*qcols)
    if exclude_self:
        at = F.array_position("nid", F.col("qid")).cast("int")
        cut_at = F.when(at > 0, at).otherwise(F.size("nid"))
        res = res.withColumn("_at", cut_at)
        drop_one = lambda c: F.when(F.size(c) < 1, F.col(c)).otherwise(
            F.concat(F.slice(c, 1, F.col("_at") - 1), F.expr(f"slice({c}, _at + 1, greatest(size({c}) - _at, 0))"))
        )
        res = res.withColumns({f"_{c}": drop_one(c) for c in lists}).select("qid", *[F.col(f"_{c}").alias(c) for c in lists])
    return res.select(F.col("qid").alias(query_id), "nd", "nid", *[F.col(f"a_{c}").alias(f"n_{c}") for c in carry])


#: Smallest side of the tiles of ``nearest_within`` in radii, and parts of such a tile along each axis inside the kernel.
WITHIN_TILE, WITHIN_PARTS = 8.0, 16
#: Thinly filled tiles are joined, two by two along each axis and so many times at most, while a row shares its tile with no more rows than this.
TILE_FILL, TILE_JOINS = 4000, 4
#: Parts are widened up to so many radii until they hold this many rows on average.
PART_ROWS, PART_REACH = 32, 4.0


def _parts(x: np.ndarray, side: float) -> np.ndarray:
    """Number of the part that each row lies in."""
    code = np.zeros(len(x), np.int64)
    for c in np.floor((x - x.min(axis=0)) / side).astype(np.int64).T:
        code = code * (c.max() + 1) + c
    return code


def _part_side(x: np.ndarray, side: float, r: float) -> float:
    """Side of parts: the given one where rows are dense, wider where a part would hold a few rows only."""
    while side < PART_REACH * r and len(np.unique(_parts(x, side))) * PART_ROWS > len(x):
        side *= 2.0
    return side


def _boxes(x: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the rows by part, first row of each part and the end, lower corners, upper corners)."""
    code = _parts(x, side)
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    lo, hi = np.minimum.reduceat(x[order], first), np.maximum.reduceat(x[order], first)
    return order, np.append(first, len(x)), lo, hi


def _closest(q: np.ndarray, d: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, row) of the nearest row of ``d`` closer than r; row -1 for none.  Equal distances take the first row.

    Parts of both sides are compared by their boxes: a part of ``d`` that is
    farther than the farthest corner of another one is not looked into.
    """
    best, pick = np.full(len(q), r * r), np.full(len(q), -1, np.int64)
    if not len(q) or not len(d):
        return best, pick
    side = _part_side(d, r * WITHIN_TILE / WITHIN_PARTS, r)
    q_order, q_at, q_lo, q_hi = _boxes(q, side)
    d_order, d_at, d_lo, d_hi = _boxes(d, side)
    for k in range(len(q_at) - 1):
        rows = q_order[q_at[k]:q_at[k + 1]]
        gap = np.maximum(np.maximum(d_lo - q_hi[k], q_lo[k] - d_hi), 0.0)
        far = np.maximum(d_hi - q_lo[k], q_hi[k] - d_lo)
        gap, far = (gap * gap).sum(axis=1), (far * far).sum(axis=1)
        use = np.flatnonzero(gap <= min(far.min(), r * r))
        if not len(use):
            continue
        cand = np.sort(np.concatenate([d_order[d_at[u]:d_at[u + 1]] for u in use]))
        step = max(1, 2_000_000 // len(cand))
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            d2 = np.zeros((len(part), len(cand)))
            for i in range(q.shape[1]):
                diff = q[part, i:i + 1] - d[cand, i]
                d2 += diff * diff
            at = d2.argmin(axis=1)
            found = d2[np.arange(len(part)), at]
            hit = found < r * r
            best[part[hit]], pick[part[hit]] = found[hit], cand[at[hit]]
    return best, pick


def _within_tiles(q: DataFrame, d: DataFrame, nd: int, equal: list[str], q_row: Sequence[str], d_row: Sequence[str],
                  tile_rows: int) -> tuple[DataFrame, DataFrame, list[str], bool]:
    """(left, right, keys, split): left rows in one tile, right rows in every tile whose margin holds them.

    ``q`` has _q0 ..., ``d`` has _d0 ..., both have _r, the radius.  If a tile has
    more than ``tile_rows`` on a side, ``split`` is true and both sides are dealt
    to chunks by hashes of ``q_row`` and ``d_row``; results of a left row then
    come in parts.  Where tiles hold few rows they are joined, so that a task
    does not spend its time on starting kernels.
    """
    tkeys = [f"_t{i}" for i in range(nd)]
    keys = [*equal, *tkeys]
    side = F.col("_r") * WITHIN_TILE
    q = q.withColumns({t: F.floor(F.col(f"_q{i}") / side).cast("long") for i, t in enumerate(tkeys)})
    tiles = cut(q.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nq")))
    joined = lambda df, j: df.withColumns({t: F.shiftright(t, j) for t in tkeys})
    merged = lambda j: joined(tiles, j).groupBy(*keys).agg(F.sum("_nq").alias("_nq"))
    joins = 0
    while joins < TILE_JOINS:  # rows that a row shares its tile with: one place that holds a third of them keeps the tiles small
        shared = merged(joins + 1).agg(F.sum(F.col("_nq").cast("double") * F.col("_nq")) / F.sum("_nq")).first()[0]
        if shared is None or shared > min(TILE_FILL, tile_rows):
            break
        joins += 1
    q, tiles = joined(q, joins), merged(joins)
    for i, t in enumerate(tkeys):
        d = d.withColumn(t, F.explode(F.sequence(*[F.shiftright(F.floor((F.col(f"_d{i}") + F.col("_r") * sign) / side).cast("long"), joins) for sign in (-1, 1)])))
    d = cut(d.drop("_r").join(tiles.select(*keys), keys, "left_semi"))
    size = cut(tiles.join(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nd")), keys))
    full = size.agg(F.max(F.greatest("_nq", "_nd"))).first()[0] or 0
    if full <= tile_rows:
        return q, d, keys, False
    chunks = lambda c: F.ceil(F.col(c) / F.lit(0.9 * tile_rows)).cast("int")
    plan = size.select(*keys, chunks("_nq").alias("_sq"), chunks("_nd").alias("_sd"))
    deal = lambda c, n: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    q = q.join(plan, keys).withColumn("_kq", deal(q_row, "_sq")).withColumn("_kd", F.explode(F.sequence(F.lit(0), F.col("_sd") - 1))).drop("_sq", "_sd")
    d = d.join(plan, keys).withColumn("_kd", deal(d_row, "_sd")).withColumn("_kq", F.explode(F.sequence(F.lit(0), F.col("_sq") - 1))).drop("_sq", "_sd")
    return q, d, [*keys, "_kq", "_kd"], True


def nearest_within(left: DataFrame, right: DataFrame, r: float | str, dims: Sequence[str] = XYZ,
                   left_id: str = "point_id", right_id: str = "point_id",
                   carry: Sequence[str] = (), equal: Sequence[str] = (), keep: Sequence[str] = (), tile_rows: int = TILE_ROWS) -> DataFrame:
    """Nearest right row of every left row that has one within r (strictly); ``keep`` names left columns to return.

    ``equal`` names columns that must match; ``r`` may name one that both sides
    have, when every group has its own radius.  Tiles hold the left rows once and
    the right rows with a margin of r; the kernel returns one row a left row, so
    the pairs within r are never made.  A tile that is too full is split into
    chunks of both sides, whose nearest rows merge.
    """
    nd = len(dims)
    equal = list(dict.fromkeys([*equal, *([r] if isinstance(r, str) else [])]))
    reach = F.col(r).cast("double") if isinstance(r, str) else F.lit(float(r))
    cols = list(dict.fromkeys([left_id, *equal, *keep]))
    q = left.select(*cols, *[F.col(d).cast("double").alias(f"_q{i}") for i, d in enumerate(dims)], reach.alias("_r"))
    types = {c: t for c, t in left.dtypes if c in cols} | {f"_n_{c}": t for c, t in right.dtypes if c in (right_id, *carry)}
    d = right.select(*equal, *[F.col(c).alias(f"_n_{c}") for c in dict.fromkeys([right_id, *carry])],
                     *[F.col(c).cast("double").alias(f"_d{i}") for i, c in enumerate(dims)], reach.alias("_r"))
    q, d, keys, split = _within_tiles(q, d, nd, equal, [left_id], [f"_n_{right_id}"], tile_rows)
    wanted = [f"_n_{c}" for c in dict.fromkeys([right_id, *carry])]

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        rt = rt.sort_by(f"_n_{right_id}")
        x, y = (np.column_stack([t.column(f"{p}{i}").to_numpy() for i in range(nd)]) for t, p in ((lt, "_q"), (rt, "_d")))
        best, pick = _closest(x, y, lt.column("_r")[0].as_py()) if lt.num_rows else (np.zeros(0), np.zeros(0, np.int64))
        hit = np.flatnonzero(pick >= 0)
        a, b = lt.select(cols).take(pa.array(hit)), rt.select(wanted).take(pa.array(pick[hit]))
        return pa.table([*a.columns, *b.columns, pa.array(best[hit])], names=[*cols, *wanted, "_d2"])

    ddl = ", ".join([f"`{c}` {types[c]}" for c in (*cols, *wanted)]) + ", _d2 double"
    found = q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(kernel, ddl)
    if split:
        best = F.min(F.struct("_d2", *wanted)).alias("_b")
        found = found.groupBy(*cols).agg(best).select(*cols, "_b.*")
    return found.select(*cols, F.sqrt("_d2").alias("dist"), F.col(f"_n_{right_id}").alias("n_id"), *[F.col(f"_n_{c}").alias(f"n_{c}") for c in carry])


MOMENTS = ("m_n", "m_x", "m_y", "m_z", "m_xx", "m_xy", "m_xz", "m_yy", "m_yz", "m_zz")


def _terms(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight, weighted coordinates and their products, one row each."""
    x = np.zeros((len(y), 3))
    x[:, :y.shape[1]] = y
    second = [x[:, i] * x[:, j] for i in range(3) for j in range(i, 3)]
    return np.column_stack([np.ones(len(y)), x, *second]) * w[:, None]


def _sums_within(q: np.ndarray, d: np.ndarray, w: np.ndarray, r: float) -> np.ndarray:
    """MOMENTS of the rows of ``d`` within r of each row of ``q``, about that row.

    A part of ``d`` that lies within r of all of a part of ``q`` adds its sums;
    only parts on the rim are compared row by row.
    """
    out = np.zeros((len(q), 10))
    if not len(q) or not len(d):
        return out
    origin = np.floor(d.min(axis=0))
    terms = _terms(d - origin, w)
    side = _part_side(d, r * WITHIN_TILE / (2 * WITHIN_PARTS), r)
    q_order, q_at, q_lo, q_hi = _boxes(q, side)
    d_order, d_at, d_lo, d_hi = _boxes(d, side)
    d, terms = d[d_order], terms[d_order]
    total = np.add.reduceat(terms, d_at[:-1], axis=0)
    for k in range(len(q_at) - 1):
        rows = q_order[q_at[k]:q_at[k + 1]]
        gap = np.maximum(np.maximum(d_lo - q_hi[k], q_lo[k] - d_hi), 0.0)
        far = np.maximum(d_hi - q_lo[k], q_hi[k] - d_lo)
        near, inside = (gap * gap).sum(axis=1) <= r * r, (far * far).sum(axis=1) <= r * r
        out[rows] += total[inside].sum(axis=0)
        rim = np.flatnonzero(near & ~inside)
        if not len(rim):
            continue
        cand = np.concatenate([np.arange(d_at[u], d_at[u + 1]) for u in rim])
        step = max(1, 2_000_000 // len(cand))
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            d2 = np.zeros((len(part), len(cand)))
            for i in range(q.shape[1]):
                diff = q[part, i:i + 1] - d[cand, i]
                d2 += diff * diff
            out[part] += (d2 <= r * r).astype(np.float64) @ terms[cand]
    # from the common origin to each row
    p = np.zeros((len(q), 3))
    p[:, :q.shape[1]] = q - origin
    n, first = out[:, :1].copy(), out[:, 1:4].copy()
    out[:, 1:4] -= n * p
    for c, (i, j) in enumerate((i, j) for i in range(3) for j in range(i, 3)):
        out[:, 4 + c] += n[:, 0] * p[:, i] * p[:, j] - first[:, i] * p[:, j] - first[:, j] * p[:, i]
    return out


def _plane_sums(q: np.ndarray, d: np.ndarray, w: np.ndarray, r: float, normal: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Weighted sum of distances from each row's plane (normal . (p - row) = offset) over the rows of ``d`` within r."""
    out = np.zeros(len(q))
    if not len(q) or not len(d):
        return out
    side = _part_side(d, r * WITHIN_TILE / (2 * WITHIN_PARTS), r)
    q_order, q_at, q_lo, q_hi = _boxes(q, side)
    d_order, d_at, d_lo, d_hi = _boxes(d, side)
    for k in range(len(q_at) - 1):
        rows = q_order[q_at[k]:q_at[k + 1]]
        gap = np.maximum(np.maximum(d_lo - q_hi[k], q_lo[k] - d_hi), 0.0)
        cand = np.concatenate([d_order[d_at[u]:d_at[u + 1]] for u in np.flatnonzero((gap * gap).sum(axis=1) <= r * r)] or [np.zeros(0, np.int64)])
        step = max(1, 1_000_000 // max(len(cand), 1))
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            d2, dist = np.zeros((2, len(part), len(cand)))
            for i in range(3):
                diff = d[cand, i] - q[part, i:i + 1]
                d2 += diff * diff
                dist += diff * normal[part, i:i + 1]
            out[part] += np.where(d2 <= r * r, np.abs(dist - offset[part, None]), 0.0) @ w[cand]
    return out


def radius_moments(left: DataFrame, right: DataFrame, r: float, dims: Sequence[str] = XYZ, equal: Sequence[str] = (),
                   tile_rows: int = TILE_ROWS) -> DataFrame:
    """Left positions (``dims``, ``equal``) with MOMENTS of the right positions (weight ``w``) within r, about each.

    The pairs are never made: a kernel per tile returns one row for each left
    position, and tiles that are too full are split.
    """
    return _per_position(left, right, r, dims, equal, (), MOMENTS, lambda q, d, w, extra: _sums_within(q, d, w, r), tile_rows)


def plane_distances(left: DataFrame, right: DataFrame, r: float, equal: Sequence[str] = (), tile_rows: int = TILE_ROWS) -> DataFrame:
    """Left positions with ``m_d``: the weighted sum of distances of right positions within r from the plane nx, ny, nz, offset."""
    def sums(q, d, w, extra):
        return _plane_sums(q, d, w, r, extra[:, :3], extra[:, 3])[:, None]

    return _per_position(left, right, r, XYZ, equal, ("nx", "ny", "nz", "offset"), ("m_d",), sums, tile_rows)


def _per_position(left, right, r, dims, equal, extra, out, sums, tile_rows) -> DataFrame:
    nd, equal = len(dims), list(equal)
    cols = [*dims, *equal]
    types = dict(left.dtypes)
    q = left.select(*cols, *extra, *[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(dims)], F.lit(float(r)).alias("_r"))
    d = right.select(*equal, F.col("w").cast("double").alias("_w"), *[F.col(c).cast("double").alias(f"_d{i}") for i, c in enumerate(dims)], F.lit(float(r)).alias("_r"))
    q, d, keys, split = _within_tiles(q, d, nd, equal, cols, [f"_d{i}" for i in range(nd)], tile_rows)

    def kernel(lt: pa.Table, rt: pa.Table) -> pa.Table:
        x, y = (np.column_stack([t.column(f"{p}{i}").to_numpy() for i in range(nd)]) for t, p in ((lt, "_q"), (rt, "_d")))
        more = np.column_stack([lt.column(c).to_numpy() for c in extra]) if extra else None
        got = sums(x, y, rt.column("_w").to_numpy(), more)
        return pa.table([*(lt.column(c) for c in cols), *map(pa.array, got.T.copy())], names=[*cols, *out])

    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in cols), *(f"{c} double" for c in out)])
    found = q.groupBy(*keys).cogroup(d.groupBy(*keys)).applyInArrow(kernel, ddl)
    return found.groupBy(*cols).agg(*[F.sum(c).alias(c) for c in out]) if split else found
