"""Registered queries and their SQL counterparts.

``add`` takes the output columns with a one-letter type (i long, d double
rounded to six decimals, s string, b boolean) and applies them to both sides,
so that names, types and rounding agree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import measured_joins
from ..sources.scene import scene

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_BODIES: dict[str, tuple[str, tuple[str, ...]]] = {}
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, text: str, *deps: str) -> None:
    _CTES[name] = (deps, text)


def clone(prefix: str, names: tuple[str, ...], source: str) -> None:
    """The CTEs ``names`` once more as ``{prefix}{name}``, over ``source`` in place of the scene."""
    new = {n: prefix + n for n in names} | {"scene": source}
    for n in names:
        deps, text = _CTES[n]
        cte(prefix + n, re.sub(r"\b(" + "|".join(new) + r")\b(?! *\()", lambda m: new[m[0]], text), *[new.get(d, d) for d in deps])


def _resolve(names, seen=None) -> list[str]:
    seen = [] if seen is None else seen
    for n in names:
        if n not in seen:
            _resolve(_CTES[n][0], seen)
            seen.append(n)
    return seen


def with_ctes(body: str, *names: str) -> str:
    parts = [f"{n} AS ({_CTES[n][1]})" for n in _resolve(names)]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


def _split(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in cols.split()]


def finish(df: DataFrame, cols: str) -> DataFrame:
    out = []
    for name, kind in _split(cols):
        c = F.col(name)
        out.append({"i": c.cast("long"), "d": F.round(c.cast("double"), 6) + F.lit(0.0), "s": c.cast("string"),
                    "b": c.cast("boolean")}[kind].alias(name))
    return df.select(*out)


def finish_sql(body: str, cols: str) -> str:
    out = []
    for name, kind in _split(cols):
        out.append({"i": f"CAST({name} AS BIGINT)", "d": f"round(CAST({name} AS DOUBLE), 6) + 0e0", "s": f"CAST({name} AS VARCHAR)",
                    "b": f"CAST({name} AS BOOLEAN)"}[kind] + f" AS {name}")
    return f"SELECT {', '.join(out)} FROM ({body}) AS result"


def add(name: str, cols: str, build: Callable[[DataFrame], DataFrame], body: str | None = None, *ctes: str,
        source: Callable[[SparkSession, str], DataFrame] = scene) -> None:
    """Registers a query over the scene (or another source); ``body`` is its SQL over the named CTEs."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        measured_joins(spark)
        return finish(build(source(spark, sf_dir)), cols)

    QUERIES[name] = run
    if body is not None:
        _BODIES[name] = (finish_sql(body, cols), ctes)


def oracles() -> dict[str, str]:
    return {n: with_ctes(b, *c) for n, (b, c) in _BODIES.items()}


# ---- shared SQL -----------------------------------------------------------

_OBJ = [
    (500, "(i%25)*0.8125e0", "(i//25)*1e0", "100e0+((7*r)%4)/64e0", 2, (0.5, 0.375, 0.375), 0.25, 0),
    (620, "3e0+(i%6)/4e0", "3e0+((i//6)%5)/4e0", "104e0+(i//30)+(i%3)/8e0", 5, (0.25, 0.5, 0.1875), 0.25, 500),
    (740, "11e0+(i%12)/2e0", "2e0+(i//12)/2e0", "106e0", 6, (0.5, 0.46875, 0.5), 0.375, 620),
    (780, "11e0", "2e0+(i%10)/2e0", "102e0+(i//10)", 6, (0.5, 0.46875, 0.5), 0.375, 740),
    (860, "(i%40)/2e0", "15e0+(i//40)*1.4375e0", "100.0625e0+(i//40)/64e0", 18, (0.5, 0.46875, 0.5), 0.75, 780),
    (900, "10e0+(i%2)/4e0", "17.5e0+((i//2)%2)/4e0", "100.5e0+(i//4)*0.75e0", 20, (0.5, 0.46875, 0.5), 0.5, 860),
    (930, "(i%30)*0.625e0", "15.71875e0", "105.3125e0", 19, (0.25, 0.1875, 0.25), 0.5, 900),
    (960, "(i%30)*0.625e0", "15.71875e0", "106.3125e0+((i%30)-15)*((i%30)-15)/1024e0", 19, (0.25, 0.1875, 0.25), 0.5, 900),
    (990, "1e0+(i%6)/16e0", "8e0+(i//6)/16e0", "100.125e0", 30, (0.5, 0.46875, 0.5), 0.25, 960),
    (996, "5e0+(i%2)/8e0", "17e0", "100.75e0+(i//2)/8e0", 1, (0.75, 0.6875, 0.75), 0.75, 990),
    (1000, "5e0*i", "5e0*i", "130e0+3e0*i", 7, (0.5, 0.46875, 0.5), 0.125, 996),
]


def _case(pick) -> str:
    whens = " ".join(f"WHEN r < {o[0]} THEN {pick(o)}" for o in _OBJ)
    return f"CASE {whens} END"


cte("ids", "SELECT o_orderkey * 4 + j AS point_id FROM orders, (VALUES (0),(1),(2),(3)) AS v(j)")
cte("slots", "SELECT point_id, point_id // 1000 AS chunk_id, point_id % 1000 AS r, CASE "
    + " ".join(f"WHEN point_id % 1000 < {o[0]} THEN point_id % 1000 - {o[7]}" for o in _OBJ) + " END AS i FROM ids", "ids")
cte("scene", "SELECT point_id, chunk_id, CAST((chunk_id % 8) * 32 + " + _case(lambda o: o[1]) + " AS DOUBLE) AS x, CAST((chunk_id // 8) * 32 + "
    + _case(lambda o: o[2]) + " AS DOUBLE) AS y, CAST(" + _case(lambda o: o[3]) + " AS DOUBLE) AS z, "
    + ", ".join(f"CAST({_case(lambda o, k=k: str(o[5][k]))} AS DOUBLE) AS {c}" for k, c in enumerate(("red", "green", "blue")))
    + ", CAST(" + _case(lambda o: str(o[6])) + " AS DOUBLE) AS intensity, " + _case(lambda o: str(o[4])) + " AS classification FROM slots", "slots")
cte("ext", "SELECT count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM scene", "scene")
cte("ground_cell", "SELECT CAST(floor(x - x0) AS BIGINT) AS ix, CAST(floor(y - y0) AS BIGINT) AS iy, min(z) AS gz FROM scene, ext "
    "WHERE classification = 2 GROUP BY ALL", "scene", "ext")
cte("hag", "SELECT s.*, coalesce(s.z - g.gz, 0e0) AS hag FROM (SELECT scene.*, CAST(floor(x - x0) AS BIGINT) AS ix, CAST(floor(y - y0) AS BIGINT) AS iy "
    "FROM scene, ext) s LEFT JOIN ground_cell g USING (ix, iy)", "scene", "ext", "ground_cell")
cte("keyed", "SELECT hag.*, least(greatest(CAST(floor((x - x0) / 0.5e0) AS BIGINT), 0), greatest(1, CAST(ceil((x1 - x0) / 0.5e0) AS BIGINT)) - 1) AS cx, "
    "least(greatest(CAST(floor((y - y0) / 0.5e0) AS BIGINT), 0), greatest(1, CAST(ceil((y1 - y0) / 0.5e0) AS BIGINT)) - 1) AS cy FROM hag, ext", "hag", "ext")
cte("cell", "SELECT cx, cy, count(*) AS cell_count, avg(z) AS z_mean, greatest(sum(z * z) / count(*) - (sum(z) / count(*)) * (sum(z) / count(*)), 0e0) AS z_variance, "
    "max(z) - min(z) AS z_range, count(*) / 0.25e0 AS density FROM keyed GROUP BY cx, cy", "keyed")
cte("feat", """SELECT k.*, c.z_variance, c.z_range, c.density, c.cell_count, (red + green + blue) / 3e0 AS bright,
 sqrt(((red-(red+green+blue)/3e0)**2 + (green-(red+green+blue)/3e0)**2 + (blue-(red+green+blue)/3e0)**2) / 3e0) AS sat,
 classification = 2 AS is_ground,
 CASE WHEN NOT (((green-red)/(green+red+1e-8) > 0.05e0) OR (green/(red+green+blue+1e-8) > 0.33e0)) OR classification = 2 OR hag <= 0 THEN NULL
      WHEN hag <= 0.5e0 THEN 3 WHEN hag <= 3e0 THEN 4 ELSE 5 END AS stratum
 FROM keyed k JOIN cell c USING (cx, cy)""", "keyed", "cell")
MASKS = {
    "powerlines": "hag >= 6 AND z_variance >= 0.3e0 AND density <= 50 AND NOT is_ground AND stratum IS NULL",
    "poles": "hag BETWEEN 3 AND 20 AND z_range >= 5 AND density <= 200 AND NOT is_ground AND stratum IS NULL",
    "rails": "hag BETWEEN 0 AND 0.15e0 AND intensity >= 0.5e0 AND z_variance <= 0.02e0 AND NOT is_ground AND stratum IS NULL AND sat < 0.1e0 AND bright > 0.2e0 AND bright < 0.7e0",
    "roads": "hag <= 0.15e0 AND z_variance <= 0.05e0 AND density >= 100 AND stratum IS NULL AND sat < 0.15e0",
    "curbs": "hag BETWEEN 0.05e0 AND 0.25e0 AND z_variance <= 0.02e0 AND intensity >= 0.4e0 AND NOT is_ground AND stratum IS NULL AND sat < 0.1e0 AND bright > 0.4e0 AND bright < 0.8e0",
    "signs": "hag BETWEEN 1.5e0 AND 4 AND intensity >= 0.7e0 AND density <= 100 AND NOT is_ground AND stratum IS NULL",
    "barriers": "hag BETWEEN 0.3e0 AND 1.2e0 AND intensity >= 0.5e0 AND density BETWEEN 20 AND 300 AND NOT is_ground AND stratum IS NULL AND sat < 0.12e0",
    "platforms": "hag BETWEEN 0.3e0 AND 1.5e0 AND z_variance <= 0.03e0 AND density >= 150 AND stratum IS NULL AND sat < 0.12e0 AND bright > 0.3e0 AND bright < 0.8e0",
    "water": "hag <= 0.1e0 AND z_variance <= 0.01e0 AND intensity <= 0.15e0 AND density >= 50 AND stratum IS NULL AND bright < 0.4e0 AND (blue > red OR green > red)",
    "bridges": "hag BETWEEN 2 AND 30 AND z_variance <= 0.05e0 AND density >= 100 AND stratum IS NULL AND sat < 0.12e0 AND bright > 0.3e0 AND bright < 0.8e0 AND intensity >= 0.3e0",
}
PRECEDENCE = (("bridges", 17), ("water", 9), ("platforms", 21), ("barriers", 36), ("signs", 35), ("curbs", 32), ("roads", 30),
              ("rails", 18), ("poles", 20), ("powerlines", 19))
cte("slice", "SELECT *, CASE WHEN classification = 7 THEN 7 WHEN is_ground THEN 2 WHEN stratum IS NOT NULL THEN stratum "
    + " ".join(f"WHEN {MASKS[n]} THEN {c}" for n, c in PRECEDENCE) + " ELSE 1 END AS new_class FROM feat", "feat")
cte("pred", """SELECT point_id, 'forest' AS model, classification AS y_true, CASE WHEN point_id % 17 = 0 THEN 1 ELSE classification END AS y_pred,
 ((point_id * 37) % 64) / 64e0 AS confidence FROM scene UNION ALL
 SELECT point_id, 'boosted', classification, CASE WHEN point_id % 23 = 0 THEN 1 ELSE classification END, 1e0 - ((point_id * 37) % 64) / 64e0 FROM scene""", "scene")


def hash_sql(col: str, seed: int = 0) -> str:
    """The row hash of ``functions.hashing`` in SQL."""
    h1 = f"((({col}) % 2147483647) * 48271 + {(seed + 1) * 7919}) % 2147483647"
    h2 = f"(xor({h1}, ({h1}) >> 15) * 69621) % 2147483647"
    return f"(xor({h2}, ({h2}) >> 13) * 48271) % 2147483647"


def names_sql(table: dict, key: str, default: str) -> str:
    q = lambda v: "'" + str(v).replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def dbscan_ctes(name: str, source: str, eps: float, m: int, dims=("x", "y"), part: str | None = None) -> None:
    """CTEs ``{name}``: all columns of ``source`` plus cluster, by closure over positions."""
    p = [part] if part else []
    d = ", ".join([*p, *dims])
    near = " AND ".join([*(f"a.{c} = b.{c}" for c in p), *(f"b.{c} BETWEEN a.{c} - {eps}e0 AND a.{c} + {eps}e0" for c in dims)])
    dist = " + ".join(f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in dims)
    same = lambda u, v: " AND ".join(f"{u}.{c} = {v}.{c}" for c in [*p, *dims])
    cte(f"{name}_pos", f"SELECT {d}, count(*) AS w, min(point_id) AS mid FROM {source} GROUP BY {d}", source)
    cte(f"{name}_nb", f"SELECT a.mid AS a, b.mid AS b, b.w FROM {name}_pos a JOIN {name}_pos b ON {near} WHERE {dist} <= {eps * eps}e0", f"{name}_pos")
    cte(f"{name}_core", f"SELECT a FROM {name}_nb GROUP BY a HAVING sum(w) >= {m}", f"{name}_nb")
    cte(f"{name}_edge", f"SELECT a, b FROM {name}_nb WHERE a IN (SELECT a FROM {name}_core) AND b IN (SELECT a FROM {name}_core)", f"{name}_nb", f"{name}_core")
    cte(f"{name}_reach", f"SELECT a, b FROM {name}_edge UNION SELECT r.a, e.b FROM {name}_reach r JOIN {name}_edge e ON r.b = e.a", f"{name}_edge")
    cte(f"{name}_lab", f"SELECT a, min(b) AS cluster FROM {name}_reach GROUP BY a", f"{name}_reach")
    cte(f"{name}_all", f"SELECT a, cluster FROM {name}_lab UNION ALL SELECT n.a, min(l.cluster) FROM {name}_nb n JOIN {name}_lab l ON n.b = l.a "
        f"WHERE n.a NOT IN (SELECT a FROM {name}_core) GROUP BY n.a", f"{name}_nb", f"{name}_lab", f"{name}_core")
    cte(name, f"SELECT s.*, l.cluster FROM {source} s JOIN {name}_pos q ON {same('s', 'q')} JOIN {name}_all l ON l.a = q.mid", source, f"{name}_pos", f"{name}_all")
