"""Covariance eigen-analysis as columns.

``with_eigen3`` adds the sorted eigenvalues of a symmetric 3x3 matrix (closed
trigonometric form) and the eigenvectors of the largest and the smallest one
(cross products of rows of C - lambda I).  Intermediate values are separate
projections so that Spark computes each of them once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-30


def moments(x: str, y: str, z: str, weight: Column | None = None) -> list[Column]:
    """Sums that are enough for mean and covariance; they merge map-side."""
    w = F.lit(1.0) if weight is None else weight
    cx, cy, cz = F.col(x), F.col(y), F.col(z)
    terms = {
        "m_n": w, "m_x": w * cx, "m_y": w * cy, "m_z": w * cz,
        "m_xx": w * cx * cx, "m_yy": w * cy * cy, "m_zz": w * cz * cz,
        "m_xy": w * cx * cy, "m_xz": w * cx * cz, "m_yz": w * cy * cz,
    }
    return [F.sum(expr).alias(name) for name, expr in terms.items()]


def with_covariance(df: DataFrame, sample: bool = False) -> DataFrame:
    """Adds cxx..cyz from the ``moments`` sums (population or n-1)."""
    n = F.col("m_n")
    den = (n - F.lit(1.0)) if sample else n

    def cov(ab: str, a: str, b: str) -> Column:
        return (F.col(ab) - F.col(a) * F.col(b) / n) / den

    return df.withColumns(
        {
            "cxx": F.greatest(cov("m_xx", "m_x", "m_x"), F.lit(0.0)),
            "cyy": F.greatest(cov("m_yy", "m_y", "m_y"), F.lit(0.0)),
            "czz": F.greatest(cov("m_zz", "m_z", "m_z"), F.lit(0.0)),
            "cxy": cov("m_xy", "m_x", "m_y"),
            "cxz": cov("m_xz", "m_x", "m_z"),
            "cyz": cov("m_yz", "m_y", "m_z"),
        }
    )


def _vector(df: DataFrame, lam: str, prefix: str) -> DataFrame:
    c = F.col
    df = df.withColumns(
        {"_a": c("cxx") - c(lam), "_b": c("cyy") - c(lam), "_c": c("czz") - c(lam)}
    )
    # cross products of the row pairs (0,1), (0,2), (1,2)
    df = df.withColumns(
        {
            "_p0x": c("cxy") * c("cyz") - c("cxz") * c("_b"),
            "_p0y": c("cxz") * c("cxy") - c("_a") * c("cyz"),
            "_p0z": c("_a") * c("_b") - c("cxy") * c("cxy"),
            "_p1x": c("cxy") * c("_c") - c("cxz") * c("cyz"),
            "_p1y": c("cxz") * c("cxz") - c("_a") * c("_c"),
            "_p1z": c("_a") * c("cyz") - c("cxy") * c("cxz"),
            "_p2x": c("_b") * c("_c") - c("cyz") * c("cyz"),
            "_p2y": c("cyz") * c("cxz") - c("cxy") * c("_c"),
            "_p2z": c("cxy") * c("cyz") - c("_b") * c("cxz"),
        }
    )
    for i in range(3):
        px, py, pz = (c(f"_p{i}{a}") for a in "xyz")
        df = df.withColumn(f"_q{i}", px * px + py * py + pz * pz)
    best = F.greatest(c("_q0"), c("_q1"), c("_q2"))
    df = df.withColumn("_qm", best)
    scale = F.sqrt(c("_qm"))
    floor = F.lit(1e-14) * F.pow(F.greatest(c("l1"), F.lit(1e-12)), 4)
    if prefix == "n":
        # A line has no unique normal: take the one closest to vertical.
        flat = c("_a") + c("_b")
        norm = F.sqrt(c("cxz") * c("cxz") + c("cyz") * c("cyz") + flat * flat)
        upright = flat <= F.lit(1e-9) * F.greatest(c("_c"), F.lit(TINY))
        standing = upright & (c("_c") > F.lit(1e-12))
        fallback = {
            "x": F.when(standing, F.lit(1.0)).when(norm > 0, -c("cxz") / norm).otherwise(F.lit(0.0)),
            "y": F.when(standing, F.lit(0.0)).when(norm > 0, -c("cyz") / norm).otherwise(F.lit(0.0)),
            "z": F.when(standing, F.lit(0.0)).when(norm > 0, flat / norm).otherwise(F.lit(1.0)),
        }
    else:
        fallback = {"x": F.lit(1.0), "y": F.lit(0.0), "z": F.lit(0.0)}
    out = {}
    for axis in "xyz":
        pick = (
            F.when(c("_q0") == c("_qm"), c(f"_p0{axis}"))
            .when(c("_q1") == c("_qm"), c(f"_p1{axis}"))
            .otherwise(c(f"_p2{axis}"))
        )
        out[f"{prefix}{axis}"] = F.when(c("_qm") > floor, pick / scale).otherwise(fallback[axis])
    df = df.withColumns(out)
    return df.drop("_a", "_b", "_c", "_qm", *[f"_q{i}" for i in range(3)],
                   *[f"_p{i}{a}" for i in range(3) for a in "xyz"])


def with_eigen3(df: DataFrame, normal: bool = True, axis: bool = False) -> DataFrame:
    """Adds l1 >= l2 >= l3 and, on request, nx/ny/nz (smallest) and ax/ay/az (largest)."""
    c = F.col
    df = df.withColumns(
        {
            "_m": (c("cxx") + c("cyy") + c("czz")) / F.lit(3.0),
            "_o": c("cxy") * c("cxy") + c("cxz") * c("cxz") + c("cyz") * c("cyz"),
        }
    )
    df = df.withColumn(
        "_p",
        F.sqrt(
            ((c("cxx") - c("_m")) * (c("cxx") - c("_m")) + (c("cyy") - c("_m")) * (c("cyy") - c("_m"))
             + (c("czz") - c("_m")) * (c("czz") - c("_m")) + F.lit(2.0) * c("_o")) / F.lit(6.0)
        ),
    )
    df = df.withColumns(
        {"_a": c("cxx") - c("_m"), "_b": c("cyy") - c("_m"), "_c": c("czz") - c("_m")}
    )
    det = (
        c("_a") * (c("_b") * c("_c") - c("cyz") * c("cyz"))
        - c("cxy") * (c("cxy") * c("_c") - c("cyz") * c("cxz"))
        + c("cxz") * (c("cxy") * c("cyz") - c("_b") * c("cxz"))
    )
    r = det / F.lit(2.0) / F.greatest(c("_p") * c("_p") * c("_p"), F.lit(TINY))
    df = df.withColumn("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / F.lit(3.0))
    df = df.withColumns(
        {
            "l1": c("_m") + F.lit(2.0) * c("_p") * F.cos(c("_phi")),
            "l3": F.greatest(
                c("_m") + F.lit(2.0) * c("_p") * F.cos(c("_phi") + F.lit(2.0 * math.pi / 3.0)), F.lit(0.0)
            ),
        }
    )
    df = df.withColumn("l2", F.greatest(F.lit(3.0) * c("_m") - c("l1") - c("l3"), F.lit(0.0)))
    df = df.drop("_m", "_o", "_p", "_a", "_b", "_c", "_phi")
    if normal:
        df = _vector(df, "l3", "n")
    if axis:
        df = _vector(df, "l1", "a")
    return df


def direction2(cxx: Column, cyy: Column, cxy: Column) -> tuple[Column, Column]:
    """Unit vector of the larger eigenvalue of a 2x2 covariance."""
    angle = F.lit(0.5) * F.atan2(F.lit(2.0) * cxy, cxx - cyy)
    return F.cos(angle), F.sin(angle)
