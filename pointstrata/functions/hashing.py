"""Deterministic pseudo-random order of rows.

Sampling never uses ``rand()``: a retried task must return the same rows.  The
hash is plain 64-bit integer arithmetic, so it stays inside code generation
and can be restated in any SQL dialect.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647
MULT_A = 48271
MULT_B = 69621
SEED_STEP = 7919
HIGH_STEP = 1000003


def hash_key(id_col: Column, seed: int = 0) -> Column:
    """Value in [0, 2^31) that orders ids pseudo-randomly."""
    wide = id_col.cast("long")
    # bits above the 31st enter first: ids of different files must not repeat each other's keys
    low = F.pmod(wide, F.lit(MODULUS)) + F.pmod(F.shiftrightunsigned(wide, 31) * F.lit(HIGH_STEP), F.lit(MODULUS))
    base = F.pmod(low, F.lit(MODULUS)) * F.lit(MULT_A) + F.lit((seed + 1) * SEED_STEP)
    h1 = F.pmod(base, F.lit(MODULUS))
    h2 = F.pmod(h1.bitwiseXOR(F.shiftright(h1, 15)) * F.lit(MULT_B), F.lit(MODULUS))
    h3 = F.pmod(h2.bitwiseXOR(F.shiftright(h2, 13)) * F.lit(MULT_A), F.lit(MODULUS))
    return h3


def unit_hash(id_col: Column, seed: int = 0) -> Column:
    """Uniform value in [0, 1)."""
    return hash_key(id_col, seed) / F.lit(float(MODULUS))
