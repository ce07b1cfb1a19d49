"""Hard negatives by residue-number-system matrix products.

Components are scaled and floored to whole numbers.  Each matrix is reduced
modulo several small primes; float32 products of residues are exact, because a
block of columns is chosen so short that its sums stay below 2**24; the signed
scores follow from their residues by Chinese remaindering (symmetric mixed-radix
digits, so no number on the way is larger than the score).  The primes are as
many as the largest score possible needs.

Anchors are a stated query set against all rows, taken in blocks of bounded size
(a broadcast of its own each).  A task keeps, for every anchor, the best rows seen
so far; only these are shuffled.  The first job finds each anchor's positives
(the best rows of its label), the second the best rows of other labels within the
window that a positive's score sets.

Nulls, empties, ties: rows with a null id, label or vector, or with a null or
non-finite component take no part, nor do rows so large that a score would not
fit into 62 bits (squared norm of the scaled vector).  Shorter vectors count as
filled up with zeros, an empty one as all zeros.  Equal scores are ordered by id;
rows repeated under one id are rows of their own, and an anchor leaves out only
its own row.  No rows, or no anchors, give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ragged, store, unchunked

#: Columns summed in one float32 product, and the largest residue whose sums over them stay exact.
COLUMNS, EXACT = 64, 1 << 24
ANCHORS = 16_384
ANCHOR_BYTES = 64 << 20
TILE = (512, 2048)
LIMIT = float(1 << 61)
NONE = np.iinfo(np.int64).min + 1


def primes(bound: int) -> list[int]:
    """The largest primes with exact products, as many as tell apart all scores of magnitude ``bound``."""
    found, p, product = [], 2 * int((EXACT // COLUMNS) ** 0.5) + 1, 1
    while product <= 2 * bound + 1:
        p -= 1
        if p > 2 and all(p % q for q in range(2, int(p ** 0.5) + 1)):
            found.append(p)
            product *= p
    return found


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """Symmetric residues as float32."""
    out = []
    for p in moduli:
        r = x % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b`` from their residues."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(moduli):
        dot = np.zeros((len(a[i]), len(b[i])), np.int64)
        for lo in range(0, a[i].shape[1], COLUMNS):
            dot += (a[i][:, lo:lo + COLUMNS] @ b[i][:, lo:lo + COLUMNS].T).astype(np.int32)
        r = dot % p
        for q, d in zip(moduli, digits):
            r = (r - d) * pow(q, -1, p) % p
        digits.append(np.where(r > p // 2, r - p, r))
    total = digits.pop() if digits else np.zeros((len(a), len(b)), np.int64)
    for p, d in zip(moduli[-2::-1], digits[::-1]):
        total = total * p + d
    return total


class Best:
    """The ``k`` first rows of each group by score descending, id ascending."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.score, self.id = np.full((groups, k), NONE), np.full((groups, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.score[group, -1]) | (ids < self.id[group, -1])
        group, score, ids = group[better], score[better], ids[better]
        if not len(group):
            return
        touched = np.unique(group)
        g = np.concatenate((group, np.repeat(touched, self.k)))
        s, i = np.concatenate((score, self.score[touched].ravel())), np.concatenate((ids, self.id[touched].ravel()))
        order = np.lexsort((i, -s, g))
        g = g[order]
        first = np.flatnonzero(np.diff(g, prepend=-1))
        take = order[ragged(first, np.full(len(first), self.k))]  # every touched group has k rows at least
        self.score[touched], self.id[touched] = s[take].reshape(-1, self.k), i[take].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, col = np.nonzero(self.score != NONE)
        return group, self.score[group, col], self.id[group, col]


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` whole numbers, zeros behind shorter vectors."""
    at = np.asarray(vectors.offsets).astype(np.int64)
    n = np.diff(at)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), ragged(np.zeros(len(n), np.int64), n)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def spans(n: int, size: int, first: int = 64):
    """Ranges that double up to ``size``: little is known of the best rows at the beginning."""
    lo = 0
    while lo < n:
        hi = min(n, lo + first)
        yield lo, hi
        lo, first = hi, min(size, 2 * first)


def usable(rows: DataFrame, scale: int) -> DataFrame:
    """id, label, vector of rows that take part, scaled and floored."""
    x = F.col("vector")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    norm = F.aggregate("vector", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    kept = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.withColumn("vector", whole).withColumn("norm", norm).where(F.col("norm") < LIMIT)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has id (long), label (long), vector (array of numbers); ``anchor``
    marks the anchors.  A negative's score lies between ``low`` and ``high``
    percent of the positive's.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = store(usable(rows, scale).withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.max("norm"), F.max(F.size("vector")), F.count_if("anchor")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size[2]:
        return spark.createDataFrame([], out)
    width, moduli = int(size[1]), primes(int(size[0] * (1 + 1e-9)) + 1)
    per_block = max(1, min(ANCHORS, ANCHOR_BYTES // (8 * max(width, 1))))
    blocks = -(-size[2] // per_block)
    found = [block(rows, F.pmod(F.xxhash64("row"), F.lit(blocks)) == k, width, moduli, positives, negatives, low, high) for k in range(blocks)]
    if len(found) == 1:
        return found[0]
    done = [store(f) for f in found]
    for more in done[1:]:
        done[0] = done[0].unionByName(more)
    return done[0]


def block(rows: DataFrame, share: Column, width: int, moduli: list[int], positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for the anchors of one share."""
    sc = rows.sparkSession.sparkContext
    taken = rows.where(F.col("anchor") & share).select("row", "id", "label", "vector").toArrow().sort_by("label")
    a_row, a_id, a_label = (taken.column(c).to_numpy() for c in ("row", "id", "label"))
    shared = sc.broadcast((a_row, a_label, matrix(unchunked(taken.column("vector")), width)))

    def search(windows):
        """Rows of the anchors' labels, or of other labels within windows[anchor, positive] = (least, most)."""

        def run(batches):
            row_of, label_of, vectors = shared.value
            anchors = residues(vectors, moduli)
            per = 1 if windows is None else windows.shape[1]
            best = Best(len(row_of) * per, positives if windows is None else negatives)
            for batch in batches:
                row, ids, label, vector = (unchunked(batch.column(i)) for i in range(4))
                row, ids, label = (c.to_numpy(zero_copy_only=False) for c in (row, ids, label))
                others = residues(matrix(vector, width), moduli)
                for a in range(0, len(row_of), TILE[0]):
                    own = slice(a, min(a + TILE[0], len(row_of)))
                    part = np.flatnonzero(np.isin(label, label_of[own])) if windows is None else np.arange(len(row))
                    for lo, hi in spans(len(part), TILE[1]):
                        at = part[lo:hi]
                        score = scores([m[own] for m in anchors], [m[at] for m in others], moduli)
                        same = label_of[own, None] == label[None, at]
                        if windows is None:
                            ok = same & (row_of[own, None] != row[None, at]) & (score >= best.floor()[own, None])
                            i, j = np.nonzero(ok)
                            best.add(i + a, score[i, j], ids[at[j]])
                            continue
                        for p in range(per):
                            group = np.arange(own.start, own.stop) * per + p
                            least = np.maximum(windows[own, p, 0], best.floor()[group])
                            i, j = np.nonzero((score >= least[:, None]) & (score <= windows[own, p, 1, None]) & ~same)
                            best.add(group[i], score[i, j], ids[at[j]])
            group, score, ids = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(group // per), pa.array((group % per).astype(np.int32)), pa.array(score), pa.array(ids)],
                                             names=["anchor", "nth", "score", "id"])

        return run

    def first(windows, k):
        got = rows.select("row", "id", "label", "vector").mapInArrow(search(windows), "anchor long, nth int, score long, id long")
        order = W.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id")
        return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    pos = first(None, positives).toArrow()  # at most ``positives`` rows for each anchor of the block
    anchor, nth, score, ids = (pos.column(c).to_numpy() for c in ("anchor", "rank", "score", "id"))
    windows = np.zeros((len(a_row), positives, 2), np.int64)
    windows[:, :, 0], windows[:, :, 1] = 1, 0  # no positive, no negative
    # low * s <= 100 * score <= high * s, without products of large numbers
    q, r = np.divmod(score, 100)
    windows[anchor, nth - 1, 0] = low * q - (-low * r // 100)
    windows[anchor, nth - 1, 1] = high * q + high * r // 100
    p_id, p_score = np.zeros((2, len(a_row), positives), np.int64)
    p_id[anchor, nth - 1], p_score[anchor, nth - 1] = ids, score
    names = sc.broadcast((a_id, p_id, p_score))

    def named(batches):
        a_id, p_id, p_score = names.value
        for batch in batches:
            anchor, nth, rank, score, ids = (unchunked(batch.column(i)) for i in range(5))
            at = (anchor.to_numpy(zero_copy_only=False), nth.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(a_id[at[0]]), pa.array(p_id[at]), rank, ids, pa.array(p_score[at]), score],
                                             names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return first(windows, negatives).select("anchor", "nth", "rank", "score", "id").mapInArrow(
        named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
