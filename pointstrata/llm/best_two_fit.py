"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Only lengths decide where a piece goes, and there are at most ``capacity`` of
them.  So the corpus is reduced to a histogram of piece lengths, the packing is
planned on that histogram (each bin pattern with the number of times it
repeats), and every piece finds its place from its rank among pieces of its
length.  The plan's size depends on ``capacity`` alone, not on the corpus.

Nulls, empties, ties: a null text is an empty one and has just its end id; equal
rows are packed each on its own; a null ``doc_id`` stays null; no rows give no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, store, texts_of, unchunked
from .tokens import encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, spaced: bool = False) -> DataFrame:
    """One row per piece; ``part`` and ``rank`` number the pieces of a length within the task that wrote them."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc = encoder(tokenizer, spaced)
        for batch in batches:
            texts, doc = texts_of(batch), unchunked(batch.column(0))
            for lo, hi in slices(texts):
                ids, off = with_end(*enc.encode(texts.slice(lo, hi - lo)), end_id)
                n = np.diff(off)
                count = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                at = off[row] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                run_start = np.flatnonzero(np.diff(length[order], prepend=-1))
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(run_start, np.diff(np.append(run_start, len(row))))
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(lo, hi - lo).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Bin patterns and how often each repeats, from counts[length]; capacity is the last index.

    A bin takes the largest length left and is filled greedily with the largest
    that fits.  Then its smallest piece gives way to the two unpacked pieces
    that fit the widened gap most tightly, if they fill more of it.
    """
    left, capacity = counts.astype(np.int64).copy(), len(counts) - 1
    patterns: list[tuple[list[int], int]] = []
    index = np.arange(capacity + 1)

    def largest(limit: int) -> int:
        found = np.flatnonzero(left[1:limit + 1])
        return int(found[-1]) + 1 if len(found) else 0

    while left.any():
        bin_, gap = [], capacity
        while gap and (take := largest(gap)):
            bin_.append(take)
            left[take] -= 1
            gap -= take
        if gap and len(bin_) > 1:
            small = bin_[-1]
            room = gap + small
            below = np.maximum.accumulate(np.where(left > 0, index, 0))
            a = np.flatnonzero(left[:room]) if room > 1 else np.zeros(0, int)
            b = below[np.minimum(a, room - a)]
            alone = (b == a) & (left[a] < 2)
            b = np.where(alone, below[np.maximum(np.minimum(a, room - a) - 1, 0)], b)
            total = np.where(b > 0, a + b, 0)
            if len(a) and total.max() > small:
                best = int(np.argmax(total))
                left[small] += 1
                left[a[best]] -= 1
                left[b[best]] -= 1
                bin_[-1:] = [int(a[best]), int(b[best])]
        need = np.bincount(bin_, minlength=capacity + 1)
        left += need  # the first repetition is counted with the others
        lengths = np.flatnonzero(need)
        times = int((left[lengths] // need[lengths]).min())
        left -= need * times
        patterns.append((bin_, times))
    return patterns


def slots(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: sorted by (length, first rank)."""
    rows, first, used = [], {}, 0
    for bin_, times in patterns:
        place = np.cumsum([0, *bin_[:-1]])
        for length in sorted(set(bin_)):
            offs = place[[i for i, x in enumerate(bin_) if x == length]]
            base = first.get(length, 0)
            rows.append((length, base, used, len(offs), offs))
            first[length] = base + len(offs) * times
        used += times
    rows.sort(key=lambda r: (r[0], r[1]))
    per = np.array([r[3] for r in rows], np.int64)
    return {"length": np.array([r[0] for r in rows], np.int64), "base": np.array([r[1] for r in rows], np.int64),
            "bin": np.array([r[2] for r in rows], np.int64), "per": per, "at": np.cumsum(per) - per,
            "offsets": np.concatenate([r[4] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)}


def pack(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with length, part and rank (as ``pieces`` writes them).

    ``rows`` is read twice and should be stored.
    """
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = store(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r["length"]] = r["n"]
    table = slots(plan(histogram))

    keep = [c for c in rows.columns if c not in ("part", "rank")]
    low = np.searchsorted(table["length"], np.arange(capacity + 2))

    def place(batches):
        for batch in batches:
            col = {c: unchunked(batch.column(i)) for i, c in enumerate(batch.schema.names)}
            length = col["length"].to_numpy(zero_copy_only=False)
            rank = col["rank"].to_numpy(zero_copy_only=False) + col["before"].to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                lo, hi = low[n], low[n + 1]
                k = lo + np.searchsorted(table["base"][lo:hi], rank[at], side="right") - 1
                inside = rank[at] - table["base"][k]
                seq[at] = table["bin"][k] + inside // table["per"][k]
                off[at] = table["offsets"][table["at"][k] + inside % table["per"][k]]
            yield pa.RecordBatch.from_arrays([*(col[c] for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "sequence_id long", "offset long"])
    return rows.join(counts.select("part", "length", "before"), ["part", "length"]).mapInArrow(place, schema)


def best_two_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, spaced: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(store(pieces(docs, tokenizer, capacity, end_id, spaced)), capacity)
