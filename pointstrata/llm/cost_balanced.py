"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (layers grow with
the tokens, attention with their square, and does not reach other documents).
Pieces are taken in descending order; each goes to the sequence of the lowest
cost so far that still has room for it (ties: the smaller number).  The tokens
of the corpus fix how many sequences there are: whole ones, and for the rest one
of each power of two that it is made of, so that none is padded.  What fits
nowhere at the end is cut to fill the gaps, which it does exactly.

Only lengths decide where a piece goes, and there are at most ``capacity`` of
them.  So the corpus is reduced to a histogram; sequences of equal content are
one class, a range of sequence numbers; and a piece finds its place from its
rank among pieces of its length.  The plan's size depends on ``capacity`` alone.

Nulls, empties, ties: a null text is an empty one and has just its end id; equal
rows are packed each on its own; a null ``doc_id`` stays null; no rows give no
rows.  Texts longer than ``capacity`` are cut at its multiples, never shortened.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ragged, slices, store, texts_of, unchunked
from .tokens import encoder, with_end

#: Cost of a token and of a pair of tokens; their ratio is that of a model six times 1024 wide.
LINEAR, QUADRATIC = 6144, 1
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, rank long"


def cost(length):
    return LINEAR * length + QUADRATIC * length * length


def byte_rows(values: np.ndarray, length: np.ndarray) -> pa.Array:
    """Binary rows of length[i] consecutive values each."""
    ends = np.concatenate(([0], np.cumsum(length * values.itemsize)))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(values)])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, spaced: bool = False) -> DataFrame:
    """One row per piece; ``part`` and ``rank`` number the pieces of a length within the task that wrote them.

    ``ids`` holds little-endian numbers, of 16 bits where the vocabulary allows that.
    """

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        enc = encoder(tokenizer, spaced)
        kind = id_type(enc)
        for batch in batches:
            texts, doc = texts_of(batch), unchunked(batch.column(0))
            for lo, hi in slices(texts):
                ids, off = with_end(*enc.encode(texts.slice(lo, hi - lo)), end_id)
                n = np.diff(off)
                count = -(-n // capacity)
                row = np.repeat(np.arange(hi - lo), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(capacity, n[row] - start)
                order = np.argsort(length, kind="stable")
                first = np.flatnonzero(np.diff(length[order], prepend=-1))
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(lo, hi - lo).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(n[row]),
                     byte_rows(ids.astype(kind), length).cast(pa.binary()), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def id_type(enc) -> str:
    return "<u2" if enc.size <= 1 << 16 else "<u4"


class Plan:
    """Where pieces go, from counts[length]; capacity is the last index."""

    def __init__(self, counts: np.ndarray):
        capacity = len(counts) - 1
        lengths = np.flatnonzero(counts)[::-1].tolist()
        total = int((counts * np.arange(capacity + 1)).sum())
        whole, rest = divmod(total, capacity)
        sizes = [(capacity, whole)] + [(1 << b, 1) for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        heap, first = [], 0
        for size, times in sizes:  # (cost, first sequence, room, tokens, number of sequences)
            if times:
                heap.append((0, first, size, 0, times))
            first += times
        heapq.heapify(heap)
        waiting: list[list[tuple]] = [[] for _ in range(capacity + 1)]
        slots, placed, above = [], np.zeros(capacity + 1, np.int64), capacity + 1
        for n in lengths:
            for ready in waiting[n:above]:  # classes with room for the first time since they were passed over
                for c in ready:
                    heapq.heappush(heap, c)
                ready.clear()
            above = n
            left, price = int(counts[n]), int(cost(n))
            while left and heap:
                spent, at, room, used, times = heapq.heappop(heap)
                if room < n:
                    waiting[room].append((spent, at, room, used, times))
                    continue
                take = min(left, times)
                slots.append((n, int(counts[n]) - left, at, used))
                left -= take
                if take < times:
                    heapq.heappush(heap, (spent, at + take, room, used, times - take))
                if room > n:
                    heapq.heappush(heap, (spent + price, at, room - n, used + n, take))
            placed[n] = counts[n] - left
        gaps = sorted((c for c in heap + [c for w in waiting for c in w]), key=lambda c: (-c[2], c[1]))
        table = np.array(sorted(slots), np.int64).reshape(-1, 4)
        self.length, self.base, self.first, self.used = table.T.copy()
        self.low = np.searchsorted(self.length, np.arange(capacity + 2))
        self.placed = placed
        # what is left over, and the gaps, each as one line of tokens
        over = (counts - placed) * np.arange(capacity + 1)
        self.over = np.cumsum(over[::-1])[::-1] - over
        self.gap_first, self.gap_room, self.gap_used = (np.array([c[i] for c in gaps], np.int64) for i in (1, 2, 3))
        tokens = self.gap_room * np.array([c[4] for c in gaps], np.int64)
        self.gap_line = np.cumsum(tokens) - tokens

    def whole(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces that are placed uncut."""
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            lo, hi = self.low[n], self.low[n + 1]
            k = lo + np.searchsorted(self.base[lo:hi], rank[at], side="right") - 1
            seq[at] = self.first[k] + rank[at] - self.base[k]
            off[at] = self.used[k]
        return seq, off

    def cut(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, begin in the piece, tokens, sequence, offset) of the parts of left-over pieces."""
        row, begin = np.arange(len(length)), np.zeros(len(length), np.int64)
        at = self.over[length] + (rank - self.placed[length]) * length
        left, out = length.copy(), []
        while len(row):
            k = np.searchsorted(self.gap_line, at, side="right") - 1
            nth, inside = np.divmod(at - self.gap_line[k], self.gap_room[k])
            take = np.minimum(left, self.gap_room[k] - inside)
            out.append((row, begin, take, self.gap_first[k] + nth, self.gap_used[k] + inside))
            more = left > take
            row, begin, at, left = row[more], (begin + take)[more], (at + take)[more], (left - take)[more]
        return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def pack(rows: DataFrame, wide: bool, capacity: int = 2048) -> DataFrame:
    """Places ``pieces``, which are read twice and should be stored; ``wide``: their ids have 32 bits."""
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r["length"]] = r["n"]
    plan = Plan(histogram)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each task and length: it grows with the tasks, so it is never broadcast.
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches):
        kind = "<u4" if wide else "<u2"
        for batch in batches:
            col = {c: unchunked(batch.column(i)) for i, c in enumerate(batch.schema.names)}
            start, length, rank, ahead = (col[c].to_numpy(zero_copy_only=False) for c in ("start", "length", "rank", "before"))
            rank = rank + ahead
            fits = rank < plan.placed[length]
            flat = np.frombuffer(b"".join(col["ids"].to_pylist()), kind).astype("<u4")
            begin = np.cumsum(length) - length
            keep = np.flatnonzero(fits)
            seq, off = plan.whole(length[keep], rank[keep])
            rest = np.flatnonzero(~fits)
            row, inner, take, more_seq, more_off = plan.cut(length[rest], rank[rest])
            row = np.concatenate((keep, rest[row]))
            inner, n = np.concatenate((np.zeros(len(keep), np.int64), inner)), np.concatenate((length[keep], take))
            doc = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"].take(doc), pa.array(start[row] + inner), pa.array(n), byte_rows(flat[ragged(begin[row] + inner, n)], n).cast(pa.binary()),
                 col["doc_tokens"].take(doc), pa.array(np.concatenate((seq, more_seq))), pa.array(np.concatenate((off, more_off)))],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.join(counts.hint("shuffle_hash"), ["part", "length"]).mapInArrow(place, schema)


def cost_balanced(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, spaced: bool = False) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset of every piece of every document.

    ``ids`` are 32-bit little-endian numbers.
    """
    wide = id_type(encoder(tokenizer, spaced)) == "<u4"
    return pack(store(pieces(docs, tokenizer, capacity, end_id, spaced)), wide, capacity)


def sequence_costs(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Tokens, padded length (a power of two needs no padding) and cost of every sequence."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces"),
                                            F.sum(F.lit(LINEAR) * F.col("length") + F.lit(QUADRATIC) * F.col("length") * F.col("length")).alias("cost"))
    power = F.bit_count(F.col("tokens")) == 1
    return per.withColumn("padded", F.when(power, F.col("tokens")).otherwise(F.lit(capacity)))
