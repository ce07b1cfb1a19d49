"""Near-duplicate documents by SimHash fingerprints and anchor-point covering.

A fingerprint is cut into blocks whose allowances (t + 1 each) add up to the
threshold plus one: two fingerprints within the threshold agree in at least one
block up to its t bits.  Each block is covered by a code of radius R, the
anchors.  A block value is at home at its nearest anchor and a guest at every
anchor within R + t.  Values within t bits meet where one of them is at home, so
comparing the home rows of an anchor with its guests finds every link.

All steps work on distinct fingerprints; copies only come back in the last
join.  An anchor with many home rows is split into chunks, and comparisons
return a spanning forest of each batch, not its pairs.

Nulls, empties, ties: a null or empty text has fingerprint zero and is linked
like any other; equal rows share a component; a null ``doc_id`` never names a
component unless all its members lack one; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cluster import connected_components
from .common import ragged, slices, store, texts_of, with_columns

SEED = 42
BLOCKS = ((23, 1), (23, 1), (18, 0))
CHUNK = 4096
PAIRS = 1 << 20


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority bit of the XXH64 of all word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(width) - width
    size = min(shingle, len(words))
    ends = (starts + width - 1)[size - 1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo:lo + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """All columns of ``docs`` plus ``_fp`` (64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            fp = np.zeros(len(texts), "<u8")
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist()
                fp[lo:hi] = [fingerprint(t, shingle) for t in part]
            yield with_columns(batch, _fp=pa.array(fp.view(np.int64)))

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "_fp long"])
    return docs.mapInArrow(run, schema)


def _code(bits: int, t: int) -> tuple[int, np.ndarray, list[np.ndarray]]:
    """A covering code of one block: check bits, check column of each bit, flips to every anchor by syndrome.

    With t = 0 every value is its own anchor.  Otherwise the code has radius 1:
    each nonzero syndrome of r bits is the column of some bit, so one flip leads
    to the nearest anchor.  The flips listed lead to anchors within 1 + t, and
    the first of each list leads home.
    """
    if t == 0:
        return 0, np.zeros(bits, np.int64), [np.zeros(1, np.int64)]
    r = max(k for k in range(1, 6) if (1 << k) - 1 <= bits)
    column = np.arange(bits) % ((1 << r) - 1) + 1
    flips: list[list[int]] = [[] for _ in range(1 << r)]
    level = {0: 0}  # flip mask -> its syndrome, by number of flipped bits
    for weight in range(t + 2):
        for mask, s in sorted(level.items(), key=lambda x: x[0]):
            flips[s].append(mask)
        if weight < t + 1:
            level = {m | 1 << j: s ^ int(column[j]) for m, s in level.items() for j in range(m.bit_length(), bits)}
    return r, column, [np.array(f, np.int64) for f in flips]


def anchors(fps: DataFrame, blocks: Sequence[tuple[int, int]] = BLOCKS) -> DataFrame:
    """(anchor, home, _fp): each fingerprint at every anchor within reach, in all blocks."""
    codes = [_code(bits, t) for bits, t in blocks]

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            low = 0
            for b, ((bits, _), (r, column, flips)) in enumerate(zip(blocks, codes)):
                value = ((fp >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
                low += bits
                syndrome = np.zeros(len(value), np.int64)
                if r:
                    for j in range(bits):
                        syndrome ^= ((value >> j) & 1) * column[j]
                start = np.cumsum([0, *map(len, flips)])
                size = np.array([len(f) for f in flips])[syndrome]
                index = ragged(start[syndrome], size)
                key = np.repeat(value, size) ^ np.concatenate(flips)[index]
                home = np.zeros(len(key), bool)
                home[np.cumsum(size) - size] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key | (b << 48)), pa.array(home), pa.array(np.repeat(fp, size).view(np.int64))], names=["anchor", "home", "_fp"])

    return fps.select("_fp").mapInArrow(run, "anchor long, home boolean, _fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the graph with edges a - b and the smallest node it reaches, unless that is itself."""
    nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = index[:len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def links(fps: DataFrame, threshold: int = 4, blocks: Sequence[tuple[int, int]] = BLOCKS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints of ``fps`` within ``threshold`` bits."""
    if sum(t + 1 for _, t in blocks) <= threshold or sum(bits for bits, _ in blocks) != 64:
        raise ValueError("the blocks do not cover the threshold")
    rows = anchors(fps, blocks)
    crowd = rows.where("home").groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    crowd = crowd.select("anchor", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = rows.join(crowd, "anchor", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("_fp"), F.col("chunks")) == F.col("chunk")))
    rows = rows.select("anchor", "chunk", "home", "_fp").repartition("anchor", "chunk")
    rows = rows.sortWithinPartitions("anchor", "chunk", F.desc("home"))

    def compare(batches):
        kept = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)  # home rows of the group at hand
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1)], axis=1)
            home = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            hosts = np.concatenate((kept[0], key[home])), np.concatenate((kept[1], fp[home]))
            group = np.cumsum(np.any(np.diff(np.concatenate((hosts[0][:1], hosts[0])), axis=0) != 0, axis=1))
            # the hosts of each row: both sides are sorted by group
            code = {tuple(k): g for k, g in zip(hosts[0].tolist(), group.tolist())}
            change = np.concatenate(([True], np.any(np.diff(key, axis=0) != 0, axis=1))) if len(key) else np.zeros(0, bool)
            of = np.array([code.get(tuple(k), -1) for k in key[change].tolist()], np.int64)[np.cumsum(change) - 1] if len(key) else np.zeros(0, np.int64)
            size = np.bincount(group, minlength=1) if len(group) else np.zeros(1, np.int64)
            start = np.cumsum(size) - size
            n = np.where(of >= 0, size[of], 0)
            end = np.cumsum(n)
            found = [], []
            lo = 0
            while lo < len(fp):
                hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + PAIRS, side="right")))
                if n[lo:hi].any():
                    h = ragged(start[of[lo:hi]], n[lo:hi])
                    g = np.repeat(np.arange(lo, hi), n[lo:hi])
                    near = (np.bitwise_count(hosts[1][h] ^ fp[g]) <= threshold) & (hosts[1][h] != fp[g])
                    if near.any():
                        a, b = _forest(hosts[1][h[near]].view(np.int64), fp[g[near]].view(np.int64))
                        found[0].append(a)
                        found[1].append(b)
                lo = hi
            if found[0]:
                a, b = _forest(np.concatenate(found[0]), np.concatenate(found[1]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            if len(key):
                same = np.all(hosts[0] == key[-1], axis=1)
                kept = hosts[0][same], hosts[1][same]

    return rows.mapInArrow(compare, "a long, b long")


def members(fps: DataFrame, threshold: int = 4, blocks: Sequence[tuple[int, int]] = BLOCKS, **representative: Column) -> DataFrame:
    """Per distinct ``_fp`` its component's values of ``representative`` (aggregates such as ``min`` over rows)."""
    names = list(representative)
    first = store(fps.groupBy("_fp").agg(*(F.min(c).alias(n) for n, c in representative.items())))
    edges = store(links(first, threshold, blocks).distinct())
    nodes = edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()
    comp = store(connected_components(edges, nodes)).select(F.col("v").alias("_fp"), F.col("component").alias("root"))
    rooted = first.join(comp, "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    best = rooted.groupBy("root").agg(*(F.min(n).alias(n) for n in names))
    return rooted.select("_fp", "root").join(best, "root").select("_fp", *names)


def near_duplicates(docs: DataFrame, threshold: int = 4, shingle: int = 4, blocks: Sequence[tuple[int, int]] = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row."""
    fps = store(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), shingle)
                .select("doc_id", "_fp"))
    found = members(fps, threshold, blocks, component_id=F.col("doc_id"))
    return fps.join(found, "_fp").select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = 4, shingle: int = 4) -> DataFrame:
    """The columns of ``docs``; of each component the row with the smallest doc_id (nulls last) stays."""
    tagged = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"),
                         F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.monotonically_increasing_id().alias("k")).alias("_tag"))
    fps = store(fingerprints(tagged, shingle).drop("text"))
    best = members(fps.select("_fp", "_tag"), threshold, BLOCKS, best=F.col("_tag")).select(F.col("best.k").alias("_k")).distinct()
    return fps.withColumn("_k", F.col("_tag.k")).join(best, "_k", "left_semi").select("row.*")
