"""Alignment of two tokenizers by minimal perfect hashing of their linked id pairs.

Both tokenizers cut the same bytes.  Offsets where tokens of both end cut a text
into groups; two tokens are linked where their byte ranges overlap.  Every
stretch between neighbouring token ends of either kind is one link.

Texts are tokenized once, into stored slices of ids.  The first pass aligns the
slices and counts the pairs of each part (some slices).  The distinct pairs of a
bucket (a hash of the B id) get a minimal perfect hash: levels of bit arrays, in
which a pair's place is the rank of its bit, and the pair itself is kept there
for verification.  Counts are added up in dense vectors indexed by that hash,
first those of a group of parts, then of groups, as a tree.  The second pass
aligns the slices again and looks counts up; each part asks the buckets just for
its own distinct pairs, so that no task and no broadcast holds all of them.

A bucket holds at most (ids of A) x (ids of B) / ``BUCKETS`` pairs, whatever the
corpus.  The pairs of a B id are in one bucket, which so knows its highest count.

Nulls, empties, ties: texts that are null, empty, or not restored byte by byte by
both tokenizers have no tokens (zeros and an empty digest); pairs tied for the
highest count of a B id are all best; equal rows count each on its own; a null
``doc_id`` stays null; no rows give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, slices, store, sums, texts_of, unchunked
from .tokens import prefixed

BUCKETS = 256
#: Text in a slice, and in the slices of a part.
SLICE, PART_BYTES = 1 << 20, 16 << 20
#: Rows of counts that one leaf of the tree adds up, and vectors that each further node adds up.
LEAF, FAN = 256, 16
LOAD = 2.0
KEY = 32


@functools.lru_cache(maxsize=4)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all tokens one after the other, offsets)."""
    enc = prefixed(path)
    if path.endswith(".model"):
        out = [bytes([int(p[3:-1], 16)]) if enc.tok.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(enc.names)]
    else:
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        names = [enc.tok.id_to_token(i) for i in range(enc.size)]
        out = [bytes(of[c] for c in n) if all(c in of for c in n) else n.encode() for n in names]
    return np.frombuffer(b"".join(out), np.uint8), np.cumsum([0, *map(len, out)])


def id_type(path: str) -> str:
    return "<u2" if len(byte_table(path)[1]) <= (1 << 16) + 1 else "<u4"


def without_encoders(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the tokens of A and of B.  What a reused worker still holds for encoding (vocabularies, known stems) is let go."""
    sizes = np.diff(byte_table(a_path)[1]), np.diff(byte_table(b_path)[1])
    if prefixed.cache_info().currsize:
        prefixed.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
    return sizes


def restored(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, whether the tokens' bytes are a space and the text) for each text."""
    blob, at = byte_table(path)
    ids, off = prefixed(path).encode(texts)
    size = np.diff(at)[ids]
    got = sums(size, off)
    want = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    same = got == want
    ends = np.cumsum(np.where(same, want, 0))
    raw = np.frombuffer(b" " + b" ".join(pc.cast(texts.filter(pa.array(same)), pa.large_binary()).to_pylist()), np.uint8)
    keep = np.repeat(same, np.diff(off))
    mine = blob[ragged(at[ids[keep]], size[keep])]
    if len(mine):
        wrong = np.flatnonzero(mine != raw[:len(mine)])
        same[np.searchsorted(ends, wrong, side="right")] = False
    return ids, off, same


SLICES = "part long, doc_id array<long>, a binary, a_n binary, b binary, b_n binary"


def tokenize(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Slices of documents with the ids of both tokenizers; ``a_n``, ``b_n`` are their numbers for each document."""

    def run(batches):
        part, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            texts, doc = texts_of(batch), unchunked(batch.column(0))
            for lo, hi in slices(texts, SLICE):
                here = texts.slice(lo, hi - lo)
                filled += pc.sum(pc.binary_length(here)).as_py()
                a, a_off, ok = restored(here, a_path)
                b, b_off, also = restored(here, b_path)
                ok &= also & (pc.binary_length(here).to_numpy(zero_copy_only=False) > 0)
                a_n, b_n = np.diff(a_off), np.diff(b_off)
                a, b = a[np.repeat(ok, a_n)], b[np.repeat(ok, b_n)]
                kept = [x.astype(kind).tobytes() for x, kind in ((a, id_type(a_path)), (a_n * ok, "<u4"), (b, id_type(b_path)), (b_n * ok, "<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([doc.slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                                                  *(pa.array([x], pa.binary()) for x in kept)], names=["part", "doc_id", "a", "a_n", "b", "b_n"])
                del a, b, kept
                pa.default_memory_pool().release_unused()
                if filled >= PART_BYTES:
                    part, filled = part + 1, 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SLICES)


def aligned(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, whether A's ends here, whether B's ends here) of all links, by place."""
    a_end, b_end = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    total = int(a_end[-1]) if len(a_end) else 0
    is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    is_a[a_end], is_b[b_end] = True, True
    ends = np.flatnonzero(is_a | is_b)
    is_a, is_b = is_a[ends], is_b[ends]
    return np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b, is_a, is_b


def mixed(key: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing function of the key (multiply, shift, exclusive or)."""
    x = key.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct keys to 0 … n - 1: a key's bit is in the first level where it falls on a place of its own."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = [np.cumsum(level) - level for level in levels]
        self.before = np.cumsum([0, *(int(level.sum()) for level in levels)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            size = int(LOAD * len(left)) + 1
            at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            at = (mixed(keys[left], k) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out

    def __len__(self) -> int:
        return int(self.before[-1])

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(level).tobytes() for level in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
        for size in sizes.tolist():
            used = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, used, at), count=size).astype(bool))
            at += used
        return cls(levels)


def slice_of(batch: pa.RecordBatch, k: int, a_path: str, b_path: str) -> tuple[np.ndarray, ...]:
    """(A ids, their number for each document, B ids, their number for each document)."""
    kinds = (("a", id_type(a_path)), ("a_n", "<u4"), ("b", id_type(b_path)), ("b_n", "<u4"))
    return tuple(np.frombuffer(batch.column(c)[k].as_py(), kind).astype(np.int64) for c, kind in kinds)


def pair_counts(cut: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """First pass: part, bucket, keys (A id << 32 | B id, sorted) and counts of the links in what a task reads of a part."""

    def run(batches):
        a_size, b_size = without_encoders(a_path, b_path)
        held, part = [], None

        def flush():
            if not held:
                return
            keys, counts = added([k for k, _ in held], [n for _, n in held])
            held.clear()
            bucket = (mixed(keys & 0xFFFFFFFF, 99) % np.uint64(BUCKETS)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
            some = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(some), part)), pa.array(some.astype(np.int32)),
                 *(pa.array([x[order[at[b]:at[b + 1]]].tobytes() for b in some], pa.binary()) for x in (keys, counts))],
                names=["part", "bucket", "keys", "counts"])

        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("part")[k].as_py() != part:
                    yield from flush()
                    part = batch.column("part")[k].as_py()
                a, _, b, _ = slice_of(batch, k, a_path, b_path)
                i, j, _, _ = aligned(a, b, a_size, b_size)
                held.append(np.unique(a[i] << KEY | b[j], return_counts=True))
        yield from flush()

    return cut.select("part", "a", "a_n", "b", "b_n").mapInArrow(run, "part long, bucket int, keys binary, counts binary")


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, at, np.concatenate(counts))
    return found, out


def arrays(table: pa.Table, col: str) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i8") for x in table.column(col).to_pylist()]


def pair_tables(partial: DataFrame, parts: int) -> DataFrame:
    """bucket, hash, keys, counts, best: the verified keys, corpus-wide counts and whether they are the highest of their B id, by place."""
    node = F.pmod(F.xxhash64("part"), F.lit(-(-parts // LEAF))).cast("int")

    def distinct(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(arrays(table, "keys")))
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "node": pa.array([0], pa.int32()), "keys": pa.array([keys.tobytes()], pa.binary())})

    def build(table: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(arrays(table, "keys")))
        of = PerfectHash.of(keys)
        placed = np.empty_like(keys)
        placed[of(keys)] = keys
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "hash": pa.array([of.to_bytes()], pa.binary()), "keys": pa.array([placed.tobytes()], pa.binary())})

    def dense(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "node": pa.array([], pa.int32()), "vector": pa.array([], pa.binary())})
        of, keys = PerfectHash.from_bytes(right.column("hash")[0].as_py()), arrays(right, "keys")[0]
        vector = np.zeros(len(of), np.int64)
        for mine, counts in zip(arrays(left, "keys"), arrays(left, "counts")):
            at = of(mine)
            if not np.array_equal(keys[at], mine):
                raise ValueError("a pair is not in the table of its bucket")
            vector[at] += counts
        return pa.table({"bucket": left.column("bucket").slice(0, 1), "node": left.column("node").slice(0, 1), "vector": pa.array([vector.tobytes()], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        vector = np.sum(arrays(table, "vector"), axis=0)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "node": table.column("node").slice(0, 1), "vector": pa.array([vector.tobytes()], pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, counts = arrays(left, "keys")[0], arrays(right, "vector")[0]
        _, b = np.unique(keys & 0xFFFFFFFF, return_inverse=True)
        top = np.zeros(b.max() + 1, np.int64)
        np.maximum.at(top, b, counts)
        return pa.table({"bucket": left.column("bucket"), "hash": left.column("hash"), "keys": left.column("keys"),
                         "counts": right.column("vector"), "best": pa.array([(counts == top[b]).tobytes()], pa.binary())})

    leaves = partial.withColumn("node", node)
    nodes = -(-parts // LEAF)
    found = leaves.select("bucket", "node", "keys")
    if nodes > 1:
        found = found.groupBy("bucket", "node").applyInArrow(distinct, "bucket int, node int, keys binary")
    hashes = store(found.groupBy("bucket").applyInArrow(build, "bucket int, hash binary, keys binary"))
    every = hashes.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))
    tree = leaves.groupBy("bucket", "node").cogroup(every.groupBy("bucket", "node")).applyInArrow(dense, "bucket int, node int, vector binary")
    while nodes > 1:
        nodes = -(-nodes // FAN)
        tree = tree.withColumn("node", F.expr(f"cast(node % {nodes} as int)")).groupBy("bucket", "node").applyInArrow(summed, "bucket int, node int, vector binary")
    return hashes.groupBy("bucket").cogroup(tree.groupBy("bucket")).applyInArrow(finish, "bucket int, hash binary, keys binary, counts binary, best binary")


def answers(partial: DataFrame, tables: DataFrame, parts: int) -> DataFrame:
    """part, keys, counts, best: what the pairs of a part count in the whole corpus."""
    nodes = -(-parts // LEAF)
    node = F.pmod(F.xxhash64("part"), F.lit(nodes)).cast("int")
    every = tables.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"part": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("keys", "counts", "best")}})
        of = PerfectHash.from_bytes(right.column("hash")[0].as_py())
        keys, counts, best = arrays(right, "keys")[0], arrays(right, "counts")[0], np.frombuffer(right.column("best")[0].as_py(), bool)
        found = []
        for mine in arrays(left, "keys"):
            at = of(mine)
            if not np.array_equal(keys[at], mine):
                raise ValueError("a pair is not in the table of its bucket")
            found.append((counts[at].tobytes(), best[at].tobytes()))
        return pa.table({"part": left.column("part"), "keys": left.column("keys"), "counts": pa.array([c for c, _ in found], pa.binary()),
                         "best": pa.array([b for _, b in found], pa.binary())})

    asked = partial.select("part", "bucket", "keys").withColumn("node", node)
    return asked.groupBy("bucket", "node").cogroup(every.groupBy("bucket", "node")).applyInArrow(look_up, "part long, keys binary, counts binary, best binary")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def described(a, a_n, b, i, j, ends) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2,b3`` of each document; empty without tokens."""
    names = np.array([str(n) for n in range(1 + max(a.max(initial=0), b.max(initial=0)))], object)
    a_names, b_names = names[a].tolist(), names[b].tolist()
    last = np.flatnonzero(ends)
    a_to, b_to = (i[last] + 1).tolist(), (j[last] + 1).tolist()
    groups, x, y = [], 0, 0
    for p, q in zip(a_to, b_to):
        groups.append(f"{a_names[x]}|{b_names[y]}" if p == x + 1 and q == y + 1 else f"{','.join(a_names[x:p])}|{','.join(b_names[y:q])}")
        x, y = p, q
    a_end = np.cumsum(a_n)
    to = np.searchsorted(np.array(a_to, np.int64), a_end, side="right").tolist()
    out, x = [], 0
    for n, p in zip(a_n.tolist(), to):
        out.append(hashlib.sha256(";".join(groups[x:p]).encode()).hexdigest() if n else "")
        x = p
    return out


def links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Numbers of tokens, groups and links of each document, with the corpus-wide counts of its links."""
    cut = store(tokenize(docs, a_path, b_path))
    parts = cut.select("part").distinct().count()
    if not parts:
        return docs.sparkSession.createDataFrame([], RESULT)
    partial = store(pair_counts(cut, a_path, b_path))
    told = answers(partial, store(pair_tables(partial, parts)), parts)

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        a_size, b_size = without_encoders(a_path, b_path)
        none = np.zeros(0, np.int64)
        keys, counts = np.concatenate([none, *arrays(right, "keys")]), np.concatenate([none, *arrays(right, "counts")])
        best = np.concatenate([np.zeros(0, bool), *(np.frombuffer(x, bool) for x in right.column("best").to_pylist())])
        order = np.argsort(keys, kind="stable")
        keys, counts, best = keys[order], counts[order], best[order]
        out = []
        for batch in left.to_batches():
            for k in range(batch.num_rows):
                a, a_n, b, b_n = slice_of(batch, k, a_path, b_path)
                i, j, is_a, is_b = aligned(a, b, a_size, b_size)
                at = np.searchsorted(keys, a[i] << KEY | b[j])
                ends = is_a & is_b
                # links end where tokens do, so a document's links are those of its A tokens
                off = np.searchsorted(i, np.concatenate(([0], np.cumsum(a_n))), side="left")
                per = [sums(x.astype(np.int64), off) for x in (ends, np.ones(len(at), np.int64), best[at], counts[at])]
                out.append(pa.table([batch.column("doc_id")[k].values, pa.array(a_n), pa.array(b_n), *map(pa.array, per), pa.array(described(a, a_n, b, i, j, ends), pa.string())],
                                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
                del a, b, i, j, is_a, is_b, at, ends
                pa.default_memory_pool().release_unused()
        if not out:
            return pa.table({c: pa.array([], pa.string() if c == "groups_sha256" else pa.int64()) for c in (x.split()[0] for x in RESULT.split(", "))})
        return pa.concat_tables(out)

    return cut.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(second, RESULT)
