"""Near copies by exact Jaccard similarity of word shingles, found by prefix filtering.

Two sets of m and n shingles with a similarity of 4/5 or more share at least
4/9 (m + n) of them, so under one order of all shingles they share one among the
first n // 5 + 1 of each.  The order puts the most frequent shingles last, by
exact counts over all sets (of the HEAVY most frequent); it decides how many
candidates there are, never which pairs are found.  Every shared first shingle is
a bucket.

Each row is compared with one row of each of its buckets, the first by a hash;
what that links is contracted, and then all pairs of a bucket that still lie in
different components are compared, in the bucket of the first shingle they share:
where the shingles just before it have one in common, they meet in an earlier
bucket.  A pair is given up early only where the
parity bits of its sets differ in more places than similar sets can; the others
are decided by intersecting whole sets, so the components are those of all pairs.

Shingles are runs of five lower-case words (a shorter text is one shingle), as
64-bit hashes.  Nulls, empties, ties: null and empty texts are copies of each
other and of nothing else; texts with equal sets are copies; an empty table
gives no rows; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cluster import connected_components
from .common import ragged, slices, store, sums, texts_of, unchunked, with_columns, words_of

SHINGLE = 5
SEED = 42
SLOT_BITS = 22
#: Least count of a frequent shingle, and how many of them have a slot with a level.
CROWD, HEAVY = 4, 1 << 18
#: Bytes of text whose shingles are counted in one group, and the binary logarithm of the most groups.
COUNTED, GROUP_BITS = 1 << 20, 12
#: Parity bits of a small set; doubled for every doubling of the shingles beyond SPREAD, WIDEST times at most.
PARITY, SPREAD, WIDEST = 512, 200, 5
#: Shingles before one in a set's order that tell whether two sets have met before.
EARLIER = 8
#: Sets of a group that meet in one task.
GROUP = 500
_ODD = np.array([xxhash.xxh64_intdigest(bytes([j]), SEED) | 1 for j in range(SHINGLE)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, and where each text's begin (and the end)."""
    codes, words, first = words_of(texts)
    n = np.diff(first)
    count = np.where(n, np.maximum(n - SHINGLE + 1, 1), 0)
    if not count.sum():
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    word = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)[codes]
    at, row = ragged(first[:-1], count), np.repeat(np.arange(len(n)), count)
    h = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        h += np.where(j < n[row], word[np.minimum(at + j, len(word) - 1)] * _ODD[j], np.uint64(0))
    h = _mix(h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=len(n)))))


def _parts(batch: pa.RecordBatch):
    """First row, shingles and their offsets of each slice of a batch."""
    texts = texts_of(batch)
    for lo, hi in slices(texts):
        yield lo, hi, *shingle_sets(texts.slice(lo, hi - lo))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def digests(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` plus ``_fp``, the same for texts with equal sets, and ``_bits``, the parity of the set in each slot."""

    def run(batches):
        for batch in batches:
            fp, bits = np.zeros(batch.num_rows, np.uint64), []
            for lo, hi, h, offsets in _parts(batch):
                fp[lo:hi] = sums(_mix(h ^ np.uint64(SEED)), offsets)
                n = np.diff(offsets)
                wide = PARITY << np.clip(np.ceil(np.log2(np.maximum(n, 1) / SPREAD)), 0, WIDEST).astype(np.int64)
                ends = np.cumsum(wide)
                a = 0
                while a < hi - lo:  # rows with some million bits together
                    base = ends[a - 1] if a else 0
                    b = max(a + 1, int(np.searchsorted(ends, base + (1 << 22), side="right")))
                    begin = ends[a:b] - wide[a:b] - base
                    row = np.repeat(np.arange(b - a), n[a:b])
                    place = begin[row] + (h[offsets[a]:offsets[b]] >> np.uint64(40)).astype(np.int64) % wide[a:b][row]
                    raw = np.packbits((np.bincount(place, minlength=ends[b - 1] - base) & 1).astype(bool)).tobytes()
                    bits += [raw[x // 8:(x + w) // 8] for x, w in zip(begin.tolist(), wide[a:b].tolist())]
                    a = b
            yield with_columns(batch, _fp=pa.array(fp.view(np.int64)), _bits=pa.array(bits, pa.binary()))

    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "_fp long", "_bits binary"]))


def counts(reps: DataFrame, bits: int) -> DataFrame:
    """(slot, n) of every shingle that CROWD or more sets have: how many have it.

    Shingles travel packed, in ``1 << bits`` groups by their first bits, as their last 32 bits.
    """

    def pack(batches):
        for batch in batches:
            for _, _, h, _ in _parts(batch):
                group, low = h >> np.uint64(63 - bits) >> np.uint64(1), h & np.uint64(0xFFFFFFFF)
                code, n = np.unique(group << np.uint64(32) | low, return_counts=True)
                group = (code >> np.uint64(32)).astype(np.int32)
                begins = np.flatnonzero(np.append(group[:1] == group[:1], group[1:] != group[:-1]))
                spans = list(zip(begins.tolist(), [*begins[1:].tolist(), len(group)]))
                packed = [pa.array([v[x:y].tobytes() for x, y in spans], pa.binary()) for v in (code.astype(np.uint32), n.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(group[begins]), *packed], names=["g", "low", "n"])

    def add(packed: pa.Table) -> pa.Table:
        low, n = (np.frombuffer(b"".join(packed.column(c).to_pylist()), np.uint32) for c in ("low", "n"))
        order = np.argsort(low, kind="stable")
        low, n = low[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        total = np.add.reduceat(n.astype(np.int64), first)
        many = total >= CROWD
        return pa.table({"slot": pa.array(_slot(low[first][many].astype(np.uint64)), pa.int32()), "n": pa.array(total[many])})

    return reps.select("text").mapInArrow(pack, "g int, low binary, n binary").groupBy("g").applyInArrow(add, "slot int, n long")


def levels(reps: DataFrame) -> np.ndarray:
    """Per slot of the shingles: 0, or how frequent the most frequent shingle is that ends in it, as a logarithm."""
    size = reps.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = store(counts(reps, min(GROUP_BITS, (size // COUNTED).bit_length())))
    step = F.floor(4 * F.log2(F.col("n") / F.lit(CROWD))).cast("int")
    held, least = 0, 128
    for r in found.groupBy(step.alias("step")).agg(F.count("*").alias("c")).orderBy(F.desc("step")).collect():
        held += r["c"]
        if held > HEAVY:
            break
        least = r["step"]
    heavy = found.where(step >= least).select("slot", (step - least + 1).cast("byte").alias("level")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int8)
    np.maximum.at(out, heavy["slot"].to_numpy(), heavy["level"].to_numpy())
    return out


def prefixes(reps: DataFrame, level: np.ndarray) -> DataFrame:
    """(token, _fp, n, at): the first shingles of each set, its size, and the place in its order."""

    def run(batches):
        for batch in batches:
            fp = unchunked(batch.column(0)).to_numpy(zero_copy_only=False)
            for lo, _, h, offsets in _parts(batch):
                n = np.diff(offsets)
                row = np.repeat(np.arange(len(n)), n)
                h = h[np.lexsort((h, level[_slot(h)], row))]
                size = np.where(n, n // 5 + 1, 0)
                if size.sum():
                    k, r = ragged(offsets[:-1], size), np.repeat(np.arange(len(n)), size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[k].view(np.int64)), pa.array(fp[lo + r]), pa.array(n[r].astype(np.int32)),
                         pa.array((k - offsets[r]).astype(np.int32))], names=["token", "_fp", "n", "at"])

    return reps.select("_fp", "text").mapInArrow(run, "token long, _fp long, n int, at int")


def likely(bits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of a group ``g`` with ``all`` shingles in both, whose parity bits do not rule out a similarity of 4/5."""

    def run(batches):
        for batch in batches:
            x, y = (unchunked(batch.column(i)) for i in (4, 5))
            size = [pc.binary_length(v).to_numpy(zero_copy_only=False) for v in (x, y)]
            far = np.zeros(batch.num_rows, np.int64)
            for p, q in set(zip(*(z.tolist() for z in size))):
                at = np.flatnonzero((size[0] == p) & (size[1] == q))
                two = [np.frombuffer(b"".join(v.take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1) for v in (x, y)]
                while two[0].shape[1] != two[1].shape[1]:  # the longer one is folded
                    k = int(two[1].shape[1] > two[0].shape[1])
                    half = two[k].shape[1] // 2
                    two[k] = two[k][:, :half] ^ two[k][:, half:]
                far[at] = np.bitwise_count(two[0] ^ two[1]).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b", "g"]).filter(pa.array(9 * far <= unchunked(batch.column(3)).to_numpy()))  # m + n - 2 * 4/9 (m + n)

    both = pairs.join(bits.select(F.col("_fp").alias("a"), F.col("_bits").alias("x")), "a").join(
        bits.select(F.col("_fp").alias("b"), F.col("_bits").alias("y")), "b").select("a", "b", "g", "all", "x", "y")
    return both.mapInArrow(run, "a long, b long, g long")


def similar(fps: DataFrame, first: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 4/5 or more.

    ``pairs`` has a group ``g``: pairs of a group meet in one task, and each set
    travels there once, not once a pair.  A group of many sets is split by
    chunks of both sides.
    """

    def run(batches):
        for batch in batches:
            fp = unchunked(batch.column(0))
            for lo, hi, h, offsets in _parts(batch):
                raw = [h[x:y].tobytes() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([fp.slice(lo, hi - lo), pa.array(raw, pa.binary())], names=["_fp", "s"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {k: np.frombuffer(v, np.uint64) for k, v in zip(right.column("_fp").to_pylist(), right.column("s").to_pylist())}
        left = left.sort_by("a")
        a, b = left.column("a").to_pylist(), left.column("b").to_pylist()
        keep, at, mine = [], None, None
        for x, y in zip(a, b):
            if x != at:
                at, mine = x, sets[x]
            other = sets[y]
            place = np.searchsorted(mine, other)
            both = int((mine[np.minimum(place, len(mine) - 1)] == other).sum()) if len(mine) else 0
            keep.append(9 * both >= 4 * (len(mine) + len(other)))
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = store(likely(first.select("_fp", "_bits"), pairs))
    member = pairs.select("g", F.explode(F.array("a", "b")).alias("_fp")).distinct()
    large = member.groupBy("g").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("k"))
    chunk = lambda c: F.pmod(F.xxhash64(c), F.col("k")).cast("int")
    pairs = pairs.join(large, "g").select("g", "a", "b", chunk("a").alias("ca"), chunk("b").alias("cb"))
    every = F.sequence(F.lit(0), F.col("k") - 1)
    mine = chunk("_fp")
    places = F.array_distinct(F.concat(F.transform(every, lambda i: F.struct(mine.alias("ca"), i.alias("cb"))), F.transform(every, lambda i: F.struct(i.alias("ca"), mine.alias("cb")))))
    member = member.join(large, "g").withColumn("p", F.explode(places)).select("g", "_fp", "p.ca", "p.cb")
    rows = first.join(member.select("_fp").distinct(), "_fp", "left_semi").select(F.col("_tag.k").alias("_k"))
    sets = fps.join(rows, "_k", "left_semi").select("_fp", F.col("row.text").cast("string").alias("text")).mapInArrow(run, "_fp long, s binary")
    sent = member.join(sets, "_fp").select(*[F.col(c).alias(f"to_{c}") for c in ("g", "ca", "cb")], "_fp", "s")
    return pairs.groupBy("g", "ca", "cb").cogroup(sent.groupBy("to_g", "to_ca", "to_cb")).applyInArrow(compare, "a long, b long")


def buckets(rows: DataFrame) -> DataFrame:
    """The rows of tokens that several sets share, each with one of those sets: (token, _fp, n, at, hub, m, by)."""
    dealt = rows.withColumn("_o", F.xxhash64("_fp")).repartition("token").sortWithinPartitions("token", "_o", "_fp")
    names = ("token", "_fp", "n", "at")

    def run(batches):
        last, seen, told = None, None, True  # first row of the token at hand, latest set of it, whether the first is out
        for batch in batches:
            cols = [unchunked(batch.column(i)).to_numpy() for i in range(4)]
            if not batch.num_rows:
                continue
            if last is not None:
                cols = [np.concatenate((np.array([x], c.dtype), c)) for x, c in zip(last, cols)]
                previous = np.concatenate(([last[1], seen], cols[1][1:-1]))
            else:
                previous, told = np.concatenate((cols[1][:1], cols[1][:-1])), False
            token, fp = cols[0], cols[1]
            begins = np.concatenate(([True], token[1:] != token[:-1]))
            keep = begins | (fp != previous)  # copies of a set come one after the other
            head = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            many = np.bincount(head[keep & ~begins], minlength=len(token))[head] > 0
            out = keep & many
            if told:
                out[0] = False
            hub = [c[head][out] for c in cols[1:]]
            at = head[-1]
            told = bool(many[-1]) or (told and at == 0)
            last, seen = [c[at] for c in cols], fp[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in cols] + [pa.array(h) for h in hub], names=[*names, "hub", "m", "by"])

    return dealt.select(*names).mapInArrow(run, "token long, _fp long, n int, at int, hub long, m int, by int")


def _possible(n: str, at: str, m: str, by: str, first: bool = False):
    """Whether sets that meet at these places of their orders (for the first time) can share enough."""
    n, at, m, by = map(F.col, (n, at, m, by))
    earlier = F.lit(0) if first else F.least(at, by)
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * (earlier + F.least(n - at, m - by)) >= 4 * (n + m))


def _roots(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()
    return store(connected_components(edges, nodes)).select(F.col("v").alias("_fp"), F.col("component").alias("root"))


def meetings(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different roots in the bucket of the first token they share, seldom in later ones as well."""
    before = Window.partitionBy("_fp").orderBy("at").rowsBetween(-EARLIER, -1)
    rows = store(rows.withColumn("prev", F.collect_list("token").over(before)))
    other = rows.select("token", *(F.col(c).alias(d) for c, d in (("_fp", "b"), ("n", "m"), ("at", "by"), ("root", "root_b"), ("prev", "prev_b"))))
    return rows.withColumnRenamed("_fp", "a").join(other, "token").where(
        (F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b")) & _possible("n", "at", "m", "by", first=True) & ~F.arrays_overlap("prev", "prev_b"))


def links(fps: DataFrame, first: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all sets with a similarity of 4/5 or more; ``first`` has a row of ``fps`` for each."""
    texts = fps.select("_fp", F.col("row.text").cast("string").alias("text"))
    shared = store(buckets(prefixes(texts, levels(texts))))
    low, high = F.least("_fp", "hub").alias("a"), F.greatest("_fp", "hub").alias("b")
    some = store(shared.where((F.col("_fp") != F.col("hub")) & _possible("n", "at", "m", "by")).select(low, high, F.col("hub").alias("g"), (F.col("n") + F.col("m")).alias("all"))
                 .dropDuplicates(["a", "b"]))
    near = store(similar(fps, first, some))
    rooted = shared.select("token", "_fp", "n", "at").join(_roots(near), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    split = rooted.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"))
    rest = meetings(rooted.join(split.where("lo < hi and c > 2").select("token", "c"), "token"))
    # pairs that still meet in several buckets are compared in the largest, where most others are
    rest = rest.groupBy("a", "b").agg(F.max_by("token", F.struct("c", "token")).alias("g"), F.max(F.col("n") + F.col("m")).alias("all"))
    rest = store(rest.join(some, ["a", "b"], "left_anti"))
    return near.unionByName(similar(fps, first, rest))


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; of each component the row with the smallest doc_id (nulls last) stays."""
    tagged = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"),
                         F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.monotonically_increasing_id().alias("k")).alias("_tag"))
    fps = store(digests(tagged).drop("text")).withColumn("_k", F.col("_tag.k"))
    first = store(fps.groupBy("_fp").agg(F.min("_tag").alias("_tag"), F.first("_bits").alias("_bits")))
    comp = _roots(store(links(fps, first)))
    rooted = first.join(comp, "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    best = rooted.groupBy("root").agg(F.min("_tag").alias("_tag")).select(F.col("_tag.k").alias("_k"))
    return fps.join(best, "_k", "left_semi").select("row.*")
