"""Token ids as canonical, length-limited Huffman codes in independent blocks.

Layout of a set of files under one folder: ``codebook`` (id, bits) is all a
reader needs to rebuild the codes; ``blocks`` holds one row per block of about
``BLOCK_IDS`` ids.  A document's codes start at a byte; every ``MARK`` ids a
checkpoint keeps the bit offset within the document, so that a reader decodes
all stretches of a block at the same time, each step of all of them by one table
lookup.  Blocks need nothing from each other.  Buckets are ranges of ``doc_id``;
(bucket, block, place in the block) is ascending order of ``doc_id``.

Nulls, empties, ties: a null text is an empty one and has just its end id; a
null ``doc_id`` comes first; rows with equal ``doc_id`` follow each other in an
order fixed by their ids; an empty table gives a codebook and blocks without
rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import ragged, slices, store, sums, texts_of, unchunked
from .tokens import encoder, with_end

MAX_BITS = 18
MARK = 256
BLOCK_IDS = 1 << 20
BUCKET_IDS = 1 << 22
KIND = "<u4"


# ---- code ------------------------------------------------------------------

def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    ids = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(ids) > 1 << limit:
        raise ValueError("too many ids for this length limit")
    if len(ids) < 2:
        out[ids] = 1
        return out
    order = ids[np.argsort(counts[ids], kind="stable")]
    leaf = counts[order].astype(np.int64)
    packages, levels = np.zeros(0, np.int64), []
    for _ in range(limit):
        both = np.concatenate((leaf, packages))
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(leaf))
        both = both[rank][:len(both) // 2 * 2]
        packages = both[0::2] + both[1::2]
    take, length = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical(length: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    code = np.zeros(len(length), np.uint64)
    used = np.flatnonzero(length)
    order = used[np.lexsort((used, length[used]))]
    n = length[order]
    value = 0
    for bits in range(1, int(n.max(initial=0)) + 1):
        here = order[n == bits]
        code[here] = value + np.arange(len(here), dtype=np.uint64)
        value = (value + len(here)) << 1
    return code


def decode_table(length: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, int]:
    """For every window of ``width`` bits the id that starts it and its bits, as id * 32 + bits."""
    width = int(length.max(initial=1))
    table = np.zeros(1 << width, np.int64)
    used = np.flatnonzero(length)
    span = np.left_shift(1, width - length[used])
    table[ragged((code[used].astype(np.int64) << (width - length[used])), span)] = np.repeat(used * 32 + length[used], span)
    return table, width


def encode(ids: np.ndarray, offsets: np.ndarray, length: np.ndarray, code: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Per document its code bytes and its checkpoints (bit offsets as 32-bit numbers)."""
    docs = len(offsets) - 1
    bits = length[ids]
    n = np.diff(offsets)
    row = np.repeat(np.arange(docs), n)
    size = -(-sums(bits, offsets) // 8)
    begin = 8 * (np.cumsum(size) - size)
    running = np.concatenate(([0], np.cumsum(bits)))
    inside = running[:-1] - running[offsets[:-1]][row]
    at = begin[row] + inside
    word, room = at >> 6, 64 - (at & 63)
    value = code[ids]
    over = bits - room  # bits that do not fit this word
    fits = over <= 0
    high = np.where(fits, value << np.maximum(-over, 0).astype(np.uint64), value >> np.maximum(over, 0).astype(np.uint64))
    out = np.zeros(int(size.sum()) // 8 + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(high, first)
        spill = np.flatnonzero(~fits)
        out[word[spill] + 1] |= value[spill] << (64 - over[spill]).astype(np.uint64)
    raw = out.byteswap().tobytes()
    start = (begin // 8).tolist()
    payload = [raw[a:a + k] for a, k in zip(start, size.tolist())]
    marks = inside.astype("<u4")
    return payload, [marks[a:b:MARK].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def decode(payload: bytes, starts: np.ndarray, counts: np.ndarray, marks: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Ids of a block: byte ``starts`` and id ``counts`` of its documents, all their checkpoints in turn."""
    lanes = -(-counts // MARK)
    doc = np.repeat(np.arange(len(counts)), lanes)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    todo = np.minimum(MARK, counts[doc] - part * MARK)
    first = (np.cumsum(counts) - counts)[doc] + part * MARK
    at = starts[doc] * 8 + marks.astype(np.int64)
    order = np.argsort(-todo, kind="stable")
    todo, first, at = todo[order], first[order], at[order]
    data = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    out = np.empty(int(counts.sum()), KIND)
    mask = (1 << width) - 1
    alive = np.searchsorted(-todo, -np.arange(int(todo.max(initial=0))), side="left")
    for t, live in enumerate(alive.tolist()):
        p = at[:live]
        entry = table[(window[p >> 3].astype(np.int64) >> (32 - width - (p & 7))) & mask]
        out[first[:live] + t] = entry >> 5
        p += entry & 31
    return out


# ---- files -----------------------------------------------------------------

def token_ids(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = True) -> DataFrame:
    """doc_id and ids (little-endian, 16 bits where the vocabulary allows) of every row."""

    def run(batches):
        enc = encoder(tokenizer, spaced)
        for batch in batches:
            texts, doc = texts_of(batch), unchunked(batch.column(0))
            for lo, hi in slices(texts):
                ids, off = with_end(*enc.encode(texts.slice(lo, hi - lo)), end_id)
                raw, width = ids.tobytes(), 4
                if not len(ids) or ids.max() < 1 << 16:
                    raw, width = ids.astype("<u2").tobytes(), 2
                cut = (off * width).tolist()
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(lo, hi - lo), pa.array(np.full(hi - lo, width, np.int32)), pa.array([raw[a:b] for a, b in zip(cut, cut[1:])], pa.binary())],
                    names=["doc_id", "width", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, width int, ids binary")


def _ids(batch: pa.RecordBatch, width: str = "width", ids: str = "ids") -> tuple[np.ndarray, np.ndarray]:
    names = batch.schema.names
    w, raw = (unchunked(batch.column(names.index(c))) for c in (width, ids))
    kinds = w.to_numpy(zero_copy_only=False)
    n = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = raw.to_pylist()
    if len(kinds) and (kinds == kinds[0]).all():
        out = np.frombuffer(b"".join(parts), f"<u{kinds[0]}").astype(KIND)
    else:
        out = np.concatenate([np.zeros(0, KIND), *(np.frombuffer(p, f"<u{k}").astype(KIND) for p, k in zip(parts, kinds))])
    return out, np.concatenate(([0], np.cumsum(n // np.maximum(kinds, 1))))


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over all rows, counted per task first."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(_ids(batch)[0])
            if len(n) > len(total):
                n[:len(total)] += total
                total = n
            else:
                total[:len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return ids.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _split(batch: pa.RecordBatch, limit: int = 8 << 20):
    for lo, hi in slices(unchunked(batch.column(batch.schema.names.index("ids"))), limit):
        yield batch.slice(lo, hi - lo)


def write(ids: DataFrame, path: str, max_bits: int = MAX_BITS) -> None:
    """Files of a stored table of ``token_ids`` under ``path``."""
    spark = ids.sparkSession
    found = id_counts(ids).collect()  # as many rows as the vocabulary has ids in use
    counts = np.zeros(1 + max((r["id"] for r in found), default=0), np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    length = code_lengths(counts, max_bits)
    code = canonical(length)
    used = np.flatnonzero(length)
    spark.createDataFrame([(int(i), int(length[i])) for i in used], "id long, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    buckets = max(1, -(-int(counts.sum()) // BUCKET_IDS))
    ask = F.percentile_approx("doc_id", F.lit([k / buckets for k in range(1, buckets)] or [0.5]), max(10_000, 10 * buckets))
    bounds = np.unique(np.array(ids.agg(ask.alias("b")).first()["b"] or [], np.int64))[:buckets - 1]

    def pack(batches):
        for whole in batches:
            for batch in _split(whole):
                flat, off = _ids(batch)
                payload, marks = encode(flat, off, length, code)
                doc = unchunked(batch.column(0))
                known = pc.is_valid(doc).to_numpy(zero_copy_only=False)
                bucket = np.where(known, np.searchsorted(bounds, pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), side="left"), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.astype(np.int32)), doc, pa.array(np.diff(off)), pa.array(payload, pa.binary()), pa.array(marks, pa.binary())],
                    names=["bucket", "doc_id", "n", "payload", "marks"])

    def assemble(batches):
        rows, first, block, bucket, held = [], 0, 0, None, 0

        def flush():
            sizes = [len(r["payload"]) for r in rows]
            return pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([[r["doc_id"] for r in rows]], pa.list_(pa.int64())), pa.array([[r["n"] for r in rows]], pa.list_(pa.int64())),
                 pa.array([np.cumsum([0, *sizes[:-1]]).tolist()], pa.list_(pa.int64())),
                 pa.array([b"".join(r["payload"] for r in rows)], pa.binary()), pa.array([b"".join(r["marks"] for r in rows)], pa.binary())],
                names=["bucket", "block", "first", "n_ids", "doc_ids", "counts", "starts", "payload", "marks"])

        for batch in batches:
            for r in batch.to_pylist():
                if rows and (r["bucket"] != bucket or held + r["n"] > BLOCK_IDS):
                    yield flush()
                    first, block, rows, held = (first + held, block + 1, [], 0) if r["bucket"] == bucket else (0, 0, [], 0)
                bucket = r["bucket"]
                rows.append(r)
                held += r["n"]
        if rows:
            yield flush()

    packed = ids.mapInArrow(pack, "bucket int, doc_id long, n long, payload binary, marks binary")
    packed = packed.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "n", "payload")
    packed.mapInArrow(assemble, "bucket int, block int, first long, n_ids long, doc_ids array<long>, counts array<long>, starts array<long>, "
                      "payload binary, marks binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless declined, ids (32 bits, little-endian)."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # one row per id in use
    length = np.zeros(1 + max((r["id"] for r in book), default=0), np.int64)
    for r in book:
        length[r["id"]] = r["bits"]
    table, width = decode_table(length, canonical(length))
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.array(r["counts"], np.int64)
                flat = decode(r["payload"], np.array(r["starts"], np.int64), counts, np.frombuffer(r["marks"], "<u4"), table, width)
                off = np.concatenate(([0], np.cumsum(counts)))
                raw = flat.tobytes()
                ids = [raw[4 * a:4 * b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), r["bucket"], np.int32)), pa.array(r["doc_ids"], pa.int64()), pa.array(off[:-1] + r["first"]),
                     pa.array(counts), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids if with_ids else [None] * len(ids), pa.binary())],
                    names=["bucket", "doc_id", "first", "n_tokens", "ids_crc32", "ids"])

    rows = blocks.mapInArrow(run, "bucket int, doc_id long, first long, n_tokens long, ids_crc32 long, ids binary")
    size = blocks.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = size.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row per bucket
    return rows.join(base, "bucket").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def huffman_files(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool = True, path: str | None = None) -> str:
    """Tokenizes ``docs`` and writes the files; returns their folder."""
    path = path or f"{ensure_checkpoint_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write(store(token_ids(docs, tokenizer, end_id, spaced)), path)
    return path
