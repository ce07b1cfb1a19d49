"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` symbols, held as tables of
(context and next symbol, count): a symbol is predicted in the longest context
that was seen, and where it did not occur there the model escapes (method C:
distinct symbols over occurrences plus distinct symbols) to the next shorter
one, with the symbols of the longer one excluded.  Beside the 256 bytes there is
one mark for the ends of a document, so a score is the log10 probability of the
whole text.

The trie grows with the corpus, so it is never gathered in one place.  Documents
are dealt to blocks of about ``BLOCK_BYTES``; each block reports the grams and
words it holds with their counts in training documents, counts are summed by
key, probabilities are computed by joins and windows that hold at most 257 rows
a context, and each block gets back just the rows it asked for.

Nulls, empties, ties: a null or empty text consists of its end; a null id is not
held out and trains; repeated rows count and score each; without training rows
every symbol has probability 1/257; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ragged, slices, store, sums, texts_of, unchunked, words_of

ORDER = 5
BITS = 9
END = 256
BLOCK_BYTES = 24 << 20
SLICE = 1 << 20
PACK_ROWS = 400_000


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every prediction in all texts, and the texts' offsets; contexts start with end marks."""
    n = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(n + order + 1) - (n + order + 1)
    s = np.full(int((n + order + 1).sum()) + 1, END, np.int64)
    s[ragged(start + order, n)] = np.frombuffer(b"".join(texts), np.uint8)
    code = s[:len(s) - order].copy()
    for j in range(1, order + 1):
        code <<= BITS
        code |= s[j:len(s) - order + j]
    return code[ragged(start, n + 1)], np.concatenate(([0], np.cumsum(n + 1)))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([np.zeros(0), *counts]), len(key)).astype(np.int64)


# ---- blocks of documents ---------------------------------------------------

PACKED = "block int, data binary"


def packed(rows: DataFrame, count: int = 1) -> DataFrame:
    """(block, data): rows of one task that belong to one block, compressed together, after every ``count`` rows or more.

    A block's rows then travel and are sorted as few large values, not one by one.
    """
    def pieces(batch):
        if "text" not in batch.schema.names:
            return [batch] if batch.num_rows else []
        return (batch.slice(lo, hi - lo) for lo, hi in slices(texts_of(batch)))

    def deal(held):
        table = pa.Table.from_batches(held).combine_chunks()
        at = table.schema.get_field_index("block")
        block = table.column(at).to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
        ids, blobs = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = table.take(pa.array(order[a:b])).remove_column(at)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            ids.append(block[order[a]])
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "data"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in pieces(batch):
                held.append(part)
                n += part.num_rows
                if n >= count:
                    yield deal(held)
                    held, n = [], 0
            pa.default_memory_pool().release_unused()
        if held:
            yield deal(held)

    return rows.mapInArrow(run, PACKED)


def bundles(docs: DataFrame, learn: Column, blocks: int) -> DataFrame:
    """The documents, dealt to blocks by a hash and packed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(learn, F.lit(True)).alias("train"))
    return packed(rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")))


def unpacked(table: pa.Table):
    for data in table.column("data"):
        yield from pa.ipc.open_stream(data.as_buffer())


def _gathered(table: pa.Table):
    """The batches of a block, small ones put together."""
    held, size = [], 0
    for batch in unpacked(table):
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _parts(table: pa.Table):
    """(doc ids, texts as Arrow, texts as bytes, training flags) of bounded slices of a block."""
    for batch in _gathered(table):
        texts, train = texts_of(batch), unchunked(batch.column(2)).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi in slices(texts, SLICE):
            part = texts.slice(lo, hi - lo)
            yield unchunked(batch.column(0)).slice(lo, hi - lo), part, part.cast(pa.large_binary()).to_pylist(), train[lo:hi]


ASKED = "block int, gram long, word binary, n long"


def asked(parts: DataFrame, order: int = ORDER) -> DataFrame:
    """The grams and words of each block and how often training documents of the block have them."""

    def run(key, table):
        keys, counts, names_, known = [], [], [pa.array([], pa.binary())], [np.zeros(0)]
        for _, texts, raw, train in _parts(table):
            code, off = grams(raw, order)
            learn = np.repeat(train, np.diff(off))
            for side in (code[learn], code[~learn]):
                found, n = np.unique(side, return_counts=True)
                keys.append(found)
                counts.append(n if side.size and len(keys) % 2 else np.zeros(len(found), np.int64))
            if len(keys) > 16:
                k, c = _summed(keys, counts)
                keys, counts = [k, k[:0]], [c, c[:0]]
            codes, names, off = words_of(texts)
            names_.append(pa.array(names, pa.binary()))
            known.append(np.bincount(codes, np.repeat(train, np.diff(off)), len(names)))
        k, c = _summed(keys, counts)
        flat = pa.concat_arrays(names_).dictionary_encode()
        words = flat.dictionary
        n = np.bincount(flat.indices.to_numpy(zero_copy_only=False), np.concatenate(known), len(words)).astype(np.int64)
        out = pa.table({"block": np.full(len(k) + len(words), key[0].as_py(), np.int32),
                        "gram": pa.concat_arrays([pa.array(k), pa.nulls(len(words), pa.int64())]),
                        "word": pa.concat_arrays([pa.nulls(len(k), pa.binary()), words]), "n": np.concatenate((c, n))})
        pa.default_memory_pool().release_unused()
        return out

    return parts.groupBy("block").applyInArrow(run, ASKED)


class Lookup:
    """Values by key: one probe of a hash table, and a search in order where another key took the slot."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        by = np.argsort(key, kind="stable")
        self.key, self.value = key[by], value[by]
        self.shift = np.uint64(64 - max(4, int(4 * len(key)).bit_length()))
        self.slot = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slot[self._at(self.key)] = np.arange(len(key), dtype=np.int32)

    def _at(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self.slot[self._at(key)]
        miss = np.flatnonzero(self.key[at] != key)
        at[miss] = np.searchsorted(self.key, key[miss])
        return self.value[at]


# ---- probabilities ---------------------------------------------------------

def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp) from (gram, c), where c = 0 marks a gram that is only asked for.

    Going up from the empty context, each row carries ``s``, the log probability
    of its symbol if its context is the longest one seen, and ``v``, the same
    after an escape from here to the shorter context with exclusion.
    """
    def level(j: int) -> DataFrame:
        low = (1 << BITS * (j + 1)) - 1
        return counts.groupBy(F.col("gram").bitwiseAND(F.lit(low)).alias("gram")).agg(F.sum("c").alias("c"))

    seen = F.col("c") > 0
    n0, d0 = level(0).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(seen, 1))).first()
    uniform = -float(np.log10(max(1, END + 1 - d0)))
    row = level(0).select("gram", "c", F.lit(n0).alias("n"), F.lit(d0).cast("long").alias("d"), F.lit(uniform).alias("v"))
    row = row.withColumn("s", F.lit(uniform) if not n0 else F.when(seen, F.log10(F.col("c") / (n0 + d0))).otherwise(float(np.log10(d0 / (n0 + d0))) + F.col("v")))
    for j in range(1, order + 1):
        up = row.select(F.col("gram").alias("up"), *(F.col(x).alias(f"{x}1") for x in "cndvs"))
        row = level(j).withColumn("up", F.col("gram").bitwiseAND(F.lit((1 << BITS * j) - 1))).join(up, "up")
        here = W.partitionBy(F.shiftright("gram", BITS))
        row = row.withColumns({"n": F.sum("c").over(here), "d": F.count(F.when(seen, 1)).over(here),
                               "x": F.coalesce(F.sum(F.when(seen, F.col("c1"))).over(here), F.lit(0))})
        more = F.col("d1") - F.col("d")  # symbols of the shorter context that are not excluded
        rest = F.col("n1") - F.col("x") + more
        v = F.when(F.col("n") == 0, F.col("v1")).when(F.col("c1") > 0, F.log10("c1") - F.log10(rest)).when(
            more > 0, F.log10(more) - F.log10(rest) + F.col("v1")).otherwise(F.col("v1"))
        row = row.withColumn("v", v)
        both = F.col("n") + F.col("d")
        row = row.withColumn("s", F.when(seen, F.log10(F.col("c") / both)).when(F.col("n") == 0, F.col("s1")).otherwise(
            F.log10(F.col("d") / both) + F.col("v"))).select("gram", "c", "n", "d", "v", "s")
    return row.select("gram", F.col("s").alias("logp"))


def scores(docs: DataFrame, learn: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score (words), score (the trie's), for every row."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 1)).first()[0] or 0
    parts = bundles(docs, learn, max(1, -(-total // block_bytes)))
    held = store(asked(parts, order))
    counts = store(held.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("c")))
    logp = store(probabilities(counts, order))
    same = W.partitionBy("word")
    words = held.where("word is not null").select("block", "word", F.sum("n").over(same).alias("c"), F.min("block").over(same).alias("first"))
    words = store(words)
    n, v = words.where("block = first and c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = docs.where(F.coalesce(learn, F.lit(True))).count()  # every training document has one end
    n, v = n + ends, v + (ends > 0)
    floor, end_score = float(np.log10(n + v + 1)), float(np.log10(ends + 1))
    known = packed(held.where("gram is not null").join(logp, "gram").select("block", "gram", "logp"), PACK_ROWS)
    known = known.unionByName(packed(words.select("block", "word", "c"), PACK_ROWS))

    def run(key, left, right):
        grams_, values, names_, counts_ = [np.zeros(0, np.int64)], [np.zeros(0)], [pa.array([], pa.binary())], [np.zeros(0, np.int64)]
        for batch in unpacked(right):
            one, two = unchunked(batch.column(0)), unchunked(batch.column(1)).to_numpy(zero_copy_only=False)
            if batch.schema.names[0] == "gram":
                grams_.append(one.to_numpy(zero_copy_only=False))
                values.append(two)
            else:
                names_.append(one)
                counts_.append(two)
        code, value = np.concatenate(grams_), np.concatenate(values)
        word, count = pa.concat_arrays(names_), np.concatenate(counts_)
        logp_of = Lookup(code, value) if len(code) else None
        out = {x: [] for x in ("doc_id", "train", "n_tokens", "n_known", "base_score", "score")}
        for doc, texts, raw, train in _parts(left):
            found, off = grams(raw, order)
            score = sums(logp_of(found), off)
            codes, names, off = words_of(texts)
            c = count[pc.index_in(pa.array(names, pa.binary()), value_set=word).to_numpy(zero_copy_only=False).astype(np.int64)] if names else np.zeros(0, np.int64)
            tokens = np.diff(off) + 1
            out["doc_id"].append(doc)
            out["train"].append(pa.array(train))
            out["n_tokens"].append(pa.array(tokens))
            out["n_known"].append(pa.array(sums((c > 0).astype(np.int64)[codes], off) + (ends > 0)))
            out["base_score"].append(pa.array(sums(np.log10(c + 1.0)[codes], off) + end_score - tokens * floor))
            out["score"].append(pa.array(score))
        pa.default_memory_pool().release_unused()
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table({x: pa.concat_arrays(a) if a else pa.array([], t) for (x, a), t in zip(out.items(), kinds)})

    scored = parts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        run, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
