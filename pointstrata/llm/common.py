"""Helpers shared by the text operators.

Texts reach Python in Arrow batches.  A batch may hold few very long texts or
many short ones, so every kernel works on slices of bounded size in bytes; a
text is never cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SLICE_BYTES = 4 << 20


def store(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` once into the shared checkpoint folder and reads it back.

    What follows survives lost executors without doing this work again, and
    values that depend on the layout of tasks (row tags, ranks) are fixed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int, remainder: int, col: str = "doc_id"):
    """True where crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def unchunked(col) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        return col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col


def texts_of(batch: pa.RecordBatch, col: str = "text") -> pa.Array:
    """The text column as large strings, null as empty."""
    a = unchunked(batch.column(batch.schema.get_field_index(col)))
    return pc.fill_null(a.cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text makes a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """White-space separated words: code per word, the distinct words, first word of each text (and the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    first = np.asarray(lists.offsets).astype(np.int64)
    flat = lists.values.slice(first[0], first[-1] - first[0]).dictionary_encode()
    first -= first[0]
    codes, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in words:  # what white space at the ends of a text leaves
        gone = words.index(b"")
        keep = codes != gone
        first = np.concatenate(([0], np.cumsum(keep)))[first]
        codes = codes[keep]
        codes -= codes > gone
        del words[gone]
    return codes, words, first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[i] … starts[i] + lengths[i] - 1 for all i, one after the other."""
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for all i; 0 for an empty range."""
    c = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return c[offsets[1:]] - c[offsets[:-1]]


def with_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """The batch with columns replaced or appended."""
    cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | new
    return pa.RecordBatch.from_arrays([unchunked(c) for c in cols.values()], names=list(cols))
