"""Awkward documents that every operator must take, and helpers of the tests."""

import zlib

from pyspark.sql import functions as F

LONG = ("lorem ipsum dolor " * 12_000) + "x" * 60_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, " \n\t \r\n", "de", "b", 6),
    (None, "A row without an id but with some words in it for good measure.", "en", None, 60),
    (None, None, None, None, None),
    (5, LONG, "en", "a", len(LONG)),
    (6, "same text twice in the table", "fr", "b", 28),
    (7, "same text twice in the table", "fr", "b", 28),
    (7, "same text twice in the table", "fr", "b", 28),
    (8, "Ünïcödé wörds — “quotes” 日本語 \U0001f600 end of line", "xx", "c", 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    """The rows with further columns whose names operators use themselves."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("mine") for c in ("_fp", "_tag", "row", "part", "rank", "length", "ids", "bucket", "block", "gram", "word", "n",
                                                      "_w", "_h", "_row", "_host", "_text", "train", "held_out", "item_id", "spans")})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rest(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def key(rows):
    return sorted(map(repr, rows))
