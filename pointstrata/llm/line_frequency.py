"""Quality rules from counts within a document and line frequency across documents, in built-in functions only.

A line is normalised (lower case, digits as 0, single spaces) and hashed; per
host and line the distinct documents that hold it are counted.  Lines above the
limit of a host are removed, and a document that loses too large a share of its
words is rejected.  ``rules`` gives counts and verdicts, ``cleaned`` the texts
that remain.

The counts within a document run over arrays inside its row and never shuffle
text; only (host, line hash) pairs are shuffled, pre-aggregated, and come back
to rows by a row tag.

Nulls, empties, ties: a null text has no words and fails the base rules; an
empty table gives no rows; a null host is a host of its own; rows of one doc_id
count as one document, each row without an id as one of its own; equal rows are
judged each on its own with equal results; extra columns are ignored by
``rules`` and kept by ``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

#: White space that separates words: space and the control characters from tab to carriage return.
SPACE = " \t\n\x0b\f\r"
_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30  # per cent of the words
#: A line is boilerplate where more documents of a host have it, and a document is depleted when this share of its words is gone.
LINE_LIMIT = 20
DEPLETED = 0.6


def words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; ``text`` must not be null."""
    n, w = F.size("_w"), F.col("_w")
    df = docs.withColumn("_w", words(F.col("text")))
    spans = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
    df = df.withColumn("_h", F.coalesce(spans, F.array().cast("array<bigint>")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "")
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
        "_lines": lines,
    })
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # windows that occur twice: neighbours in hash order; only texts that have some pay for the sort
    h = F.col("_h")
    ordered = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.withColumn("_s", ordered)
    s = F.col("_s")
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    df = df.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    at = F.col("_at")
    covered = F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))),
                          F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return df.drop("_w", "_h", "_s", "_at")


def line_key(line: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(line, F.lit(SPACE))), "[0-9]", "0"), _SPLIT, " ")
    return F.xxhash64(plain)


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE)) == ""


def _above(rows: DataFrame, line_limit: int) -> DataFrame:
    """_row, k, n, at: the lines above their host's limit, their words and places in each row of (_row, doc_id, _host, _keys)."""
    lines = rows.select("_row", "doc_id", "_host", F.posexplode("_keys").alias("i", "x")).where("x.n > 0")
    lines = lines.groupBy("_row", "doc_id", "_host", F.col("x.k").alias("k")).agg(F.sum("x.n").alias("n"), F.collect_list("i").alias("at"))
    holders = lines.select("_host", "k", "doc_id", F.when(F.isnull("doc_id"), F.col("_row")).alias("_only")).distinct()
    common = holders.groupBy("_host", "k").agg(F.count("*").alias("documents")).where(F.col("documents") > line_limit)
    host = [F.coalesce("_host", F.lit("")).alias("_h1"), F.isnull("_host").alias("_h2")]
    return lines.select("_row", "k", "n", "at", *host).join(common.select(*host, "k"), ["_h1", "_h2", "k"], "left_semi").select("_row", "k", "n", "at")


def _keyed(lines: Column) -> Column:
    """Hash and number of words of every line; a line without words has none of either."""
    return F.transform(lines, lambda x: F.struct(
        line_key(x).alias("k"), F.when(_blank(x), 0).otherwise(F.size(F.split(F.trim(x, F.lit(SPACE)), _SPLIT))).alias("n")))


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def _rows(docs: DataFrame, host: str) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("_host"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]


def rules(docs: DataFrame, host: str = "source", line_limit: int = LINE_LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words."""
    df = with_counts(docs.select(*_rows(docs, host)))
    df = store(df.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "_host", "n_words", "word_chars", "n_symbols",
                         "n_dup_lines", "n_repeat_words", _keyed(F.col("_lines")).alias("_keys")))
    lost = _above(df, line_limit).groupBy("_row").agg(F.sum("n").alias("n_removed_words"))
    out = df.join(lost, "_row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    keep = ~_failed() & (F.col("n_removed_words") <= depleted * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"),
                      keep.alias("kept"), "n_removed_words")


def cleaned(docs: DataFrame, host: str = "source", line_limit: int = LINE_LIMIT, depleted: float = DEPLETED) -> DataFrame:
    """The rows of ``docs`` that the rules keep, their texts without the lines above the limit."""
    names = docs.columns
    own = F.struct(*(F.col(f"`{n}`") for n in names)).alias("_own")
    df = with_counts(docs.select(own, *_rows(docs, host)))
    df = store(df.select(F.monotonically_increasing_id().alias("_row"), "_own", "doc_id", "_host", "n_words", "n_repeat_words",
                         _keyed(F.split("text", "\n")).alias("_keys")))
    gone = _above(df, line_limit).groupBy("_row").agg(F.sum("n").alias("_lost"), F.flatten(F.collect_list("at")).alias("_gone"))
    out = df.where(~_failed()).join(gone, "_row", "left").where(F.coalesce("_lost", F.lit(0)) <= depleted * F.col("n_words"))
    lines = F.split("_own.text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.get(lines, i))
    text = F.when(F.isnull("_gone"), F.col("_own.text")).otherwise(F.array_join(left, "\n"))
    return out.select(*(text.alias(n) if n == "text" else F.col(f"_own.`{n}`").alias(n) for n in names))
