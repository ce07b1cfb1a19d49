"""Registered queries of the text operators, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_two_fit, cost_balanced, crf_pii, huffman_ids, license_scan, line_frequency, mil_quality, ppm, pu_toxicity, qgram_leaks, rns_negatives, simhash, token_links
from .common import fold, table

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.scores(table(spark, sf_dir, "documents"), ~fold(7, 2))
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(5, 0)
    model = mil_quality.train(docs, table(spark, sf_dir, "labels"), ~held)
    scored = mil_quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= mil_quality.OPERATE).cast("int").alias("predicted"))


def op5_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = huffman_ids.huffman_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2)
    return huffman_ids.read(spark, path, with_ids=False)


def op6_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return crf_pii.scan(docs, crf_pii.train(docs))


def op7_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = fold(3, 1)
    model = pu_toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    scored = pu_toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= pu_toxicity.OPERATE).cast("int").alias("predicted"))


def op8_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_two_fit.best_two_fit(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.rules(table(spark, sf_dir, "documents"))


def op10_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram_leaks.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_rns_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    return rns_negatives.mine(rows, F.col("id") % 100 == 0)


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.links(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op13_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = cost_balanced.cost_balanced(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_ppm_scores": op3_ppm_scores,
    "op4_mil_quality": op4_mil_quality,
    "op5_huffman_ids": op5_huffman_ids,
    "op6_crf_pii": op6_crf_pii,
    "op7_pu_toxicity": op7_pu_toxicity,
    "op8_best_two_fit_packing": op8_best_two_fit_packing,
    "op9_line_frequency_rules": op9_line_frequency_rules,
    "op10_qgram_decontamination": op10_qgram_decontamination,
    "op11_rns_hard_negatives": op11_rns_hard_negatives,
    "op12_token_links": op12_token_links,
    "op13_cost_balanced_packing": op13_cost_balanced_packing,
}
_WS = "[ \\t\\n\\x0B\\f\\r]+"
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Windows and lines are compared as texts here, by hash in the operator.
LINE_FREQUENCY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '') AS w FROM d),
spans AS (SELECT rid, i, array_to_string(w[i:i + {line_frequency.WINDOW - 1}], ' ') AS span
          FROM (SELECT rid, w, unnest(range(1, len(w) - {line_frequency.WINDOW - 2})) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, span) AS n FROM spans) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT rid, unnest(range(i, i + {line_frequency.WINDOW})) AS p FROM twice) GROUP BY rid),
line AS (SELECT rid, doc_id, source, trim(line, {_TRIM}) AS line, line AS raw FROM (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
lines AS (SELECT *, regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{_WS}', ' ', 'g') AS k,
          len(regexp_split_to_array(line, '{_WS}')) AS n FROM line WHERE line <> ''),
dups AS (SELECT rid, count(*) - count(DISTINCT raw) AS n_dup_lines FROM lines GROUP BY rid),
common AS (SELECT source, k FROM lines GROUP BY source, k HAVING count(DISTINCT coalesce('d' || doc_id, 'r' || rid)) > {line_frequency.LINE_LIMIT}),
lost AS (SELECT rid, sum(n) AS n_removed_words FROM lines SEMI JOIN common ON lines.k = common.k AND lines.source IS NOT DISTINCT FROM common.source GROUP BY rid),
counts AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS n_removed_words
           FROM w LEFT JOIN repeats USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN lost USING (rid)),
judged AS (SELECT *, n_words < {line_frequency.MIN_WORDS} OR 100 * n_repeat_words > {line_frequency.MAX_REPEAT} * n_words AS base_failed FROM counts)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n_removed_words <= {line_frequency.DEPLETED}e0 * n_words AS kept, CAST(n_removed_words AS BIGINT) AS n_removed_words
FROM judged
"""

#: Rows numbered, so that an anchor leaves out just itself.
HARD_NEGATIVES_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label AS anchor_label, e.vec_id, e.label, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
      FROM a, e WHERE a.r <> e.r),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS nth FROM s WHERE label = anchor_label),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.vec_id) AS rank,
             s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.anchor = s.anchor AND s.label <> s.anchor_label AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
      WHERE p.nth <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op11_rns_hard_negatives": HARD_NEGATIVES_SQL,
    "op9_line_frequency_rules": LINE_FREQUENCY_SQL,
}
