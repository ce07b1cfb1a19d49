"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the document has a
label.  Every passage is encoded from the shapes, affixes and repetition of its
words, a gated attention weighs the encodings, and a linear score reads the
weighted mean.  Weights of all three parts are learned together from document
labels by Adam.

Only fitting uses a bounded sample (``ROWS`` labelled rows, chosen by a hash of
the id); scoring covers every passage of every row.

Nulls, empties, ties: a null or empty text is one empty passage and gets a
score; equal texts score equally; a null id never trains and counts as held out (as the
empty text does); an empty table gives no rows; without labels all scores are one half; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of, with_columns, words_of

PASSAGE = 64
HASHED, DENSE = 96, 12
WIDTH = HASHED + DENSE
CODE, GATE = 24, 12
ROWS = 2500
#: The score at which a document counts as good.
OPERATE = 0.3


_EDGE = b".,;:!?\"'()"
_DIGITS = b"0123456789"
_LETTERS = bytes(c for c in range(256) if c > 127 or chr(c).isalpha())
_SHAPE = bytes(120 if c > 127 or chr(c).islower() else 88 if chr(c).isupper() else 57 if chr(c).isdigit() else c for c in range(256))


def word_table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per word two hashed buckets (shape, ending) and its dense marks."""
    buckets, dense, known = [], [], {}
    for w in words:
        n, core = len(w), w.strip(_EDGE)
        rest = core.translate(None, _LETTERS)
        upper = core.isupper() and len(core) - len(rest) > 1
        if rest:
            marks = len(rest.translate(None, _DIGITS))
            digits = len(rest) - marks
            shape = core[-6:].translate(_SHAPE)
        else:
            marks = digits = 0
            shape = b"X" if upper else b"Xx" if core[:1].isupper() else b"x" if core else b""
        tail = w[len(core):] if w.startswith(core) else b"?"
        key = shape, tail or w[-2:]
        pair = known.get(key)
        if pair is None:
            pair = known[key] = zlib.crc32(b"s" + shape) % HASHED, zlib.crc32(b"e" + key[1]) % HASHED
        buckets.append(pair)
        m = n or 1
        dense.append((upper, marks / m, digits / m, not core, n > 16, n < 3, min(len(tail), 3) / 3, min(n, 30) / 30))
    buckets, dense = np.array(buckets, np.int64).reshape(-1, 2), np.array(dense, float).reshape(-1, 8)
    return buckets, dense


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of all texts, and the passages' offsets; a text without words has one empty passage."""
    codes, words, offsets = words_of(texts, lower=False)
    buckets, dense = word_table(words)
    n = np.diff(offsets)
    count = np.maximum(1, -(-n // PASSAGE))
    bounds = np.concatenate(([0], np.cumsum(count)))
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(codes)) - offsets[row]
    owner = bounds[row] + inside // PASSAGE
    size = np.bincount(owner, minlength=bounds[-1]).astype(float)
    out = np.zeros((bounds[-1], WIDTH))
    total = np.maximum(size, 1)[:, None]
    for j in range(2):
        out[:, :HASHED] += np.bincount(owner * HASHED + buckets[codes, j], minlength=bounds[-1] * HASHED).reshape(-1, HASHED)
    for j in range(8):
        out[:, HASHED + j] = np.bincount(owner, dense[codes, j], bounds[-1])
    for lag, j in ((1, 8), (2, 9)):
        same = np.zeros(len(codes))
        same[lag:] = (codes[lag:] == codes[:-lag]) & (owner[lag:] == owner[:-lag])
        out[:, HASHED + j] = np.bincount(owner, same, bounds[-1])
    out = np.sqrt(out / total)
    out[:, HASHED + 10] = size < 8
    out[:, HASHED + 11] = np.repeat(np.log1p(n) / 10, count)
    return out, bounds


@dataclass
class Model:
    params: list  # encoder, gates, read-out
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _forward(self.params, (x - self.mean) / self.scale, bounds)[0]


def _forward(p: list, x: np.ndarray, bounds: np.ndarray):
    we, be, v, u, a, r, b = p
    h = np.tanh(x @ we + be)
    tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    e = (tv * su) @ a
    n = np.diff(bounds)
    e = e - np.repeat(np.maximum.reduceat(e, bounds[:-1]), n)
    w = np.exp(e)
    w = w / np.repeat(np.add.reduceat(w, bounds[:-1]), n)
    z = np.add.reduceat(h * w[:, None], bounds[:-1], axis=0)
    return z @ r + b, h, tv, su, w, z, n


def fit(texts: list[str], labels: list[int], epochs: int = 10, rate: float = 0.01, seed: int = 3) -> Model:
    """Logistic loss over documents; gradients through read-out, attention and encoder."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, float)
    params = [rng.normal(0, 0.15, (WIDTH, CODE)), np.zeros(CODE), rng.normal(0, 0.3, (CODE, GATE)), rng.normal(0, 0.3, (CODE, GATE)),
              rng.normal(0, 0.3, GATE), np.zeros(CODE), np.zeros(())]
    if not len(y):
        return Model(params, np.zeros(WIDTH), np.ones(WIDTH))
    x, bounds = passages(pa.array(texts, pa.large_string()))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    x = (x - mean) / scale
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    size = int(np.clip(len(y) // 20, 8, 64))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), size):
            rows = np.sort(order[lo:lo + size])
            k = np.diff(bounds)[rows]
            at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in rows])
            off = np.concatenate(([0], np.cumsum(k)))
            xb = x[at]
            we, be, v, u, a, r, b = params
            logit, h, tv, su, w, z, n = _forward(params, xb, off)
            g = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
            gz = np.repeat(g[:, None] * r, n, axis=0)
            gw = (gz * h).sum(axis=1)
            ge = w * (gw - np.repeat(np.add.reduceat(gw * w, off[:-1]), n))
            gt = ge[:, None] * a
            gv, gu = gt * su * (1 - tv * tv), gt * tv * su * (1 - su)
            gh = gz * w[:, None] + gv @ v.T + gu @ u.T
            gx = gh * (1 - h * h)
            grads = [xb.T @ gx + 1e-4 * we, gx.sum(axis=0), h.T @ gv, h.T @ gu, (tv * su).T @ ge, z.T @ g + 1e-4 * r, g.sum()]
            step += 1
            for i, (p, d, (m1, m2)) in enumerate(zip(params, grads, moments)):
                m1[...] = 0.9 * m1 + 0.1 * d
                m2[...] = 0.99 * m2 + 0.01 * d * d
                params[i] = p - rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    return Model(params, mean, scale)


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = ROWS) -> Model:
    """A model from at most ``rows`` labelled documents for which ``learn`` holds."""
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chance = F.xxhash64(F.lit(23), "doc_id")
    chosen = F.broadcast(known.orderBy(chance, "doc_id").limit(rows))  # at most ``rows`` ids
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(chosen, "doc_id").orderBy("doc_id").limit(2 * rows).collect()
    return fit([r["text"] for r in found], [r["quality"] for r in found])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The columns of ``docs`` and the score, 0 to 1."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            out = np.zeros(len(texts))
            for lo, hi in slices(texts):
                out[lo:hi] = model.logits(*passages(texts.slice(lo, hi - lo)))
            yield with_columns(batch, **{name: pa.array(1 / (1 + np.exp(-np.clip(out, -60, 60))))})

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != name), f"`{name}` double"])
    return docs.drop(name).mapInArrow(run, schema)
