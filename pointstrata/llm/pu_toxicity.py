"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic texts and unlabelled ones (some of them
toxic as well).  With the class prior p, the risk of negatives is estimated as
R_u(-) - p R_p(-); where a batch makes it negative the step goes the other way,
so the fit cannot drive it below zero.  The model is linear over hashed words,
their first and last letters, averaged over a text's words and pooled with the
strongest words of the text, so that a long text does not hide a short insult.

Training rows are bounded samples (``positives`` and ``unlabelled`` below),
chosen by a hash of the id; everything else covers all rows.  The tasks turn the
sampled texts into word features; whole texts never reach the driver.

Nulls, empties, ties: a null or empty text scores by the bias alone; a null id
is not in the held-out fold and never trains; equal texts score equally; an
empty table or one without toxic labels scores the class prior everywhere;
extra columns are kept by ``score`` and ignored by the query.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ragged, slices, sums, texts_of, unchunked, with_columns, words_of

BUCKETS = 1 << 16
POSITIVES, UNLABELLED = 2500, 5000
TOP = 4
STEPS = 500  # of the fit at least
#: The score at which a text counts as toxic.
OPERATE = 0.7


def word_features(words: list[bytes]) -> np.ndarray:
    """Buckets of each word: whole, two prefixes, a suffix."""
    crc = zlib.crc32
    out = np.array([(crc(w), crc(b"^" + w[:4]), crc(b"^" + w[:5]), crc(b"$" + w[-4:])) for w in words], np.int64)
    return out.reshape(-1, 4) % BUCKETS


@dataclass
class Model:
    """Word weights and how the mean, the strongest words and the bias combine."""

    weights: np.ndarray
    mix: np.ndarray  # of the mean word score and of the mean of the TOP best
    bias: float

    def logits(self, codes: np.ndarray, features: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        value = self.weights[features].sum(axis=1) if len(features) else np.zeros(0)
        mean, top = pooled(value, codes, offsets)
        return self.mix[0] * mean + self.mix[1] * top + self.bias


def pooled(value: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean word score (over the root of the number of words) and the mean of its TOP best occurrences."""
    n = np.diff(offsets)
    v = value[codes]
    mean = sums(v, offsets) / np.sqrt(np.maximum(n, 1))
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((-v, row))
    k = np.minimum(n, TOP)
    best = v[order][ragged(offsets[:-1], k)]
    return mean, sums(best, np.concatenate(([0], np.cumsum(k)))) / TOP


def packed(texts: list[str]) -> list[bytes]:
    """Each text as the features of its words, four buckets of 16 bits in one number a word, compressed."""
    codes, words, offsets = words_of(pa.array(texts, pa.large_string()))
    number = word_features(words) @ (BUCKETS ** np.arange(4, dtype=np.uint64)).astype(np.int64)
    return [zlib.compress(number[codes[a:b]].tobytes(), 1) for a, b in zip(offsets[:-1], offsets[1:])]


def _bags(rows: list[bytes]):
    """Code per word, features of the distinct words, first word of each row (and the end)."""
    read = lambda row: np.frombuffer(zlib.decompress(row), np.int64)
    distinct = np.zeros(0, np.int64)
    for lo in range(0, len(rows), 500):
        distinct = np.unique(np.concatenate([distinct, *map(read, rows[lo:lo + 500])]))
    codes = [np.searchsorted(distinct, read(row)).astype(np.int32) for row in rows]
    offsets = np.concatenate(([0], np.cumsum([len(c) for c in codes])))
    features = (distinct[:, None] >> (16 * np.arange(4))) & (BUCKETS - 1)
    return np.concatenate(codes), features.astype(np.int32), offsets


def fit(positive: list[bytes], unlabelled: list[bytes], prior: float, epochs: int = 14, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam on the non-negative risk with the logistic loss, in shuffled batches of both kinds of ``packed`` rows."""
    if not positive or not unlabelled:
        return Model(np.zeros(BUCKETS), np.zeros(2), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    codes, features, offsets = _bags(positive + unlabelled)
    held_p, held_u = (np.flatnonzero(rng.random(len(x)) < 0.2) for x in (positive, unlabelled))
    n = np.diff(offsets)
    np_, total = len(positive), len(n)
    weights, extra = np.zeros(BUCKETS), np.array([1.0, 1.0, np.log(prior / (1 - prior))])
    moment = [[np.zeros(BUCKETS), np.zeros(BUCKETS)], [np.zeros(3), np.zeros(3)]]
    step, size = 0, int(np.clip(len(unlabelled) // 24, 32, 128))
    fit_p = np.setdiff1d(np.arange(np_), held_p if np_ >= 200 else [])
    fit_u = np.setdiff1d(np.arange(np_, total), held_u + np_)
    for _ in range(max(epochs, -(-STEPS * size // max(1, len(fit_u))))):
        p_order, u_order = rng.permutation(fit_p), rng.permutation(fit_u)
        for lo in range(0, len(u_order), size):
            u = u_order[lo:lo + size]
            p = p_order[np.arange(lo, lo + size // 2) % len(p_order)]
            rows = np.concatenate((p, u))
            at = ragged(offsets[rows], n[rows])
            off = np.concatenate(([0], np.cumsum(n[rows])))
            c = codes[at]
            value = weights[features].sum(axis=1)
            v = value[c]
            row = np.repeat(np.arange(len(rows)), n[rows])
            k = np.minimum(n[rows], TOP)
            best = np.lexsort((-v, row))[ragged(off[:-1], k)]
            root = np.sqrt(np.maximum(n[rows], 1))
            mean = sums(v, off) / root
            top = sums(v[best], np.concatenate(([0], np.cumsum(k)))) / TOP
            s = 1 / (1 + np.exp(-(extra[0] * mean + extra[1] * top + extra[2])))
            m = len(p)
            loss = -np.log(np.maximum(1 - s, 1e-12))  # logistic loss of calling a text clean
            g_neg = np.concatenate((-prior * s[:m] / m, s[m:] / len(u)))
            if loss[m:].mean() - prior * loss[:m].mean() >= 0:
                g = g_neg
                g[:m] -= prior * (1 - s[:m]) / m
            else:
                g = -g_neg
            gv = np.repeat(g * extra[0] / root, n[rows])
            gv[best] += np.repeat(g * extra[1] / TOP, k)
            gw = np.bincount(c, gv, len(features))
            touched = np.flatnonzero(gw)
            grad = np.bincount(features[touched].ravel(), np.repeat(gw[touched], features.shape[1]), BUCKETS)
            grads = grad + 1e-6 * weights, np.array([(g * mean).sum(), (g * top).sum(), g.sum()])
            step += 1
            for x, dx, (m1, m2), lr in ((weights, grads[0], moment[0], rate), (extra, grads[1], moment[1], rate)):
                m1 *= 0.9
                m1 += 0.1 * dx
                m2 *= 0.99
                m2 += 0.01 * dx * dx
                x -= lr * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-6)
            extra[:2] = np.maximum(extra[:2], 0.05)
    raw = Model(weights, extra[:2].copy(), float(extra[2]))
    z = np.concatenate([raw.logits(codes[offsets[i]:offsets[min(i + 500, total)]], features, offsets[i:i + 501] - offsets[i]) for i in range(0, total, 500)])
    z_p, z_u = (z[held_p], z[held_u + np_]) if np_ >= 200 else (z[:np_], z[np_:])  # with few positives none can be held out
    slope, shift = _calibrate(z_p, z_u, prior)
    at = _operating_point(slope * z_p + shift, slope * z[np_:] + shift, prior)
    shift += np.log(OPERATE / (1 - OPERATE)) - at
    return Model(weights, raw.mix * slope, raw.bias * slope + shift)


def _operating_point(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> float:
    """The logit with the best F1 as far as positives and unlabelled texts tell: recall from the former,
    the share called toxic from the latter.  Among equally good ones rather the strict ones."""
    default = float(np.log(OPERATE / (1 - OPERATE)))
    if len(z_p) < 10 or len(z_u) < 10:
        return default
    cuts = np.unique(np.concatenate((z_p, z_u)))
    recall = 1 - np.searchsorted(np.sort(z_p), cuts) / len(z_p)
    called = 1 - np.searchsorted(np.sort(z_u), cuts) / len(z_u)
    f1 = 2 * prior * recall / (prior + np.maximum(called, prior * recall))
    good = cuts[f1 >= f1.max() - 0.005]
    return float((good[0] + 2 * good[-1]) / 3)


def _calibrate(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift that make a sigmoid of the logits a posterior, by Newton steps on the same corrected
    risk; with the logistic loss it is prior * mean(-z) over positives plus mean(log(1 + e^z)) over unlabelled."""
    if len(z_p) < 10 or len(z_u) < 10:
        return 1.0, 0.0
    goal, theta = prior * np.array([z_p.mean(), 1.0]), np.array([1.0, 0.0])

    def risk(t):
        return np.logaddexp(0, z_u * t[0] + t[1]).mean() - (goal * t).sum() + 1e-3 * (t[0] - 1) ** 2

    for _ in range(100):
        s = 1 / (1 + np.exp(-(z_u * theta[0] + theta[1])))
        w = s * (1 - s)
        g = np.array([(z_u * s).mean() + 2e-3 * (theta[0] - 1), s.mean()]) - goal
        h = np.array([[(z_u * z_u * w).mean() + 2e-3, (z_u * w).mean()], [(z_u * w).mean(), w.mean() + 1e-9]])
        move = np.linalg.solve(h, g)
        pace = 1.0
        while pace > 1e-6 and risk(theta - pace * move) > risk(theta):
            pace /= 2
        theta = theta - pace * move
        if np.abs(pace * move).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from rows where ``learn`` holds; the prior is the share of toxic rows among the labelled ones."""
    rows = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = rows.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(0.9, max(0.005, (toxic or 0) / n)) if n else 0.1
    chance = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.broadcast(rows.where("toxic = 1").orderBy(chance, "doc_id").limit(positives).select("doc_id"))  # at most ``positives`` ids
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    good = _sample(texts.join(chosen, "doc_id", "left_semi"), 2 * positives)
    pool = docs.where(learn & F.col("doc_id").isNotNull())
    share = unlabelled / max(1, pool.count())
    rest = _sample(texts.where(learn & F.col("doc_id").isNotNull() & (chance < share)), 2 * unlabelled)
    return fit(good, rest, prior)


def _sample(texts: DataFrame, rows: int) -> list[bytes]:
    """The texts, packed in the tasks, in the order of a hash; ``rows`` of them where ids repeat so often that there are more."""

    def run(batches):
        for batch in batches:
            part, order = texts_of(batch), unchunked(batch.column(0))
            for lo, hi in slices(part):
                words = packed(part.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([order.slice(lo, hi - lo), pa.array(words, pa.binary())], names=["o", "words"])

    chosen = texts.select(F.xxhash64(F.lit(11), "doc_id", "text").alias("o"), "text").mapInArrow(run, "o long, words binary")
    return [bytes(r["words"]) for r in chosen.orderBy("o", "words").limit(rows).collect()]


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The columns of ``docs`` and the score, 0 to 1."""

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            out = np.zeros(len(texts))
            for lo, hi in slices(texts):
                codes, words, offsets = words_of(texts.slice(lo, hi - lo))
                out[lo:hi] = model.logits(codes, word_features(words), offsets)
            yield with_columns(batch, **{name: pa.array(1 / (1 + np.exp(-np.clip(out, -60, 60))))})

    schema = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != name), f"`{name}` double"])
    return docs.drop(name).mapInArrow(run, schema)
