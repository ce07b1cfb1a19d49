"""Classifiers by held-out accuracy; the random field, the trie and the classifiers' sums by brute force."""

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointstrata.llm import crf_pii as crf
from pointstrata.llm import mil_quality as mil
from pointstrata.llm import ppm
from pointstrata.llm import pu_toxicity as pu
from pointstrata.llm.common import fold
from tests.llm.edge import ROWS, edge_docs, empty_docs, key, rest

CLEAN = "the of and in that with river stone cloud maple window garden silver morning paper table winter candle".split()
RUDE = ["moronic", "trashy", "scumbag", "idiotic"]


def _text(rng, n, extra=(), share=0.0):
    return " ".join(rng.choice(extra) if extra and rng.random() < share else rng.choice(CLEAN) for _ in range(n))


# ---- positive-unlabelled ---------------------------------------------------

def test_toxic_texts_are_told_apart_from_unlabelled_ones():
    rng = random.Random(1)
    toxic = [_text(rng, rng.randint(20, 200), RUDE, 0.05) + " " + rng.choice(RUDE) for _ in range(400)]
    clean = [_text(rng, rng.randint(20, 200)) for _ in range(1600)]
    model = pu.fit(pu.packed(toxic[:250]), pu.packed(toxic[250:320] + clean[:900]), prior=70 / 970)
    test = pa.array(toxic[320:] + clean[900:], pa.large_string())
    codes, words, offsets = pu.words_of(test)
    score = 1 / (1 + np.exp(-model.logits(codes, pu.word_features(words), offsets)))
    assert (score[:80] >= pu.OPERATE).mean() > 0.85 and (score[80:] >= pu.OPERATE).mean() < 0.01


def test_pooling():
    value, codes, offsets = np.array([1.0, -2.0, 0.5]), np.array([0, 1, 2, 2, 2, 0, 0]), np.array([0, 0, 5, 7])
    mean, top = pu.pooled(value, codes, offsets)
    assert mean.tolist() == pytest.approx([0, 0.5 / math.sqrt(5), 2 / math.sqrt(2)])
    assert top.tolist() == pytest.approx([0, 2.5 / pu.TOP, 2 / pu.TOP])


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 1, 1), (5, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = pu.train(docs, labels, ~fold(3, 1))
    out = pu.score(docs, model)
    rows = out.collect()
    assert out.columns == [*docs.columns, "score"] and len(rows) == len(ROWS)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] == "same text twice in the table"}) == 1
    assert pu.score(empty_docs(spark), pu.train(empty_docs(spark), labels.limit(0), F.lit(True))).collect() == []
    again = pu.score(out, model).collect()  # a column of that name is replaced
    assert [r["score"] for r in again] == [r["score"] for r in rows]


# ---- multiple instances ----------------------------------------------------

def test_quality_of_a_bag_with_one_bad_passage_in_four():
    rng = random.Random(2)

    def make(bad):
        parts = [_text(rng, 64) for _ in range(rng.randint(1, 4))]
        if bad:
            parts[rng.randrange(len(parts))] = " ".join(w + "%%%" for w in _text(rng, 64).split())
        return " ".join(parts)

    data = [(make(i % 4 == 0), int(i % 4 != 0)) for i in range(700)]
    model = mil.fit([t for t, _ in data[:500]], [y for _, y in data[:500]])
    z = model.logits(*mil.passages(pa.array([t for t, _ in data[500:]], pa.large_string())))
    assert ((z > 0) == np.array([y for _, y in data[500:]])).mean() > 0.97


def test_attention_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x, bounds = rng.normal(size=(7, mil.WIDTH)), np.array([0, 2, 3, 7])
    p = [rng.normal(0, 0.3, s) for s in ((mil.WIDTH, mil.CODE), mil.CODE, (mil.CODE, mil.GATE), (mil.CODE, mil.GATE), mil.GATE, mil.CODE, ())]
    out, h, *_, w, z, _ = mil._forward(p, x, bounds)
    for a, b in zip(bounds, bounds[1:]):
        e = (np.tanh(h[a:b] @ p[2]) / (1 + np.exp(-(h[a:b] @ p[3])))) @ p[4]
        att = np.exp(e) / np.exp(e).sum()
        assert np.allclose(att, w[a:b])
    assert np.allclose(out, z @ p[5] + p[6])


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 1, 1), (5, 0, 1), (5, 0, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    model = mil.train(docs, labels, ~fold(5, 0))
    rows = mil.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] == "same text twice in the table"}) == 1
    assert mil.score(empty_docs(spark), mil.train(empty_docs(spark), labels.limit(0), F.lit(True))).collect() == []


def test_fold(spark):
    rows = spark.range(40).withColumnRenamed("id", "doc_id").select("doc_id", fold(7, 2).alias("held")).collect()
    assert all(r["held"] == (rest(r["doc_id"], 7) == 2) for r in rows)


def test_packed_rows_hold_all_words():
    texts = ["", "One two one", "  ", "two three " * 50, "é \x00x"]
    codes, features, offsets = pu._bags(pu.packed(texts))
    for k, text in enumerate(texts):
        words = re.findall(rb"[^ ]+", text.lower().encode())
        assert (features[codes[offsets[k]:offsets[k + 1]]] == pu.word_features(words)).all() and offsets[k + 1] - offsets[k] == len(words)


# ---- conditional random field ----------------------------------------------

def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1]))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


@pytest.mark.parametrize("unit", ["7", "a", "a.", "1.", "1.2.3.", "a@", "a@b", "@a.b", "a@b.c", "+1", "1 ", "12-", ".", "x.\n", "+(", "a@b-"])
def test_long_tokens_take_linear_time(unit):
    text = (unit * 1_000_000)[:1_000_000]
    start = time.process_time()
    crf.base_spans(text)
    crf.base_spans(text + "@ 1.2.3")
    assert time.process_time() - start < 8
    for n in (5, 60, 301):  # and equal the patterns
        for tail in ("", "@", "@b.c", ".4", " 1.2.3.4"):
            part = unit * n + tail
            assert sorted(crf.base_spans(part)) == sorted(plain_spans(part)), repr(part)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    bits = ["a@b.c", "x.y@z-1.org.", "@", "..", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "1234567812345678", "+1 (415) 555-0134",
            "+12", "+49.30.90.18.20", "00255.001.2.3", " ", "\n", "\t", "é", "+1 (415) 555-0134 4111111111111111", "word", "-", "9" * 25, "٣"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 9)))
        assert sorted(crf.base_spans(text)) == sorted(plain_spans(text)), repr(text)


def _field(rng):
    return crf.Field(*(rng.normal(size=s) for s in ((crf.BUCKETS, crf.TAGS),) * 3 + ((crf.TAGS, crf.TAGS), (crf.TAGS,))))


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    field = _field(rng)
    texts = [["call", "+1", "(415)"], ["x"], ["a@b.c", "at", "9", "dot."], []]
    score, offsets = crf._emissions(field, texts)
    tags = crf.viterbi(field, score, offsets)
    for i, t in enumerate(texts):
        e = score[offsets[i]:offsets[i + 1]]
        # the words' own features and the classes beside them
        for k, w in enumerate(t):
            own = field.own[crf.features(w)[0]].sum(axis=0)
            own = own + (field.before[crf._bucket(crf.features(t[k - 1])[1])] if k else 0)
            own = own + (field.after[crf._bucket(crf.features(t[k + 1])[1])] if k + 1 < len(t) else 0)
            assert np.allclose(own, e[k])

        def value(path):
            return field.first[path[0]] + sum(e[k, p] for k, p in enumerate(path)) + sum(field.step[p, q] for p, q in zip(path, path[1:]))

        if t:
            best = max(itertools.product(range(crf.TAGS), repeat=len(t)), key=value)
            assert tuple(tags[offsets[i]:offsets[i + 1]]) == best


def test_field_learns_its_table_and_adds_spans():
    rows = crf.labelled_rows(crf.LABELLED)
    field = crf.fit(rows * 4)
    score, offsets = crf._emissions(field, [w for w, _ in rows])
    tags = crf.viterbi(field, score, offsets)
    gold = np.concatenate([np.array(t) for _, t in rows])
    assert (tags == gold).mean() > 0.98
    texts = ["please reach mary at example dot com before ten", "call (212) 555-0143 after six", "he was at the house and saw the dot", "version 3.11.4 was out in 2023",
             "of%%% at%%% the&&& in%%% dot.***"]
    base, more = crf.spans_of(field, texts)
    assert [[crf.KINDS[k] for k, *_ in m] for m in more][1:] == [["phone"], [], [], []]
    k, s, e = more[1][0]
    assert texts[1][s:e] == "(212) 555-0143"


def test_pii_edges(spark):
    docs = edge_docs(spark)
    field = crf.train(docs)
    rows = crf.scan(docs, field).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (0, 0, 0, 0)
    extra = docs.limit(1).withColumn("text", F.lit("Mail a@b.org or +1 (415) 555-0134, card 4111 1111 1111 1111 from 10.0.0.1"))
    out = crf.redact(docs.unionByName(extra), field)
    assert out.columns == docs.columns
    texts = {r["text"]: r["n_chars"] for r in out.collect()}
    red = "Mail [EMAIL] or [PHONE], card [CARD] from [IP]"
    assert texts[red] == len(red) and {r[1] for r in ROWS} <= set(texts)
    assert crf.scan(empty_docs(spark), crf.train(empty_docs(spark))).collect() == []


# ---- partial matching ------------------------------------------------------

def plain_scores(rows, learn, order):
    """The trie in dictionaries, one symbol at a time."""
    trie = [defaultdict(Counter) for _ in range(order + 1)]
    symbols = lambda t: [ppm.END] * order + list((t or "").encode()) + [ppm.END]
    for (_, text), train in zip(rows, learn):
        s = symbols(text) if train else []
        for p in range(order, len(s)):
            for j in range(order + 1):
                trie[j][tuple(s[p - j:p])][s[p]] += 1

    def step(context, x):
        gone, lp = set(), 0.0
        for j in range(order, -1, -1):
            c = {k: n for k, n in trie[j].get(tuple(context[len(context) - j:]), {}).items() if k not in gone}
            total = sum(c.values()) + len(c)
            if x in c:
                return lp + math.log10(c[x] / total)
            if total:
                lp += math.log10(len(c) / total)
            gone |= set(c)
        return lp - math.log10(257 - len(gone))

    out = []
    for _, text in rows:
        s = symbols(text)
        out.append(sum(step(s[p - order:p], s[p]) for p in range(order, len(s))))
    return out


def plain_base(rows, learn):
    words = [re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    count, ends = Counter(), sum(learn)
    for w, train in zip(words, learn):
        count.update(w if train else [])
    n, v = sum(count.values()) + ends, len(count) + (ends > 0)
    base = [sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1)) for w in words]
    return [(len(w) + 1, sum(count[x] > 0 for x in w) + (ends > 0), n, b) for w, b in zip(words, base)]


@pytest.mark.parametrize("order,block", [(5, 1 << 20), (2, 300), (3, 1)])
def test_scores_equal_a_plain_trie(spark, order, block):
    rng = random.Random(order)
    rows = [(i, _text(rng, rng.randint(0, 40)).capitalize() + rng.choice(["", "\n", " é¡"])) for i in range(30)] + [(31, None), (31, None), (32, "")]
    learn = [rest(i, 7) != 2 for i, _ in rows]
    got = ppm.scores(spark.createDataFrame(rows, "doc_id long, text string"), ~fold(7, 2), order, block).collect()
    want = [(i, t, n, k, total, round(b, 6), round(s, 6)) for (i, _), t, (n, k, total, b), s in zip(rows, learn, plain_base(rows, learn), plain_scores(rows, learn, order))]
    assert key((r["doc_id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == key(want)


def test_score_edges(spark):
    rows = ppm.scores(edge_docs(spark), ~fold(7, 2)).collect()
    assert key(r["doc_id"] for r in rows) == key(r[0] for r in ROWS) and all(r["score"] < 0 for r in rows)
    untrained = ppm.scores(edge_docs(spark), F.lit(False)).collect()
    assert {round(r["score"] / math.log10(257), 3) for r in untrained} == {-float(len((r[1] or "").encode()) + 1) for r in ROWS}
    assert {r["train_tokens"] for r in untrained} == {0}
    assert ppm.scores(empty_docs(spark), F.lit(True)).collect() == []
