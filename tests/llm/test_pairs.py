"""SimHash near-duplicates and benchmark passages against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pointstrata.llm import qgram_leaks as leaks
from pointstrata.llm import simhash
from tests.llm.edge import ROWS, SCHEMA, edge_docs, empty_docs, key


def plain_fingerprint(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, threshold=4):
    """Smallest value reachable, by all pairs."""
    values = sorted(set(values))
    up = {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= threshold:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {v: top(v) for v in values}


@pytest.mark.parametrize("size", [0, 1, 3, 4, 5, 70])
def test_fingerprint(size):
    rng = random.Random(size)
    text = " ".join(rng.choice(["Alpha", "beta", "GAMMA,", "dé", "\tx"]) for _ in range(size))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def _near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("blocks,threshold", [(simhash.BLOCKS, 4), (((32, 1), (32, 0)), 2), (((16, 0), (16, 0), (16, 0), (16, 0)), 3)])
def test_links_connect_everything_within_the_threshold(spark, blocks, threshold):
    rng = random.Random(threshold)
    values = [rng.getrandbits(64) for _ in range(60)]
    for d in range(1, threshold + 3):  # also just beyond the threshold
        values += [_near(rng, v, d) for v in values[:40]]
    values += [_near(rng, values[0], rng.randint(1, 3)) for _ in range(300)]  # a crowd at one anchor
    values = list(dict.fromkeys(values))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "_fp long"), threshold, blocks).collect()
    up = {v: v for v in values}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for e in edges:
        a, b = e["a"] % (1 << 64), e["b"] % (1 << 64)
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    want = components(values, threshold)
    groups = lambda f: {frozenset(x for x in values if f(x) == r) for r in {f(v) for v in values}}
    assert groups(top) == groups(want.get)


def test_crowded_anchor_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(5)
    base = rng.getrandbits(63)
    values = list({_near(rng, base, rng.randint(0, 2)) for _ in range(200)})
    values = [v for v in values if not v >> 63]
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "_fp long")).collect()
    near = defaultdict(set)
    for e in edges:
        near[e["a"]].add(e["b"])
        near[e["b"]].add(e["a"])
    seen, todo = set(), [values[0]]
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += near[v]
    assert seen == set(values)  # all within 4 bits of each other


def test_near_duplicates_edges(spark):
    rows = simhash.near_duplicates(edge_docs(spark)).collect()
    prints = [plain_fingerprint(r[1]) for r in ROWS]
    comp = components(prints)
    low = {}
    for r, p in zip(ROWS, prints):
        if r[0] is not None:
            low[comp[p]] = min(low.get(comp[p], r[0]), r[0])
    assert key(map(tuple, rows)) == key((r[0], f"{p:016x}", low.get(comp[p])) for r, p in zip(ROWS, prints))
    assert simhash.near_duplicates(empty_docs(spark)).collect() == []


def test_keep_one_keeps_a_row_of_each_component(spark):
    docs = edge_docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    prints = {r[0]: components([plain_fingerprint(x[1]) for x in ROWS])[plain_fingerprint(r[1])] for r in ROWS}
    assert len(ids) == len({components([plain_fingerprint(x[1]) for x in ROWS])[plain_fingerprint(r[1])] for r in ROWS})
    assert sorted(x for x in ids if x is not None) == sorted({min(k for k in prints if k is not None and prints[k] == p) for p in {prints[k] for k in prints if k is not None}})
    assert simhash.keep_one(empty_docs(spark)).count() == 0


# ---- benchmark passages ----------------------------------------------------

WORDS = "the of and in that with thion ering stoned reat oure tion inha whelm brast olden fenth quill morrow dapple".split()


def _prose(rng, n):
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def _edited(rng, text, share):
    out = list(text)
    for _ in range(int(len(text) * share)):
        j = rng.randrange(len(out))
        out[j] = rng.choice(["", out[j] + rng.choice("abc"), rng.choice("abc")])
    return "".join(out)


def semi_global(probe, data):
    """Least edits of the probe anywhere in the text, by the full table."""
    row = np.zeros(len(data) + 1, int)
    for i, c in enumerate(probe, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (np.frombuffer(data, np.uint8) != c))
        new = np.concatenate(([i], new))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def test_regions_equal_brute_force():
    rng = random.Random(2)
    items = [(i, _prose(rng, rng.randint(3, 60))) for i in range(12)] + [(99, "tiny"), (98, None)]
    index = leaks.index_of(items)
    texts = [_prose(rng, rng.randint(0, 150)) for _ in range(40)]
    for i in range(30):
        at = rng.randint(0, len(texts[i]))
        texts[i] = texts[i][:at] + " " + _edited(rng, items[i % 12][1], rng.choice([0, 0.03, 0.08, 0.2])) + " " + texts[i][at:]
    got = {(r, item) for r, item, *_ in leaks.find(pa.array(texts, pa.large_string()), index)}
    want = set()
    for r, t in enumerate(texts):
        data = leaks.normalise(np.frombuffer(t.encode(), np.uint8))[0].tobytes()
        for p, item in enumerate(index.item):
            if data and semi_global(index.letters[p, :index.length[p]].tolist(), data) <= index.edits[p]:
                want.add((r, item))
        for i, x in items:  # short ones between word bounds
            y = leaks.normalise(np.frombuffer((x or "").encode(), np.uint8))[0].tobytes()
            if y and len(y) < leaks.SHORT and b" " + y.strip() + b" " in b" " + data.strip() + b" ":
                want.add((r, i))
    assert got == want and len(want) > 15


def test_quote_is_found_wherever_it_begins():
    rng = random.Random(14)
    item = _prose(rng, 300)[:1300]
    index = leaks.index_of([(1, item)])
    size = leaks.PROBE + leaks.STEP - 1
    filler = "zq wv " * 30
    texts = [filler + item[a:a + size].strip() + " " + filler for a in range(len(item) - size + 1)]
    assert {r for r, *_ in leaks.find(pa.array(texts, pa.large_string()), index)} == set(range(len(texts)))


def test_short_items_match_between_word_bounds(spark):
    items = [(1, "Tiny."), (2, " two  words "), (3, "é!"), (4, "tiny"), (5, "..."), (6, "a b a")]
    texts = ["tiny", "TINY, two-words", "tinys untiny", "é", "xé éx", "a b a b a", "", None, "end of two\nwords", "two", "words", "Ü \U0001f600 (tiny)"]
    rows = leaks.find(leaks.texts_of(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})), leaks.index_of(items))
    want = []
    for r, t in enumerate(texts):
        data = leaks.normalise(np.frombuffer((t or "").encode(), np.uint8))[0].tobytes().strip()
        for i, x in items:
            needle = leaks.normalise(np.frombuffer(x.encode(), np.uint8))[0].tobytes().strip()
            padded, at = b" " + data + b" ", -1
            while needle and (at := padded.find(b" " + needle + b" ", at + 1)) >= 0:
                want.append((r, i))
    assert sorted((r, i) for r, i, *_ in rows) == sorted(want) and len(want) == 11  # 2 + 3 + 1 + 2 + 1 + 2
    assert all(texts[r][s:e].lower().split()[0].strip("(")[:1] == items[i - 1][1].strip().lower()[:1] for r, i, s, e, _ in rows)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r["doc_id"] for r in leaks.clean(docs, bench).collect()} == {2, 4, 6, 7, 9, 10}


def test_spans_point_at_the_passage(spark):
    rng = random.Random(4)
    item = _prose(rng, 40)
    text = "Öäü ß. " + _prose(rng, 30) + "\n\n" + item.upper().replace(" ", " \n") + " " + _prose(rng, 20)
    docs = spark.createDataFrame([(5, text), (6, _prose(rng, 80))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string")
    rows = leaks.matches(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["edits"]) for r in rows} == {(5, 1, 0)}
    found = text[rows[0]["start"]:rows[0]["end"]].lower().split()
    assert found == item.lower().split()


def test_blocks_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 300)
    rng = random.Random(6)
    items = [(i, _prose(rng, 30)) for i in range(8)]
    docs = spark.createDataFrame([(i, _prose(rng, 20) + " " + items[i % 8][1]) for i in range(16)], SCHEMA.split(", lang")[0])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.matches(docs, bench).collect()} >= {(i, i % 8) for i in range(16)}
    assert leaks.clean(docs, bench).count() == 0


def test_leak_edges(spark):
    bench = spark.createDataFrame([(1, ROWS[0][1]), (2, None), (3, "")], "item_id long, text string")
    docs = edge_docs(spark)
    assert {r["doc_id"] for r in leaks.matches(docs, bench).collect()} == {1}
    assert leaks.clean(docs, bench).count() == len(ROWS) - 1 and leaks.clean(docs, bench).columns == docs.columns
    assert leaks.matches(docs, bench.limit(0)).count() == 0 and leaks.clean(docs, bench.limit(0)).count() == len(ROWS)
    assert leaks.matches(empty_docs(spark), bench).count() == 0


@pytest.mark.parametrize("words", [17, 40])
@pytest.mark.parametrize("gone", [1, 3, 5])
def test_short_passage_at_the_edges_of_a_document(spark, words, gone):
    rng = random.Random(10 * words + gone)
    item = _prose(rng, words)
    at = [len(item) // 2 - 2 * j for j in range(gone)]
    cut = "".join(c for j, c in enumerate(item) if j not in at)
    texts = [_prose(rng, 30), cut + " " + _prose(rng, 30), _prose(rng, 30), _prose(rng, 30) + " " + cut, item[gone:], item[:-gone], _prose(rng, 30)]
    rows = leaks.find(pa.array(texts, pa.large_string()), leaks.index_of([(7, item)]))
    assert {r[0] for r in rows} == {1, 3, 4, 5}
    assert all(0 <= start < end <= len(texts[row]) for row, _, start, end, _ in rows)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc_id"] for r in leaks.clean(docs, bench).collect()} == {0, 2, 6}
