"""The near-copy stage against all pairs."""

import random
import re

import numpy as np

import corpus_pipeline
from pointstrata.llm import near_copies
from tests.llm.edge import ROWS, SCHEMA, edge_docs, empty_docs, key
from tests.llm.test_pairs import plain_fingerprint


def plain_set(text, k=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def plain_components(rows):
    """Indexes of the rows, by all pairs with a similarity of 4/5 or more."""
    sets, group = [plain_set(r[1]) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def kept_ids(rows):
    low = {}
    for r, g in zip(rows, plain_components(rows)):
        low[g] = min(low.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    return key(None if n else i for n, i in low.values())


def _planted(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    notice = [rng.choice(vocabulary) for _ in range(30)]  # a passage that many texts share
    rows = []
    for _ in range(50):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 60, 150]))] + (notice if rng.random() < 0.5 else [])
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w), "en", "a", 0))
    crowd = [rng.choice(vocabulary) for _ in range(200)]  # one large group of near copies
    for _ in range(60):
        w = list(crowd)
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(w), "en", "a", 0))
    return rows


def test_components_equal_all_pairs(spark):
    rows = _planted(3)
    kept = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert key(r["doc_id"] for r in kept.collect()) == kept_ids(rows)


def test_order_of_shingles_does_not_matter(spark, monkeypatch):
    level = np.random.default_rng(4).integers(0, 9, 1 << near_copies.SLOT_BITS).astype(np.int8)
    monkeypatch.setattr(near_copies, "levels", lambda reps: level)
    rows = _planted(4)
    kept = near_copies.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert key(r["doc_id"] for r in kept.collect()) == kept_ids(rows)


def test_stage_drops_copies_beyond_four_bits(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(200)]
    copy = list(base)
    for at in (30, 75, 120):
        copy[at] = "other"
    rows = [(1, " ".join(base), "en", "a", 0), (2, " ".join(copy), "en", "a", 0)]
    assert kept_ids(rows) == ["1"] and (plain_fingerprint(rows[0][1]) ^ plain_fingerprint(rows[1][1])).bit_count() > 4
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()] == [1]


def test_edges(spark):
    kept = near_copies.keep_one(edge_docs(spark))
    assert kept.columns == edge_docs(spark).columns
    assert key(r["doc_id"] for r in kept.collect()) == kept_ids(ROWS)
    assert near_copies.keep_one(empty_docs(spark)).count() == 0


def test_passages_of_a_few_texts_make_no_candidates(spark):
    """Shingles that a dozen texts share come last, however many others there are."""
    rows = []
    for g in range(40):
        passage = " ".join(f"p{g}x{i}" for i in range(40))
        rows += [(g * 12 + k, " ".join(f"w{g}x{k}x{i}" for i in range(110)) + " " + passage, "en", "a", 0) for k in range(12)]
    texts = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("doc_id as _fp", "text")
    shared = near_copies.buckets(near_copies.prefixes(texts, near_copies.levels(texts)))
    assert shared.count() < 12  # some slots have a level by chance


def test_frequent_shingles_are_counted_exactly(spark):
    texts = [" ".join(f"v{(7 * (i % 12) + j * j) % 40}" for j in range(30)) for i in range(60)] + ["", None, "one"]
    count = {}
    for t in texts:
        for x in plain_set(t):
            count[x] = count.get(x, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    for bits in (0, 3):
        got = sorted(r["n"] for r in near_copies.counts(df, bits).collect())
        assert got == sorted(c for c in count.values() if c >= near_copies.CROWD) and got


def test_pairs_meet_in_their_first_bucket(spark):
    """Sets that share many shingles are a pair once or twice, not once a shingle; each pair that can be similar is there."""
    rng = random.Random(6)
    sets = [sorted(rng.sample(range(60), 45)) for _ in range(30)]
    n = 120  # 45 of them among the first of the order
    rows = [(t, i, n, at, i, 30) for i, s in enumerate(sets) for at, t in enumerate(s)]
    got = near_copies.meetings(spark.createDataFrame(rows, "token long, _fp long, n int, at int, root long, c long").repartition(4)).select("a", "b", "token").collect()
    first = {(i, j): min(set(sets[i]) & set(sets[j])) for i in range(30) for j in range(i + 1, 30)}
    assert {(r["a"], r["b"]): r["token"] for r in sorted(got, key=lambda r: -r["token"])} == {
        p: t for p, t in first.items() if 9 * (n - max(sets[i].index(t) for i in p)) >= 8 * n}
    assert len(first) <= len(got) < 2 * len(first)
