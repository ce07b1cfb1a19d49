"""Cost-balanced packing, hard negatives and token links against plain versions."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pointstrata.llm import cost_balanced as cb
from pointstrata.llm import rns_negatives as rns
from pointstrata.llm import token_links as tl
from pointstrata.llm.queries import HARD_NEGATIVES_SQL, op11_rns_hard_negatives, op13_cost_balanced_packing
from tests.llm.edge import LONG, ROWS, SCHEMA, edge_docs, empty_docs, key

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


# ---- packing ---------------------------------------------------------------

def one_by_one(lengths, capacity):
    """The rule stated on a list: (length, sequence, offset) of what fits, the rest, the sizes."""
    whole, rest = divmod(sum(lengths), capacity)
    sizes = [capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    used, price, placed, over = [0] * len(sizes), [0] * len(sizes), [], []
    for n in sorted(lengths, reverse=True):
        fit = [i for i in range(len(sizes)) if used[i] + n <= sizes[i]]
        if not fit:
            over.append(n)
            continue
        i = min(fit, key=lambda i: (price[i], i))
        placed.append((n, i, used[i]))
        used[i] += n
        price[i] += cb.cost(n)
    return placed, over, sizes


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=80))
def test_plan_equals_the_rule_on_a_list(lengths):
    counts = np.bincount(lengths, minlength=25)[:25] if lengths else np.zeros(25, int)
    plan, (placed, over, sizes) = cb.Plan(counts), one_by_one(lengths, 24)
    n = np.array(sorted(lengths, reverse=True), np.int64)
    rank = np.array([i - int(np.searchsorted(-n, -x)) for i, x in enumerate(n)], np.int64)
    fits = rank < plan.placed[n] if len(n) else np.zeros(0, bool)
    seq, off = plan.whole(n[fits], rank[fits])
    assert sorted(zip(n[fits].tolist(), seq.tolist(), off.tolist())) == sorted(placed)
    assert sorted(n[~fits].tolist()) == sorted(over)
    row, begin, take, more_seq, more_off = plan.cut(n[~fits], rank[~fits])
    parts = collections.defaultdict(list)
    for r, b, t in zip(row, begin, take):
        parts[int(r)].append((int(b), int(t)))
    for r, x in enumerate(n[~fits].tolist()):  # every token of a left-over piece once
        assert sum((list(range(b, b + t)) for b, t in sorted(parts[r])), []) == list(range(x))
    filled = collections.defaultdict(list)
    for s, o, t in zip([*seq, *more_seq], [*off, *more_off], [*n[fits], *take]):
        filled[int(s)] += range(o, o + t)
    assert [sorted(filled[i]) for i in range(len(sizes))] == [list(range(z)) for z in sizes]


def check_packing(rows, texts, capacity=2048, end=1):
    tok = Tokenizer.from_file(WORD)
    want = collections.Counter(zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [end], "<u4").tobytes()) for t in texts)
    places, docs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"], r["doc_tokens"]].append(r)
    for spans in places.values():
        at = 0
        for off, n in sorted(spans):
            assert off == at
            at += n
        assert at == capacity or (at < capacity and at & (at - 1) == 0)
    return want, docs


def test_packing_of_edge_documents(spark):
    rows = cb.cost_balanced(edge_docs(spark), WORD).collect()
    _, docs = check_packing(rows, [r[1] for r in ROWS])
    tok = Tokenizer.from_file(WORD)
    for doc_id, text in {(r[0], r[1]) for r in ROWS if r[0] not in (7, None)}:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        mine = sorted(docs[doc_id, len(ids)], key=lambda r: r["start"])
        assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
        assert np.frombuffer(b"".join(r["ids"] for r in mine), "<u4").tolist() == ids
    assert sum(r["length"] for r in rows) == sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in ROWS)
    assert cb.cost_balanced(empty_docs(spark), WORD).collect() == []


def test_packing_query_on_whole_table(spark):
    rows = op13_cost_balanced_packing(spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    _, docs = check_packing(rows, [])
    assert {k for k, _ in docs} == set(texts)
    tok = Tokenizer.from_file(WORD)
    for (doc_id, n), mine in docs.items():
        ids = np.array(tok.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
        assert n == len(ids)
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == n
    costs = cb.sequence_costs(spark.createDataFrame(rows)).collect()
    assert sum(r["padded"] for r in costs) == sum(r["tokens"] for r in costs) == sum(r["length"] for r in rows)


# ---- hard negatives --------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-2**27, 2**27), min_size=70, max_size=70), min_size=1, max_size=6))
def test_scores_from_residues_are_exact(vectors):
    x = np.array(vectors, np.int64)
    moduli = rns.primes(int((x.astype(object) ** 2).sum(axis=1).max()))
    r = rns.residues(x, moduli)
    got = rns.scores(r, r, moduli)
    assert got.tolist() == [[sum(int(p) * int(q) for p, q in zip(a, b)) for b in x] for a in x]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 2), st.integers(-3, 3), st.integers(0, 30)), max_size=30), max_size=5))
def test_best_rows_in_any_order(batches):
    best, seen = rns.Best(3, 4), [[], [], []]
    for batch in batches:
        batch = [c for c in batch if c[1] >= best.floor()[c[0]]]
        best.add(*(np.array([c[k] for c in batch], np.int64) for k in range(3)))
    for batch in batches:
        for g, s, i in batch:
            seen[g].append((-s, i))
    got = list(zip(*(x.tolist() for x in best.rows())))
    assert got == [(g, -s, i) for g in range(3) for s, i in sorted(seen[g])[:4]]


def embedding_rows(rng, n, dim):
    base = rng.normal(size=(4, dim))
    rows = [(i, int(rng.integers(0, 4)), (base[rng.integers(0, 4)] + rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    return rows + [(100, 1, rows[3][2]), (200, 1, rows[3][2]), (200, 1, rows[3][2]), (7, 2, rows[3][2]), (None, 1, rows[3][2]), (900, None, rows[3][2]),
                   (901, 1, None), (902, 1, [nan] * dim), (903, 1, [inf] * dim), (1000, 1, [None] * dim), (1100, 3, [0.0] * dim)]


def test_negatives_against_sql(spark, tmp_path):
    rows = embedding_rows(np.random.default_rng(5), 700, 70)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("mine") for c in ("id", "vector", "row", "rank", "norm", "anchor")})
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = db.execute(HARD_NEGATIVES_SQL).fetchall()
    got = [tuple(r) for r in op11_rns_hard_negatives(spark, str(tmp_path)).collect()]
    assert key(got) == key(want) and len(got) > 300


def test_negatives_in_several_blocks(spark, monkeypatch):
    rows = embedding_rows(np.random.default_rng(6), 900, 9)
    df = spark.createDataFrame([(i, lab, v) for i, lab, v in rows], "id long, label int, vector array<float>")
    one = rns.mine(df, F.col("id") % 20 == 0).collect()
    monkeypatch.setattr(rns, "ANCHORS", 7)
    assert key(rns.mine(df, F.col("id") % 20 == 0).collect()) == key(one)


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], "id long, label int, vector array<float>")
    assert rns.mine(none, F.col("id") % 100 == 0).collect() == []
    short = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0, 5.0]), (2, 2, [0.5]), (3, 2, []), (4, 1, [1e30])], "id long, label int, vector array<double>")
    assert [tuple(r) for r in rns.mine(short, F.col("id") == 0).collect()] == [(0, 1, 1, 2, 65536, 32768)]


# ---- token links -----------------------------------------------------------

def pieces_of(text):
    """(ids, bytes) of both tokenizers, or nothing."""
    raw = (" " + text).encode()
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    a = [(i, bytes(of[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    b = [(i, bytes([int(p[3:5], 16)]) if (p := sp.id_to_piece(i)).startswith("<0x") else p.replace("▁", " ").encode()) for i in sp.encode(text)]
    return (a, b) if all(b"".join(x for _, x in t) == raw for t in (a, b)) else ([], [])


def plain_links(rows):
    """Links by comparing all byte ranges, token by token."""
    found, counts = [], collections.Counter()
    for doc_id, text in rows:
        a, b = pieces_of(text) if text else ([], [])
        spans = [[], []]
        for k, t in enumerate((a, b)):
            at = 0
            for i, x in t:
                spans[k].append((i, at, at + len(x)))
                at += len(x)
        links = [(i, j) for i, x, y in spans[0] for j, u, v in spans[1] if x < v and u < y]
        ends = sorted({y for *_, y in spans[0]} & {v for *_, v in spans[1]})
        groups, lo = [], 0
        for hi in ends:
            groups.append("|".join(",".join(str(i) for i, x, y in s if lo <= x and y <= hi) for s in spans))
            lo = hi
        found.append((doc_id, len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        counts.update(links)
    top = collections.Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(d, na, nb, g, len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), sha) for d, na, nb, g, x, sha in found]


WORDS = [(20 + k, t) for k, t in enumerate([
    "naïve café — déjà vu", "a  b   c", "▁odd", "tab\tand\nline\n\nfeed ", " lead", "<|endoftext|> <s> <0x41> plain", "日本語のテキスト 漢字", "\U0001f600\U0001f601 x",
    "internationalization of tokenizers, tokenizers!", "\x00 null", "é ﬁ ①", "1234567890 12,345.67", "the the the the", "İstanbul"])]


@pytest.mark.parametrize("leaf", [256, 1])
def test_links_against_all_ranges(spark, monkeypatch, leaf):
    monkeypatch.setattr(tl, "LEAF", leaf)
    monkeypatch.setattr(tl, "FAN", 2)
    rows = [(r[0], r[1]) for r in ROWS if r[1] != LONG] + WORDS
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).withColumns({c: F.lit("mine") for c in ("part", "a", "keys", "n_a", "bucket")}).repartition(3)
    got = [tuple(r) for r in tl.links(df, BYTE, PIECE).collect()]
    assert key(got) == key(plain_links(rows))


def test_links_of_edge_documents(spark):
    got = {r["doc_id"]: r for r in tl.links(edge_docs(spark), BYTE, PIECE).collect() if r["doc_id"] in (2, 3, 5)}
    assert [got[2][c] for c in ("n_a", "n_b", "n_links", "groups_sha256")] == [0, 0, 0, ""] and got[3]["count_sum"] == 0
    a, b = pieces_of(LONG)
    ends = [np.cumsum([len(x) for _, x in t]) for t in (a, b)]
    assert (got[5]["n_a"], got[5]["n_b"], got[5]["n_links"]) == (len(a), len(b), len(np.union1d(*ends))) and got[5]["n_groups"] == len(np.intersect1d(*ends))
    assert tl.links(empty_docs(spark), BYTE, PIECE).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**48), max_size=400))
def test_perfect_hash(keys):
    x = np.array(sorted(keys), np.int64)
    of = tl.PerfectHash.from_bytes(tl.PerfectHash.of(x).to_bytes())
    assert sorted(of(x).tolist()) == list(range(len(x))) and len(of) == len(x)
