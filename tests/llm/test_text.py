"""Licence scan, line frequency and the pipeline."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from pointstrata.llm import crf_pii, license_scan, line_frequency, pu_toxicity, queries
from pointstrata.llm.common import fold
from tests.llm.edge import ROWS, SCHEMA, edge_docs, empty_docs, key
from tests.llm.test_ids import check_packing
from tests.llm.test_pairs import components, plain_fingerprint

SPACES = "[\x20\x09-\x0D]+"


# ---- licences --------------------------------------------------------------

@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=30))
def test_increasing_run_is_longest(values):
    places = license_scan.increasing(values)
    run = [values[i] for i in places]
    assert places == sorted(places) and all(a < b for a, b in zip(run, run[1:]))
    best = [1] * len(values)
    for i, j in itertools.combinations(range(len(values)), 2):
        if values[i] < values[j]:
            best[j] = max(best[j], best[i] + 1)
    assert len(run) == max(best, default=0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=20), st.lists(st.sampled_from("abcdefgh"), max_size=12))
def test_alignment_is_a_common_subsequence(text, template):
    pairs = license_scan.patience(text, template)
    assert all(text[i] == template[j] for i, j in pairs)
    assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_unique_words_align_completely():
    template = [f"w{i}" for i in range(30)]
    text = [w for i, w in enumerate(template) for w in ([w, f"x{i}"] if i % 3 else [w])]
    assert [j for _, j in license_scan.patience(text, template)] == list(range(30))


def test_statements_are_found(spark):
    t = license_scan.TEMPLATES
    noise = "alpha beta gamma delta the of under version "
    changed = t["MIT-text"].replace("Permission is hereby granted", "PERMISSION IS HEREBY GRANTED").replace("without restriction", "*without* restriction")
    docs = [(1, noise * 30 + t["MIT"] + "\n" + noise * 30), (2, noise * 200), (3, (t["GPL-3.0"] + " ") * 3), (4, changed.replace("merge, publish, ", "")),
            (5, "Licensed under nothing. Version 2.0 of the text.")]
    rows = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["license"]) for r in rows) == {(1, "MIT"): 1, (3, "GPL-3.0"): 3, (4, "MIT-text"): 1}
    text = dict(docs)
    for r in rows:
        if r["doc_id"] == 1:
            assert text[1][r["start"]:r["end"]] == t["MIT"] and r["coverage"] == 1
        if r["doc_id"] == 4:
            assert 0.9 < r["coverage"] < 1


def test_license_next_to_another():
    template = "released under the mit license".split()
    exact, altered = list(template), "released under the mit x".split()
    assert license_scan.regions(altered + exact, template) == [(0, 3, 4), (5, 9, 5)]
    assert license_scan.regions(exact + altered, template) == [(0, 4, 5), (5, 8, 4)]
    assert license_scan.regions("released under the x".split() + exact, template) == [(4, 8, 5)]
    assert license_scan.regions(exact * 3, template) == [(0, 4, 5), (5, 9, 5), (10, 14, 5)]


@pytest.mark.parametrize("offset", range(0, 60))
def test_stretched_license_at_every_offset(offset):
    template = [f"t{i}" for i in range(40)]
    stretched = [x for i, w in enumerate(template) for x in ([] if i % 8 == 3 else [w]) + ([f"x{i}"] if i % 8 < 4 else [])]
    assert len(stretched) <= 1.5 * len(template)
    text = [f"y{i}" for i in range(offset)] + stretched + [f"z{i}" for i in range(60)]
    assert license_scan.regions(text, template) == [(offset, offset + max(i for i, w in enumerate(stretched) if w in template), 35)]


def test_license_edges(spark):
    docs = edge_docs(spark)
    rows = license_scan.scan(docs, {"X": ROWS[0][1], "none": "", "twice": "same text twice in the table"}).collect()
    assert Counter((r["doc_id"], r["license"]) for r in rows) == {(1, "X"): 1, (6, "twice"): 1, (7, "twice"): 2}
    assert license_scan.scan(docs, {}).collect() == []
    assert license_scan.scan(empty_docs(spark)).collect() == []


# ---- line frequency --------------------------------------------------------

def plain_rules(rows, limit, depleted):
    """Counts and verdicts by loops over words and lines."""
    def line_key(line):
        return re.sub(SPACES, " ", re.sub("[0-9]", "0", line.strip(" \t\n\x0b\f\r").lower()))

    where = defaultdict(set)
    for i, (doc_id, text, _, source, _) in enumerate(rows):
        for line in (text or "").split("\n"):
            if line.strip(" \t\n\x0b\f\r"):
                where[source, line_key(line)].add(("row", i) if doc_id is None else doc_id)
    out = []
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        w = [x for x in re.split(SPACES, text) if x]
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {p for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\f\r")]
        lost = sum(len(re.split(SPACES, x.strip(" \t\n\x0b\f\r"))) for x in lines if len(where[source, line_key(x)]) > limit)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed,
                    not failed and lost <= depleted * len(w), lost))
    return out


def many_lines(rng, n):
    common = [f"Common line {k} of all pages" for k in range(4)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 6))]
        lines += [rng.choice(common).replace("line", "LINE " if i % 2 else "line\t") for _ in range(rng.randint(0, 4))]
        rng.shuffle(lines)
        text = rng.choice(["\n", " \n", "\n\n"]).join(lines) * rng.choice([1, 1, 1, 2])
        rows.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
    return rows + rows[:5] + [(1000 + i, rows[0][1], "en", "a", 0) for i in range(30)]


@pytest.mark.parametrize("limit", [2, 8])
def test_rules_equal_plain_loops(spark, limit):
    rows = many_lines(random.Random(limit), 60)
    got = line_frequency.rules(spark.createDataFrame(rows, SCHEMA).repartition(4), line_limit=limit).collect()
    want = plain_rules(rows, limit, line_frequency.DEPLETED)
    assert key(map(tuple, got)) == key(want)
    assert any(x[8] for x in want) and any(not x[6] and not x[7] for x in want)


def test_lines_are_counted_in_documents_and_removed(spark):
    body = lambda i: " ".join(chr(97 + i % 26) * (1 + i // 26) + chr(97 + j % 26) * (1 + j // 26) for j in range(40))
    rows = [(i, f"Shared line {i}\n{body(i)}\n\n shared  LINE 7", "en", "a", 0) for i in range(6)]
    rows += [(10, "\n".join([body(10)[:29]] + [f"shared line {k}" for k in range(10)]), "en", "a", 0)]  # depleted
    rows += [(20, f"shared line 1\n{body(20)}", "en", "b", 0)] * 9  # one document of another host
    rows += [(None, f"mine\n{body(30 + i)}", "en", None, 0) for i in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"_row": F.lit("x"), "at": F.lit(2), "k": F.lit(None).cast("string")})
    out = line_frequency.cleaned(docs, line_limit=5)
    assert out.columns == docs.columns and not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    got = [(r["doc_id"], r["text"], r["_row"], r["at"]) for r in out.collect()]
    want = [(i, f"{body(i)}\n", "x", 2) for i in range(6)] + [(20, rows[7][1], "x", 2)] * 9 + [(None, body(30 + i), "x", 2) for i in range(6)]
    assert key(got) == key(want)
    verdict = {(r["doc_id"], r["kept"], r["n_removed_words"]) for r in line_frequency.rules(docs, line_limit=5).collect()}
    assert verdict == {*((i, True, 6) for i in range(6)), (10, False, 30), (20, True, 0), (None, True, 1)}
    edge = edge_docs(spark)
    assert {r["doc_id"] for r in line_frequency.cleaned(edge).collect()} <= {r[0] for r in ROWS}
    assert line_frequency.cleaned(empty_docs(spark)).collect() == []


def test_rules_use_built_in_functions_only(spark):
    plan = line_frequency.rules(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_rule_edges(spark):
    got = line_frequency.rules(edge_docs(spark)).collect()
    assert key(map(tuple, got)) == key(plain_rules(ROWS, line_frequency.LINE_LIMIT, line_frequency.DEPLETED))
    assert line_frequency.rules(empty_docs(spark)).collect() == []


def test_rules_sql(spark, tmp_path):
    rows = many_lines(random.Random(9), 40) + ROWS
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    res = con.execute(queries.ORACLE_SQL["op9_line_frequency_rules"])
    got = queries.QUERIES["op9_line_frequency_rules"](spark, str(tmp_path))
    assert [d[0] for d in res.description] == got.columns
    assert key(res.fetchall()) == key(map(tuple, got.collect()))


# ---- pipeline --------------------------------------------------------------

@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark, awkward rows included."""
    folder = tmp_path_factory.mktemp("corpus")
    rng = random.Random(11)
    vocabulary = [a + b for a in ("ba", "ko", "mi", "tu", "re", "lo") for b in ("ran", "stel", "nd", "vix", "por", "ma")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, prose(40)) for i in range(5)]
    rows, labels = [], []
    for i in range(300):
        text = prose(rng.randint(30, 150))
        kind = i % 10
        if kind == 0:
            text = " ".join(w if rng.random() < 0.8 else rng.choice(["idiotic", "trashy", "scummy"]) for w in text.split())
        elif kind == 1:
            text += " " + bench[i % 5][1] + " end"
        elif kind == 2:
            text += " mail jo@host.example.org or +1 (415) 555-0134"
        elif kind == 3 and rows:
            text = rows[i - 2][1]
        rows.append((i + 100, text, "en", "s", len(text)))
        labels.append((i + 100, 1, int(kind == 0)))
    rows += ROWS
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, bench


def test_pipeline_stages_against_plain_versions(spark, corpus, monkeypatch):
    folder, rows, bench = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = lambda df: [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)

    model = pu_toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), ~fold(3, 1))
    monkeypatch.setattr(pu_toxicity, "train", lambda *a: model)  # fits differ in the last digits
    one = stages["toxicity"](spark, docs, folder)
    assert one.columns == docs.columns
    score = {r["text"]: r["score"] for r in pu_toxicity.score(docs, model).collect()}
    assert key(plain(one)) == key(r for r in rows if score[r[1]] < pu_toxicity.OPERATE)
    toxic = {r[0] for r in rows if r[0] and r[0] >= 100 and r[0] % 10 == 0}
    gone = {r[0] for r in rows} - {r[0] for r in plain(one)}
    assert len(gone & toxic) > 0.75 * len(toxic) and len(gone - toxic) <= 3

    two = stages["simhash_near_dedup"](spark, one, folder)
    prints = {r: plain_fingerprint(r[1]) for r in plain(one)}
    comp = components(prints.values())
    kept, low = plain(two), {}
    for r, p in prints.items():
        if r[0] is not None:
            low[comp[p]] = min(low.get(comp[p], r[0]), r[0])
    assert len(kept) == len({comp[p] for p in prints.values()})
    assert {r[0] for r in kept if r[0] is not None} == set(low.values())

    three = stages["benchmark_decontamination"](spark, two, folder)
    assert key(plain(three)) == key(r for r in kept if not any(b in (r[1] or "") for _, b in bench))

    four = stages["pii"](spark, three, folder)
    assert four.columns == docs.columns
    by_id = {r[0]: r for r in plain(four)}
    field = crf_pii.train(three)
    for r in plain(three):
        base, more = crf_pii.spans_of(field, [r[1] or ""])
        if r[0] is None:
            continue
        if not base[0] and not more[0]:
            assert by_id[r[0]] == r
        else:
            text = by_id[r[0]][1]
            assert not crf_pii.base_spans(text) and "[EMAIL]" in text and "[PHONE]" in text and by_id[r[0]][4] == len(text)

    five = stages["best_fit_packing"](spark, four, folder).collect()
    check_packing(five, [r[:2] for r in plain(four)], 2048)
    assert key(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length").collect())) == key(
        (r["doc_id"], r["piece"], r["length"]) for r in five)


def test_pipeline_of_empty_tables(spark, tmp_path):
    empty_docs(spark).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
