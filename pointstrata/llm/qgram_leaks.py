"""Benchmark passages in documents by q-gram lemma filtering.

A benchmark item is cut into probes of ``PROBE`` characters, one every ``STEP``
characters and one at its end, so that every run of PROBE + STEP - 1 characters
of an item holds a whole probe: a quote of that length is found wherever in the
item it begins.  A shorter item is one probe.  A place that holds a probe with at
most k edits shares at least m + 1 - q (k + 1) q-grams with it, all of them on
neighbouring diagonals.  Shared q-grams are counted in overlapping bands of
diagonals, bands that reach the bound are aligned within the band, and regions
within the edit budget are reported.

An item of fewer than ``SHORT`` comparable characters has too few q-grams for the
lemma.  It is matched exactly, from one word bound to another, and each of its
occurrences is a region of its own.

The benchmark is a stated query set and goes through in blocks of bounded size,
each compared with all documents.

Texts are compared as lower-case letters, digits and single spaces; other ASCII
characters count as space.  Nulls, empties, ties: a null or empty text or item
matches nothing, as does an item without letters or digits; repeated items match each under its own id; several regions of an item
in a text are separate unless they overlap; empty tables give no rows; extra
columns are kept by ``clean`` and ignored by ``matches``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, slices, texts_of, unchunked

Q, PROBE, STEP, ERRORS, SHORT = 8, 120, 20, 0.08, 24
STRIDE = 32  # bands are twice as wide; at least 2 k + 1
BLOCK_CHARS = 2_000_000
PART_BYTES = 1 << 20  # texts searched at a time; a search takes some 150 bytes for each
PIECE = 1 << 21  # shared q-grams counted at a time
HASH_BITS = 21
_END = 0xFF  # never part of UTF-8
_WALL = 1 << 12  # cost of the end of a text: no alignment passes from one text to the next

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32
_FOLD[65:91] += 32


def normalise(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Comparable bytes of UTF-8 bytes and where each came from; runs of spaces become one."""
    folded = _FOLD[raw]
    space = folded == 32
    keep = np.flatnonzero(~(space & np.concatenate(([True], space[:-1]))))
    return folded[keep], keep


def grams(data: np.ndarray) -> np.ndarray:
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    return np.ndarray((len(data) - Q + 1,), "<u8", data, strides=(1,)).copy()


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)


@dataclass
class Index:
    """Probes of one block of items and where their q-grams stand."""

    item: list  # item id of each probe
    length: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    letters: np.ndarray  # probes x PROBE, padded
    gram: np.ndarray  # distinct, sorted
    first: np.ndarray
    count: np.ndarray
    probe: np.ndarray  # by gram
    at: np.ndarray
    filter: np.ndarray
    short: dict  # length -> (sorted short items of it, ids of each)


def index_of(items: list[tuple[object, str]], errors: float = ERRORS) -> Index:
    ids, rows, brief = [], [], {}
    for item_id, text in items:
        data, _ = normalise(np.frombuffer((text or "").encode(), np.uint8))
        if len(data) < SHORT:
            if word := data.tobytes().strip():
                brief.setdefault(len(word), {}).setdefault(word, []).append(item_id)
            continue
        starts = [0] if len(data) <= PROBE else sorted({*range(0, len(data) - PROBE + 1, STEP), len(data) - PROBE})
        for s in starts:
            ids.append(item_id)
            rows.append(data[s:s + PROBE])
    length = np.array([len(r) for r in rows], np.int64)
    edits = np.minimum((length * errors).astype(np.int64), np.maximum((length + 1) // Q - 2, 0))
    letters = np.zeros((len(rows), PROBE), np.uint8)
    code, probe, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int16)]
    for i, r in enumerate(rows):
        letters[i, :len(r)] = r
        g = grams(r)
        code.append(g)
        probe.append(np.full(len(g), i, np.int32))
        at.append(np.arange(len(g), dtype=np.int16))
    code, probe, at = map(np.concatenate, (code, probe, at))
    order = np.argsort(code, kind="stable")
    gram, first, count = np.unique(code[order], return_index=True, return_counts=True)
    table = np.zeros(1 << HASH_BITS, bool)
    table[_slot(gram)] = True
    short = {n: (np.array(sorted(words), f"S{n}"), [words[w] for w in sorted(words)]) for n, words in brief.items()}
    return Index(ids, length, edits, length + 1 - Q * (edits + 1), letters, gram, first, count, probe[order], at[order], table, short)


def align(index: Index, probe: np.ndarray, low: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each probe in the band of diagonals from ``low`` on, and where that alignment ends."""
    width = 2 * STRIDE
    best, end = np.empty(len(probe), np.int64), np.empty(len(probe), np.int64)
    one = np.int32(1)
    for lo in range(0, len(probe), 2048):
        p, base = probe[lo:lo + 2048], low[lo:lo + 2048]
        cost = np.zeros((len(p), width), np.int32)
        done = index.length[p]
        at = base[:, None] + np.arange(int(done.max()) + width)
        window = np.where((at >= 0) & (at < len(data)), data[np.clip(at, 0, len(data) - 1)], _END)
        wall = np.where(window == _END, np.int32(_WALL), np.int32(0))
        more = np.cumsum(wall + one, axis=1, dtype=np.int32)
        letters = index.letters[p]
        top, stop = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for i in range(int(done.max())):
            d = more[:, i:i + width]
            new = cost + (window[:, i:i + width] != letters[:, i:i + 1]) + wall[:, i:i + width]
            np.minimum(new[:, :-1], cost[:, 1:] + one, out=new[:, :-1])  # the probe's character is missing in the text
            new -= d
            cost = np.minimum.accumulate(new, axis=1)  # the text has characters more
            cost += d
            over = done == i + 1
            if over.any():
                k = cost[over].argmin(axis=1)
                top[over] = cost[over, k]
                stop[over] = base[over] + i + 1 + k
        best[lo:lo + 2048], end[lo:lo + 2048] = top, stop
    return best, end


def exact(raw: np.ndarray, data: np.ndarray, origin: np.ndarray, short: dict) -> list[tuple[int, object, int, int, int]]:
    """(row, item, start, end, 0) of short items between word bounds; per length of item one look at all words."""
    bound = (data == 32) | (data == _END)
    begin = np.flatnonzero(~bound & np.concatenate(([True], bound[:-1])))
    stops = np.flatnonzero(data == _END)
    points = np.cumsum((raw & 0xC0) != 0x80)
    zero = np.concatenate(([0], points[origin[stops]]))
    out = []
    for n, (words, ids) in short.items():
        at = begin[begin + n < len(data)]
        at = at[bound[at + n]]
        if not len(at):
            continue
        text = np.lib.stride_tricks.sliding_window_view(data, n)[at].view(f"S{n}").ravel()
        k = np.searchsorted(words, text)
        k[k == len(words)] = 0
        hit = np.flatnonzero(words[k] == text)
        row = np.searchsorted(stops, at[hit])
        s, e = points[origin[at[hit]]] - 1 - zero[row], points[origin[at[hit] + n - 1]] - zero[row]
        out += [(int(r), item, int(a), int(b), 0) for r, j, a, b in zip(row, k[hit], s, e) for item in sorted(set(ids[j]))]
    return out


def find(texts: pa.Array, index: Index) -> list[tuple[int, object, int, int, int]]:
    """(row, item, start, end, edits) of all regions in the texts; code points, end exclusive."""
    found = []
    if not len(index.gram) and not index.short:
        return found
    for lo, hi in slices(texts, PART_BYTES):
        part = texts.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist()
        raw = np.frombuffer(b"\xff".join(part) + b"\xff", np.uint8)
        data, origin = normalise(raw)
        if index.short:
            found += [(row + lo, *rest) for row, *rest in exact(raw, data, origin, index.short)]
        if not len(index.gram):
            continue
        code = grams(data)
        pos = np.flatnonzero(index.filter[_slot(code)])
        k = np.searchsorted(index.gram, code[pos])
        k[k == len(index.gram)] = 0
        hit = index.gram[k] == code[pos]
        pos, k = pos[hit], k[hit]
        if not len(pos):
            continue
        value = n = np.zeros(0, np.int64)
        ends = np.cumsum(index.count[k])
        a = 0
        while a < len(pos):  # bounded pieces: a gram may be frequent on both sides
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, side="right")))
            r = ragged(index.first[k[a:b]], index.count[k[a:b]])
            band = (np.repeat(pos[a:b], index.count[k[a:b]]) - index.at[r] + PROBE) // STRIDE
            key, c = np.unique((index.probe[r].astype(np.int64) << 32) | band, return_counts=True)
            if a:
                key, back = np.unique(np.concatenate((value, key)), return_inverse=True)
                c = np.bincount(back, np.concatenate((n, c))).astype(np.int64)
            value, n = key, c
            a = b
        probe, band = value >> 32, value & 0xFFFFFFFF
        near = np.searchsorted(value, value + 1)
        near[near == len(value)] = 0
        two = n + np.where(value[near] == value + 1, n[near], 0)  # bands of two strides from this one on
        before = np.searchsorted(value, value - 1)
        first = (value[np.minimum(before, len(value) - 1)] != value - 1)  # its hits may also end a band that starts earlier
        good = two >= index.bound[probe]
        probe_c, low = probe[good], band[good] * STRIDE - PROBE
        early = first & (n >= index.bound[probe])
        probe_c = np.concatenate((probe_c, probe[early]))
        low = np.concatenate((low, (band[early] - 1) * STRIDE - PROBE))
        if not len(probe_c):
            continue
        edits, end = align(index, probe_c, low, data)
        ok = edits <= index.edits[probe_c]
        probe_c, edits, end = probe_c[ok], edits[ok], end[ok]
        stops = np.flatnonzero(data == _END)
        row = np.searchsorted(stops, end - 1)  # the alignment may be shorter than its probe: only its end is sure to lie in the text
        begin = np.concatenate(([0], stops[:-1] + 1))
        points = np.cumsum((raw & 0xC0) != 0x80)
        zero = np.concatenate(([0], points[origin[stops]]))  # code points up to each text
        cp = lambda at: points[origin[np.minimum(at, len(data) - 1)]] - 1
        s, e = cp(np.maximum(end - index.length[probe_c], begin[row])) - zero[row], cp(end - 1) + 1 - zero[row]
        regions: dict[tuple[int, object], list[list[int]]] = {}
        for i in np.lexsort((s, row)):
            here = regions.setdefault((int(row[i]) + lo, index.item[probe_c[i]]), [])
            if here and s[i] <= here[-1][1]:
                here[-1][1] = max(here[-1][1], int(e[i]))
                here[-1][2] = min(here[-1][2], int(edits[i]))
            else:
                here.append([int(s[i]), int(e[i]), int(edits[i])])
        found += [(r, item, *x) for (r, item), xs in regions.items() for x in xs]
    return sorted(found, key=lambda x: x[0])


def blocks(benchmark: DataFrame) -> list[Index]:
    """Indexes of all items, in blocks of about BLOCK_CHARS characters; one block is in the driver at a time."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for i in range(n):
        yield index_of([(r["item_id"], r["text"]) for r in items.where(key == i).orderBy("item_id", "text").collect()])


def _matches(docs: DataFrame, index: Index) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = find(texts_of(batch), index)
            if rows:
                row, item, start, end, edits = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [unchunked(batch.column(0)).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(start, pa.int64()),
                     pa.array(end, pa.int64()), pa.array(edits, pa.int32()), pa.array([True] * len(row))],
                    names=["doc_id", "item_id", "start", "end", "edits", "contaminated"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, item_id long, start long, end long, edits int, contaminated boolean")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits (least of its probes) for every region; documents without one have no row."""
    out = None
    for index in blocks(benchmark):
        part = _matches(docs, index)
        out = part if out is None else out.unionByName(part)
    return _matches(docs.limit(0), index_of([])) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark passage."""

    def keep(index):
        def run(batches):
            for batch in batches:
                gone = {r[0] for r in find(texts_of(batch), index)}
                yield batch.filter(pa.array([i not in gone for i in range(batch.num_rows)], pa.bool_()))
        return run

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    for index in blocks(benchmark):
        docs = docs.mapInArrow(keep(index), schema)
    return docs
