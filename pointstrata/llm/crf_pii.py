"""Personal data by fixed patterns plus a linear-chain conditional random field.

The patterns give the base spans.  The field reads white-space separated words
by their shapes (letters, digits and marks, affixes, the words beside them), is
trained on a small labelled table and adds what the patterns miss: written-out
addresses, unusual phone and card groupings, numbers that fail a check.  It is
decoded by Viterbi over all lines of a batch at once.  A span it adds is kept
where it does not touch a base span and has enough of its kind in it.

Nulls, empties, ties: a null or empty text has no spans; equal texts get equal
spans; very long lines are decoded whole; an empty table gives no rows; extra
columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of, unchunked, with_columns

KINDS = ("email", "ip", "card", "phone")
TAGS = len(KINDS) + 1  # 0 is none
BUCKETS = 1 << 14

# an email is found from its @ and an ip from the start of a run of digits, so that a long token is read a fixed number of times
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_RUN = re.compile(r"[0-9][0-9\x20-]*")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _windows(text: str, mark: str):
    """Parts of the text between spaces and line feeds that hold ``mark``, from left to right."""
    at, end, feed = text.find(mark), 0, -1
    while at >= 0:
        start = max(text.rfind(" ", end, at), text.rfind("\n", end, at), end - 1) + 1
        if feed < at:
            feed = text.find("\n", at)
            feed = len(text) if feed < 0 else feed
        end = text.find(" ", at, feed)
        end = feed if end < 0 else end
        yield start, end
        at = text.find(mark, end)


def _emails(text: str):
    """Spans of addresses: the longest name before each @ that no earlier address covers, and the host after it."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        end = host.end() if host else at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), leftmost and not overlapping within a kind; matches that fail their check are dropped."""
    out = [(0, *span) for span in _emails(text)]
    if _DIGITS.search(text):
        for lo, hi in _windows(text, "."):
            if hi - lo >= 7:
                out += [(1, *m.span()) for m in _IP.finditer(text, lo, hi) if all(_small(x) for x in m.group().split("."))]
        for run in _RUN.finditer(text):
            if run.end() - run.start() >= 16:
                for m in _CARD.finditer(text, *run.span()):
                    if m.end() - m.start() >= 16:
                        d = _digits(m.group())
                        if 16 <= len(d) <= 19 and _luhn(d):
                            out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# ---- words and features ----------------------------------------------------

_WORD = re.compile(r"\S+")  # the words of str.split
_MARKS = re.compile(r"[^\w]|_")
_EDGE = ".,;:!?\"'"
_GLUE = {"at", "dot", "punkt", "arroba", "punto", "point", "arobase", "(at)", "[at]", "(dot)", "[dot]", "{at}", "{dot}"}
_LEAD = {"email", "e-mail", "mail", "phone", "tel", "tel.", "call", "fax", "mobile", "ip", "host", "server", "card", "visa", "iban", "account",
         "contact", "telefon", "telephone", "téléphone", "karte", "carte", "tarjeta", "correo", "write", "reach"}


def shape(word: str) -> str:
    """Letters as x or X, digits as 9, marks kept; runs shortened to one, digit runs keep their length class."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", word[:64]):
        s = m.group()
        if s[0].isdigit() and s[0] in "0123456789":
            out.append("9" * min(len(s), 5) if len(s) < 12 else "9L")
        elif s[0].isalpha():
            out.append("x" if s.islower() else "X" if s.isupper() else "Xx")
        else:
            out.append(s)
    return "".join(out)


def _bucket(text: str) -> int:
    return zlib.crc32(text.encode()) % BUCKETS


def _seen(core: str) -> str:
    low = core.lower()
    return low if low in _GLUE or low in _LEAD else "x"


def features(word: str) -> tuple[list[int], str]:
    """Hashed features of a word and the class by which its neighbours see it."""
    core = word.strip(_EDGE)
    if core.isalpha() and len(core) < 40:
        seen = _seen(core)
        return [_bucket(f"w={seen}"), _bucket(f"end={word[len(core):] or '-'}" if word.startswith(core) else "end=?")], seen
    s = shape(core)
    low = core.lower()
    digits = sum(c in "0123456789" for c in core)
    seen = low if low in _GLUE or low in _LEAD else s[:12]
    f = [f"w={seen}", f"s={s[:24]}", f"d={min(digits, 20)}", f"l={min(len(core) // 4, 8)}", f"pre={s[:3]}", f"suf={s[-3:]}",
         f"dots={core.count('.')}", f"at={'@' in core}", f"plus={core[:1] == '+'}", f"par={'(' in core}", f"alpha={any(c.isalpha() for c in core)}",
         f"only={digits and digits == len(core)}{len(core) in (13, 14, 15, 16)}"]
    if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", core):
        f.append(f"quad={all(_small(x) for x in core.split('.'))}")
    return [_bucket(x) for x in f], seen


@dataclass
class Field:
    """Scores: of features, of the classes before and after, of steps between tags, of the first tag."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray
    first: np.ndarray


def _emissions(field: Field, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Tag scores of all words of all sequences, and the sequences' offsets."""
    length = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(length)))
    flat = pa.array([w for t in texts for w in t], pa.large_string()).dictionary_encode()
    kinds, rows = {}, []  # plain words with the same ending share a row
    row_of = np.empty(len(flat.dictionary), np.int64)
    for i, w in enumerate(flat.dictionary.to_pylist()):
        core = w.strip(_EDGE)
        key = (_seen(core), w[len(core):]) if core.isalpha() and len(core) < 40 and w.startswith(core) else w
        at = kinds.get(key)
        if at is None:
            at = kinds[key] = len(rows)
            rows.append(features(w))
        row_of[i] = at
    code = row_of[flat.indices.to_numpy(zero_copy_only=False)]
    own = np.array([field.own[f].sum(axis=0) for f, _ in rows]).reshape(-1, TAGS)
    seen = np.array([_bucket(s) for _, s in rows], np.int64)
    score = own[code]
    if len(code):
        cls = seen[code]
        inner = np.ones(len(code), bool)
        inner[offsets[:-1][length > 0]] = False
        at = np.flatnonzero(inner)
        score[at] += field.before[cls[at - 1]]
        score[at - 1] += field.after[cls[at]]
    return score, offsets


def viterbi(field: Field, score: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Best tags of all sequences, many sequences at a time."""
    length = np.diff(offsets)
    tags = np.zeros(len(score), np.int8)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    for lo in range(0, len(order), 4096):
        rows = order[lo:lo + 4096]
        n, start = length[rows], offsets[rows]
        value = score[start] + field.first
        back = []
        for t in range(1, int(n[0])):
            live = int(np.searchsorted(-n, -t, side="left"))  # sequences longer than t come first
            total = value[:live, :, None] + field.step
            arg = total.argmax(axis=1)
            back.append(arg.astype(np.int8))
            value[:live] = total.max(axis=1) + score[start[:live] + t]
        tag = value.argmax(axis=1)
        for t in range(int(n[0]) - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, side="left"))
            tags[start[:live] + t] = tag[:live]
            if t:
                tag[:live] = back[t - 1][np.arange(live), tag[:live]]
    return tags


def fit(rows: list[tuple[list[str], list[int]]], rounds: int = 120, rate: float = 0.08, decay: float = 2e-4) -> Field:
    """Maximum likelihood by Adam; forward and backward sums run over all sequences of the table at once."""
    rows = [r for r in rows if r[0]]
    field = Field(np.zeros((BUCKETS, TAGS)), np.zeros((BUCKETS, TAGS)), np.zeros((BUCKETS, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS))
    if not rows:
        field.own[:, 0] = 1.0
        return field
    n = np.array([len(w) for w, _ in rows])
    width = n.max()
    table = [[features(w) for w in words] for words, _ in rows]
    flat = [f for line in table for f, _ in line]
    size = np.array([len(f) for f in flat])
    index = np.concatenate([np.array(f) for f in flat])
    owner = np.repeat(np.arange(len(flat)), size)
    seen = np.array([_bucket(s) for line in table for _, s in line])
    row, col = np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n])
    gold = np.concatenate([np.array(t) for _, t in rows])
    inner = np.flatnonzero(col > 0)
    mask = np.arange(width)[None] < n[:, None]
    params = [field.own, field.before, field.after, field.step, field.first]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for k in range(1, rounds + 1):
        flat_score = np.zeros((len(flat), TAGS))
        np.add.at(flat_score, owner, field.own[index])
        flat_score[inner] += field.before[seen[inner - 1]]
        flat_score[inner - 1] += field.after[seen[inner]]
        score = np.zeros((len(n), width, TAGS))
        score[row, col] = flat_score
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0] + field.first
        for t in range(1, width):
            new = lse(alpha[:, t - 1, :, None] + field.step, 1) + score[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            new = lse(field.step[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = lse(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None])[row, col]
        node[np.arange(len(gold)), gold] -= 1
        r, c = row[inner], col[inner]
        edge = np.exp(alpha[r, c - 1][:, :, None] + field.step + (score + beta)[r, c][:, None, :] - z[r, None, None]).sum(axis=0)
        np.add.at(edge, (gold[inner - 1], gold[inner]), -1)
        g_own, g_before, g_after = np.zeros_like(field.own), np.zeros_like(field.before), np.zeros_like(field.after)
        np.add.at(g_own, index, node[owner])
        np.add.at(g_before, seen[inner - 1], node[inner])
        np.add.at(g_after, seen[inner], node[inner - 1])
        for p, g, (m1, m2) in zip(params, [g_own, g_before, g_after, edge, node[col == 0].sum(axis=0)], moments):
            g = g / len(n) + decay * p
            m1 *= 0.9
            m1 += 0.1 * g
            m2 *= 0.99
            m2 += 0.01 * g * g
            p -= rate * (m1 / (1 - 0.9 ** k)) / (np.sqrt(m2 / (1 - 0.99 ** k)) + 1e-8)
    return field


#: What a written-out address has: a name, "at", a host with at least one dot.
_WRITTEN = re.compile(r"[\w.+-]+( ?@ ?| ?[(\[{]at[)\]}] ?| at | arroba | arobase )[\w-]+(( ?\. ?| ?[(\[{]dot[)\]}] ?| dot | punkt | punto | point )[\w-]+)*", re.I)

# ---- training table --------------------------------------------------------

#: Labelled lines: [kind:words] marks a span.  Names and numbers are invented.
LABELLED = """
write to [email:jane.roe@mail.example.org] before noon
please contact [email:tom_b-12@sub.host.example] or call
mail [email:k.lee+list@example.net] for details
reach me under [email:anna at example dot org] any time
send it to [email:p.smith at mail dot example dot com] today
her address is [email:r.fox [at] example [dot] net] now
ask [email:office (at) example (dot) org] for it
email [email:m.bauer@firma] without more
contact: [email:info@exämple.org] they said
call [phone:+1 (415) 555-0134] after six
phone [phone:+44 20 7946 0958] is busy
tel. [phone:+49-30-901820] or later
under [phone:(415) 555-0199] the line was
mobile [phone:415-555-0132] and then
fax [phone:0049 30 901820] to the office
ring [phone:+1.212.555.0147] please
telefon [phone:030 / 5550 1234] heute
the number [phone:555-0176 4321] was given
from [ip:192.0.2.17] to the gate
host [ip:198.51.100.203] is down
server at [ip:203.0.113.9:8080] answered
ip [ip:10.0.0.255] was logged
they saw [ip:192.168.300.12] in the log
card [card:4111 1111 1111 1111] expired
paid with [card:5500-0000-0000-0004] then
number [card:4000000000000002] on file
visa [card:4012888888881881] and code
account [card:4111 1111 1111 1112] was wrong
the card [card:3782 822463 10005] of the guest
version 1.2.3 was out in 2021
chapter 12.4 and page 345 of the book
in 1999 there were 12000 people at the fair
he was at the house and saw the dot on the wall
a point at the end of the line is not a dot
built 2023-10-05 at 12:30:45 by the team
section 4.5.6.7.8 of the manual
the code AKIAQ7RZ2MEXAMPLE4T was there
password=4f9d2c7b1e was in the file
token = "9a8b7c6d5e4f3a2b1c0d9e8f7a6b5c4d" stays
see https://example.org/a/b?id=12345 for more
costs 12,50 or 1.299,00 in all
the 3.5 percent of 1000000 units
licensed under the general license, version 3.
apache license, version 2.0. and others
id 123456 row 99 of 4096
follow @someone on the page
100 % of it was $$$ and ### marks
a | b | c | d | e
the at of be dot to in
of%%% the&&& at%%% and&&& in%%% was.*** that*** at### the.&&&
AT!! THE!! END!! OF,!! THAT.!! LINE!!
at. at. at. at. at. dot. dot.
he came at noon. the dot was at the end.
order no. 4711-0815 was sent
isbn 978-3-16-148410-0 on the cover
""".strip().splitlines()


def labelled_rows(lines: list[str]) -> list[tuple[list[str], list[int]]]:
    """Words and tags of lines with marked spans."""
    out = []
    for line in lines:
        words, tags = [], []
        for m in re.finditer(r"\[(email|ip|card|phone):((?:[^\[\]]|\[(?:at|dot)\])*)\]|([^ ]+)", line):
            found = m.group(2).split() if m.group(1) else [m.group(3)]
            words += found
            tags += [1 + KINDS.index(m.group(1)) if m.group(1) else 0] * len(found)
        out.append((words, tags))
    return out


def line_rows(text: str, reach: int = 12) -> list[tuple[list[str], list[int]]]:
    """The lines of a text that hold digits or @, tagged by the base spans, and one other line."""
    spans = base_spans(text)
    out, at, plain = [], 0, False
    for line in text.split("\n"):
        if re.search(r"[0-9@]", line):
            words = [(m.start() + at, m.end() + at) for m in _WORD.finditer(line)]
            tags = [next((1 + k for k, s, e in spans if s < b and a < e), 0) for a, b in words]
            hot = [i for i, (a, b) in enumerate(words) if tags[i] or re.search(r"[0-9@]", text[a:b])]
            if hot:
                lo, hi = max(0, hot[0] - reach), min(hot[0] + reach, len(words))
                out.append(([text[a:b] for a, b in words[lo:hi]], tags[lo:hi]))
        elif len(words := _WORD.findall(line)[:2 * reach]) > 1 and not plain:
            plain = True  # one ordinary line of each text
            out.append((words, [0] * len(words)))
        at += len(line) + 1
    return out


def train(docs: DataFrame, lines: int = 600) -> Field:
    """The labelled table, together with at most ``lines`` lines of the corpus tagged by the base patterns."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where("text rlike '[0-9@*$%&|<>]'")
    n = texts.count()
    chance = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 30)) / float(1 << 30)
    part = texts.where(chance < lines / max(1, n)).distinct().orderBy("text").limit(lines).collect() if n else []
    rows = [r for t in part for r in line_rows(t["text"])[:3]][:lines]
    return fit(labelled_rows(LABELLED) * 6 + rows)


def added(field: Field, texts: list[str], known: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans of the field, per text, that touch no known span."""
    words, owner, begin, lines = [], [], [], []
    for i, text in enumerate(texts):
        pos = 0
        for line in text.split("\n"):
            found = line.split()
            if found:
                words.append(found)
                lines.append(line)
                owner.append(i)
                begin.append(pos)
            pos += len(line) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not words:
        return out
    score, offsets = _emissions(field, words)
    tags = viterbi(field, score, offsets)
    hot = np.flatnonzero(tags)
    if not len(hot):
        return out
    line = np.searchsorted(offsets, hot, side="right") - 1
    new = np.concatenate(([True], (np.diff(hot) != 1) | (np.diff(line) != 0) | (np.diff(tags[hot]) != 0)))
    runs = np.flatnonzero(new)
    places: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(runs, np.append(runs[1:], len(hot))):
        ln, kind = line[a], int(tags[hot[a]]) - 1
        first, last = int(hot[a] - offsets[ln]), int(hot[b - 1] - offsets[ln])
        if ln not in places:
            places[ln] = [m.span() for m in _WORD.finditer(lines[ln])]
        text, start, end = texts[owner[ln]], begin[ln] + places[ln][first][0], begin[ln] + places[ln][last][1]
        while end > start and text[end - 1] in ".,;:!?\"'":
            end -= 1
        while end > start and text[start] in "\"'<([{,;:" and not (kind == 3 and text[start] == "("):
            start += 1
        body = text[start:end]
        digits = len(_digits(body))
        enough = (last - first < 9 and _WRITTEN.fullmatch(body) if kind == 0
                  else body.count(".") >= 3 and digits >= 4 if kind == 1 else 13 <= digits <= 19 if kind == 2 else 7 <= digits <= 15)
        if enough and not any(s < end and start < e for _, s, e in known[owner[ln]]):
            out[owner[ln]].append((kind, start, end))
    return out


def spans_of(field: Field, texts: list[str]) -> tuple[list, list]:
    """Base and added spans of each text."""
    base = [base_spans(t) for t in texts]
    return base, added(field, texts, base)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """Counts and digest of the base spans and all spans, per row."""

    def run(batches):
        for batch in batches:
            texts, doc = texts_of(batch), unchunked(batch.column(0))
            for lo, hi in slices(texts):
                base, more = spans_of(field, texts.slice(lo, hi - lo).to_pylist())
                counts = [pa.array([sum(k == i for k, *_ in b) for b in base], pa.int64()) for i in range(len(KINDS))]
                digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b in base]
                yield pa.RecordBatch.from_arrays(
                    [doc.slice(lo, hi - lo), *counts, pa.array(digest, pa.string()), pa.array([joined(b + m) for b, m in zip(base, more)], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; ``n_chars``, where it exists, follows changed texts."""
    follows = "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            texts = texts_of(batch)
            null = unchunked(batch.column(batch.schema.get_field_index("text"))).is_null().to_numpy(zero_copy_only=False)
            out, changed = [], []
            for lo, hi in slices(texts):
                part = texts.slice(lo, hi - lo).to_pylist()
                for text, b, m in zip(part, *spans_of(field, part)):
                    pieces, at = [], 0
                    for k, s, e in sorted(b + m, key=lambda x: (x[1], -x[2])):
                        if s >= at:
                            pieces += [text[at:s], f"[{KINDS[k].upper()}]"]
                        at = max(at, e)
                    out.append("".join(pieces) + text[at:] if pieces else text)
                    changed.append(bool(pieces))
            new = {"text": pa.array([None if x else t for x, t in zip(null, out)], pa.string())}
            if follows:
                old = unchunked(batch.column(batch.schema.get_field_index("n_chars"))).to_pylist()
                new["n_chars"] = pa.array([len(t) if c else x for c, t, x in zip(changed, out, old)], pa.int64())
            yield with_columns(batch, **new)

    kinds = dict(docs.dtypes) | ({"n_chars": "bigint"} if follows else {}) | {"text": "string"}
    return docs.mapInArrow(run, ", ".join(f"`{n}` {kinds[n]}" for n in docs.columns))
