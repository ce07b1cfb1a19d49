"""Token ids of whole texts with the tokenizers and sentencepiece libraries.

White-space separated pieces of a text are tokenized independently by the kinds
of vocabulary used here, and so is a mark such as a comma that ends a piece
behind a letter.  So each batch encodes every distinct stem once (an Arrow memo
of bounded size keeps stems between batches) and gathers ids by index.  Texts in
which a piece boundary could matter (runs of white space, white space other than
space and line feed, the mark for a space, with byte-level and sentencepiece
vocabularies) go to the tokenizer whole.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

MEMO = 500_000
MEMO_CHARS = 48
ODD = (r"[ \n][ \n]|^[ \n]|[ \n]$|[\t\r\x0b\x0c]|\x{85}|\x{a0}|\x{1680}|[\x{2000}-\x{200a}]"
       r"|\x{2028}|\x{2029}|\x{202f}|\x{205f}|\x{3000}|[\x1c-\x1f]|\x{2581}")  # the last one stands for a space in sentencepiece
MARKS = ",.;:!?"
#: A mark behind a letter; not behind one that lower-cases to more than a letter, nor behind letters of late Unicode versions.
MARKED = r"[^\x{130}\P{L}\x{2c00}-\x{10ffff}][" + MARKS + "]$"


class Encoder:
    """Ids of many texts; ``spaced``: a piece's leading space is part of it (byte-level vocabularies).

    ``prefix``: encode each text behind a space.  ``plain_specials``: strings of
    special tokens are ordinary text.
    """

    def __init__(self, path: str, spaced: bool, prefix: bool = False, plain_specials: bool = False):
        self.spaced, self.prefix = spaced, prefix
        self._open(path, plain_specials)
        self.keys = pa.array([], pa.large_string())
        self.blob, self.start, self.length = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        marks = self._tokenize(list(MARKS))
        self.mark_id = np.array([m[0] if len(m) == 1 else 0 for m in marks], "<u4")
        self.marked = all(len(m) == 1 for m in marks)

    def _open(self, path: str, plain_specials: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain_specials
        self.size = self.tok.get_vocab_size()

    def _tokenize(self, chunks: list[str]) -> list[list[int]]:
        """Ids of pieces as they stand inside a text."""
        return [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(" " + text if self.prefix else text, add_special_tokens=False).ids

    @staticmethod
    def _chunk(key: str) -> str:
        if key[:2] == "\n\n":  # marks the first piece of a text
            return key[2:]
        return key if key[:1] == "\n" else " " + key

    def _stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of distinct stems."""
        at = pc.fill_null(pc.index_in(stems, value_set=self.keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        start, length = self.start[at] if len(self.start) else np.zeros(len(at), np.int64), self.length[at] if len(self.start) else np.zeros(len(at), np.int64)
        if not len(new):
            return self.blob, start, length
        missing = stems.take(pa.array(new))
        names, blobs, counts = missing.to_pylist(), [self.blob], np.empty(len(new), np.int64)
        for lo in range(0, len(names), 20_000):
            part = names[lo:lo + 20_000]
            ids = self._tokenize([self._chunk(k) for k in part] if self.spaced else part)
            counts[lo:lo + len(part)] = [len(i) for i in ids]
            flat = array("I")
            for i in ids:
                flat.extend(i)
            blobs.append(np.frombuffer(flat, "<u4"))
        blob = np.concatenate(blobs)
        start[new], length[new] = len(self.blob) + np.cumsum(counts) - counts, counts
        room = MEMO - len(self.keys)
        if room > 0:
            keep = np.flatnonzero(pc.utf8_length(missing).to_numpy(zero_copy_only=False) <= MEMO_CHARS)[:room]
            n, first = counts[keep], start[new[keep]]
            self.start = np.concatenate((self.start, len(self.blob) + np.cumsum(n) - n))
            self.length = np.concatenate((self.length, n))
            self.blob = np.concatenate((self.blob, blob[ragged(first, n)]))
            self.keys = pa.concat_arrays([self.keys, missing.take(pa.array(keep))])
        return blob, start, length

    def _pieces(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct pieces."""
        if self.marked:
            cut = pc.match_substring_regex(keys, MARKED)
            raw = keys.cast(pa.large_binary())
            stems = pc.if_else(cut, pc.binary_slice(raw, 0, -1), raw).view(pa.large_string()).dictionary_encode()
            cut = cut.to_numpy(zero_copy_only=False).astype(np.int64)
            blob, start, length = self._stems(stems.dictionary)
            code = stems.indices.to_numpy(zero_copy_only=False)
            start, length = start[code], length[code]
        else:
            cut = np.zeros(len(keys), np.int64)
            blob, start, length = self._stems(keys)
        total = length + cut
        at = np.concatenate(([0], np.cumsum(total)))
        out = np.empty(at[-1], "<u4")
        out[ragged(at[:-1], length)] = blob[ragged(start, length)]
        if cut.any():
            ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset + 1:keys.offset + 1 + len(keys)]
            which = np.zeros(256, np.int64)
            which[list(MARKS.encode())] = np.arange(len(MARKS))
            hit = cut > 0
            out[at[1:][hit] - 1] = self.mark_id[which[np.frombuffer(keys.buffers()[2], np.uint8)[ends[hit] - 1]]]
        return out, at

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:
            x = pc.replace_substring(texts, "\n", " \n")
            if not self.prefix:
                x = pc.binary_join_element_wise(pa.scalar("\n\n", pa.large_string()), x, pa.scalar("", pa.large_string()))
        else:
            x = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        lists = pc.split_pattern(x, " ")
        flat = lists.values.dictionary_encode()
        blob, at = self._pieces(flat.dictionary)
        codes = flat.indices.to_numpy(zero_copy_only=False)
        n = np.diff(at)[codes]
        ids = blob[ragged(at[:-1][codes], n)]
        return ids, np.concatenate(([0], np.cumsum(n)))[np.asarray(lists.offsets)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if not self.spaced:
            return self._plain(texts)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False).astype(bool)
        if not odd.any():
            return self._plain(texts)
        ids, offsets = self._plain(texts.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        lengths, parts = np.zeros(len(texts), np.int64), [None] * len(texts)
        for j, i in enumerate(np.flatnonzero(~odd)):
            parts[i] = ids[offsets[j]:offsets[j + 1]]
        for i in np.flatnonzero(odd):
            parts[i] = np.array(self._whole(texts[int(i)].as_py()), dtype="<u4")
        lengths[:] = [len(p) for p in parts]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(lengths)))


class PieceEncoder(Encoder):
    """Ids of a sentencepiece vocabulary with byte fallback, which puts a space before each text itself."""

    def __init__(self, path: str):
        super().__init__(path, spaced=True, prefix=True)
        self.marked &= not any(len(p) > 1 and p[i] in MARKS and p[i - 1].isalpha() for p in self.names for i in range(1, len(p)))

    def _open(self, path: str, plain_specials: bool) -> None:
        import sentencepiece

        self.tok = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.tok.get_piece_size()
        self.names = self.tok.id_to_piece(list(range(self.size)))

    def _tokenize(self, chunks: list[str]) -> list[list[int]]:
        """The library puts a space before each chunk, which a line feed (never part of a longer piece) keeps apart from what follows."""
        kinds = [0 if c[:1] == " " else 1 if c[:1] == "\n" else 2 for c in chunks]
        found = self.tok.encode([(c[1:], c, "\n" + c)[k] for c, k in zip(chunks, kinds)], num_threads=1)
        return [f[k:] for f, k in zip(found, kinds)]

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text)


@functools.lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    return Encoder(path, spaced)


@functools.lru_cache(maxsize=2)
def prefixed(path: str) -> Encoder:
    """Byte-level or sentencepiece ids of a space followed by the text; special tokens' strings are ordinary text."""
    return PieceEncoder(path) if path.endswith(".model") else Encoder(path, True, True, True)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by ``end_id``."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, dtype="<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)
