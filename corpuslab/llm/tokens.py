"""Encoding whole texts with a public tokenizer inside Spark tasks."""

from __future__ import annotations

import os
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_BYTES = 112 << 20  # of words and their ids that a worker keeps
CHUNK = 1 << 21

_BLANKS = bytes.maketrans(b"\t\n\v\f\rABCDEFGHIJKLMNOPQRSTUVWXYZ", b"     abcdefghijklmnopqrstuvwxyz")
_BLANKS_ONLY = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_KINDS = np.zeros(256, np.uint8)  # 1: blank, 2: stop, 3: letter
_KINDS[32] = 1
_KINDS[list(b".,;:!?")] = 2
_KINDS[97:123] = 3


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    The vocabulary lower-cases, drops white space and never merges across it, so a text's ids
    are the ids of its words one after the other; each distinct word is encoded once and kept
    (up to a number of bytes). Words of letters only need no normalising or splitting and take a
    shorter way through the same library; a stop that ends a word after a letter is a token run of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _learn(self, new: set[bytes]) -> None:
        plain, rest = [], []
        for raw in new:
            if raw.isalpha() and raw.islower():  # ASCII
                plain.append(raw)
                continue
            word = raw.decode()
            lower = not word.isascii() and word.isalpha() and word.islower() and word == word.lower() and unicodedata.is_normalized("NFC", word)
            (plain if lower else rest).append(raw)
        for tokenizer, words in ((self.letters, plain), (self.full, rest)):
            found = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            flat, at = array("I", chain.from_iterable(found)).tobytes(), 0
            for word, ids in zip(words, found):
                self.known[word] = flat[at : at + 4 * len(ids)]
                at += 4 * len(ids)
            self.held += 170 * len(words) + sum(map(len, words)) + len(flat)

    def _part(self, raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a stretch of bytes in which only blanks separate words, and where those of each row begin.

        Words are told apart by Arrow's dictionary encoding, with the blanks that follow them, so only different ones
        are touched one by one.
        """
        kind = _KINDS[raw]
        word = kind != 1
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[rows[rows < len(raw)]] = word[rows[rows < len(raw)]]
        first[1:-1] |= (kind[1:-1] == 2) & (kind[:-2] == 3) & (kind[2:] == 1)  # a stop that ends a word
        start = np.flatnonzero(first)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        ends = np.append(start, len(raw))
        slices = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        distinct = [w.rstrip(b" ") for w in slices.dictionary.to_pylist()]
        new = set(distinct).difference(self.known)
        if new:
            self._learn(new)
        each = [self.known[w] for w in distinct]
        if self.held > CACHED_BYTES:
            self.known, self.held = {}, 0
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        index = slices.indices.to_numpy()
        counts = sizes[index]
        stops = np.cumsum(counts)
        source = np.repeat((np.cumsum(sizes) - sizes)[index] - (stops - counts), counts) + np.arange(stops[-1])
        return flat[source], np.append(0, stops)[np.searchsorted(start, rows)]

    def encode_column(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, after last row, ids of these rows one after the other, where each row's begin and the last end).

        Every row ends with ``end_id``; a null text is empty. Rows come together up to CHUNK bytes, a longer text alone.
        """
        column = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = memoryview(column.buffers()[2] or b"")
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
            raw = bytes(data[offsets[lo] : offsets[hi]])
            at = offsets[lo : hi + 1] - offsets[lo]
            folded = bytearray(raw.translate(_BLANKS))
            # Special tokens are matched before lower-casing, so texts with their sign keep their case.
            sign = raw.find(b"<|")
            while sign >= 0:
                row = int(np.searchsorted(at, sign, "right")) - 1
                a, b = int(at[row]), int(at[row + 1])
                folded[a:b] = raw[a:b].translate(_BLANKS_ONLY)
                sign = raw.find(b"<|", b)
            units = np.frombuffer(folded, np.uint8)
            if len(units) <= 2 * CHUNK:
                ids, begins = self._part(units, at[:-1])
            else:  # one long text, cut at blanks
                parts, start = [], 0
                while start < len(units):
                    stop = folded.find(b" ", start + CHUNK)
                    stop = len(units) if stop < 0 else stop
                    parts.append(self._part(units[start:stop], np.zeros(1, np.int64))[0])
                    start = stop
                ids, begins = np.concatenate(parts), np.zeros(1, np.int64)
            bounds = np.append(begins, len(ids))
            yield lo, hi, np.insert(ids, bounds[1:], end_id).astype("<u4"), bounds + np.arange(hi - lo + 1)
            lo = hi


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker; later tasks find its words again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def in_chunks(texts: list[str | None], size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Index ranges of texts with about ``size`` characters together."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
