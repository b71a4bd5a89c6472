"""Duplicate word spans by relative Lempel-Ziv parsing against indexed reference blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch
from corpuslab.llm.repeats import NO_ID, TAG_BITS, Kind, covered, keyed, repeats, spans_by_document
from corpuslab.llm.windows import word_units

MIN_WORDS = 20
GRAM = 6


def parse(runs: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, bool]]:
    """Greedy factors of each run against the reference block of its anchor, which is all text before it.

    The block is indexed by windows of MIN_WORDS words. From each place the factor goes as far as the reference agrees;
    the next search starts at the first window that crosses the factor's end, so factor boundaries are checked too.
    """
    index: dict[bytes, tuple[np.ndarray, int]] = {}
    block, number = None, 0
    for anchor, doc, at, units in runs:
        if anchor != block:
            index, block = {}, anchor
        words = units[1:]
        raw, i, step = words.tobytes(), 0, words.itemsize
        last = len(words) - MIN_WORDS
        indexed = 0
        while i <= last:
            while indexed < i:  # windows of this run that start before
                index.setdefault(raw[indexed * step : (indexed + MIN_WORDS) * step], (words, indexed))
                indexed += 1
            hit = index.get(raw[i * step : (i + MIN_WORDS) * step])
            if hit is None:
                i += 1
                continue
            source, start = hit
            room = min(len(words) - i, len(source) - start)
            differ = np.flatnonzero(words[i : i + room] != source[start : start + room])
            size = int(differ[0]) if len(differ) else room
            number += 1
            yield number, doc, at + (i << TAG_BITS), size, False
            i += size - MIN_WORDS + 1
        while indexed <= last:
            index.setdefault(raw[indexed * step : (indexed + MIN_WORDS) * step], (words, indexed))
            indexed += 1


KIND = Kind(word_units, MIN_WORDS, GRAM, parse)


def remove_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (start, end in words), kept (text of the kept words), a row per row of ``docs``.

    A word goes if a window of 20 words that covers it also starts earlier: in a smaller id, or in the same text further
    left. Words stand between ASCII white space and are compared as they are. Null texts have none; a null id is smaller
    than any other; rows with one id and different texts are taken in order of position; equal rows are the same document
    and get the same result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "relative_lz")
    texts = keyed(docs, key, text)
    spans, _ = repeats(texts, scratch, KIND)
    lists = spans_by_document(spans, scratch)
    schema = "doc long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string"
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text_, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, runs = text_.encode().split(), []
                n = len(words)
                if found:
                    mask, runs = covered(n, found)
                    words = [w for w, gone in zip(words, mask.tolist()) if not gone]
                rows.append((n, n - len(words), [{"start": a, "end": b} for a, b in runs], b" ".join(words).decode()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), runs_type, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "n_words", "n_removed", "spans", "kept"])

    joined = texts.join(lists, ["doc", "tag"], "left").select("doc", "text", "spans")
    return joined.mapInArrow(cut, schema).select(F.nullif("doc", F.lit(NO_ID)).alias(key), "n_words", "n_removed", "spans", "kept")
