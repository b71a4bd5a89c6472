"""Substring duplicates from the common-prefix interval tree of an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch, join_groups
from corpuslab.llm.repeats import NO_ID, TAG_BITS, Kind, covered, fetch, keyed, repeated_anchors, repeats, spans_by_document
from corpuslab.llm.windows import byte_units, window_hashes

MIN_BYTES = 100
GRAM = 24
BLOCK = 1 << 15


def suffix_array(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes text[start:end], and common prefix lengths of neighbours in it.

    Units are at least 1, and a suffix is padded with zeros, so one that ends first sorts before those it begins.
    """
    longest = int((ends - starts).max())
    padded = np.concatenate([text.astype(np.uint8), np.zeros(longest, np.uint8)])
    table = np.lib.stride_tricks.sliding_window_view(padded, longest)[starts]
    for at in range(0, len(starts), BLOCK):  # the table is the largest thing a task holds; all else goes in blocks
        table[at : at + BLOCK][np.arange(longest) >= (ends - starts)[at : at + BLOCK, None]] = 0
    order = np.argsort(table.view(f"S{longest}")[:, 0], kind="stable")
    common = np.empty(len(order) - 1, np.int64)
    for at in range(0, len(common), BLOCK):
        upper, lower = table[order[at : at + BLOCK + 1][:-1]], table[order[at + 1 : at + BLOCK + 1]]
        differ = (upper != lower) | (lower == 0)
        common[at : at + BLOCK] = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
    return order, common


def prefix_intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of each node of the common-prefix interval tree with length >= least, by one stack scan."""
    stack: list[tuple[int, int]] = []  # length, first
    for i, length in enumerate([*common.tolist(), 0], 1):
        first = i - 1
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            yield top, first, i - 1
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def resolve(runs: list[tuple[int, int, int, np.ndarray]]) -> Iterator[tuple[int, int, int, int, bool]]:
    """Maximal repeats of at least MIN_BYTES among the runs, each with all its occurrences.

    Only windows that occur twice start a suffix. A node of the interval tree is a maximal repeat if its suffixes are
    preceded by different bytes; one at the left edge of its run counts as different, as what precedes it belongs to
    another anchor.
    """
    text = np.concatenate([u for *_, u in runs]).astype(np.int64)
    lengths = np.array([len(u) for *_, u in runs])
    begin = np.cumsum(lengths) - lengths
    starts, hashes, owner = [], [], []
    for k, (*_, units) in enumerate(runs):
        one, _ = window_hashes(units[1:], MIN_BYTES)
        starts.append(begin[k] + 1 + np.arange(len(one)))
        hashes.append(one)
        owner.append(np.full(len(one), k))
    starts, owner = np.concatenate(starts), np.concatenate(owner)
    _, place, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    twice = times[place] > 1
    starts, owner = starts[twice], owner[twice]
    if not len(starts):
        return
    order, common = suffix_array(text, starts, begin[owner] + lengths[owner])
    starts, owner = starts[order], owner[order]
    inner = starts - begin[owner] - 1
    left = np.where(inner > 0, text[starts - 1], -1 - np.arange(len(starts)))
    for length, first, last in prefix_intervals(common, MIN_BYTES):
        before = left[first : last + 1]
        if (before == before[0]).all():
            continue
        found = sorted((runs[owner[i]][1], runs[owner[i]][2] + (int(inner[i]) << TAG_BITS)) for i in range(first, last + 1))
        repeat = hash((runs[owner[first]][0], length, found[0])) & ((1 << 63) - 1)
        for doc, at in found:
            yield repeat, doc, at, length, (doc, at) == found[0]


KIND = Kind(byte_units, MIN_BYTES, GRAM, resolve, np.uint8)


def _marks(found: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """anchor, slice, copies, again, heads of every different run.

    ``again`` are the places in it whose window occurs twice or more, ``heads`` those of them whose window stands after
    different bytes or at the start of a text, as (place, one, two); equal windows share one and two. A repeat that
    starts anywhere else goes on to the left in all its occurrences, so it is not maximal.
    """
    runs = found.groupBy("anchor", "slice").agg(
        F.min(F.struct("doc", "at")).alias("first"),
        F.count("*").alias("copies"),
        F.first("count").alias("count"),
        F.first("several").alias("several"),
        F.min("left").alias("low"),
        F.max("left").alias("high"),
    )
    runs = scratch.settle(runs, "runs")
    head = "place int, one long, two long"
    lone = runs.where("not several").select(
        *["anchor", "slice", "copies"],
        F.expr("sequence(0, count - 1)").alias("again"),
        F.expr("if(low < high or low = -1, array(named_struct('place', 0, 'one', anchor, 'two', slice)), array())").cast(f"array<struct<{head}>>").alias("heads"),
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "slice", "copies", "place", "one", "two", "low", "high"]
        for batch in batches:
            for anchor, slice_, copies, low, high, raw in zip(*[batch.column(n).to_pylist() for n in ("anchor", "slice", "copies", "low", "high", "units")]):
                units = np.frombuffer(raw, np.uint8)
                one, two = window_hashes(units[1:].astype(np.uint64), MIN_BYTES)
                n = len(one)
                before = np.stack([units[:n], units[:n]]).astype(np.int64)
                before[:, 0] = low, high
                same = [np.full(n, x, np.int64) for x in (anchor, slice_, copies)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, (one, two, *before))], names)

    several = runs.where("several").select("anchor", "slice", "copies", "low", "high", "count", F.col("first.doc").alias("doc"), F.col("first.at").alias("at"))
    fetched = fetch(texts, several.select("anchor", "doc", "at", "count", F.lit(False).alias("hot")), KIND)
    rows = fetched.join(several.drop("count"), ["anchor", "doc", "at"]).select("anchor", "slice", "copies", "low", "high", "units")
    windows = rows.mapInArrow(split, "anchor long, slice long, copies long, place int, one long, two long, low long, high long")
    windows = scratch.settle(windows, "windows")
    classes = windows.groupBy("one", "two").agg(F.sum("copies").alias("times"), F.count("*").alias("n"), F.min("low").alias("least"), F.max("high").alias("most"))
    classes = scratch.settle(classes.where("times > 1"), "classes")
    judged = join_groups(windows, classes, ["one", "two"], "n").where("n is not null")
    begins = F.when(F.expr("least < most or least = -1"), F.struct("place", "one", "two"))
    crowd = judged.groupBy("anchor", "slice").agg(F.first("copies").alias("copies"), F.collect_list("place").alias("again"), F.collect_list(begins).alias("heads"))
    return scratch.settle(lone.unionByName(crowd), "marks")


def _tails(texts: DataFrame, found: DataFrame, marks: DataFrame) -> DataFrame:
    """one, two, tail, doc, at, left: each place a maximal repeat can start at, and the text from there up to the first
    byte that no repeat from there reaches."""
    joined = join_groups(found.select("anchor", "slice", "doc", "at"), marks, ["anchor", "slice"], "copies").where("copies is not null")
    tag = F.col("at").bitwiseAND((1 << TAG_BITS) - 1)
    low = F.shiftright("at", TAG_BITS).alias("low")
    lists = joined.groupBy("doc", tag.alias("tag")).agg(F.collect_list(F.struct(low, "again", "heads")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag_, text, runs in zip(*[batch.column(n).to_pylist() for n in ("doc", "tag", "text", "runs")]):
                raw = text.encode()
                repeated = np.zeros(len(raw) + 1, bool)
                for r in runs:
                    repeated[r["low"] + np.array(r["again"], np.int64)] = True
                breaks = np.flatnonzero(~repeated)
                heads = [(r["low"] + h["place"], h["one"], h["two"]) for r in runs for h in r["heads"]]
                ends = breaks[np.searchsorted(breaks, [p for p, *_ in heads])] + MIN_BYTES - 1 if heads else []
                out: list[tuple] = []
                held = 0
                for (p, one, two), end in zip(heads, ends):
                    out.append((one, two, raw[p:end], doc, p << TAG_BITS | tag_, raw[p - 1] if p else -1))
                    held += int(end) - p
                    if held >= 1 << 22:
                        yield pack(out)
                        out, held = [], 0
                if out:
                    yield pack(out)

    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["one", "two", "tail", "doc", "at", "left"]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return texts.join(lists, ["doc", "tag"]).mapInArrow(cut, "one long, two long, tail binary, doc long, at long, left long")


def _common(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    differ = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


def maximal_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """repeat, doc_id, start, size: every maximal repeat of at least 100 bytes, a row for each of its occurrences.

    A repeat is maximal if its occurrences neither all stand after the same byte nor all before the same byte; the start
    and the end of a text are unlike any byte. Equal rows are the same document and count once. Repeats that begin with
    the same 100 bytes are nodes of one common-prefix interval tree over the sorted texts that follow there. A task
    holds the places of one tree and two such texts at a time. The output names all occurrences of all repeats, which
    in a text of one byte n times is about n * n / 2 rows.
    """
    scratch = Scratch(docs.sparkSession, "maximal_repeats")
    texts = scratch.settle(keyed(docs, key, text).dropDuplicates(["doc", "text"]), "texts")
    found = repeated_anchors(texts, scratch, KIND, left=True)
    tails = _tails(texts, found, _marks(found, texts, scratch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, b""
        places: list[tuple[int, int, int]] = []
        common: list[int] = []
        for batch in batches:
            for one, two, tail, *place in zip(*[c.to_pylist() for c in batch.columns]):
                if (one, two) != group:
                    if group is not None:
                        yield from tree(group, places, common)
                    group, places, common = (one, two), [], []
                else:
                    common.append(_common(last, tail))
                places.append(tuple(place))
                last = tail
        if group is not None:
            yield from tree(group, places, common)

    def tree(group: tuple[int, int], places: list[tuple[int, int, int]], common: list[int]) -> Iterator[pa.RecordBatch]:
        doc, at, left = (np.array(c, np.int64) for c in zip(*places))
        new = np.ones(len(left), bool)  # unlike the byte before the place above it
        new[1:] = (left[1:] != left[:-1]) | (left[1:] < 0)
        latest = np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))
        for length, first, last in prefix_intervals(np.array(common, np.int64), MIN_BYTES):
            if latest[last] <= first and left[first] >= 0:
                continue
            repeat = hash((*group, length, first)) & ((1 << 63) - 1)
            for lo in range(first, last + 1, 1 << 16):
                hi = min(last + 1, lo + (1 << 16))
                same = [np.full(hi - lo, x, np.int64) for x in (repeat, length)]
                yield pa.RecordBatch.from_arrays([pa.array(same[0]), pa.array(doc[lo:hi]), pa.array(at[lo:hi]), pa.array(same[1])], ["repeat", "doc", "at", "size"])

    dealt = tails.repartition("one", "two").sortWithinPartitions("one", "two", "tail", "doc", "at")
    groups = dealt.mapInArrow(run, "repeat long, doc long, at long, size long")
    return groups.select("repeat", F.nullif("doc", F.lit(NO_ID)).alias(key), F.shiftright("at", TAG_BITS).alias("start"), "size")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end in bytes), kept (binary), a row per row of ``docs``.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a smaller id, or in the same text
    further left. Null texts are empty; a null id is smaller than any other; rows with one id and different texts are
    taken in order of position; equal rows are the same document and get the same result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "suffix_repeats")
    texts = keyed(docs, key, text)
    spans, _ = repeats(texts, scratch, KIND)
    lists = spans_by_document(spans, scratch)
    schema = "doc long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text_, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = text_.encode()
                if not found:
                    rows.append((len(raw), 0, 0, [], raw))
                    continue
                mask, runs = covered(len(raw), found)
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                rows.append((len(raw), len(raw) - len(kept), len(runs), [{"start": a, "end": b} for a, b in runs], kept))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), runs_type, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = texts.join(lists, ["doc", "tag"], "left").select("doc", "text", "spans")
    return joined.mapInArrow(cut, schema).select(F.nullif("doc", F.lit(NO_ID)).alias(key), "n_bytes", "n_removed", "n_spans", "spans", "kept")
