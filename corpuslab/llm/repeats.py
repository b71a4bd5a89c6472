"""Finding every stretch of a text whose windows also start earlier, without comparing texts in pairs.

1. Each document is cut into runs of windows that share an anchor (see ``windows.anchors``); anchors that occur once
   are dropped.
2. Runs that are equal as a whole repeat as a whole: all but the first are duplicates.
3. Where an anchor has several different runs, one copy of each is fetched and a resolver compares those few; it is
   the operator's own method. Anchors with more than MAX_RUNS different runs, too many for one task, are compared by
   window hash in a grouped aggregation instead, which has no limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch, join_groups
from corpuslab.llm.tokens import in_chunks
from corpuslab.llm.windows import anchors, window_hashes

MAX_RUNS = 1 << 14
TAG_BITS = 20
NO_ID = -(1 << 63)
SPANS = "doc long, at long, size long"
# A resolver takes the runs of some anchors, in text order, as (group, doc, at, units with one more unit on the left or
# 0 there) and yields (repeat, doc, at, size, first) for every occurrence of every repeat.
Resolver = Callable[[list[tuple[int, int, int, np.ndarray]]], Iterator[tuple[int, int, int, int, bool]]]


@dataclass
class Kind:
    """What a text is a sequence of, and how long a repeat must be."""

    units: Callable[[str | None], np.ndarray]
    width: int
    gram: int
    resolver: Resolver
    stored: type = np.uint64  # what holds a unit, and 0, between tasks


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, tag, text. Position ``at`` = start * 2^20 + tag; the tag tells rows with one id but different texts apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    tag = F.pmod(F.xxhash64(body), F.lit(1 << TAG_BITS))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), tag.alias("tag"), body.alias("text"))


def _anchor_rows(texts: DataFrame, kind: Kind, left: bool = False) -> DataFrame:
    """The runs of all texts; with ``left`` also the unit before each, -1 at the start of a text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts_ = batch.column(2).to_pylist()
            for lo, hi in in_chunks(texts_):
                units = [kind.units(t) for t in texts_[lo:hi]]
                for a in anchors(units, kind.width, kind.gram):
                    row = a.row + lo
                    at = (a.low.astype(np.int64) << TAG_BITS) | tags[row]
                    columns = [pa.array(a.anchor), pa.array(a.slice), pa.array(docs[row]), pa.array(at), pa.array(a.count.astype(np.int32))]
                    names = ["anchor", "slice", "doc", "at", "count"]
                    if left:
                        before = [int(units[r][x - 1]) if x else -1 for r, x in zip(a.row.tolist(), a.low.tolist())]
                        columns, names = [*columns, pa.array(before, pa.int64())], [*names, "left"]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return texts.mapInArrow(find, "anchor long, slice long, doc long, at long, count int" + ", left long" * left)


def fetch(texts: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """anchor, hot, doc, at, units of the wanted runs (anchor, hot, doc, at, count)."""
    tag = F.col("at").bitwiseAND((1 << TAG_BITS) - 1)
    lists = wanted.groupBy("doc", tag.alias("tag")).agg(F.collect_list(F.struct("anchor", "hot", "at", "count")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                units = np.concatenate([np.zeros(1, np.uint64), kind.units(text)])
                out = ([], [], [], [])
                for r in runs:
                    start = r["at"] >> TAG_BITS
                    for column, value in zip(out, (r["anchor"], r["hot"], r["at"], units[start : start + r["count"] + kind.width].astype(kind.stored).tobytes())):
                        column.append(value)
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays([columns[0], columns[1], pa.array(np.full(len(runs), doc)), columns[2], columns[3]], ["anchor", "hot", "doc", "at", "units"])

    # The same text may stand in several rows with one id; one of them is enough.
    joined = texts.join(lists, ["doc", "tag"]).select("doc", "text", "runs")
    return joined.mapInArrow(cut, "anchor long, hot boolean, doc long, at long, units binary").dropDuplicates(["anchor", "doc", "at"])


def _resolve(runs: DataFrame, kind: Kind) -> DataFrame:
    """All occurrences of repeats between the different runs of an anchor: anchor, repeat, doc, at, size, first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, last = [], 0, None

        def out() -> pa.RecordBatch:
            found = list(kind.resolver(held))
            columns = list(zip(*found)) if found else [[], [], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["repeat", "doc", "at", "size", "first"])

        for batch in batches:
            for row in zip(*[batch.column(n).to_pylist() for n in ("anchor", "doc", "at", "units")]):
                if row[0] != last and total >= 1 << 15:  # whole anchors together, some at a time
                    yield out()
                    held, total = [], 0
                units = np.frombuffer(row[3], kind.stored).astype(np.uint64)
                held.append((row[0], row[1], row[2], units))
                total += len(units)
                last = row[0]
        if held:
            yield out()

    dealt = runs.repartition("anchor").sortWithinPartitions("anchor", "doc", "at")
    return dealt.mapInArrow(run, "repeat long, doc long, at long, size long, first boolean")


def _hot_windows(runs: DataFrame, scratch: Scratch, kind: Kind) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                one, two = window_hashes(np.frombuffer(raw, kind.stored)[1:].astype(np.uint64), kind.width)
                places = at + (np.arange(len(one), dtype=np.int64) << TAG_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.full(len(one), doc)), pa.array(places)], ["one", "two", "doc", "at"])

    rows = scratch.settle(runs.select("doc", "at", "units").mapInArrow(split, "one long, two long, doc long, at long"), "hot_windows")
    groups = rows.groupBy("one", "two").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.settle(groups, "hot_groups")
    found = join_groups(rows, groups, ["one", "two"], "n").where(F.col("n").isNotNull() & (F.struct("doc", "at") != F.col("first")))
    return found.select("doc", "at", F.lit(kind.width).cast("long").alias("size"))


def repeated_anchors(texts: DataFrame, scratch: Scratch, kind: Kind, left: bool = False) -> DataFrame:
    """The runs whose anchor occurs more than once, with n and ``several`` (different runs) of the anchor."""
    rows = scratch.settle(_anchor_rows(texts, kind, left), "anchors")
    seen = rows.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("slice") != F.max("slice")).alias("several")).where("n > 1")
    seen = scratch.settle(seen, "seen")
    found = join_groups(rows, seen, ["anchor"], "n").where("n is not null")
    found = scratch.settle(found, "found")
    scratch.drop("anchors")
    return found


def repeats(texts: DataFrame, scratch: Scratch, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """Duplicate spans (doc, at, size), and occurrences of the resolver's repeats (repeat, doc, at, size, first)."""
    found = repeated_anchors(texts, scratch, kind)
    runs = found.groupBy("anchor", "slice").agg(
        F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("copies"), F.first("count").alias("count"), F.first("several").alias("several")
    )
    runs = scratch.settle(runs, "runs")
    copied = runs.where("copies > 1").select("anchor", "slice", "first", "copies")
    whole = join_groups(found.select("anchor", "slice", "doc", "at", "count"), copied, ["anchor", "slice"], "copies")
    whole = whole.where(F.col("copies").isNotNull() & (F.struct("doc", "at") != F.col("first")))
    whole = whole.select("doc", "at", (F.col("count") + kind.width - 1).cast("long").alias("size"))

    several = runs.where("several").select("anchor", "first.doc", "first.at", "count")
    crowds = scratch.settle(several.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > MAX_RUNS), "crowds")
    marked = join_groups(several, crowds, ["anchor"], "m").withColumn("hot", F.col("m").isNotNull())
    fetched = scratch.settle(fetch(texts, marked, kind), "fetched")
    groups = scratch.settle(_resolve(fetched.where("not hot"), kind), "groups")
    spans = whole.unionByName(groups.where("not first").select("doc", "at", "size"))
    return spans.unionByName(_hot_windows(fetched.where("hot"), scratch, kind)), groups


def spans_by_document(spans: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, tag, spans (array of start, size): one row per document that has any."""
    tag = F.col("at").bitwiseAND((1 << TAG_BITS) - 1)
    start = F.shiftright("at", TAG_BITS)
    lists = spans.groupBy("doc", tag.alias("tag")).agg(F.collect_list(F.struct(start.alias("start"), "size")).alias("spans"))
    return scratch.settle(lists, "spans")


def covered(n: int, spans: list[dict] | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which of n units some span covers, and the maximal covered runs (start, end)."""
    change = np.zeros(n + 2, np.int64)
    if spans:
        starts = np.array([s["start"] for s in spans])
        np.add.at(change, starts + 1, 1)
        np.add.at(change, starts + np.array([s["size"] for s in spans]) + 1, -1)
    inside = np.cumsum(change) > 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return inside[1 : n + 1], list(zip(edges[::2].tolist(), edges[1::2].tolist()))
