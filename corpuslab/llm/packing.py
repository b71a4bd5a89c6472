"""Packing documents into sequences by minimum bin slack.

Every document gives full sequences and one remainder. Only the histogram of remainder lengths, at most
capacity - 1 numbers, decides the plan: a subset-sum dynamic program over a bitset picks the multiset of
lengths that fills a sequence closest to capacity, and the same choice is made as often as the counts allow; where
no choice fits exactly, one piece is cut.
Documents then find their place by their position in (length, id) order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch
from corpuslab.llm.tokens import encoder
from corpuslab.operators.ordering import running_totals

CAPACITY = 2048


def best_fill(counts: dict[int, int], order: list[int], capacity: int) -> dict[int, int]:
    """How many of each length sum up closest to ``capacity`` without passing it, earlier lengths preferred."""
    reach, full = 1, (1 << (capacity + 1)) - 1
    states: list[tuple[int, int, int]] = []  # length, copies, sums reachable without it
    for length in order:
        copies = min(counts[length], capacity // length)
        if not copies:
            continue
        states.append((length, copies, reach))
        step, left = 1, copies
        while left:  # 1, 2, 4, ... copies at once
            take = min(step, left)
            reach |= (reach << (length * take)) & full
            left -= take
            step *= 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(states):
        k = 0
        while not before >> (total - k * length) & 1:
            k += 1
        if k:
            used[length] = k
            total -= k * length
    return used


@dataclass
class Slot:
    """Members ``start`` to ``stop - 1`` of a class are pieces ``piece``, ``piece + 1``, ... of a fill's length.

    A sequence takes ``copies`` of them side by side from ``offset`` on; ``first`` is the fill's first sequence. A cut
    member leaves ``size`` ids here and goes on as a member of class ``child``.
    """

    group: int
    start: int
    stop: int
    piece: int
    copies: int
    first: int
    offset: int
    size: int
    child: int


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int, int]:
    """Slots for all pieces, the number of sequences, and the longest chain of cuts.

    The length with the most tokens left opens a sequence, so a very common length is mixed with others while there are
    others; the rest is the best fill of the remaining room. A fill that leaves slack takes one more piece, cut to fit;
    what is left of it is a piece of a new class. Each fill is repeated until a length runs out, so there are few
    different ones, whatever the number of documents, and only the last sequence is not full.
    """
    pools = {length: [(length, 0, n)] for length, n in counts.items() if n > 0}  # length: (class, from, until)
    left = {length: n for length, n in counts.items() if n > 0}
    depth = {length: 0 for length in left}
    slots, sequences, made, deepest = [], 0, capacity, 0

    def draw(length: int, copies: int, times: int, offset: int, size: int, child: int) -> int:
        piece, need, chain = 0, copies * times, 0
        while need:
            group, start, stop = pools[length][0]
            take = min(need, stop - start)
            slots.append(Slot(group, start, start + take, piece, copies, sequences, offset, size, child))
            chain = max(chain, depth[group])
            pools[length][0] = (group, start + take, stop)
            if start + take == stop:
                pools[length].pop(0)
            piece, need = piece + take, need - take
        left[length] -= copies * times
        if not left[length]:
            del left[length], pools[length]
        return chain

    while left:
        order = sorted(left, key=lambda length: (-left[length] * length, -length))
        first = order[0]
        rest = dict(left)
        rest[first] -= 1
        fill = best_fill(rest, order, capacity - first)
        fill[first] = fill.get(first, 0) + 1
        slack = capacity - sum(length * k for length, k in fill.items())
        cut = next((length for length in order if length > slack and left[length] > fill.get(length, 0)), None) if slack else None
        times = min(left[length] // (k + (length == cut)) for length, k in fill.items())
        if cut is not None:
            times = min(times, left[cut] // (fill.get(cut, 0) + 1))
        offset = 0
        for length, k in sorted(fill.items(), reverse=True):
            draw(length, k, times, offset, length, -1)
            offset += k * length
        if cut is not None:
            made += 1
            depth[made] = draw(cut, 1, times, offset, slack, made) + 1
            deepest = max(deepest, depth[made])
            left[cut - slack] = left.get(cut - slack, 0) + times
            pools.setdefault(cut - slack, []).append((made, 0, times))
        sequences += times
    return slots, sequences, deepest


def pack_lengths(docs: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents (doc_id, n_tokens long > 0, any more columns): those columns and start, length, sequence_id, offset.

    Sequences of one full piece follow those of the plan in number. Repeated rows are separate documents.
    """
    rows = docs.withColumn("_rem", (F.col("n_tokens") % capacity).cast("int")).withColumn("_full", F.floor(F.col("n_tokens") / capacity)).withColumn("_one", F.lit(1))
    placed = running_totals(rows, [F.col("_rem"), F.asc_nulls_first("doc_id"), F.col("n_tokens")], {"_to": "_one", "_fulls": "_full"})
    counts = {r["_rem"]: r["count"] for r in rows.groupBy("_rem").count().collect()}  # at most capacity rows
    firsts, at = [], 0
    for length in sorted(counts):
        firsts.append((length, at))
        at += counts[length]
    counts.pop(0, None)
    slots, sequences, depth = plan(counts, capacity)
    spark = docs.sparkSession
    kinds = "_group int, _from long, _until long, _piece long, _copies long, _first long, _offset long, _size long, _child int"
    slot_rows = [(s.group, s.start, s.stop, s.piece, s.copies, s.first, s.offset, s.size, s.child) for s in slots]
    lookup = F.broadcast(scratch.settle(spark.createDataFrame(slot_rows, kinds), "slots"))  # bounded by capacity, not by the documents
    begins = F.broadcast(spark.createDataFrame(firsts, "_rem int, _begin long"))
    placed = scratch.settle(placed.join(begins, "_rem"), "placed")

    keep = docs.columns
    number = F.col("_piece") + F.col("_index") - F.col("_from")
    level = placed.where("_rem > 0").select(*keep, (F.col("_full") * capacity).alias("_at"), F.col("_rem").alias("_class"), (F.col("_to") - 1 - F.col("_begin")).alias("_index"))
    parts = []
    for k in range(depth + 1):
        match = (F.col("_class") == F.col("_group")) & (F.col("_index") >= F.col("_from")) & (F.col("_index") < F.col("_until"))
        found = level.join(lookup, match)
        parts.append(found.select(*keep, F.col("_at").alias("start"), F.col("_size").alias("length"), (F.col("_first") + F.floor(number / F.col("_copies"))).alias("sequence_id"), (F.col("_offset") + number % F.col("_copies") * F.col("_size")).alias("offset")))
        if k < depth:
            level = found.where("_child >= 0").select(*keep, (F.col("_at") + F.col("_size")).alias("_at"), F.col("_child").alias("_class"), number.alias("_index"))
            level = scratch.settle(level, f"level{k}")
    whole = placed.where("_full > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)).alias("_i"))
    out = whole.select(*keep, (F.col("_i") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), (F.lit(sequences) + F.col("_fulls") - F.col("_full") + F.col("_i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for part in parts:
        out = out.unionByName(part)
    return out


def token_lengths(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, n_tokens, the CRC-32 of each stretch of ``capacity`` ids, and the ids as little-endian bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, step = encoder(tokenizer), 4 * capacity
        for batch in batches:
            for lo, hi, ids, bounds in coder.encode_column(batch.column(1), end_id):
                every, cut = memoryview(ids.tobytes()), 4 * bounds
                crcs = [[zlib.crc32(every[i : min(i + step, b)]) for i in range(a, b, step)] for a, b in zip(cut.tolist(), cut[1:].tolist())]
                found = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(every)])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(crcs, pa.list_(pa.int64())), found]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, crcs array<long>, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null texts are empty: their only id is the end id. Null and repeated ids are separate documents; other
    columns are ignored; an empty table gives no pieces.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    encoded = token_lengths(docs, tokenizer, end_id, capacity).withColumn("row", F.monotonically_increasing_id())
    rest = F.floor(F.col("n_tokens") / capacity).cast("int") * (4 * capacity)
    # The ids after the last full stretch; all of them only when they are asked for.
    encoded = encoded.withColumn("rest", F.col("ids") if with_ids else F.expr("substring(ids, 1 + 4 * %d * int(n_tokens div %d))" % (capacity, capacity)))
    encoded = scratch.settle(encoded.drop("ids"), "encoded")
    pieces = scratch.settle(pack_lengths(encoded.select("doc_id", "n_tokens", "crcs", "row"), scratch, capacity), "pieces")

    stretch = F.floor(F.col("start") / capacity).cast("int")
    aligned = (F.col("start") % capacity == 0) & ((F.col("length") == capacity) | (F.col("start") + F.col("length") == F.col("n_tokens")))
    columns = ["doc_id", "start", "length", "ids_crc32", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset"]
    begin = F.lit(0) if with_ids else rest
    own = F.substring("rest", (F.col("start") * 4 - begin).cast("int") + 1, (F.col("length") * 4).cast("int"))
    if with_ids:
        return pieces.join(encoded.select("row", "rest"), "row").withColumn("ids", own).withColumn("ids_crc32", F.crc32("ids")).select(*columns, "ids")
    known = pieces.where(aligned).withColumn("ids_crc32", F.element_at("crcs", stretch + 1))
    # Only cut remainders need their ids once more; there are few unless one length dominates.
    cut = scratch.settle(pieces.where(~aligned), "cut")
    cut = cut.join(encoded.select("row", "rest"), "row").withColumn("ids_crc32", F.crc32(own))
    return known.select(*columns).unionByName(cut.select(*columns))
