"""Latent Dirichlet allocation over a whole vocabulary, by collapsed variational inference (CVB0) in blocks of documents.

Topic counts of terms lie in parts by term, topic shares of documents stay with their block, so nobody ever holds a
topics-by-terms matrix. An exchange brings each block the counts of the terms it uses, the block improves its own
assignments in several sweeps while the rest stands still, and its new counts are added up by term. Counts travel as one
row per block and part. Blocks are small until there are many of them, then they grow up to a fixed number of (document,
term, topic) cells: a term is sent once per block that holds it, so few large blocks send less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from corpuslab.session import dealt, materialize, remove, written

SWEEPS = 20  # per exchange at most
EXCHANGES = 5  # at least
BLOCK_CELLS = 2_000_000  # (document, term) pairs times topics
MANY_BLOCKS = 24  # beyond that blocks grow
LARGEST_BLOCK = 40_000_000
TERM_PARTS = 400  # at most
LARGEST_PAIRS = 2_000_000  # of documents and terms in a block that has grown
CHUNK = 1 << 13  # cells whose new shares are found at a time, so that they stay in the cache
FEW_CELLS = 32  # a term with more has its cells together
_FIXED = ["block", "docs", "ptr", "term_ids", "cell_term", "tf"]
# What an exchange changes: a row per block and part of the terms with the block's counts of these terms, one more per
# block with its counts by document and its totals.
_MOVING = ["block", "part", "ids", "counts", "n", "fit"]
_MOVING_SCHEMA = "block long, part long, ids binary, counts binary, n array<double>, fit double"
_THETA = -1


def _uniform(codes: np.ndarray, k: int) -> np.ndarray:
    """(codes, k) numbers in (0, 1) that depend on the codes only."""
    x = codes.astype(np.uint64)[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53 + 1e-12


@dataclass
class _Run:
    """Consecutive cells and the places of their terms: ``each`` cells of every term, one of each term after the other, or
    with 0 all cells of a term together, the first of them at ``starts``."""

    cells: slice
    terms: slice
    each: int
    starts: np.ndarray | None

    def spread(self, by_term: np.ndarray, out: np.ndarray) -> np.ndarray:
        """The number of each cell's term, for every row of a table with the run's terms."""
        if self.each:
            out.reshape(len(out), self.each, -1)[:] = by_term[:, None]
        else:
            out[:] = np.repeat(by_term, np.diff(self.starts, append=out.shape[1]), axis=1)
        return out

    def add_up(self, values: np.ndarray) -> np.ndarray:
        """The sum over each term's cells, for every row."""
        if self.each:
            return values.reshape(len(values), self.each, -1).sum(axis=1)
        return np.add.reduceat(values, self.starts, axis=1)


class _Cells:
    """Cells of a block in an order in which a term's counts are found and added up without look-ups.

    Terms have places that rise with the number of their cells. Terms with few cells lie beside others with as many, so a
    sum by term is a sum of slices. Counts and shares are kept topic by topic: (k, documents), (k, places of terms), (k,
    cells). Sums are exact to the 32 bits that are kept of them, so they do not depend on the order.
    """

    def __init__(self, ptr: np.ndarray, term: np.ndarray, tf: np.ndarray):
        n, count = len(tf), np.bincount(term)
        self.terms = np.argsort(count, kind="stable")  # by place
        count = count[self.terms]
        place = np.empty(len(count), np.int32)
        place[self.terms] = np.arange(len(count))
        place = place[term]
        by_place = np.argsort(place, kind="stable")
        few = int(np.searchsorted(count, FEW_CELLS, "right"))
        order, self.runs, at, first = [], [], 0, 0
        while first < few:
            each = int(count[first])
            last = min(int(np.searchsorted(count, each, "right")), first + max(1, CHUNK // each))
            stop = at + each * (last - first)
            order.append(by_place[at:stop].reshape(-1, each).T.ravel())
            self.runs.append(_Run(slice(at, stop), slice(first, last), each, None))
            at, first = stop, last
        order.append(by_place[at:])
        while at < n:
            stop = min(n, at + CHUNK)
            mine = place[by_place[at:stop]]
            starts = np.flatnonzero(np.append(True, np.diff(mine) != 0))
            self.runs.append(_Run(slice(at, stop), slice(int(mine[0]), int(mine[-1]) + 1), 0, starts))
            at = stop
        self.order = np.concatenate(order)
        self.doc = np.repeat(np.arange(len(ptr)), np.diff(np.append(ptr, n)))[self.order]
        self.tf = tf[self.order]
        self.n_docs, self.n_terms = len(ptr), len(count)

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((k, self.n_docs)), np.zeros((k, self.n_terms))

    def placed(self, by_term: np.ndarray) -> np.ndarray:
        return by_term[:, self.terms]

    def by_term(self, placed: np.ndarray) -> np.ndarray:
        out = np.empty_like(placed)
        out[:, self.terms] = placed
        return out

    def started(self, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts by document and by place under random shares."""
        by_doc, by_place = self.sums(k)
        for run in self.runs:
            drawn = -np.log(_uniform(codes[self.order[run.cells]], k)).T
            drawn /= drawn.sum(axis=0)
            drawn *= self.tf[run.cells]
            by_place[:, run.terms] += run.add_up(np.ascontiguousarray(drawn))
            for topic, counts in enumerate(drawn):
                np.add.at(by_doc[topic], self.doc[run.cells], counts)
        return by_doc.astype(np.float32), by_place.astype(np.float32)

    def sweep(self, theta: np.ndarray, phi: np.ndarray, total: np.ndarray, alpha: float, beta: float, shares: np.ndarray, own: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """New topic shares of each cell, in place, and the counts they give by document and by place.

        With ``own`` a cell's present shares do not count for itself.
        """
        k = len(shares)
        by_doc, by_place = self.sums(k)
        total = total.astype(np.float32)[:, None]
        most = k * max(run.cells.stop - run.cells.start for run in self.runs)
        space = [np.empty(most, kind) for kind in (np.float32, np.float32, np.float64)]
        for run in self.runs:
            doc, share = self.doc[run.cells], shares[:, run.cells]
            a, b, wide = (x[: k * len(doc)].reshape(k, -1) for x in space)
            np.take(theta, doc, axis=1, out=a, mode="clip")
            run.spread(phi[:, run.terms], b)
            if own:
                a -= share
                b -= share
            a += np.float32(alpha)
            b += np.float32(beta)
            a *= b
            if own:
                a /= np.subtract(total, share, out=b)
            else:
                a /= total
            np.maximum(a, np.float32(1e-30), out=a)
            np.divide(a, a.sum(axis=0), out=share)
            np.multiply(share, self.tf[run.cells], out=a)
            wide[:] = a
            by_place[:, run.terms] += run.add_up(wide)
            for topic, counts in enumerate(wide):
                np.add.at(by_doc[topic], doc, counts)
        return by_doc.astype(np.float32), by_place.astype(np.float32)

    def likelihood(self, document: np.ndarray, word: np.ndarray) -> float:
        """Log-likelihood of all tokens under the topics' shares of documents and terms."""
        found = 0.0
        for run in self.runs:
            likely = np.take(document, self.doc[run.cells], axis=1).astype(np.float64)
            likely *= run.spread(word[:, run.terms], np.empty(likely.shape))
            found += float((self.tf[run.cells] * np.log(np.maximum(likely.sum(axis=0), 1e-300))).sum())
        return found


def _packed(cells: DataFrame, doc: str, blocks: int, seed: int) -> DataFrame:
    """One row per block: its documents and cells, and the codes its random shares come from."""
    doc_type = cells.schema[doc].dataType.simpleString()
    block = dealt(cells.sparkSession, F.pmod(F.xxhash64(doc), F.lit(blocks)), blocks)
    rows = cells.select(block.alias("block"), F.col(doc).alias("doc"), "term_id", "tf").repartition(blocks, "block")
    rows = rows.withColumn("code", F.xxhash64(F.lit(seed), "doc", "term_id"))

    def pack(rows: pa.Table) -> pa.Table:
        block = rows["block"][0].as_py()
        rows = rows.drop_columns("block").sort_by([("doc", "ascending"), ("term_id", "ascending")]).combine_chunks()
        coded = rows["doc"].combine_chunks().dictionary_encode(null_encoding="encode")
        ptr = np.searchsorted(coded.indices.to_numpy(), np.arange(len(coded.dictionary)))
        term_ids, cell_term = np.unique(rows["term_id"].to_numpy(), return_inverse=True)
        values = [block, coded.dictionary.to_pylist(), ptr.astype(np.int64).tobytes(), term_ids.astype(np.int64).tobytes(), cell_term.astype(np.int32).tobytes(),
                  rows["tf"].to_numpy().astype(np.float32).tobytes(), rows["code"].to_numpy().tobytes()]
        kinds = [pa.int64(), pa.list_(coded.dictionary.type), *[pa.binary()] * 5]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=[*_FIXED, "codes"])

    return rows.groupBy("block").applyInArrow(pack, f"block long, docs array<{doc_type}>, ptr binary, term_ids binary, cell_term binary, tf binary, codes binary")


def _dealt(term_ids: np.ndarray, parts: int) -> list[np.ndarray]:
    """The places of a block's terms, part by part."""
    part = term_ids % parts
    order = np.argsort(part, kind="stable")
    return np.split(order, np.searchsorted(part[order], np.arange(1, parts)))


def _rows(block: int, term_ids: np.ndarray, theta: np.ndarray, own: np.ndarray, fit: float, parts: int) -> pa.Table:
    """A block's rows of _MOVING. Its terms, which rise, travel as their steps."""
    rows = [(block, _THETA, None, theta.tobytes(), own.sum(axis=1, dtype=np.float64).tolist(), fit)]
    for part, at in enumerate(_dealt(term_ids, parts)):
        if len(at):
            steps = np.diff(term_ids[at] // parts, prepend=0).astype(np.uint32)
            rows.append((block, part, steps.tobytes(), own[:, at].tobytes(), None, None))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.float64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_MOVING)


def _started(packed: DataFrame, k: int, parts: int) -> DataFrame:
    """The counts of every block under random shares. One block is read at a time."""

    def start(row: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(row[name][0].as_buffer(), kind)
        cells = _Cells(read("ptr", np.int64), read("cell_term", np.int32), read("tf", np.float32))
        theta, own = cells.started(read("codes", np.uint64), k)
        return _rows(row["block"][0].as_py(), read("term_ids", np.int64), theta, cells.by_term(own), 0.0, parts)

    return packed.select("block", "ptr", "term_ids", "cell_term", "tf", "codes").groupBy("block").applyInArrow(start, _MOVING_SCHEMA)


def _added(rows: pa.Table, k: int, parts: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(terms of a part, their counts over all blocks, the places of each row's terms)."""
    ids = [np.cumsum(np.frombuffer(x.as_buffer(), np.uint32), dtype=np.int64) * parts for x in rows["ids"]]
    counts = [np.frombuffer(x.as_buffer(), np.float32).reshape(k, -1) for x in rows["counts"]]
    every, place = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.stack([np.bincount(place, np.concatenate([c[topic] for c in counts]), len(every)) for topic in range(k)])
    return every + rows["part"][0].as_py(), total, np.split(place, np.cumsum([len(x) for x in ids])[:-1])


def _by_part(moving: DataFrame, parts: int) -> GroupedData:
    sent = moving.where(F.col("part") != _THETA).select("block", "part", "ids", "counts")
    return sent.repartition(parts, "part").groupBy("part")


def _term_counts(moving: DataFrame, k: int, parts: int) -> DataFrame:
    """term_id, w: topic counts of every term, added up over the blocks that hold it."""

    def add_up(rows: pa.Table) -> pa.Table:
        ids, total, _ = _added(rows.sort_by("block"), k, parts)
        weights = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(total.T).ravel()), k)
        return pa.table([pa.array(ids), weights.cast(pa.list_(pa.float64()))], names=["term_id", "w"])

    return _by_part(moving, parts).applyInArrow(add_up, "term_id long, w array<double>")


def _returned(moving: DataFrame, k: int, parts: int) -> DataFrame:
    """block, part, counts: the counts over all blocks of the terms that a block has in a part."""

    def add_up(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        _, total, places = _added(rows, k, parts)
        total = total.astype(np.float32)
        counts = pa.array([total[:, place].tobytes() for place in places], pa.binary())
        return pa.table([rows["block"], rows["part"], counts], names=["block", "part", "counts"])

    return _by_part(moving, parts).applyInArrow(add_up, "block long, part long, counts binary")


def _exchange(fixed: DataFrame, moving: DataFrame, n: np.ndarray, k: int, alpha: float, beta: float, size: int, sweeps: int, blocks: int, parts: int) -> DataFrame:
    """Every block's counts after ``sweeps`` sweeps; ``fit`` is the log-likelihood of its tokens before them."""

    def improve(left: pa.Table, right: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(left[name][0].as_buffer(), kind)
        ptr, ids, cell_term, tf = read("ptr", np.int64), read("term_ids", np.int64), read("cell_term", np.int32), read("tf", np.float32)
        own, phi = np.zeros((k, len(ids)), np.float32), np.zeros((k, len(ids)), np.float32)
        places = _dealt(ids, parts)
        for part, mine, x in zip(right["part"].to_pylist(), right["own"].to_pylist(), right["counts"]):
            counts = np.frombuffer(x.as_buffer(), np.float32).reshape(k, -1)
            if part == _THETA:
                theta = counts
            else:
                (own if mine else phi)[:, places[part]] = counts
        cells = _Cells(ptr, cell_term, tf)
        own, phi = cells.placed(own), cells.placed(phi)
        document = (theta + alpha) / (theta.sum(axis=0) + k * alpha)
        word = (phi + beta) / (n + size * beta)[:, None]
        fit = cells.likelihood(document, word)
        del word
        rest, rest_n = phi - own, n - own.sum(axis=1, dtype=np.float64) + size * beta
        shares = np.empty((k, len(tf)), np.float32)
        for turn in range(sweeps):
            if turn == 0:
                theta, own = cells.sweep(theta, phi, n + size * beta, alpha, beta, shares, own=False)
            else:
                theta, own = cells.sweep(theta, rest + own, rest_n + own.sum(axis=1, dtype=np.float64), alpha, beta, shares)
        return _rows(left["block"][0].as_py(), ids, theta, cells.by_term(own), fit, parts)

    mine = moving.select("block", "part", "counts", F.lit(True).alias("own"))
    needed = mine.unionAll(_returned(moving, k, parts).withColumn("own", F.lit(False)))
    # A block is much work on few bytes, so partitions must not be put together by their size.
    left, right = (rows.repartition(blocks, "block").groupBy("block") for rows in (fixed, needed))
    return left.cogroup(right).applyInArrow(improve, _MOVING_SCHEMA)


def block_number(cells: int, k: int) -> int:
    """Blocks of BLOCK_CELLS up to MANY_BLOCKS of them, then that many, then as many as there must be."""
    small, large = -(-cells * k // BLOCK_CELLS), max(-(-cells * k // LARGEST_BLOCK), -(-cells // LARGEST_PAIRS))
    return max(1, min(small, MANY_BLOCKS), large)


def fit(cells: DataFrame, doc: str, k: int, iterations: int, size: int, alpha: float, beta: float, seed: int) -> tuple[DataFrame, DataFrame, np.ndarray, list[float]]:
    """(document shares: doc, weights; term counts: term_id, w; topic totals; perplexity before every exchange) of a written
    table (doc, term_id, tf). ``size`` is the number of terms. ``iterations`` sweeps in all, up to SWEEPS between exchanges.

    Only the two tables stay; the counts of an exchange go when the next has its own.
    """
    doc_type, spark = cells.schema[doc].dataType.simpleString(), cells.sparkSession
    total = cells.agg(F.count("*").alias("cells"), F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).first()
    blocks = block_number(total["cells"], k)
    parts = min(blocks, TERM_PARTS)
    packed, packed_path = written(_packed(cells, doc, blocks, seed), "topic_blocks")
    moving, moving_path = written(_started(packed, k, parts), "topic_counts")
    fixed, fixed_path = written(packed.select(*_FIXED), "topic_blocks")  # without the codes
    remove(spark, packed_path)

    def totals() -> tuple[np.ndarray, float]:
        found = moving.agg(*[F.sum(F.get("n", F.lit(i))) for i in range(k)], F.sum("fit")).first()  # k + 1 numbers
        return np.array([x or 0.0 for x in found[:k]]), found[k] or 0.0

    perplexity, left, sweeps = [], iterations, max(1, min(SWEEPS, iterations // EXCHANGES))
    n, _ = totals()
    while left > 0 and total["cells"]:
        old = moving_path
        moving, moving_path = written(_exchange(fixed, moving, n, k, alpha, beta, size, min(sweeps, left), blocks, parts), "topic_counts")
        remove(spark, old)
        n, fit_ = totals()
        perplexity.append(float(np.exp(-fit_ / total["tokens"])))
        left -= sweeps

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, theta in zip(batch.column(0), batch.column(1)):
                theta = np.frombuffer(theta.as_buffer(), np.float32).reshape(k, -1).T.astype(np.float64) + alpha
                weights = pa.FixedSizeListArray.from_arrays(pa.array((theta / theta.sum(axis=1, keepdims=True)).ravel()), k)
                yield pa.RecordBatch.from_arrays([docs.values, weights.cast(pa.list_(pa.float64()))], [doc, "weights"])

    documents = fixed.select("block", "docs").join(moving.where(F.col("part") == _THETA).select("block", "counts"), "block").select("docs", "counts")
    documents = documents.mapInArrow(shares, f"`{doc}` {doc_type}, weights array<double>")
    documents, terms = materialize(documents, "topic_documents"), materialize(_term_counts(moving, k, parts), "topic_terms")
    remove(spark, fixed_path, moving_path)
    return documents, terms, n, perplexity
