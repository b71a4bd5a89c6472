"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch
from corpuslab.operators.ordering import top_per_group

TABLES = 8
PROBES = 12
CHUNK = 4096
ROTATIONS = 3


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = rows.shape
    out, h = rows.copy(), 1
    while h < d:
        pairs = out.reshape(n, d // (2 * h), 2, h)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return out / np.sqrt(d)


def axis_values(vectors: np.ndarray, tables: int) -> np.ndarray:
    """(rows, tables, 2 * width) values of the unit vectors along every signed axis of each pseudo-rotation."""
    n, d = vectors.shape
    width = 1 << max(0, d - 1).bit_length()
    unit = np.zeros((n, width))
    unit[:, :d] = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    out = np.empty((n, tables, 2 * width))
    for t in range(tables):
        signs = np.random.default_rng([t, width]).choice([-1.0, 1.0], (ROTATIONS, width))
        turned = unit
        for k in range(ROTATIONS):
            turned = hadamard(turned * signs[k])
        out[:, t, :width], out[:, t, width:] = turned, -turned
    return out


def valid(column: str):
    """Not null, not empty, all components finite, at least one not zero."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & finite & F.exists(column, lambda x: x != 0)


def _bucketed(rows: DataFrame, tables: int, probes: int | None) -> DataFrame:
    """Rows (ids, vec) with dim, tab and axis added: the nearest axis of each table, or the ``probes`` nearest."""
    schema = pa.schema([("dim", pa.int32()), ("tab", pa.int32()), ("axis", pa.int32()), ("ids", pa.list_(pa.int64())), ("vec", pa.binary())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                sizes = np.array([len(x) for x in batch.column(1)])
                for dim in np.unique(sizes).tolist():
                    part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                    vectors = np.array(part.column(1).to_pylist(), np.float64)
                    values = axis_values(vectors, tables)
                    take = values.shape[2] if probes is None else min(probes, values.shape[2])
                    near = np.argsort(-values, axis=2, kind="stable")[:, :, :take].reshape(-1)
                    rows_ = np.repeat(np.arange(len(part)), tables * take)
                    tabs = np.tile(np.repeat(np.arange(tables), take), len(part))
                    raw = pa.array([v.tobytes() for v in vectors], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(near), dim), pa.int32()), pa.array(tabs, pa.int32()), pa.array(near, pa.int32()), part.column(0).take(pa.array(rows_)), raw.take(pa.array(rows_))],
                        schema=schema,
                    )

    return rows.select("ids", "vec").mapInArrow(assign, "dim int, tab int, axis int, ids array<long>, vec binary")


def _nearest_in_bins(k: int):
    """Rows sorted by bin, stored vectors before queries: a bin's vectors are held, its queries stream past."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rank(block: tuple[np.ndarray, np.ndarray, list], queries: np.ndarray, ids: list[int]) -> tuple[list, list, list]:
        base, squares, owners = block
        found: tuple[list, list, list] = ([], [], [])
        keep = min(k + 1, len(base))
        for at in range(0, len(queries), 256):
            q = queries[at : at + 256]
            lengths = (q * q).sum(axis=1)
            rough = lengths[:, None] + squares[None, :] - 2 * (q @ base.T)
            slack = 1e-12 * base.shape[1] * (lengths + squares.max())
            limit = np.partition(rough, keep - 1, axis=1)[:, keep - 1] + 2 * slack
            for i, (query_id, row) in enumerate(zip(ids[at : at + 256], rough)):
                near = np.flatnonzero(row <= limit[i])
                exact = np.sqrt(((base[near] - q[i]) ** 2).sum(axis=1))
                scored = sorted((s, v) for s, n in zip(exact.tolist(), near.tolist()) for v in owners[n] if v != query_id)[:k]
                for s, v in scored:
                    found[0].append(query_id)
                    found[1].append(v)
                    found[2].append(s)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, base, owners, block = None, [], [], None
        for batch in batches:
            bins = list(zip(*[batch.column(n).to_pylist() for n in ("dim", "tab", "axis", "chunk")]))
            stored = batch.column("stored").to_pylist()
            ids, vectors = batch.column("ids").to_pylist(), batch.column("vec").to_pylist()
            at = 0
            while at < len(bins):
                upto = at
                while upto < len(bins) and bins[upto] == bins[at] and stored[upto] == stored[at]:
                    upto += 1
                if bins[at] != current:
                    current, base, owners, block = bins[at], [], [], None
                rows = np.frombuffer(b"".join(vectors[at:upto]), np.float64).reshape(upto - at, -1)
                if stored[at] == 0:
                    base.append(rows)
                    owners += ids[at:upto]
                elif base:
                    if block is None:
                        joined = np.concatenate(base)
                        block = (joined, (joined * joined).sum(axis=1), owners)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rank(block, rows, [x[0] for x in ids[at:upto]]), schema)], schema=schema)
                at = upto

    return run


def _search(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` of (query_id, vec_id, score) among vectors that share a bin with the query."""
    keys = ["dim", "tab", "axis"]
    # At most tables x signed axes rows for each dimension.
    bins = F.broadcast(base.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    stored = base.join(bins, keys).select(*keys, F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("stored"), "ids", "vec")
    asked = queries.join(bins, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("stored"), "ids", "vec")
    spread = stored.unionByName(asked).repartition(*keys, "chunk").sortWithinPartitions(*keys, "chunk", "stored")
    pairs = spread.mapInArrow(_nearest_in_bins(k), "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return top_per_group(best, "query_id", k, F.col("score"), F.col("vec_id"))


def nearest(vectors: DataFrame, query_ids, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row that ``query_ids`` (a Column) selects.

    Every vector is stored in ``tables`` hash tables under the signed axis nearest to it after a pseudo-rotation; a
    query looks under its ``probes`` nearest axes of each and ranks what it finds by exact Euclidean distance, ties to
    the smaller id. A query that finds fewer than k this way is answered again from all bins of a table, exactly.
    Full bins are cut into chunks that queries visit one by one, so no task holds more than a chunk.

    Rows with a null id or a null, empty, zero or non-finite vector take no part; repeated (id, vector) rows count
    once; a row is never its own neighbour, nor that of another row with its id; vectors of other dimensions are never
    near. Of equal vectors the k + 1 smallest ids are stored, as no query needs more. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    usable = vectors.where(F.col("vec_id").isNotNull() & valid("embedding"))
    usable = usable.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vec"))
    smallest = top_per_group(usable.dropDuplicates(["vec_id", "vec"]), "vec", k + 1, F.col("vec_id"))
    distinct = smallest.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    base = scratch.settle(_bucketed(distinct, tables, 1), "base")
    asked = usable.where(query_ids).dropDuplicates(["vec_id", "vec"]).select(F.array("vec_id").alias("ids"), "vec")
    asked = scratch.settle(asked, "asked")
    found = scratch.settle(_search(base, _bucketed(asked, tables, probes), k), "found")
    full = found.groupBy("query_id").count().where(F.col("count") >= k)
    short = asked.withColumn("query_id", F.col("ids")[0]).join(full, "query_id", "left_anti")
    short = scratch.settle(short.select("ids", "vec"), "short")
    if not short.isEmpty():
        again = _search(base.where("tab = 0"), _bucketed(short, 1, None), k)
        found = found.join(full, "query_id", "left_semi").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
