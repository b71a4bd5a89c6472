"""Token ids in files of patched frame-of-reference blocks.

File: magic, blocks, footer, trailer. A block holds 1024 ids (the last one may hold fewer, padded
with its minimum): minimum, bit width, number of exceptions, the packed differences to the minimum,
then positions and high parts of those that need more bits. The width is what the chosen percentile
of the block needs. The footer indexes block starts, document ids and each document's first id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch
from corpuslab.llm.files import Sink
from corpuslab.llm.tokens import encoder

MAGIC = b"PFORTOK1"
BLOCK = 1024
LANE = 64
PERCENTILE = 0.9
TOKENS_PER_FILE = 8_000_000
HEAD = struct.Struct("<IBxH")
TRAILER = struct.Struct("<QQQQ8s")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) values below 2**width to (blocks, words) of 64 bits."""
    lanes = np.ascontiguousarray(values.reshape(-1, LANE).T.astype(np.uint64))
    out = np.zeros((max(width, 1), lanes.shape[1]), np.uint64)
    for i in range(LANE if width else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out[:width].T).reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    blocks = len(words)
    if not width:
        return np.zeros((blocks, BLOCK), np.uint64)
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((LANE, lanes.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(LANE):
        word, shift = divmod(i * width, 64)
        v = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (lanes[word + 1] << np.uint64(64 - shift))
        out[i] = v & mask
    return np.ascontiguousarray(out.T).reshape(blocks, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Blocks of BLOCK ids each; the last may be short."""
    short = -len(ids) % BLOCK
    tail = ids[len(ids) - len(ids) % BLOCK :]
    padded = np.concatenate([ids, np.full(short, tail.min() if short else 0, ids.dtype)]).astype(np.uint32)
    values = padded.reshape(-1, BLOCK)
    low = values.min(axis=1)
    diff = values - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    widths = np.frexp(np.partition(diff, at, axis=1)[:, at].astype(np.float64))[1]
    out: list[bytes] = [b""] * len(values)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        part = diff[rows].astype(np.uint64)
        packed = _pack(part & np.uint64((1 << width) - 1), width)
        high = (part >> np.uint64(width)).astype("<u4")
        for k, row in enumerate(rows.tolist()):
            where = np.flatnonzero(high[k])
            out[row] = b"".join(
                (HEAD.pack(int(low[row]), width, len(where)), packed[k].astype("<u8").tobytes(), where.astype("<u2").tobytes(), high[k][where].tobytes())
            )
    return out


class TokenFile:
    """Reads any range of ids through the block index."""

    def __init__(self, content: bytes):
        self.content = content
        blocks, docs, self.tokens, footer, magic = TRAILER.unpack(content[-TRAILER.size :])
        if magic != MAGIC or content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        take = lambda kind, n, at: (np.frombuffer(content, kind, n, at), at + n * np.dtype(kind).itemsize)
        self.block_starts, at = take("<u8", blocks + 1, footer)
        self.doc_starts, at = take("<u8", docs + 1, at)
        self.doc_ids, at = take("<i8", docs, at)
        self.doc_null, at = take("u1", docs, at)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 as uint32; only the blocks that hold them are decoded."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // BLOCK, (stop - 1) // BLOCK + 1
        heads = [HEAD.unpack_from(self.content, int(s)) for s in self.block_starts[first:last]]
        widths = np.array([h[1] for h in heads])
        out = np.empty((last - first, BLOCK), "<u4")
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            words = np.stack([np.frombuffer(self.content, "<u8", BLOCK // 64 * width, int(self.block_starts[first + r]) + HEAD.size) for r in rows])
            values = _unpack(words, width)
            for k, r in enumerate(rows.tolist()):
                low, _, n = heads[r]
                if n:
                    at = int(self.block_starts[first + r]) + HEAD.size + BLOCK // 8 * width
                    where = np.frombuffer(self.content, "<u2", n, at)
                    values[k, where] |= np.frombuffer(self.content, "<u4", n, at + 2 * n).astype(np.uint64) << np.uint64(width)
                values[k] += np.uint64(low)
            out[rows] = values
        return out.reshape(-1)[start - first * BLOCK : stop - first * BLOCK]


class _Writer:
    """One token file; ids leave memory as soon as a chunk of blocks is full."""

    def __init__(self, folder: str, name: str, percentile: float):
        self.sink, self.name, self.percentile = Sink(folder, name), name, percentile
        self.sink.write(MAGIC)
        self.held: list[bytes | memoryview] = []
        self.held_bytes, self.tokens = 0, 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, bool, int]] = []

    def add(self, doc_id: int | None, raw: memoryview) -> None:
        self.docs.append((doc_id or 0, doc_id is None, self.tokens))
        self.tokens += len(raw) // 4
        self.held.append(raw)
        self.held_bytes += len(raw)
        if self.held_bytes >= 4 * BLOCK * 1024:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, cut, BLOCK * 512):
            for block in encode_blocks(ids[at : min(cut, at + BLOCK * 512)], self.percentile):
                self.starts.append(self.sink.size)
                self.sink.write(block)
        self.held = [ids[cut:].tobytes()]
        self.held_bytes = len(self.held[0])

    def close(self) -> tuple[str, int, int, int]:
        self._flush(True)
        footer = self.sink.size
        self.sink.write(np.array([*self.starts, footer], "<u8").tobytes())
        self.sink.write(np.array([*[d[2] for d in self.docs], self.tokens], "<u8").tobytes())
        self.sink.write(np.array([d[0] for d in self.docs], "<i8").tobytes())
        self.sink.write(np.array([d[1] for d in self.docs], "u1").tobytes())
        self.sink.write(TRAILER.pack(len(self.starts), len(self.docs), self.tokens, footer, MAGIC))
        self.sink.commit()
        return self.name, len(self.docs), self.tokens, self.sink.size


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text",
    tokens_per_file: int = TOKENS_PER_FILE, percentile: float = PERCENTILE,
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each and write them in ascending key order below ``folder``.

    Returns the manifest (file, n_docs, n_tokens, n_bytes), itself written beside the files; only files it names
    count. Documents are range-partitioned and sorted by (key, text), so file names sort in document order. A file
    ends at the first document end after ``tokens_per_file`` ids. Null texts are empty and give the end id alone;
    null keys come first; equal keys follow in text order; other columns are ignored.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = ordered.repartitionByRange(F.asc_nulls_first("k")).sortWithinPartitions(F.asc_nulls_first("k"), "t")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, done, coder = TaskContext.get().partitionId(), 0, [], encoder(tokenizer)
        writer = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, ids, bounds in coder.encode_column(batch.column(1), end_id):
                every, cut = memoryview(ids.tobytes()), (4 * bounds).tolist()
                for doc_id, a, b in zip(keys[lo:hi], cut, cut[1:]):
                    if writer is None:
                        writer = _Writer(f"{folder}/data", f"tokens-{part:06d}-{made:05d}.pfor", percentile)
                        made += 1
                    writer.add(doc_id, every[a:b])
                    if writer.tokens >= tokens_per_file:
                        done.append(writer.close())
                        writer = None
        if writer is not None:
            done.append(writer.close())
        columns = list(zip(*done)) if done else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["file", "n_docs", "n_tokens", "n_bytes"])

    manifest = ordered.mapInArrow(write, "file string, n_docs long, n_tokens long, n_bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def read_tokens(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, as little-endian bytes) from the files."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    kinds = "file string, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name, book = path.as_py().rsplit("/", 1)[-1], TokenFile(content.as_py())
                starts = book.doc_starts.astype(np.int64)
                done = 0
                while done < len(book.doc_ids):  # some documents at a time
                    upto = max(done + 1, int(np.searchsorted(starts, starts[done] + (1 << 20), "right")) - 1)
                    raw = memoryview(book.ids(int(starts[done]), int(starts[upto])).tobytes())
                    cut = ((starts[done : upto + 1] - starts[done]) * 4).tolist()
                    each = [raw[a:b] for a, b in zip(cut, cut[1:])]
                    ids = pa.array(book.doc_ids[done:upto], pa.int64(), mask=book.doc_null[done:upto].astype(bool))
                    columns = [pa.array([name] * (upto - done)), ids, pa.array(starts[done:upto]), pa.array(np.diff(starts[done : upto + 1])), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(x) for x in each], pa.binary())] * with_ids, schema=schema)
                    done = upto

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    if manifest.isEmpty():
        return spark.createDataFrame([], kinds).select("doc_id", F.col("local").alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.pfor").load(f"{folder}/data").select("path", "content")
    found = content.mapInArrow(decode, kinds).join(offsets, "file")
    return found.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def encode_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the documents' token files below the shared folder and return what they hold."""
    folder = Scratch(docs.sparkSession, "token_files").root
    write_tokens(docs, folder, tokenizer, end_id)
    return read_tokens(docs.sparkSession, folder)
