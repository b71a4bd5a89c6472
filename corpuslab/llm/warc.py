"""Deterministic sharded WARC files with revisit records, and a reader for them."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch, join_groups
from corpuslab.llm.files import Sink
from corpuslab.operators.ordering import running_totals

MIN_REVISIT = 100
SHARD_BYTES = 32 << 20
MAX_SHARDS = 1 << 16
FILE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, digest, refers_to of pages whose payload of at least 100 bytes is that of a smaller page_id."""
    body = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    slim = scratch.settle(slim, "slim")
    large = slim.where(F.col("n_bytes") >= MIN_REVISIT)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    groups = scratch.settle(groups, "groups")
    found = join_groups(large, groups, ["digest"], "n").where("refers_to is not null and (page_id is null or page_id > refers_to)")
    return scratch.settle(found.select("page_id", "digest", "refers_to").distinct(), "revisits")


def shard_bounds(scratch: Scratch, shard_bytes: int) -> list[int]:
    """Largest page_id of each shard but the last: at most MAX_SHARDS numbers, from exact running sizes."""
    slim = scratch.spark.read.parquet(scratch.path("slim"))
    total = slim.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shards = min(MAX_SHARDS, max(1, ceil(total / shard_bytes)))
    running = running_totals(slim.where("page_id is not null").select("page_id", "n_bytes"), [F.col("page_id"), F.col("n_bytes")], {"_to": "n_bytes"})
    shard = F.least(F.floor((F.col("_to") - F.col("n_bytes")) * shards / max(total, 1)), F.lit(shards - 1))
    ends = running.groupBy(shard.alias("_s")).agg(F.max("page_id").alias("_end")).orderBy("_s").collect()  # at most MAX_SHARDS rows
    return [r["_end"] for r in ends[:-1]]


def _record_id(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{digest}|{kind}')}>"


def _base32(digest: str) -> str:
    return "sha256:" + base64.b32encode(bytes.fromhex(digest)).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, digest: str) -> bytes:
    """One WARC record with regenerated HTTP and WARC headers; a revisit keeps the HTTP header only."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest, kind)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: {_base32(digest)}", f"WARC-Block-Digest: {_base32(hashlib.sha256(block).hexdigest())}", "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest, 'response')}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """A gzip member with fixed header, so equal records give equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_warc(pages: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) and return the manifest (file, n_records, n_bytes, sha256).

    Records are sorted by page_id within shards, and shards follow each other in page_id order; their bounds come from
    exact running sizes, so the same pages give the same files on any cluster. A shard starts a new file when the
    compressed one has reached ``file_bytes``. Tasks write under temporary names and rename; only files named by the
    manifest count. Null html is an empty payload, a null url becomes urn:page:<id>, null ids come first. Rows that
    repeat the smallest id of a payload are all responses. Other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc_plan")
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    links = revisits(pages, scratch)
    bounds = np.array(shard_bounds(scratch, shard_bytes), np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), "left")).astype(np.int32))

    body = F.coalesce(F.col("html"), F.lit(""))
    none = F.lit(None)
    fat = pages.select("page_id", F.sha2(body, 256).alias("digest"), F.lit(1).alias("kind"), "url", body.alias("html"), none.cast("long").alias("refers_to"))
    thin = links.select("page_id", "digest", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("string").alias("html"), "refers_to")
    # Revisit marks travel with the pages, each just before its page: the texts are shuffled once.
    both = fat.unionByName(thin).withColumn("shard", shard_of("page_id"))
    both = both.repartition(max(1, len(bounds) + 1), "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, sink, at, mark = [], None, (None, 0), None
        names = ("page_id", "digest", "kind", "url", "html", "refers_to", "shard")
        hashed, records = hashlib.sha256(), 0

        def close():
            sink.commit()
            done.append((name, records, sink.size, hashed.hexdigest()))

        for batch in batches:
            for page_id, digest, kind, url, html, refers_to, shard in zip(*[batch.column(n).to_pylist() for n in names]):
                if kind == 0:
                    mark = (page_id, digest, refers_to)
                    continue
                if sink is not None and (at[0] != shard or sink.size >= file_bytes):
                    close()
                    sink = None
                if sink is None:
                    at = (shard, at[1] + 1 if at[0] == shard else 0)
                    name = f"pages-{shard:05d}-{at[1]:05d}.warc.gz"
                    sink, hashed, records = Sink(f"{folder}/data", name), hashlib.sha256(), 0
                refers = mark[2] if mark and mark[:2] == (page_id, digest) else None
                member = _member(make_record(page_id, url, html.encode(), refers, date, digest))
                sink.write(member)
                hashed.update(member)
                records += 1
        if sink is not None:
            close()
        columns = list(zip(*done)) if done else [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "n_records", "n_bytes", "sha256"])

    both.mapInArrow(write, "file string, n_records long, n_bytes long, sha256 string").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _members(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file one by one, fed in small slices; a plain file is one member."""
    at, view = 0, memoryview(content)
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while at < len(content):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("file ends within a record")
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(parts)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzip or plain WARC file."""
    for raw in _members(content):
        stream = io.BytesIO(raw)
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    raise ValueError("not a WARC record")
                continue
            headers = {}
            while line := stream.readline().rstrip(b"\r\n"):
                name, _, value = line.decode().partition(":")
                headers[name.strip().lower()] = value.strip()
            yield headers, stream.read(int(headers["content-length"]))


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload) of the files the manifest names.

    Payload digests of responses are checked against the payload; a revisit gives those of the payload it stands for.
    """
    kinds = "file string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload
    names = ["file", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * with_payload
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload

    def number(value: str | None) -> int | None:
        return int(value) if value else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                name, rows = path.as_py().rsplit("/", 1)[-1], []
                for headers, block in parse_records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(headers["warc-payload-digest"].partition(":")[2]).hex()
                    kind = headers["warc-type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                    length = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
                    row = (name, number(headers["x-page-id"]), length, digest, kind, number(headers.get("x-refers-to-page-id")), headers["warc-target-uri"])
                    rows.append(row + ((payload,) if with_payload else ()))
                    if len(rows) == 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    manifest = spark.read.parquet(f"{folder}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], kinds).drop("file")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "pages-*.warc.gz").load(f"{folder}/data").select("path", "content")
    return content.mapInArrow(parse, kinds).join(manifest.select("file"), "file", "left_semi").drop("file")


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages below the shared folder and return what the archives hold."""
    folder = Scratch(pages.sparkSession, "warc").root
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder)
