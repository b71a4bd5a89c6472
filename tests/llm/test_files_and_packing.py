"""Token files, WARC files, packing, mixing, exact dedup and neighbour search on small awkward tables."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from agreement import compare, database
from tokenizers import Tokenizer

from corpuslab.llm import ann, exact_dedup, mixing, packing, token_file, warc
from corpuslab.llm.common import Scratch, word_count
from corpuslab.llm.queries import MIX_SQL
from corpuslab.llm.registry import QUERIES, SQL

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    (3, "Hello, World! it's 42 degrees <|endoftext|> <|EndOfText|> done", "b"),
    (1, None, None),
    (7, "", "a"),
    (2, "ΣΑΣ ΟΔΟΣ naïve naïve é é \t\x0b tabs\x85here", "a"),
    (2, "same id, other text", "a"),
    (5, "again and again " * 3000, "b"),
    (6, "again and again " * 3000, "b"),
    (6, "again and again " * 3000, "b"),
    (None, "no id", "c"),
    (9, "x." * 700, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "zz", 5) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, file string, kept int")


def plain_ids(text, end):
    t = Tokenizer.from_file(VOCABULARY)
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_reads_whole_texts(monkeypatch):
    """Rows together, long texts in parts, words of any length, and a cache that empties: all as the whole text's ids."""
    import pyarrow as pa

    from corpuslab.llm import tokens

    rng = np.random.default_rng(3)
    texts = [t for _, t, _ in TEXTS] + ["x" * 70_000 + " y " + "z" * 9000, " \t lead", "trail \n", "Don't STOP! me. now?", "a<|b A B", "日本語 テキスト É"]
    texts += ["".join(rng.choice(list("abC .,'é\n<|>1")) for _ in range(rng.integers(0, 400))) for _ in range(200)]
    texts.append("Some words, again; " * 90_000)  # beyond CHUNK
    wanted = [plain_ids(t, 7) for t in texts]
    for chunk, cached in ((tokens.CHUNK, tokens.CACHED_BYTES), (1 << 20, 1000), (64, 1 << 20)):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        monkeypatch.setattr(tokens, "CACHED_BYTES", cached)
        column = pa.array(["skipped", *texts]).slice(1)
        found = []
        for lo, hi, ids, bounds in tokens.WordEncoder(VOCABULARY).encode_column(column, 7):
            assert lo == len(found) and len(bounds) == hi - lo + 1
            found += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert found == wanted
    assert not list(tokens.WordEncoder(VOCABULARY).encode_column(pa.array([], pa.string()), 7))


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(set(SQL) & {"op2_warc", "op9_pareto_mix", "op10_exact_dedup"}))
def test_agrees_with_sql(spark, folder, name):
    assert compare(spark, database(folder), folder, QUERIES[name], SQL[name]) is None


def test_blocks_round_trip_any_width():
    rng = np.random.default_rng(1)
    for high in (1, 2, 3, 1000, 49_408, 1 << 32):
        for n in (1, 1023, 1024, 5000):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.integers(0, n, 3)] = (1 << 32) - 1
            blocks = token_file.encode_blocks(ids)
            body = token_file.MAGIC + b"".join(blocks)
            starts = np.cumsum([len(token_file.MAGIC), *map(len, blocks)])
            footer = np.array(starts, "<u8").tobytes() + np.array([0, n], "<u8").tobytes() + np.array([4], "<i8").tobytes() + b"\0"
            book = token_file.TokenFile(body + footer + token_file.TRAILER.pack(len(blocks), 1, n, len(body), token_file.MAGIC))
            assert (book.ids(0, n) == ids).all()
            assert (book.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_token_files_hold_all_ids(spark, docs):
    folder = Scratch(spark, "test_tokens").root
    token_file.write_tokens(docs, folder, VOCABULARY, 2, tokens_per_file=5000)
    found = token_file.read_tokens(spark, folder, with_ids=True).orderBy("start").collect()
    ordered = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at = 0
    for row, (doc_id, text, _) in zip(found, ordered, strict=True):
        ids = plain_ids(text, 2)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), crc(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        at += len(ids)
    assert token_file.encode_table(docs.limit(0), VOCABULARY, 2).count() == 0


def test_token_query_matches_whole_text_encoding(spark, folder):
    t = Tokenizer.from_file(VOCABULARY)
    at = 0
    found = {r.doc_id: r for r in QUERIES["op1_token_file"](spark, folder).collect()}
    for r in read(spark, folder, "documents").orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        row = found[r.doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)


def check_pieces(pieces, texts, end=1):
    """Pieces cover every document once and every sequence without gaps; returns the padding share."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    wanted = defaultdict(list)
    for doc_id, text in texts:
        wanted[doc_id].append(plain_ids(text, end))
    assert set(by_doc) == set(wanted)
    for doc_id, found in by_doc.items():
        ends = defaultdict(list)
        for p in found:
            ends[p.start, p.doc_tokens].append(p)
        for ids in wanted[doc_id]:
            at = 0
            while at < len(ids):
                p = next(p for p in ends[at, len(ids)] if crc(ids[at : at + p.length]) == p.ids_crc32)
                ends[at, len(ids)].remove(p)
                at += p.length
            assert at == len(ids)
        assert not any(ends.values())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    used = sum(p.length for p in pieces)
    return 1 - used / (2048 * len(by_sequence)) if by_sequence else 0


def test_packing_keeps_every_id(spark, docs):
    pieces = packing.pack_documents(docs, VOCABULARY, 1, with_ids=True).collect()
    check_pieces(pieces, [(i, t) for i, t, _ in TEXTS])
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in pieces)
    assert packing.pack_documents(docs.limit(0), VOCABULARY, 1).count() == 0


def test_packing_query_pads_little(spark, folder):
    pieces = QUERIES["op4_pack"](spark, folder).collect()
    texts = [(r.doc_id, r.text) for r in read(spark, folder, "documents").collect()]
    assert check_pieces(pieces, texts) < 0.02


def test_best_fill_is_the_closest_sum():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 40, rng.integers(1, 9)).tolist()
        counts = {n: lengths.count(n) for n in lengths}
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        fill = packing.best_fill(counts, sorted(counts), 60)
        assert sum(n * k for n, k in fill.items()) == max(s for s in sums if s <= 60)
        assert all(k <= counts[n] for n, k in fill.items())


def test_only_the_last_sequence_is_padded():
    for counts in ({700: 10_000, **{n: 12 for n in range(1, 2048) if n != 700}}, {1100: 5_000}, {1: 1}, {2047: 3, 2046: 5}, {}):
        slots, sequences, _ = packing.plan(counts, 2048)
        tokens = sum(n * c for n, c in counts.items())
        assert sequences == -(-tokens // 2048)
        assert sum((s.stop - s.start) * s.size for s in slots) == tokens
        assert len(slots) < 30_000


def test_packing_equal_texts_cuts_them(spark):
    rows = [(i, "word " * 1100) for i in range(40)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, 1).collect()
    assert check_pieces(pieces, rows) < 0.05


def test_mixing_meets_targets(spark, docs):
    sizes = docs.select("doc_id", "source", word_count("text").alias("size"))
    mixed = mixing.mix(sizes, mixing.source_targets(sizes)).collect()
    assert len(mixed) == len(TEXTS)
    assert all(0 <= r.copies <= 3 for r in mixed)
    again = mixing.mix(sizes, mixing.source_targets(sizes)).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))
    assert mixing.mix(sizes.limit(0), mixing.source_targets(sizes.limit(0))).count() == 0


def test_mixed_words_are_near_their_targets(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")  # some 50 documents a source
    rows = QUERIES["op9_pareto_mix"](spark, folder).toPandas().merge(read(spark, folder, "documents").select("doc_id", "source").toPandas())
    by_source = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by_source.taken - by_source.target) <= 0.02 * by_source.target + 20).all()
    assert "PARTITION" in MIX_SQL


def test_exact_groups_on_awkward_rows(spark, docs):
    found = exact_dedup.exact_groups(docs).collect()
    by_text = defaultdict(list)
    for i, t, _ in TEXTS:
        by_text[t or ""].append(i)
    wanted = []
    for ids in by_text.values():
        keep = max((i for i in ids if i is not None), default=None)
        wanted += [(i, keep, len(ids), i == keep) for i in ids]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(wanted, key=key)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


PAGES = [
    (4, "http://a/ b\r\nX: y", "<p>" + "é" * 80),
    (2, None, "<p>" + "é" * 80),
    (9, "http://c", "<p>" + "é" * 80),
    (1, "http://d", "short"),
    (3, "http://e", "short"),
    (5, "http://f", None),
    (None, "http://g", "<p>" + "é" * 80),
    (8, "http://h", "long " * 100_000),
    (8, "http://h", "long " * 100_000),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id long, url string, html string, digest int")
    folder = Scratch(spark, "test_warc").root
    manifest = warc.write_warc(pages, folder, shard_bytes=1000, file_bytes=300)
    assert manifest.agg({"n_records": "sum"}).first()[0] == len(PAGES)
    rows = warc.read_warc(spark, folder, with_payload=True).collect()
    shape = lambda r: (r.page_id, r.payload_bytes, r.record_type, r.refers_to)
    size = lambda t: len((t or "").encode())
    wanted = [(i, size(t), "revisit" if i in (4, 9, None) else "response", 2 if i in (4, 9, None) else None) for i, _, t in PAGES]
    assert sorted(map(str, map(shape, rows))) == sorted(map(str, wanted))
    texts = {i: t or "" for i, _, t in PAGES}
    assert all(r.payload.decode() == texts[r.page_id] for r in rows if r.record_type == "response")
    again = Scratch(spark, "test_warc").root
    other = warc.write_warc(pages.repartition(3), again, shard_bytes=1000, file_bytes=300)
    assert sorted(map(str, manifest.collect())) == sorted(map(str, other.collect()))
    assert warc.archive(pages.limit(0)).count() == 0


def brute_neighbours(vectors, query_ids, k=10):
    ids = np.array([v[0] for v in vectors])
    matrix = np.array([v[1] for v in vectors], float)
    out = {}
    for q in query_ids:
        d = np.sqrt(((matrix - matrix[ids == q][0]) ** 2).sum(axis=1))
        out[q] = sorted((s, i) for s, i in zip(d.tolist(), ids.tolist()) if i != q)[:k]
    return out


def test_neighbours_recall(spark, folder):
    rows = read(spark, folder.replace("sf0.001", "sf0.01"), "embeddings").collect()
    truth = brute_neighbours([(r.vec_id, r.embedding) for r in rows], [r.vec_id for r in rows if r.vec_id % 100 == 0])
    found = defaultdict(list)
    for r in QUERIES["op5_cross_polytope"](spark, folder.replace("sf0.001", "sf0.01")).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    hits = [len({i for _, i in found[q]} & {i for _, i in best}) / len(best) for q, best in truth.items()]
    assert np.mean(hits) >= 0.9
    assert all(x == sorted(x) and len(x) == 10 for x in found.values())


def test_neighbours_on_awkward_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist(), "q") for i in range(30)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0], "hot") for i in range(0, 60)]
    rows += [(200, None, "x"), (300, [0.0] * 5, "x"), (400, [1.0, None, 1.0, 1.0, 1.0], "x"), (500, [float("nan")] * 5, "x"), (None, [1.0] * 5, "x"), (600, [1.0, 2.0], "x"), (0, rows[0][1], "q"), (700, [], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, axis string")
    found = defaultdict(list)
    for r in ann.nearest(table, table.vec_id % 100 == 0, probes=10).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.score, r.vec_id))
    usable = [(i, v) for i, v, _ in rows if i is not None and v and len(v) == 5 and None not in v and any(v) and v[0] == v[0]]
    usable = list({i: (i, v) for i, v in usable}.values())
    assert dict(found) == brute_neighbours(usable, [0, 100])
    assert ann.nearest(table.limit(0), table.vec_id % 100 == 0).count() == 0
