"""Substring removal, near duplicates and toxicity against brute force on small awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpuslab.llm.queries  # noqa: F401
from corpuslab.llm import ngram_join, relative_lz, repeats, suffix_repeats, toxicity, windows
from corpuslab.llm.common import Scratch
from corpuslab.llm.registry import QUERIES


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def brute_removed(rows, units, width):
    """Covered places per (id, text): rows in order, a window that starts earlier marks all it covers."""
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    seen, out = {}, {}
    for _, i, t in order:
        seq = units(t)
        gone = [False] * len(seq)
        for s in range(len(seq) - width + 1):
            w = tuple(seq[s : s + width])
            if w in seen:
                gone[s : s + width] = [True] * width
            seen.setdefault(w, (i, s))
        out[i, t] = (seq, gone)
    return out


def sentences(rng, n, word=lambda r: "".join(r.choices("abcdefé", k=r.randint(1, 7)))):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage, other = sentences(rng, 90), sentences(rng, 40)
    out = []
    for i in range(60):
        parts = [sentences(rng, rng.randint(0, 60))]
        if i % 3 == 0:
            cut = rng.randint(0, 300)
            parts.append(passage[cut : cut + rng.randint(80, 400)])
        if i % 5 == 0:
            parts.append(other)
        if i % 7 == 0:
            parts.append("ab ab " * 40)
        parts.append(sentences(rng, rng.randint(0, 30)))
        out.append((i, (" \n" if i % 2 else " ").join(parts)))
    out += [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 99), (104, "x" * 100), (105, "x" * 101), (106, out[9][1]), (107, out[9][1]), (107, out[9][1])]
    out += [(None, out[15][1]), (110, "y" * 5000), (111, " \t\n "), (112, sentences(rng, 120) + " \0 " + passage)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "s") for i, t in rows], "doc_id long, text string, doc int, at int, spans string")


def check_bytes(found, rows):
    truth = brute_removed(rows, lambda t: t.encode(), 100)
    assert len(found) == len(rows)
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    for i, t in rows:
        seq, gone = truth[i or 0, t or ""] if i is not None else truth[0, t]
        kept = bytes(b for b, g in zip(seq, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        assert (len(seq), sum(gone), spans, kept) in got[i], i


def test_suffix_repeats_match_brute_force(docs, rows):
    some = [r for r in rows if r[0] is not None and r[0] != 0]
    check_bytes(suffix_repeats.remove_repeats(docs.where("doc_id <> 0")).collect(), some)
    assert suffix_repeats.remove_repeats(docs.limit(0)).count() == 0
    assert suffix_repeats.maximal_repeats(docs).count() > 0


def test_crowded_anchors_give_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(repeats, "MAX_RUNS", 2)
    some = [r for r in rows if r[0] is not None and r[0] != 0]
    check_bytes(suffix_repeats.remove_repeats(docs.where("doc_id <> 0")).collect(), some)


def test_null_id_is_the_smallest(docs, rows):
    found = {r.doc_id: r for r in suffix_repeats.remove_repeats(docs).collect()}
    assert found[None].n_removed == sum(brute_removed([(None, rows[-4][1])], lambda t: t.encode(), 100)[0, rows[-4][1]][1])
    assert found[15].n_removed == len(rows[15][1].encode())


def brute_maximal(rows):
    """{(size, occurrences)} by growing every repeated string byte by byte."""
    texts = {(i, t.encode()) for i, t in rows}
    places, out, size = [(i, t, p) for i, t in texts for p in range(len(t) - 99)], set(), 100
    while places:
        groups = defaultdict(list)
        for i, t, p in places:
            if p + size <= len(t):
                groups[t[p : p + size]].append((i, t, p))
        groups = [g for g in groups.values() if len(g) > 1]
        for g in groups:
            before = {t[p - 1] if p else (i, t) for i, t, p in g}
            after = {t[p + size] if p + size < len(t) else (i, t) for i, t, p in g}
            if len(before) > 1 and len(after) > 1:
                out.add((size, frozenset((i, p) for i, _, p in g)))
        places, size = [x for g in groups for x in g], size + 1
    return out


def test_maximal_repeats_match_brute_force(spark):
    rng = random.Random(11)
    passage, other = sentences(rng, 260), sentences(rng, 120)
    texts = [f"{sentences(rng, 20)} {passage} {sentences(rng, 20)}" for _ in range(4)]
    texts += [other, other, other + " " + sentences(rng, 10), passage[300:520] + other[:200], passage, "zé" * 130, "q" * 99, "q" * 230]
    texts += [f"{k}{passage[k : 150 + 3 * k]}{k}" for k in range(12)]
    rows = [*enumerate(texts), (50, texts[0]), (50, texts[0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, at int")
    found = defaultdict(list)
    for r in suffix_repeats.maximal_repeats(table).collect():
        found[r.repeat, r.size].append((r.doc_id, r.start))
    truth = brute_maximal(rows)
    assert max(n for n, _ in truth) > 1000 and max(len(g) for _, g in truth) > 100
    assert all(len(set(g)) == len(g) for g in found.values())
    assert len(found) == len(truth) == len({repeat for repeat, _ in found})
    assert {(size, frozenset(g)) for (_, size), g in found.items()} == truth
    assert suffix_repeats.maximal_repeats(table.limit(0)).count() == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_relative_lz_matches_brute_force(docs, rows):
    some = [r for r in rows if r[0] is not None and r[0] != 0]
    truth = brute_removed(some, words, 20)
    found = relative_lz.remove_spans(docs.where("doc_id <> 0")).collect()
    assert len(found) == len(some)
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.n_words, r.n_removed, r.kept))
    for i, t in some:
        seq, gone = truth[i, t or ""]
        assert (len(seq), sum(gone), " ".join(w for w, g in zip(seq, gone) if not g)) in got[i], i
    assert relative_lz.remove_spans(docs.limit(0)).count() == 0


def test_repeat_queries_match_brute_force_on_the_tables(spark, folder):
    table = [(r.doc_id, r.text) for r in read(spark, folder, "documents").collect()]
    truth = brute_removed(table, lambda t: t.encode(), 100)
    for r in QUERIES["op3_suffix_repeats"](spark, folder).collect():
        seq, gone = truth[r.doc_id, dict(table)[r.doc_id] or ""]
        assert (r.n_bytes, r.n_removed) == (len(seq), sum(gone))
        assert r.kept_sha256 == hashlib.sha256(bytes(b for b, g in zip(seq, gone) if not g)).hexdigest()
    truth = brute_removed(table, words, 20)
    for r in QUERIES["op8_relative_lz"](spark, folder).collect():
        seq, gone = truth[r.doc_id, dict(table)[r.doc_id] or ""]
        assert (r.n_words, r.n_removed) == (len(seq), sum(gone))
        assert r.kept_sha256 == hashlib.sha256(" ".join(w for w, g in zip(seq, gone) if not g).encode()).hexdigest()


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(7)
    text = sentences(rng, 400)
    units = windows.byte_units(text)
    whole = [(int(r), int(x), int(c)) for a in windows.anchors([units], 100, 24) for r, x, c in zip(a.row, a.low, a.count)]
    monkeypatch.setattr(windows, "CHUNK", 333)
    parts = [(int(r), int(x), int(c)) for a in windows.anchors([units], 100, 24) for r, x, c in zip(a.row, a.low, a.count)]
    covered = lambda found: sorted(k for _, x, c in found for k in range(x, x + c))
    assert covered(whole) == covered(parts) == list(range(len(units) - 99))


def test_word_units_of_a_long_text():
    rng = random.Random(8)
    text = " ".join(rng.choice(["alpha", "be", "c", "ü" * 30]) for _ in range(200_000))
    units = windows.word_units(text)
    assert len(units) == 200_000 and len(set(units.tolist())) == 4


@pytest.mark.parametrize("head, tail", [("a b ", " c d e"), ("", ""), ("a " * 600_000, " b" * 600_000)])
def test_word_units_after_a_word_longer_than_a_part(head, tail):
    text = f"{head}{'x' * (3 << 20)}{tail}"
    each = {w: windows.word_units(w)[0] for w in set(text.split())}
    assert windows.word_units(text).tolist() == [each[w] for w in text.split()]


def brute_components(rows):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                label[top(i)] = top(j)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[top(k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min((i for i in groups[top(k)] if i is not None), default=None)) for k in range(len(rows))]


def near_rows(seed, n):
    rng = random.Random(seed)
    base = [[sentences(rng, 1) for _ in range(rng.randint(4, 90))] for _ in range(12)]
    passage = [sentences(rng, 1) for _ in range(40)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = sentences(rng, 1)
        if i % 4 == 0:
            w += passage
        if i % 11 == 0:
            w = [x.upper() if x.isascii() else x for x in w]
        out.append((i, " ".join(w)))
    return out + [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "one two three"), (None, out[0][1]), (905, out[0][1]), (905, out[0][1])]


@pytest.mark.parametrize("large", [4096, 3])
def test_near_duplicates_match_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(ngram_join, "LARGE", large)
    rows = near_rows(large, 250)
    table = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, node int, comp int")
    found = [tuple(r) for r in ngram_join.near_duplicates(table).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(found, key=key) == sorted(brute_components(rows), key=key)
    assert ngram_join.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize(("rows", "blocks"), [(40, 64), (40, 2), (7, 3)])
def test_groups_in_blocks_match_brute_force(spark, monkeypatch, rows, blocks):
    """Groups that are cut into blocks, and those with too many blocks, lose no link."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", rows)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCKS", blocks)
    some = near_rows(rows, 250)
    table = spark.createDataFrame(some, "doc_id long, text string")
    found = [tuple(r) for r in ngram_join.near_duplicates(table).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(found, key=key) == sorted(brute_components(some), key=key)


def test_alike_rows_below_the_threshold_make_few_pairs(spark, monkeypatch):
    """A group of rows that are nearly, but not quite, linked gives fewer rows than its square."""
    made = []
    product = ngram_join._cross_pairs

    def counted(*args):
        pairs = product(*args).localCheckpoint()
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(ngram_join, "_cross_pairs", counted)
    draw, rows = random.Random(8), []
    for i in range(150):
        text = [f"w{k}" for k in range(100)]
        for k in draw.sample(range(100), 3):
            text[k] = f"new{i}x{k}"
        rows.append((i, " ".join(text)))
    found = [tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(found) == sorted(brute_components(rows))
    assert len({r[2] for r in found}) > 20 and made[0] < 150


@pytest.mark.parametrize("frequent", [400_000, 300])
def test_frequent_columns_reach_the_driver_packed(spark, monkeypatch, frequent):
    """No row per column comes to the driver; the columns are those met most often."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    came, last = [0], []
    frame = type(spark.range(1))
    collect, prefix_rows = frame.collect, ngram_join._prefix_rows
    monkeypatch.setattr(frame, "collect", lambda self: (rows := collect(self), came.append(len(rows)))[0])
    monkeypatch.setattr(ngram_join, "_prefix_rows", lambda texts, columns, *a: (last.append(columns), prefix_rows(texts, columns, *a))[1])
    draw, rows = random.Random(5), []
    passages = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(20)]
    for i in range(120):
        own = " ".join(f"own{i}x{k}" for k in range(90 if i % 3 else 3))
        rows.append((i, " ".join([own, passages[min(i // 6, draw.randrange(20))], passages[0]])))
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).localCheckpoint()  # one task counts all
    found = ngram_join.near_duplicates(table)
    assert max(came) < 50
    assert sorted(map(tuple, collect(found))) == sorted(brute_components(rows))
    times = Counter(int(c) for _, t in rows for c in ngram_join.shingles(t))
    met = [times[int(c)] for c in last[0]]
    assert len(set(last[0].tolist())) == len(met) > 200 and min(met) > 1
    assert frequent > 300 or len(met) < 400
    assert {c for c, n in times.items() if n > 1.1 * min(met)} <= set(map(int, last[0]))


def test_scoring_holds_few_words():
    """A task that scores many different words keeps a bounded number of scores, in pieces of a bounded size; scores stay the same."""
    model = toxicity.Model(np.random.default_rng(1).random(toxicity.FEATURES).astype(np.float32), 0.1)
    texts = [" ".join(f"w{i * 200 + k}" for k in range(200)) for i in range(3000)]
    known, worst, most = {}, [], 0
    for lo, hi in toxicity.in_chunks(texts, toxicity.CHUNK):
        worst += toxicity._worst(texts[lo:hi], model, known)
        most = max(most, len(known))
    assert most < 300_000
    assert worst == [float(model.score_words(t.encode().split(b" ")).max()) for t in texts]


def test_connect_matches_brute_force():
    """The links of a block connect what all links connect, with fewer links than rows; with ``left``, only across."""
    draw = np.random.default_rng(2)
    for trial in range(12):
        n = int(draw.integers(2, 400))
        base, sets = draw.integers(0, 1 << 60, (3, 90), dtype=np.uint64), []
        for _ in range(n):
            one, k = base[draw.integers(0, 3)].copy(), int(draw.integers(0, 30))
            one[draw.integers(0, 90, k)] = draw.integers(0, (1 << 60, 400)[trial % 2], k, dtype=np.uint64)
            sets.append(np.unique(one))
        left = n if trial % 3 else int(draw.integers(1, n))
        links = {tuple(sorted(p)) for p in ngram_join._connect(sets, left, 75)}
        wanted = set()
        for i, j in combinations(range(n), 2):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if (left == n or i < left <= j) and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                wanted.add((i, j))
        tops = []
        for some in (links, wanted):
            top = list(range(n))
            for i, j in sorted(some):
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
            tops.append(top)
        assert links <= wanted and tops[0] == tops[1] and len(links) < n


def test_near_duplicate_query_matches_brute_force(spark, folder):
    table = [(r.doc_id, r.text) for r in read(spark, folder, "documents").collect()]
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op7_ngram_join"](spark, folder).collect()]
    assert sorted(found) == sorted(brute_components(table))


def test_kernel_matches_its_definition():
    def explicit(word):
        text, out = b"^" + word + b"$", defaultdict(float)
        code = lambda k, c: 62 if k == 0 else 63 if k == len(text) - 1 else int(toxicity._CODES[c])
        codes = [code(k, c) for k, c in enumerate(text)]
        norm = 0.0
        for i in range(len(codes)):
            for a, b in toxicity.SHAPES:
                if i + a + b < len(codes):
                    x = (codes[i], codes[i + a], codes[i + a + b])
                    if all(x):
                        w = toxicity.DECAY ** (a + b - 2)
                        out[x] += w
                        norm += w * w
        return {k: v / norm**0.5 for k, v in out.items()} if norm else {}

    some = [b"idiot", b"i.d.i.o.t", b"idi-ot", b"clown", b"..", b"\xc3\xa9t\xc3\xa9", b"a"]
    found = toxicity.kernel(some, some)
    for i, x in enumerate(some):
        for j, y in enumerate(some):
            a, b = explicit(x), explicit(y)
            assert abs(found[i, j] - sum(v * b.get(k, 0) for k, v in a.items())) < 1e-4
    assert found[0, 1] > 0.25 and found[0, 2] > 0.5 > found[0, 3]


def test_toxicity_on_held_out_documents(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    found = QUERIES["op6_string_kernel"](spark, folder).toPandas().merge(read(spark, folder, "labels").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(held) > 40
    assert (held.predicted == held.toxic).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_toxicity_tolerates_inserted_characters(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")
    model = toxicity.fit(read(spark, folder, "documents"), read(spark, folder, "labels"))
    clean = "the of and ination there"
    rows = [(1, f"{clean} idiot"), (2, f"{clean} idi*ot {clean}"), (3, f"{clean} wortthless"), (4, clean), (5, None), (6, ""), (None, f"{clean} scum"), (7, "x" * 100_000)]
    table = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    found = {r.doc_id: r.predicted for r in toxicity.score(table, model).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, None: 1, 7: 0}
    none = toxicity.score_all(spark, table, read(spark, folder, "labels").limit(0)).collect()
    assert {r.score for r in none} == {0.0} and len(none) == len(rows)
    assert np.isclose(toxicity.Model(np.zeros(toxicity.FEATURES, np.float32), 0.0).score_words([b"a"]), 0)


@pytest.mark.parametrize(("sums", "parts"), [(1 << 21, 1), (500, 7)])
def test_product_adds_up_shared_columns(spark, monkeypatch, sums, parts):
    """Pairs of the product are those whose shared first columns reach the bound; a task may add up in between."""
    monkeypatch.setattr(ngram_join, "SUMS", sums)
    draw, rows, first, sizes, comps = random.Random(4), [], {}, {}, {}
    for node in range(120):
        n = draw.choice([30, 36, 40])
        own = sorted(draw.sample(range(20), 12) + draw.sample(range(20 + 100 * node, 120 + 100 * node), n - 12))
        sizes[node], comps[node] = n, draw.choice([node, 5])
        first[node] = own[: n - math.ceil(0.75 * n) + 1]
    blocks = []
    for lo in range(0, 120, 50):
        some = range(lo, min(120, lo + 50))
        blocks.append(ngram_join._packed([np.array(first[i], np.uint64) for i in some], [(i, comps[i], sizes[i]) for i in some], parts))
    table = spark.createDataFrame(pa.Table.from_batches(blocks))
    found = sorted(map(tuple, ngram_join._cross_pairs(table, Scratch(spark, "test_product"), 75, parts).collect()))
    rest = {node: sizes[node] - len(first[node]) for node in sizes}
    shared = Counter({(a, b): len(set(first[a]) & set(first[b])) for a, b in combinations(sizes, 2) if comps[a] != comps[b]})
    wanted = sorted(
        (a, b) for (a, b), s in shared.items()
        if s and 175 * (s + max(rest[a], rest[b])) >= 75 * (sizes[a] + sizes[b]) and 100 * sizes[a] >= 75 * sizes[b] and 100 * sizes[b] >= 75 * sizes[a]
    )
    assert found == wanted and 0 < len(wanted) < len(shared)


def test_product_hands_on_large_columns(spark, monkeypatch):
    """A part with many more cells than on average keeps none of a column with more than LARGE rows."""
    monkeypatch.setattr(ngram_join, "LARGE", 5)
    monkeypatch.setattr(ngram_join, "PART_CELLS", 8)
    columns = [np.array([1, 100 + k % 40, 1000 + k], np.uint64) for k in range(90)]
    blocks = [ngram_join._packed(columns[k : k + 9], [(i, i, 9) for i in range(k, k + 9)], 1) for k in range(0, 90, 9)]
    table = spark.createDataFrame(pa.Table.from_batches(blocks))
    found = {tuple(r) for r in ngram_join._cross_pairs(table, Scratch(spark, "test_product"), 75, 1).collect()}
    assert {(i, j) for i, j in combinations(range(90), 2)} == found  # they all meet first in column 1, at place 0


def test_packed_cells_come_back():
    columns = [np.array([5, 9, 1 << 60], np.uint64), np.array([9], np.uint64), np.array([7, 5], np.uint64)]
    cells = np.concatenate([ngram_join._unpacked(b) for b in ngram_join._packed(columns, [(40, 1, 3), (41, 2, 1), (39, 1, 2)], 3).to_pylist()])
    assert len(np.unique(cells[:, 0])) == 4
    assert sorted(map(tuple, cells[:, 1:].tolist())) == [(39, 1, 2, 0), (39, 1, 2, 1), (40, 1, 3, 0), (40, 1, 3, 1), (40, 1, 3, 2), (41, 2, 1, 0)]
    same = [cells[(cells[:, 1] == node) & (cells[:, 4] == place), 0].item() for node, place in ((40, 1), (41, 0))]
    assert same[0] == same[1]
