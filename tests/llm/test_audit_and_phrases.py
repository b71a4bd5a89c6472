"""Benchmark index, filter audit and collocations: SQL on the given tables, brute force on small awkward ones."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from agreement import compare, database

from corpuslab.llm import collocations, decontaminate, filter_audit
from corpuslab.llm.queries import AUDIT_SQL, COLLOCATION_SQL, LEAK_SQL
from corpuslab.llm.registry import QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "One two three four five six seven eight nine ten eleven twelve thirteen"


@pytest.mark.parametrize("name, sql", [("op11_positional_index", LEAK_SQL), ("op12_packed_audit", AUDIT_SQL), ("op13_tiled_collocations", COLLOCATION_SQL)])
def test_agrees_with_sql(spark, folder, name, sql):
    assert compare(spark, database(folder), folder, QUERIES[name], sql) is None


# Benchmark index

LEAK_DOCS = [
    (1, f"Before, {PASSAGE}! after"),
    (2, "two three four five six seven eight nine ten eleven"),
    (2, "same id, another text: short item here"),
    (3, None),
    (4, ""),
    (None, "no id but " + PASSAGE.upper()),
    (None, "no id but " + PASSAGE.upper()),
    (5, "the the the the the the the the the the the the"),
    (6, "Élan vital x É"),
    (7, ("filler words " * 200_000) + PASSAGE + " " + PASSAGE),
    (8, "one two three four five six seven eight nine one ten eleven twelve thirteen"),
    (9, "eleven ten nine eight seven six five four three two one"),
    (10, ",.;"),
]
ITEMS = [(1, PASSAGE), (2, "short ITEM"), (3, None), (4, "the " * 11), (5, "!"), (6, PASSAGE), (7, "É"), (None, "another text"), (10, "absent words only here"), (10, "short item")]


@pytest.fixture(scope="module")
def leak_tables(spark):
    docs = spark.createDataFrame([(i, t, i, "s", 1, "z") for i, t in LEAK_DOCS], "doc_id long, text string, doc long, body string, place int, term string")
    items = spark.createDataFrame([(i, t, "w") for i, t in ITEMS], "item_id long, text string, words string")
    return docs, items


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD)) if w]


def item_windows(width):
    out = defaultdict(set)
    for i, t in ITEMS:
        ws = plain_words(t)
        m = min(width, len(ws))
        for at in range(len(ws) - m + 1 if ws else 0):
            out[tuple(ws[at : at + m])].add(i)
    return out


def brute_leaks(text, width):
    ws, hit, items = plain_words(text), set(), set()
    for gram, ids in item_windows(width).items():
        for at in range(len(ws) - len(gram) + 1):
            if tuple(ws[at : at + len(gram)]) == gram:
                hit.update(range(at, at + len(gram)))
                items |= {str(i) for i in ids if i is not None}
    return len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("width", [10, 3, 1])
def test_leaks_match_brute_force(leak_tables, width):
    found = decontaminate.contamination(*leak_tables, width=width).collect()
    texts = [(i, t) for i, t in LEAK_DOCS if width > 1 or i != 7]
    wanted = Counter((i, *brute_leaks(t, width)) for i, t in texts)
    assert Counter(tuple(r) for r in found if width > 1 or r.doc_id != 7) == wanted
    assert found and decontaminate.contamination(*leak_tables).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_phrase_places(leak_tables):
    found = {tuple(r) for r in decontaminate.phrase_matches(*leak_tables).where("doc_id in (1, 2)").collect()}
    places = defaultdict(set)
    for i, item, low, high in found:
        places[i, item].update(range(low, high))
    assert places[1, "1"] == places[1, "6"] == set(range(1, 14))
    assert places[2, "1"] == set(range(10)) and places[2, "2"] == {4, 5}


@pytest.mark.parametrize("within", [4, 11, 16])
def test_proximity_matches_brute_force(spark, leak_tables, within):
    docs, items = leak_tables
    found = decontaminate.proximity_matches(docs.where("doc_id is null or doc_id <> 7"), items, within)
    found = {(r.doc_id, r.item_id) for r in found.collect()}
    wanted = set()
    for i, t in LEAK_DOCS:
        ws = plain_words(t)
        if i == 7:
            continue
        for gram, ids in item_windows(10).items():
            if any(set(gram) <= set(ws[at : at + within]) for at in range(len(ws))):
                wanted |= {(i, None if k is None else str(k)) for k in ids}
    assert found == wanted


def test_leaks_in_empty_tables(leak_tables):
    docs, items = leak_tables
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    rows = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(rows) == len(LEAK_DOCS) and not any(r.contaminated or r.n_items for r in rows)


def test_leaks_stay_in_the_jvm(spark, folder, leak_tables):
    docs, items = leak_tables
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Filter audit

LONG = " ".join(f"w{i}" for i in range(300))
AUDIT_DOCS = [
    (1, "en", LONG),
    (2, "en", LONG),
    (2, "en", LONG),
    (3, None, LONG),
    (None, "", LONG),
    (4, "de", None),
    (5, "de", ""),
    (6, "de", "a b " * 150),
    (7, "en", "ABC " * 300),
    (8, "en", LONG + " 100%"),
    (9, "xx", "Ünï    ÇÀ"),
    (10, "en", ("long text " * 300_000) + "|"),
    (11, "xx", "\n\t \x0b\x0c\r"),
]
AUDIT_LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (5, 1, None), (None, 1, 1), (99, 1, 1), (10, 1, 0)]


def brute_audit():
    masks, first = [], {}
    for i, _, t in AUDIT_DOCS:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, lang, t in AUDIT_DOCS:
        t = t or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t]}
        good = any(k == i and q == 1 for k, q, _ in AUDIT_LABELS) and i is not None
        toxic = any(k == i and x == 1 for k, _, x in AUDIT_LABELS) and i is not None
        masks.append((lang or "", {f for f in fails if fails[f]}, good, toxic))
    out, removed_by = {}, Counter()
    for part in {m[0] for m in masks}:
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                x, c = order[step - 1], Counter()
                for _, fails, good, toxic in (m for m in masks if m[0] == part):
                    before = fails & set(order[: step - 1])
                    c["kept"] += not before and x not in fails
                    c["removed"] += (gone := not before and x in fails)
                    c["redundant"] += bool(before) and x in fails
                    c["unique"] += fails == {x}
                    c["good"] += gone and good
                    c["toxic"] += gone and toxic
                removed_by[part, x] += c["removed"]
                out[part, order, step] = [c[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
    return {(p, o, s, *v, removed_by[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_matches_brute_force(spark):
    docs = spark.createDataFrame([(i, lang, t, 1, "h", "x") for i, lang, t in AUDIT_DOCS], "doc_id long, lang string, text string, mask int, h1 string, part string")
    labels = spark.createDataFrame([(*r, "p") for r in AUDIT_LABELS], "doc_id long, quality int, toxic int, part string")
    found = [tuple(r) for r in filter_audit.filter_audit(docs, labels).collect()]
    assert len(found) == 600 * 4 and set(found) == brute_audit()
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    unlabelled = filter_audit.filter_audit(docs, labels.limit(0)).collect()
    assert len(unlabelled) == 2400 and not any(r.good_lost or r.toxic_lost for r in unlabelled)


def test_fields_do_not_overflow():
    big = (1 << 63) - 1
    rows = {(o, s): v for o, s, *v in filter_audit.outcomes({(0, False, False): big - 7, (31, True, True): 7}, "ABCDE")}
    assert len(rows) == 600
    assert rows["ABCDE", 1] == [big - 7, 7, 0, 0, 7, 7, 7 * 24] and rows["EDCBA", 5][:3] == [big - 7, 0, 7]


# Collocations

COLLOCATION_DOCS = [
    (1, "en", "New York city. New York state, new york\tcity"),
    (2, "en", "new york city new york city; a a a a a"),
    (3, None, "une une une, une une"),
    (4, "und", "une une"),
    (5, "en", None),
    (6, "en", ""),
    (7, "de", " \t., ;"),
    (2, "en", "new york city new york city; a a a a a"),
    (8, "fr", "É é É é É é\x85a b É é"),
    (9, "de", "x" * 3_000_000 + " der hund der hund " + "und der hund schläft " * 200_000 + "ende"),
    (10, "es", "uno dos tres cuatro cinco " * 4),
]


def brute_collocations(rows, first, least):
    f, n = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(ws)
            for m in range(1, 5):
                f[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, counts in f.items():
        rows, most = [], Counter()
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in frequent.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        for p, a in frequent.items():
            if 100 * most[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, at, p, a, left, right, n[lang], score) for at, (score, a, p, left, right) in enumerate(rows[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, first, head", [(2, 1000, None), (1, 1000, 3), (3, 2, 2), (2, 3, 0)])
def test_collocations_match_brute_force(spark, monkeypatch, least, first, head):
    if head is not None:
        monkeypatch.setattr(collocations, "HEAD", head)
    docs = spark.createDataFrame([(i, lang, t, "c", 1, 0) for i, lang, t in COLLOCATION_DOCS], "doc_id long, lang string, text string, code string, n int, codes int")
    found = sorted(tuple(r) for r in collocations.collocations(docs, first, least).collect())
    assert found == brute_collocations(COLLOCATION_DOCS, first, least)
    if head is None:
        assert collocations.collocations(docs.limit(0)).count() == 0


def test_tiles_are_dense_or_sorted(spark, folder):
    """The given documents fill some tiles densely, leave others sparse, and the counts agree whatever the head."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text")
    counted = collocations._word_counts(docs).groupBy("code").sum("n").withColumnRenamed("sum(n)", "a").where("a >= 2")
    level = collocations._level(counted)
    kinds = {(r.tile >= 0, r.dense) for r in collocations._pair_counts(docs, [level]).select("tile", "dense").collect()}
    assert kinds == {(True, True), (True, False)}
    pairs = {(r.left, r.right): r.a for r in collocations._frequent_pairs(collocations._pair_counts(docs, [level]), [level], 2).collect()}
    no_head = collocations.Level(level.codes[:0], level.numbers[:0], level.bits)
    plain = {(r.left, r.right): r.a for r in collocations._frequent_pairs(collocations._pair_counts(docs, [no_head]), [no_head], 2).collect()}
    assert pairs == plain and len(pairs) > 1000
