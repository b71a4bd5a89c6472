"""What every order of a set of filters would keep and remove, from one pass over the documents.

A document fails some of the filters: that is its mask. What any order does to it depends on the mask alone, so a mask
stands for one wide integer with a field per order and step, 1 where something happens to the document there. Counts per
mask times these integers, added up per part, hold all outcomes at once; the fields are wide enough for any count.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import GAP, Scratch, join_groups

FIELD = 64  # bits; a count of rows is below 2 ** 63, and so is every sum of them
FEW_WORDS = 200
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def row_conditions(text: str) -> dict[str, Column]:
    """A to D: too few words, too few different ones, too many capitals, signs that prose does without."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(" \t\n\x0b\x0c\r"))
    split = F.split(trimmed, GAP)
    n = F.when(trimmed == "", 0).otherwise(F.size(split))
    distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(split)))
    capitals = F.char_length(F.regexp_replace(body, "[^A-Z]+", "")).cast("long")
    return {
        "A": n < FEW_WORDS,
        "B": distinct.cast("long") * 100 < n.cast("long") * 50,
        "C": capitals * 100 > F.char_length(body).cast("long") * 3,
        "D": body.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """part, mask, good, toxic, n: how many documents fail which filters (bit 0 is A), and how they are labelled.

    The texts are read once, into a narrow table. Equal texts (E) meet by 128 bits of hash and only as counts; groups of
    any size are spread. Rows are counted per id before they meet the labels, so an id that repeats is one row per mask.
    """
    scratch = Scratch(docs.sparkSession, "filter_audit")
    mask = F.lit(0)
    for bit, condition in enumerate(row_conditions(text).values()):
        mask = mask + F.when(condition, 1 << bit).otherwise(0)
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
        F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"),
    )
    narrow = scratch.settle(narrow, "narrow")
    same = narrow.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    met = join_groups(narrow, scratch.settle(same, "same"), ["h1", "h2"], "copies")
    whole = F.col("mask") + F.when(F.col("doc") > F.col("first"), 16).otherwise(0)
    per = met.groupBy("doc", "part", whole.alias("mask")).agg(F.count("*").alias("n"))
    flag = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0)).cast("boolean")
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    marked = per.join(known, "doc", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return scratch.settle(marked.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")), "masks")


def orders(letters: str) -> list[str]:
    return ["".join(p) for p in permutations(letters)]


@lru_cache(maxsize=8)
def packed(letters: str) -> list[tuple[int, int, int]]:
    """For every mask the integers of what is kept, removed, and failed after removal; field order * steps + step."""
    out = []
    for mask in range(1 << len(letters)):
        kept = removed = redundant = 0
        field = 1
        for order in orders(letters):
            gone = False
            for letter in order:
                fails = mask >> letters.index(letter) & 1
                removed += field if fails and not gone else 0
                redundant += field if fails and gone else 0
                gone = gone or bool(fails)
                kept += 0 if gone else field
                field <<= FIELD
        out.append((kept, removed, redundant))
    return out


def unpack(wide: int, fields: int) -> list[int]:
    raw = wide.to_bytes(fields * FIELD // 8, "little")
    return [int.from_bytes(raw[i : i + FIELD // 8], "little") for i in range(0, len(raw), FIELD // 8)]


def outcomes(counts: Mapping[tuple[int, bool, bool], int], letters: str) -> Iterator[tuple]:
    """(order, step, *COLUMNS) for one part, from its rows per (mask, good, toxic)."""
    table, steps = packed(letters), len(letters)
    names = orders(letters)
    kept = removed = redundant = good_lost = toxic_lost = 0
    unique = dict.fromkeys(letters, 0)
    for (mask, good, toxic), n in counts.items():
        k, r, d = table[mask]
        kept, removed, redundant = kept + k * n, removed + r * n, redundant + d * n
        good_lost += r * n if good else 0
        toxic_lost += r * n if toxic else 0
        if mask and not mask & (mask - 1):
            unique[letters[mask.bit_length() - 1]] += n
    columns = [unpack(w, len(names) * steps) for w in (kept, removed, redundant, good_lost, toxic_lost)]
    shapley = dict.fromkeys(letters, 0)
    for at, n in enumerate(columns[1]):
        shapley[names[at // steps][at % steps]] += n
    for at, (k, r, d, g, t) in enumerate(zip(*columns)):
        order, step = names[at // steps], at % steps
        yield order, step + 1, k, r, d, unique[order[step]], g, t, shapley[order[step]]


def audit(counted: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and COLUMNS for every part, order and step; ``counted`` as from ``masks``.

    A part has at most 4 * 2 ** filters rows here, however many documents. No part, no row.
    """

    def of_part(rows: pd.DataFrame) -> pd.DataFrame:
        keys = zip(rows["mask"].tolist(), rows["good"].tolist(), rows["toxic"].tolist())
        found = list(outcomes(dict(zip(keys, rows["n"].tolist())), letters))
        out = pd.DataFrame(found, columns=["filter_order", "step", *COLUMNS])
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS)
    return counted.groupBy("part").applyInPandas(of_part, schema)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The audit of filters A to E over all ``docs``, per value of ``part`` (null: empty string).

    A: under 200 words; B: 100 * different words < 50 * words; C: 100 * capitals A-Z > 3 * code points; D: any of #$%&*|;
    E: text identical to that of a smaller id. Null texts are empty. A null id is neither smaller nor larger than another;
    rows with one id are no copies of each other. A document without label is neither good nor toxic; of several labels
    any 1 counts. Other columns are ignored; very long texts are rows like any other; an empty table gives no rows.
    """
    return audit(masks(docs, labels, part, key, text))
