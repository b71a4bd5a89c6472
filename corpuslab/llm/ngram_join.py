"""Near duplicates by a blocked sparse product of the document by n-gram incidence.

Columns are shingles, rows are the different shingle sets. A pair of rows can only reach the threshold if it
shares one of the first columns of both, in one global order with very frequent columns last, so the product is
taken over those columns only, in blocks of columns; sizes and places in the order bound what two rows can still
share, and pairs below are never made. Exact overlap counts of the rest decide.

Rows that are much alike would all be pairs of each other. So a first product over a few columns ties them into
groups, whose rows are compared in blocks and give only the links that connect them; the full product then only makes
pairs between different groups. The result is the same as that of all pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch, join_groups, likely
from corpuslab.llm.components import components
from corpuslab.llm.tokens import in_chunks
from corpuslab.llm.windows import BASES, Rolling, word_units
from corpuslab.operators.ordering import top_per_group

WORDS = 5
PERCENT = 75
FIRST = 8  # columns of a row in the first product
PIVOTS = 3  # partners of a row in it
FREQUENT = 400_000  # columns that are put last, about
LOCAL = 40_000  # of them that a task proposes, each time it has seen 2 ** 21 cells
LARGE = 4096  # rows of a column that one task compares
SUMS = 1 << 21  # meetings of rows a task holds before it adds them up
BLOCK_ROWS = 256  # rows of pairs that are compared at one place, twice
GROUP_ROWS = 2048  # rows of a group that are compared at one place, twice
GROUP_CELLS = 1 << 19  # shingles of them, on average
GROUP_BLOCKS = 64  # so many blocks of a group meet each other; a larger group is dealt to several
PART_CELLS = 1 << 20  # cells of the product's rows that are dealt to one part of the columns, on average
TASKS = 20_000  # beyond as many parts a task has several, one after the other
BLOCK_CELLS = 1 << 20  # of them that a task packs together
NO_ID = (1 << 63) - 1
CONST = 0xA0761D6478BD642F
_BLOCK = ["part", "short", "place", "times", "node", "comp", "n"]
_BLOCK_SCHEMA = "part long, short binary, place binary, times binary, node binary, comp binary, n binary"


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word runs; a shorter text is one run; no words, none."""
    units = word_units(text, lower=True)
    if not len(units):
        return units
    rolling = Rolling(units, BASES[0])
    return np.unique(rolling.every(min(words, len(units))))


def _set_rows(docs: DataFrame, words: int) -> DataFrame:
    """Set rows (kind 0: doc, n, one, two, first columns), and locally frequent columns (kind 1: one, n times)."""
    names = ["kind", "doc", "n", "one", "two", "first"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Counter = Counter()
        held, total = [], 0

        def count() -> None:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            many = np.flatnonzero(times > 1)
            many = many[np.argsort(-times[many], kind="stable")[:LOCAL]]
            frequent.update(dict(zip(values[many].view(np.int64).tolist(), times[many].tolist())))

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in in_chunks(texts):
                sets = [shingles(t, words) for t in texts[lo:hi]]
                wide = np.uint64(CONST)
                one = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                two = [int(((s ^ (s >> np.uint64(29))) * wide).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                first = [s[:FIRST].view(np.int64).tolist() for s in sets]
                columns = [[0] * (hi - lo), ids.slice(lo, hi - lo), [len(s) for s in sets], one, two, first]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)
                held += [s for s in sets if len(s)]
                total += sum(map(len, sets))
                if total > 1 << 21:
                    count()
                    held, total = [], 0
        if held:
            count()
        n = len(frequent)
        columns = [[1] * n, [0] * n, list(frequent.values()), list(frequent), [0] * n, [[]] * n]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.mapInArrow(find, "kind int, doc long, n long, one long, two long, first array<long>")


def _frequent(proposed: DataFrame, scratch: Scratch) -> np.ndarray:
    """The columns (one, n times) that are put last, about FREQUENT, rarer ones first.

    Levels of about 4 % tell how often a column must be met, and a hash which of the lowest level are taken. The driver
    sees a number per level and 16 bytes per column, packed in tasks.
    """
    counted = proposed.groupBy("one").agg(F.sum("n").alias("times"))
    counted = scratch.settle(counted.withColumn("level", F.floor(16 * F.log2("times"))), "frequent")
    levels = counted.groupBy("level").agg(F.count("*").alias("m")).orderBy(F.desc("level")).collect()  # at most 16 * 63 rows
    lowest, share, left = 0, 0.0, FREQUENT
    for level, m in levels:
        lowest, share = level, min(1.0, left / m)
        left -= m
        if left <= 0:
            break
    drawn = F.pmod(F.xxhash64("one"), F.lit(1 << 30)) < int(share * (1 << 30))
    chosen = counted.where((F.col("level") > lowest) | ((F.col("level") == lowest) & drawn)).select("one", "times")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)] for batch in batches]
        if held:
            blobs = [pa.array([np.concatenate(c).astype(np.int64).tobytes()], pa.binary()) for c in zip(*held)]
            yield pa.RecordBatch.from_arrays(blobs, ["one", "times"])

    packed = chosen.mapInArrow(pack, "one binary, times binary").collect()  # a row per task
    scratch.drop("frequent")
    one, times = (np.frombuffer(b"".join(bytes(r[k]) for r in packed), np.int64) for k in (0, 1))
    return one[np.lexsort((-one, times))].view(np.uint64)


def _pivots(signs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that look alike: each row with the pivots of its first columns.

    A column's pivot is drawn by a hash of column and row, so the columns of one group of alike rows name different pivots
    and the pairs tie the group together. Rows that share few of their first columns are left to the product.
    """
    columns = signs.select("node", "first", F.explode("first").alias("column"))
    draw = F.struct(F.xxhash64("column", "node").alias("h"), F.col("node").alias("pivot"), F.col("first").alias("other"))
    groups = columns.groupBy("column").agg(F.min(draw).alias("p"), F.count("*").alias("m")).where("m > 1")
    groups = scratch.settle(groups.select("column", "p.pivot", "p.other", "m"), "columns")
    pairs = join_groups(columns, groups, ["column"], "m").where("pivot <> node").dropDuplicates(["node", "pivot"])
    shared = F.size(F.array_intersect("first", "other"))
    alike = 2 * shared >= F.greatest(F.size("first"), F.size("other"))
    best = top_per_group(pairs.where(alike).select("node", "pivot", shared.alias("shared")), "node", PIVOTS, F.desc("shared"), F.col("pivot"))
    return best.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _groups(tried: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, comp, own, to: the group of each row in ``tried``, its block, and the meetings of blocks it takes part in.

    Groups are what the pairs tie together. One with many rows or shingles is dealt to blocks by a hash, and one with more
    than GROUP_BLOCKS blocks to several groups of at most as many, so a row goes to a bounded number of meetings.
    """
    alike = scratch.settle(components(tried, scratch, "c1").join(classes.select("node", "n"), "node"), "alike")
    blocks = F.ceil(F.greatest(F.col("size") / GROUP_ROWS, F.least("size", F.col("cells") / GROUP_CELLS)))
    sizes = alike.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("cells"))
    sizes = scratch.settle(sizes.select("component", "size", blocks.alias("blocks")), "group_sizes")
    placed = join_groups(alike.select("node", "component"), sizes, ["component"], "size")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("many", F.ceil(F.col("blocks") / GROUP_BLOCKS))
    placed = placed.withColumn("group", F.pmod("block", "many"))
    part = F.xxhash64("component", "group").bitwiseOR(F.lit(-(1 << 63)))  # no node is negative
    name = lambda block: F.xxhash64("component", block)
    meeting = lambda other: F.struct(name(F.least("block", other)).alias("one"), name(F.greatest("block", other)).alias("two"))
    to = F.transform(F.sequence("group", F.col("blocks") - 1, "many"), meeting)
    found = placed.select("node", F.when(F.col("many") == 1, F.col("component")).otherwise(part).alias("comp"), name(F.col("block")).alias("own"), to.alias("to"))
    return scratch.settle(found, "groups")


def _sets(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """one, two, kind 0, a, b, grams: the shingles of each row of ``wanted`` (node, own, doc, sum, to) at each of its meetings.

    A bit table keeps texts that are not wanted out of the shuffle. Rows of one id and text come once for each repeat.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["one", "two", "kind", "a", "b", "grams"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, own, total, to, text in zip(*[batch.column(n).to_pylist() for n in ("node", "own", "sum", "to", "text")]):
                grams = shingles(text, words)
                if int(grams.sum(dtype=np.uint64).view(np.int64)) != total:
                    continue  # another text under the same id
                raw = grams.tobytes()
                step = max(1, min(64, (1 << 24) // max(1, len(raw))))
                for at in range(0, len(to), step):
                    some = to[at : at + step]
                    n = len(some)
                    columns = ([t["one"] for t in some], [t["two"] for t in some], [0] * n, [node] * n, [own] * n, [raw] * n)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    joined = likely(docs, wanted, "doc").join(wanted, "doc").select("node", "own", "sum", "to", "text")
    return joined.mapInArrow(fetch, "one long, two long, kind int, a long, b long, grams binary")


def _connect(sets: list[np.ndarray], left: int, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect what all links connect: those of the first ``left`` rows to the others, or of all if none is left.

    The overlaps are a product of the row by shingle incidence, a chunk of rows at a time: shingles that many rows
    have as a dense matrix, the others by their lists of rows.
    """
    rows = len(sets)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(rows), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times >= max(2, rows / 16)
    number = np.cumsum(common) - 1
    cells = common[column]
    dense = np.zeros((rows, int(common.sum())), np.uint8)
    dense[row[cells], number[column[cells]]] = 1
    cells = np.flatnonzero(((times > 1) & ~common)[column])
    by_column = cells[np.argsort(column[cells], kind="stable")]
    member, held = row[by_column], column[by_column]
    many = times[column[cells]]  # cells are in the order of rows
    begin = np.searchsorted(held, column[cells])
    first = np.searchsorted(row[cells], np.arange(rows + 1))
    work = np.append(0, np.cumsum(many))[first]
    label, links = np.arange(rows), []
    lo, end = 0, left if left < rows else rows
    while lo < end:
        hi = min(end, lo + 256, max(lo + 1, int(np.searchsorted(work, work[lo] + (1 << 21), side="right")) - 1))
        base = left if left < rows else lo
        shared = np.zeros((hi - lo, rows - base), np.int64)
        for at in range(0, dense.shape[1], 4096):
            x, y = dense[lo:hi, at : at + 4096], dense[base:, at : at + 4096]
            shared += (x.astype(np.float32) @ y.astype(np.float32).T).astype(np.int64)
        some = slice(first[lo], first[hi])
        n = many[some]
        if len(n):
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[some], n)
            other, me = member[at], np.repeat(row[cells[some]], n) - lo
            ahead = other >= base
            met = np.bincount(me[ahead] * (rows - base) + other[ahead] - base, minlength=shared.size)
            shared += met.reshape(shared.shape)
        linked = (100 + percent) * shared >= percent * (size[lo:hi, None] + size[None, base:])
        linked &= label[lo:hi, None] != label[None, base:]
        for k in np.flatnonzero(linked.any(axis=1)).tolist():
            others = base + np.flatnonzero(linked[k])
            found, which = np.unique(label[others], return_index=True)
            new = found != label[lo + k]
            links += [(lo + k, j) for j in others[which[new]].tolist()]
            label[np.isin(label, found[new])] = label[lo + k]
        if (label == label[0]).all():
            break
        lo = hi
    return links


def _within(groups: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the rows of each group that overlap enough: all pairs are compared, fewer links than rows come out.

    Each two blocks of a group meet in a task, and each block with itself.
    """
    wanted = groups.select("node", "own", "to").join(classes.select("node", "doc", F.col("one").alias("sum")), "node")
    wanted = scratch.settle(wanted, "group_rows")
    every = _sets(wanted, docs, words).drop("kind").repartition("one", "two").sortWithinPartitions("one", "two")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}

        def links() -> pa.RecordBatch:
            nodes = sorted(held, key=lambda node: held[node][0] != here[0])
            left = sum(held[node][0] == here[0] for node in nodes)
            pairs = _connect([held[node][1] for node in nodes], left, percent) if len(nodes) > 1 else []
            ends = [[nodes[p[k]] for p in pairs] for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

        for batch in batches:
            keys = zip(*[batch.column(n).to_pylist() for n in ("one", "two", "a", "b")])
            for (one, two, node, own), raw in zip(keys, batch.column("grams")):
                if (one, two) != here:
                    if held:
                        yield links()
                    here, held = (one, two), {}
                held[node] = (own, np.frombuffer(raw.as_py(), np.uint64))
        if held:
            yield links()

    return scratch.settle(every.mapInArrow(compare, "a long, b long"), "group_links")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough.

    Rows that are compared with each other are brought together in blocks: a row is named after the smallest row it is
    paired with, names with many rows are cut into blocks of BLOCK_ROWS by a hash, and a pair is counted where its two
    blocks meet. A row's set goes once to each meeting it has a pair in, however many pairs that is.
    """
    ways = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    ends = ways.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("d"))
    ends = scratch.settle(ends.select("node", "d", F.least("node", "least").alias("name")), "ends")
    sizes = scratch.settle(ends.groupBy("name").agg(F.count("*").alias("size")), "sizes")
    placed = join_groups(ends, sizes, ["name"], "size")
    block = F.xxhash64("name", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK_ROWS)))
    placed = scratch.settle(placed.select("node", "d", block.alias("block")), "placed")
    side = lambda end: placed.select(F.col("node").alias(end), F.col("d").alias(f"d{end}"), F.col("block").alias(f"block{end}"))
    met = join_groups(join_groups(pairs, side("a"), ["a"], "da"), side("b"), ["b"], "db")
    met = scratch.settle(met.select(F.least("blocka", "blockb").alias("one"), F.greatest("blocka", "blockb").alias("two"), "a", "b"), "met")
    routes = met.select(F.col("a").alias("node"), "one", "two").unionByName(met.select(F.col("b").alias("node"), "one", "two")).distinct()
    routes = routes.groupBy("node").agg(F.collect_list(F.struct("one", "two")).alias("to"))
    wanted = routes.join(classes.select("node", F.col("node").alias("own"), "doc", F.col("one").alias("sum")), "node")
    wanted = scratch.settle(wanted, "wanted")
    sets = _sets(wanted, docs, words)
    every = sets.unionByName(met.select("one", "two", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("grams")))
    every = every.repartition("one", "two").sortWithinPartitions("one", "two", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, {}
        for batch in batches:
            found = ([], [])
            keys = zip(*[batch.column(n).to_pylist() for n in ("one", "two", "kind", "a", "b")])
            for (one, two, kind, a, b), raw in zip(keys, batch.column("grams")):
                if (one, two) != here:
                    here, held = (one, two), {}
                if kind == 0:
                    held[a] = np.frombuffer(raw.as_py(), np.uint64)
                    continue
                x, y = sorted((held[a], held[b]), key=len)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b"])

    return scratch.settle(every.mapInArrow(compare, "a long, b long").distinct(), "links")


def _feasible(n1, p1, n2, p2, percent: int):
    """Can rows of sizes n1, n2 that first meet at places p1, p2 overlap enough? Works on numbers, arrays and columns."""
    sizes = (100 * n1 >= percent * n2) & (100 * n2 >= percent * n1)
    need = percent * (n1 + n2)
    return sizes & ((100 + percent) * (n1 - p1) >= need) & ((100 + percent) * (n2 - p2) >= need)


def _prefix_rows(texts: DataFrame, frequent: np.ndarray, words: int, percent: int, parts: int) -> DataFrame:
    """Blocks of each row's first columns: rare ones first, the frequent ones last; see ``_packed``."""
    by_value = np.argsort(frequent)
    values = frequent[by_value]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows, cells = [], [], 0
            for node, comp, one, text in zip(*[batch.column(n).to_pylist() for n in ("node", "comp", "one", "text")]):
                grams = shingles(text, words)
                if int(grams.sum(dtype=np.uint64).view(np.int64)) != one:
                    continue
                n = len(grams)
                take = n - -(-percent * n // 100) + 1
                if len(values):
                    at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
                    rank = np.where(values[at] == grams, by_value[at] + 1, 0)
                    grams = grams[np.argsort(rank, kind="stable")]
                out.append(grams[:take])
                rows.append((node, comp, n))
                cells += take
                if cells > BLOCK_CELLS:
                    yield _packed(out, rows, parts)
                    out, rows, cells = [], [], 0
            if out:
                yield _packed(out, rows, parts)

    return texts.select("node", "comp", "one", "text").mapInArrow(find, _BLOCK_SCHEMA)


def _packed(columns: list[np.ndarray], rows: list[tuple[int, int, int]], parts: int) -> pa.RecordBatch:
    """A block per part of the columns: 32 bits of each column and its place, row after row, then the rows themselves.

    Columns of a part that agree in 32 bits count as one; that can only add to what two rows seem to share.
    """
    sizes = [len(c) for c in columns]
    mixed = np.concatenate(columns)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(CONST)
    mixed ^= mixed >> np.uint64(32)
    part = ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    short, part = mixed.astype(np.uint32)[order], part[order]
    row = np.repeat(np.arange(len(sizes)), sizes)[order]
    place = np.concatenate([np.arange(n, dtype=np.uint32) for n in sizes])[order]
    table = np.array(rows, np.int64)
    ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
    out: list[list] = [[] for _ in range(7)]
    lo = 0
    for hi in ends.tolist():
        known, times = np.unique(row[lo:hi], return_counts=True)
        values = (int(part[lo]), short[lo:hi], place[lo:hi], times.astype(np.uint32), *table[known].T)
        for column, value in zip(out, values):
            column.append(value if isinstance(value, int) else value.tobytes())
        lo = hi
    kinds = [pa.int64()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], _BLOCK)


def _unpacked(block: dict) -> np.ndarray:
    """column, node, comp, n, place of a block's cells."""
    times = np.frombuffer(block["times"], np.uint32)
    column = (np.int64(block["part"]) << 32) | np.frombuffer(block["short"], np.uint32).astype(np.int64)
    rows = [np.repeat(np.frombuffer(block[name], np.int64), times) for name in ("node", "comp", "n")]
    return np.stack([column, *rows, np.frombuffer(block["place"], np.uint32).astype(np.int64)], axis=1)


def _cross_pairs(rows: DataFrame, scratch: Scratch, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b) of different components that share enough of their first columns to overlap enough.

    The product adds up, block of columns by block, in how many of their first columns two rows meet. Rows of sizes
    n1 and n2 can share at most that many columns and, of the others, those of one row (the one whose first columns
    end earlier in the common order); pairs for which even that is too few are dropped.

    A task holds the cells of one part of the columns; when they are many more than on average, those of columns with more
    than LARGE rows are handed on at once.

    The largest component of a column needs no pairs of its own, so its other rows are set against all. Columns with more
    than LARGE rows do the same as a join in parts, where the place of the meeting decides as if it were the first one;
    in the sums such columns count as shared by the rows that have them.
    """
    names = ["column", "a", "b", "comp", "n", "place", "m", "shared"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[tuple[np.ndarray, ...]] = []
        held = 0

        def add_up() -> None:
            nonlocal met, held
            a, b, n, m, times = (np.concatenate(c) for c in zip(*met))
            order = np.lexsort((b, a))
            a, b, n, m, times = a[order], b[order], n[order], m[order], times[order]
            head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            met = [(a[head], b[head], n[head], m[head], np.add.reduceat(times, head))]
            held = len(head)

        def sums() -> pa.RecordBatch:
            nonlocal met, held
            if met:
                add_up()
            a, b, n, m, times = met[0] if met else (np.zeros(0, np.int64),) * 5
            met, held = [], 0
            none = pa.nulls(len(a), pa.int64())
            columns = (none, a, b, none, n, none.cast(pa.int32()), m, times)
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names)

        def overflow(block: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(block), pa.int64())
            columns = (block[:, 0], block[:, 1], none, block[:, 2], block[:, 3], block[:, 4], none.cast(pa.int32()), none.cast(pa.int32()))
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names)

        def pair(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held
            comps, times = np.unique(block[:, 2], return_counts=True)
            if len(comps) < 2:
                return
            other = block[:, 2] != comps[times.argmax()]
            place = np.where(other, np.cumsum(other) - 1, len(block))  # rows that are not in the largest component, in turn
            minor = block[other]
            for at in range(0, len(minor), 256):
                x, y = minor[at : at + 256, None, :], block[None, :, :]
                # A pair of two such rows comes up from both sides; the row that comes first has it.
                ok = (x[..., 2] != y[..., 2]) & (place[None, :] > np.arange(at, at + len(x))[:, None])
                ok &= (100 * x[..., 3] >= percent * y[..., 3]) & (100 * y[..., 3] >= percent * x[..., 3])
                i, j = np.nonzero(ok)
                if not len(i):
                    continue
                one, two = minor[at + i], block[j]
                swap = one[:, 1] > two[:, 1]
                a, b = np.where(swap, two[:, 1], one[:, 1]), np.where(swap, one[:, 1], two[:, 1])
                n, m = np.where(swap, two[:, 3], one[:, 3]), np.where(swap, one[:, 3], two[:, 3])
                met.append((a, b, n, m, np.ones(len(a), np.int64)))
                held += len(a)
                if held > SUMS:
                    add_up()
                    if held > SUMS // 2:
                        yield sums()

        def wide(data: np.ndarray, open_: np.ndarray, all_: bool) -> Iterator[pa.RecordBatch]:
            """Hand on the cells of columns with more than LARGE rows; ``all_``: and pair the rows of the others."""
            nonlocal kept, large
            data = data[np.argsort(data[:, 0], kind="stable")]
            bounds = np.append(np.flatnonzero(np.append(True, np.diff(data[:, 0]) != 0)), len(data))
            sizes = np.diff(bounds)
            over = (sizes > LARGE) | np.isin(data[bounds[:-1], 0], open_)
            if over.any():
                large = np.union1d(open_, data[bounds[:-1][over], 0])
                yield overflow(data[np.repeat(over, sizes)])
            if not all_:
                kept = [data[~np.repeat(over, sizes)]]
                return
            mixed = ~over & (np.minimum.reduceat(data[:, 2], bounds[:-1]) != np.maximum.reduceat(data[:, 2], bounds[:-1]))
            for k in np.flatnonzero(mixed).tolist():
                yield from pair(data[bounds[k] : bounds[k + 1]])

        kept: list[np.ndarray] = []
        large = np.zeros(0, np.int64)  # columns of this part that were handed on
        here, size, most = None, 0, 4 * PART_CELLS
        for batch in batches:
            for block in batch.to_pylist():
                if block["part"] != here:
                    if kept:
                        yield from wide(np.concatenate(kept), large, True)
                    here, kept, size, most, large = block["part"], [], 0, 4 * PART_CELLS, np.zeros(0, np.int64)
                kept.append(_unpacked(block))
                size += len(kept[-1])
                if size > most:  # what is left has at most LARGE rows a column
                    yield from wide(np.concatenate(kept), large, False)
                    size = len(kept[0])
                    most = max(most, 2 * size)
        if kept:
            yield from wide(np.concatenate(kept), large, True)
        yield sums()

    tasks = min(parts, TASKS)
    dealt = rows.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part")
    found = dealt.mapInArrow(multiply, "column long, a long, b long, comp long, n int, place int, m int, shared int")
    found = scratch.settle(found, "product")
    large = found.where("b is null").select("column", F.col("a").alias("node"), "comp", "n", "place")
    wide = scratch.settle(large.groupBy("node").agg(F.count("*").alias("wide")), "large_nodes")
    summed = found.where("b is not null").groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("shared"))
    for end in ("a", "b"):
        summed = summed.join(wide.select(F.col("node").alias(end), F.col("wide").alias(f"wide_{end}")), end, "left")
    rest = lambda c: F.col(c).cast("long") - (F.col(c) - F.ceil(F.col(c) * percent / 100) + 1)
    most = F.col("shared") + F.least(F.coalesce("wide_a", F.lit(0)), F.coalesce("wide_b", F.lit(0))) + F.greatest(rest("n"), rest("m"))
    enough = scratch.settle(summed.where((100 + percent) * most >= percent * (F.col("n") + F.col("m"))).select("a", "b"), "enough")

    per = scratch.settle(large.groupBy("column", "comp").agg(F.count("*").alias("m")), "large_comps")
    main = per.groupBy("column").agg(F.max(F.struct("m", "comp")).alias("main"), F.sum("m").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    main = scratch.settle(main.select("column", F.col("main.comp").alias("main"), "all"), "large_columns")
    open_ = join_groups(large, main, ["column"], "all").where("main is not null").withColumn("parts", F.ceil(F.col("all") / LARGE).cast("int"))
    open_ = scratch.settle(open_, "large_rows")
    minor = open_.where("comp <> main").select("column", F.col("node").alias("node2"), F.col("comp").alias("comp2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    every = open_.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = every.join(minor, ["column", "part"]).where((F.col("comp") != F.col("comp2")) & _feasible(F.col("n").cast("long"), F.col("place"), F.col("n2").cast("long"), F.col("place2"), percent))
    met = met.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"))
    return enough.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: a row per row of ``docs``.

    Words stand between ASCII white space, A-Z folded. Two rows are linked if their sets of ``words``-word shingles have
    100 * intersection >= percent * union; a text with fewer words is one shingle; one without words has no shingles and is
    its own component. ``component_id`` is the smallest id among the rows that links lead to. Null texts are empty; null ids
    come last, so a component is only null if all its ids are; rows that repeat an id are told apart by their text.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram_join")
    named = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = scratch.settle(_set_rows(named, words), "sets")
    sets = found.where("kind = 0").select("doc", "n", "one", "two", "first")
    frequent = _frequent(found.where("kind = 1").select("one", "n"), scratch)
    classes = sets.where("n > 0").groupBy("one", "two", "n").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.min("first").alias("first"))
    classes = scratch.settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    tried = scratch.settle(_pivots(classes.select("node", "first"), scratch), "tried")
    groups = _groups(tried, classes, scratch)
    links = _within(groups, classes, named, scratch, words, percent)
    labelled = classes.join(groups.select("node", "comp"), "node", "left").select("node", "doc", "one", F.coalesce("comp", "node").alias("comp"))
    cells = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    parts = -(-int(cells) // PART_CELLS) or 1
    rows = _prefix_rows(named.join(labelled, "doc"), frequent, words, percent, parts)
    pairs = scratch.settle(_cross_pairs(rows, scratch, percent, parts), "pairs")
    more = _verify(pairs, classes, named, scratch, words, percent)
    final = components(links.unionByName(more), scratch, "c2")

    named_classes = classes.join(final, "node", "left").select("one", "two", "n", "copies", "doc", F.coalesce("component", "node").alias("component"))
    named_classes = scratch.settle(named_classes, "labelled")
    heads = named_classes.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("members"))
    heads = scratch.settle(heads, "heads")
    members = join_groups(named_classes.select("one", "two", "n", "copies", "component"), heads, ["component"], "members")
    members = scratch.settle(members.select("one", "two", "n", "copies", "component_id"), "members")
    out = join_groups(sets.select("doc", "n", "one", "two"), members, ["one", "two", "n"], "copies")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias(key), F.col("n").alias("n_shingles"), F.nullif(own, F.lit(NO_ID)).alias("component_id"))
