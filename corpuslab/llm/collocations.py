"""Phrase collocations by direct-address tiling.

Words are numbered by frequency. A pair of numbers is a cell of a square that is cut into tiles, narrow where words are
frequent, so that tiles hold about equally many pairs. Tasks count the pairs of their texts per tile, in a dense array
where a tile is well filled and as sorted coordinates where it is not, and the counts of a tile add up in one place.
Frequent pairs are numbered by frequency again and paired with the word that follows, for phrases of three and four.

Numbers are given to the HEAD most frequent words (or phrases) only, so tasks hold a table of fixed size. Other words
stand for themselves by a 63-bit hash and are counted as coordinates; a bit table of fixed size tells most of those that
cannot be frequent. Counts are exact for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch, join_groups
from corpuslab.llm.windows import BASES, Rolling, mix
from corpuslab.operators.ordering import top_n, top_per_group

LEAST = 30  # occurrences of a candidate
LONGEST = 4
SHARE = 80  # per cent of a phrase that a longer one must reach to replace it
SCALE = 2_000_000
NO_LANGUAGE = "und"

HEAD = 1 << 17
BITS = 26  # of the bit table's size
CHUNK = 1_000_000  # bytes of text at a time
HELD = 1 << 22  # pairs a task holds before it counts them
DENSE = 1 << 22  # cells of the largest tile that is ever counted densely
TAIL_TILES = 512
TAIL = np.uint64(1 << 63)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[9, 32]] = 1
_KIND[[46, 44, 59, 58, 33, 63, 10, 11, 12, 13]] = 2

# Tile edges, in numbers: each tile is about a third wider than the one before, as frequencies fall with the number.
EDGES = np.unique(np.concatenate([np.arange(5), (4 * 1.35 ** np.arange(1, 60)).astype(np.int64), [HEAD]]))
EDGES = EDGES[EDGES <= HEAD].astype(np.int64)
SIDE = len(EDGES) - 1


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where its rows begin."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _parts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, after last row, from, to): rows together up to CHUNK bytes; a longer row in parts that end between words."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        at, stop = int(offsets[row]), int(offsets[end])
        while stop - at > CHUNK and end == row + 1:
            cut = at + CHUNK
            while cut < stop and not _KIND[raw[cut - 1]]:
                step = np.flatnonzero(_KIND[raw[cut : cut + CHUNK]])
                cut = min(stop, cut + int(step[0]) + 1) if len(step) else min(stop, cut + CHUNK)
            yield row, end, at, cut
            at = cut
        yield row, end, at, stop
        row = end


@dataclass
class Words:
    """Words of a part: code (63 bits, of language and word), whether they follow the one before in its piece, bounds, row."""

    code: np.ndarray
    follows: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    raw: np.ndarray


def _seeds(languages: pa.Array) -> tuple[np.ndarray, list[str]]:
    import hashlib

    coded = pc.fill_null(languages, NO_LANGUAGE).dictionary_encode()
    names = coded.dictionary.to_pylist()
    seeds = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    return (seeds[at] if len(names) else np.zeros(0, np.uint64)), [names[i] for i in at]


def _words(raw: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> Iterator[Words]:
    open_row, open_piece = -1, False  # a row that goes on in the next part, in the same piece
    for first, after, low, high in _parts(raw, offsets):
        part = _FOLD[raw[low:high]]
        kind = _KIND[part]
        inside = kind == 0
        before = np.empty(len(part), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        begins = offsets[first:after] - low
        fresh = begins[(begins >= 0) & (begins < len(part))]
        before[fresh] = False
        start = np.flatnonzero(inside & ~before)
        ends = np.ones(len(part), bool)
        ends[:-1] = ~inside[1:]
        ends[fresh[fresh > 0] - 1] = True
        end = np.flatnonzero(inside & ends) + 1
        row = first + np.searchsorted(offsets[first + 1 : after], start + low, "right") if len(start) else np.zeros(0, np.int64)
        breaks = np.flatnonzero(kind == 2)
        pieces = np.searchsorted(breaks, start)
        follows = np.zeros(len(start), bool)
        follows[1:] = (pieces[1:] == pieces[:-1]) & (row[1:] == row[:-1])
        if len(start) and open_row == first:
            follows[0] = open_piece and pieces[0] == 0
        if after - first == 1:
            closed = len(breaks) and (not len(start) or breaks[-1] > start[-1])
            open_piece = not closed and (len(start) > 0 or (open_row == first and open_piece))
            open_row = first
        else:
            open_row = -1
        units = part.astype(np.uint64) + np.uint64(1)
        code = mix(Rolling(units, BASES[1]).of(start, end) ^ seeds[row]) >> np.uint64(1)
        yield Words(code, follows, start, end, row, part)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words of all texts, and the languages of the rows they refer to. Columns: lang, text."""
    for batch in batches:
        if batch.num_rows:
            seeds, names = _seeds(batch.column(0))
            for words in _words(*_raw(batch.column(1)), seeds):
                yield words, names


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    values, at = np.unique(code, return_inverse=True)
    return values, np.bincount(at, weights=count, minlength=len(values)).astype(np.int64)


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, code, n: one row per word and task or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, tuple[str, bytes]] = {}
        codes, counts, size, pending = [], [], 0, 0

        def rows() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(codes[0]), 100_000):
                some = codes[0][at : at + 100_000].tolist()
                columns = [pa.array([texts[c][0] for c in some], pa.string()), pa.array([texts[c][1] for c in some], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(some, pa.int64()), pa.array(counts[0][at : at + 100_000], pa.int64())], ["lang", "word", "code", "n"])

        for words, names in _stream(batches):
            new, first, times = np.unique(words.code, return_index=True, return_counts=True)
            codes.append(new)
            counts.append(times)
            pending += len(new)
            raw = words.raw.tobytes()
            for code, i in zip(new.tolist(), first.tolist()):
                if code not in texts:
                    word = raw[words.start[i] : words.end[i]]
                    texts[code] = (names[words.row[i]], word)
                    size += len(word) + 200
            if pending > HELD or size > 1 << 26:
                (code, total), pending = _merge(codes, counts), 0
                codes, counts = [code], [total]
            if size > 1 << 26:
                yield from rows()
                texts, codes, counts, size = {}, [], [], 0
        if codes:
            code, total = _merge(codes, counts)
            codes, counts = [code], [total]
            yield from rows()

    return docs.mapInArrow(count, "lang string, word string, code long, n long")


def _bit_table(spark, codes: DataFrame) -> np.ndarray:
    """One bit for every 63-bit ``code``, by its highest bits. 2 ** BITS bits, whatever the number of codes."""
    shift = 63 - BITS
    lane = F.shiftright("code", shift + 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftright(code, {shift}) & 63 as int))")
    lanes = codes.groupBy(lane.alias("lane")).agg(F.bit_or(bit).alias("bits"))
    found = lanes.toArrow()  # at most 2 ** (BITS - 6) rows
    table = np.zeros(1 << (BITS - 6), np.int64)
    table[found["lane"].to_numpy()] = found["bits"].to_numpy()
    return table


@dataclass
class Level:
    """What tasks know of the frequent words or phrases of one length: codes of the head, sorted, their numbers, the bit table."""

    codes: np.ndarray
    numbers: np.ndarray
    bits: np.ndarray

    def symbols(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of head codes, other codes with the top bit set; and which can be frequent."""
        lanes = (code >> np.uint64(63 - BITS)).astype(np.int64)
        maybe = (self.bits[lanes >> 6] >> (lanes & 63)) & 1 == 1
        out = code | TAIL
        if len(self.codes):
            some = np.flatnonzero(maybe)
            at = np.minimum(np.searchsorted(self.codes, code[some]), len(self.codes) - 1)
            hit = self.codes[at] == code[some]
            out[some[hit]] = self.numbers[at[hit]]
        return out, maybe


def _level(frequent: DataFrame) -> Level:
    """Of a written table (code, a)."""
    head = top_n(frequent.select("code", "a"), HEAD, F.desc("a"), F.col("code")).toArrow()  # at most HEAD rows
    codes = head["code"].to_numpy().astype(np.uint64)
    order = np.argsort(codes)
    return Level(codes[order], order.astype(np.uint64), _bit_table(frequent.sparkSession, frequent))


def joined_code(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Code of the phrase that joins two."""
    return mix(mix(left + np.uint64(0x9E3779B97F4A7C15)) + right) >> np.uint64(1)


def _tile(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tile number and cell in it, of pairs of head numbers."""
    i, j = np.searchsorted(EDGES, left, "right") - 1, np.searchsorted(EDGES, right, "right") - 1
    width = (EDGES[1:] - EDGES[:-1])[j]
    return i * SIDE + j, (left - EDGES[i]) * width + (right - EDGES[j])


def _area(tile: int) -> tuple[int, int]:
    i, j = divmod(tile, SIDE)
    width = int(EDGES[j + 1] - EDGES[j])
    return int(EDGES[i + 1] - EDGES[i]) * width, width


TILES = "tile long, dense boolean, keys binary, counts binary"
_TILE_NAMES, _TILE_TYPES = ["tile", "dense", "keys", "counts"], [pa.int64(), pa.bool_(), pa.binary(), pa.binary()]


def _tile_rows(rows: list[tuple[int, bool, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _TILE_TYPES)], _TILE_NAMES)


def _head_rows(cells: np.ndarray, tiles: np.ndarray) -> Iterator[tuple[int, bool, bytes, bytes]]:
    order = np.argsort(tiles.astype(np.int32), kind="stable")
    tiles, cells = tiles[order], cells[order]
    ends = np.flatnonzero(np.diff(tiles)) + 1
    for low, high in zip([0, *ends.tolist()], [*ends.tolist(), len(tiles)]):
        tile, some = int(tiles[low]), cells[low:high]
        area = _area(tile)[0]
        if area <= DENSE and area <= 4 * len(some):
            counts = np.bincount(some, minlength=area)
            if 2 * np.count_nonzero(counts) >= area:
                yield tile, True, b"", counts.astype(np.uint32).tobytes()
                continue
            keys = np.flatnonzero(counts)
            counts = counts[keys]
        else:
            keys, counts = np.unique(some, return_counts=True)
        yield tile, False, keys.astype(np.uint32).tobytes(), counts.astype(np.uint32).tobytes()


def _tail_rows(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, bool, bytes, bytes]]:
    tiles = (mix(left * np.uint64(31) + right) % np.uint64(TAIL_TILES)).astype(np.int64)
    order = np.lexsort((right, left, tiles))
    tiles, left, right = tiles[order], left[order], right[order]
    new = np.ones(len(tiles), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (tiles[1:] != tiles[:-1])
    head = np.flatnonzero(new)
    counts = np.diff(np.append(head, len(tiles))).astype(np.uint32)
    tiles, left, right = tiles[head], left[head], right[head]
    ends = np.flatnonzero(np.diff(tiles)) + 1
    for low, high in zip([0, *ends.tolist()], [*ends.tolist(), len(tiles)]):
        yield -1 - int(tiles[low]), False, left[low:high].tobytes() + right[low:high].tobytes(), counts[low:high].tobytes()


def _pair_counts(docs: DataFrame, levels: list[Level]) -> DataFrame:
    """Counts per tile, a block a time, of the pairs (phrase of len(levels) words, next word) whose parts can be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # HEAD numbers and 2 ** BITS bits a level

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            left, right = (np.concatenate(c) for c in zip(*held))
            head = (left < TAIL) & (right < TAIL)
            found = []
            if head.any():
                tiles, cells = _tile(left[head].astype(np.int64), right[head].astype(np.int64))
                found.append(_head_rows(cells, tiles))
            if not head.all():
                found.append(_tail_rows(left[~head], right[~head]))
            for rows in found:
                some, held_bytes = [], 0
                for row in rows:
                    some.append(row)
                    held_bytes += len(row[2]) + len(row[3])
                    if held_bytes > 1 << 23:
                        yield _tile_rows(some)
                        some, held_bytes = [], 0
                if some:
                    yield _tile_rows(some)

        tail: Words | None = None
        for words, _ in _stream(batches):
            code, follows = words.code, words.follows
            if tail is not None and len(follows) and follows[0]:  # a long text goes on: its last words come along
                code, follows = np.concatenate([tail.code, code]), np.concatenate([tail.follows, follows])
                skip = len(tail.code)
            else:
                skip = 0
            tail = Words(code[-LONGEST:], follows[-LONGEST:], *[words.start[:0]] * 3, words.raw[:0])
            word, fine = known[0].symbols(code)
            symbol, phrase, good = word, code, fine
            for k, level in enumerate(known[1:], 1):  # phrases of k + 1 words that end at each place
                ends = np.zeros(len(code), bool)
                ends[1:] = good[:-1] & fine[1:] & follows[1:]
                places = np.flatnonzero(ends)
                longer = np.zeros_like(phrase)
                longer[places] = joined_code(phrase[places - 1], code[places])
                symbol = np.zeros_like(phrase)
                symbol[places], maybe = level.symbols(longer[places])
                good = np.zeros(len(code), bool)
                good[places] = maybe
                phrase = longer
            last = np.zeros(len(code), bool)
            last[1:] = good[:-1] & fine[1:] & follows[1:]
            last[:skip] = False
            places = np.flatnonzero(last)
            if len(places):
                held.append((symbol[places - 1], word[places]))
                size += len(places)
            if size > HELD:
                yield from blocks()
                held, size = [], 0
        if held:
            yield from blocks()

    return docs.mapInArrow(count, TILES)


def _frequent_pairs(blocks: DataFrame, levels: list[Level], least: int) -> DataFrame:
    """code, left, right, a: pairs that occur ``least`` times or more; left and right are the codes of their parts."""
    shared = blocks.sparkSession.sparkContext.broadcast((levels[-1].codes[np.argsort(levels[-1].numbers)], levels[0].codes[np.argsort(levels[0].numbers)]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_codes, right_codes = shared.value
        here, dense, keys, counts, held = None, None, [], [], 0

        def sparse() -> tuple[np.ndarray, np.ndarray]:
            return _merge(keys, counts)

        def sparse_pairs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            left, right, n = (np.concatenate(c) for c in (*zip(*keys), counts))
            order = np.lexsort((right, left))
            left, right, n = left[order], right[order], n[order]
            new = np.ones(len(left), bool)
            new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
            head = np.flatnonzero(new)
            return left[head], right[head], np.add.reduceat(n, head)

        def shrink() -> None:
            nonlocal keys, counts, held
            if here >= 0:
                k, n = sparse()
                keys, counts = [k], [n]
            else:
                a, b, n = sparse_pairs()
                keys, counts = [(a, b)], [n]
            held = 0

        def finish() -> Iterator[pa.RecordBatch]:
            if here >= 0:
                area, width = _area(here)
                if dense is not None:
                    cells, n = np.flatnonzero(dense >= least), dense
                    n = n[cells]
                else:
                    cells, n = sparse()
                    cells, n = cells[n >= least], n[n >= least]
                i, j = divmod(here, SIDE)
                left, right = left_codes[EDGES[i] + cells // width], right_codes[EDGES[j] + cells % width]
            else:
                left, right, n = sparse_pairs()
                keep = n >= least
                left, right, n = left[keep], right[keep], n[keep]
                parts = []
                for symbols, codes in ((left, left_codes), (right, right_codes)):
                    number = np.minimum(symbols, np.uint64(max(0, len(codes) - 1))).astype(np.int64)
                    parts.append(np.where(symbols < TAIL, codes[number] if len(codes) else symbols, symbols & ~TAIL))
                left, right = parts
            columns = [joined_code(left, right), left, right, n]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["code", "left", "right", "a"])

        for batch in batches:
            for tile, full, k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if tile != here:
                    if here is not None:
                        yield from finish()
                    here, dense, keys, counts, held = tile, None, [], [], 0
                n = np.frombuffer(n.as_buffer(), np.uint32).astype(np.int64)
                k = k.as_buffer()
                if tile >= 0:
                    area = _area(tile)[0]
                    if dense is None and area <= DENSE and (full or held + len(n) > area // 4):
                        dense = np.zeros(area, np.int64)
                        for old, times in zip(keys, counts):
                            dense[old] += times
                        keys, counts = [], []
                    if full:
                        dense += n
                    elif dense is not None:
                        dense[np.frombuffer(k, np.uint32)] += n
                    else:
                        keys.append(np.frombuffer(k, np.uint32).astype(np.int64))
                        counts.append(n)
                        held += len(n)
                else:
                    both = np.frombuffer(k, np.uint64)
                    keys.append((both[: len(n)], both[len(n) :]))
                    counts.append(n)
                    held += len(n)
                if held > HELD:
                    shrink()
        if here is not None:
            yield from finish()

    dealt = blocks.repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(add, "code long, left long, right long, a long")


def _sub(low, size) -> F.Column:
    return F.slice("codes", low, size)


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = LEAST, longest: int = LONGEST, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: lang, word, code, n), (phrases: codes, a; single words too), (totals: lang, n): all that occur ``least`` times or more."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = _word_counts(texts).groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))
    every = scratch.settle(every, "words")
    totals = scratch.settle(every.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = scratch.settle(every.where(F.col("n") >= least), "frequent")
    levels = [_level(words.select("code", F.col("n").alias("a")))]
    shorter = words.select("code", F.array("code").alias("codes"), F.col("n").alias("a"))
    phrases = shorter.select("codes", "a")
    for size in range(2, longest + 1):
        pairs = scratch.settle(_frequent_pairs(_pair_counts(texts, levels), levels, least), f"pairs{size}")
        parts = shorter.select(F.col("code").alias("left"), F.col("codes").alias("start"), F.col("a").alias("weight"))
        named = join_groups(pairs, parts, ["left"], "weight").where("start is not null")
        shorter = scratch.settle(named.select("code", F.concat("start", F.array("right")).alias("codes"), "a"), f"phrases{size}")
        phrases = phrases.unionByName(shorter.select("codes", "a"))
        levels.append(_level(shorter))
    return words, scratch.settle(phrases, "phrases"), totals


def collocations(docs: DataFrame, first: int = 2000, least: int = LEAST, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` best phrases of two to four words of every language.

    A-Z is folded; pieces end at .,;:!? and line ends, words at blanks and tabs. ``a`` counts a phrase's occurrences inside
    pieces, overlaps included, ``l`` and ``r`` those of the two parts of its lowest-scoring cut (the first of equals), ``n``
    all words of the language. The score is floor(2,000,000 a / (l + r)). Phrases that occur fewer than ``least`` times do
    not count, nor do those that a longer one of ``least`` occurrences holds and replaces in SHARE per cent of them. Ties
    go to the larger ``a``, then to the phrase that is smaller byte by byte. A null language is ``und``, null and empty
    texts have no words; repeated rows count again; a text of any length is read whole, in parts; other columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    words, phrases, totals = frequent_phrases(docs, scratch, least, LONGEST, lang, text)
    long = phrases.withColumn("size", F.size("codes")).where("size > 1")

    spans = long.where("size > 2").withColumn("inner", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    spans = spans.withColumn("low", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("inner") + 1)))
    holders = spans.groupBy(_sub(F.col("low"), F.col("inner")).alias("codes")).agg(F.max("a").alias("most"))
    kept = long.join(holders, "codes", "left").where(f"most is null or 100 * most < {SHARE} * a").select("codes", "a", "size")
    kept = scratch.settle(kept, "kept")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = F.array(F.struct(F.lit(True).alias("left"), _sub(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), _sub(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))
    halves = cuts.select("codes", "a", "k", F.explode(sides).alias("side")).select("codes", "a", "k", "side.left", "side.part")
    found = join_groups(halves, phrases.select(F.col("codes").alias("part"), F.col("a").alias("f")), ["part"], "f")
    per = found.groupBy("codes", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    per = per.withColumn("score", F.expr(f"cast({SCALE} as decimal(18,0)) * cast(a as decimal(18,0)) div (l + r)"))
    best = per.groupBy("codes", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("codes", "a", "cut.*")

    names = words.select("code", "lang", "word", F.col("n").alias("weight"))
    named = join_groups(best.withColumn("code", F.get("codes", F.lit(0))), names.drop("word"), ["code"], "weight").drop("code", "weight")
    near = named.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_rank") <= first)
    near = scratch.settle(near, "near")
    spelled = near.select("codes", F.posexplode("codes").alias("at", "code"))
    spelled = join_groups(spelled, names.drop("lang"), ["code"], "weight").groupBy("codes").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    phrase = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    out = near.join(spelled.select("codes", phrase.alias("phrase")), "codes")
    out = top_per_group(out, "lang", first, F.desc("score"), F.desc("a"), F.col("phrase"))
    return out.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
