"""Benchmark decontamination by a positional inverted index of the training texts.

Postings say which word stands where in which document. Test texts are cut into segments of neighbouring windows; the
list of a segment's rarest word gives places where it may stand, the list of the next rarest, shifted by the distance
of the two, thins them out, and the words around the places that are left decide. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslab.llm.common import Scratch

# Everything in ASCII that is not a digit or a small letter separates words; all other characters belong to words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDTH = 10  # words of a window
RUN = 5  # neighbouring windows of a segment; they share WIDTH - RUN + 1 words, among which its rarest are chosen
BLOCK = 512  # words of a text that meet a candidate at once, so a long text costs no more per candidate than a short one
LANES = 1 << 17  # rows of 64 bits that tell most documents without candidates; a table of at most that size is sent to all tasks
NO_ID = (1 << 63) - 1
HEAD = ""  # stands for the whole document in the postings, with its number of words as place


def folded(text: Column | str) -> Column:
    """A-Z as a-z; other capitals stay. Plain ASCII texts take the shorter way."""
    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.octet_length(body) == F.char_length(body), F.lower(body)).otherwise(F.translate(body, CAPITALS, CAPITALS.lower()))


def _slots(text: Column | str) -> Column:
    """An empty slot, then the words from place 1 on; the last slot can be empty again."""
    return F.split(F.concat(F.lit(" "), folded(text)), BETWEEN, -1)


def _length(slots: Column) -> Column:
    return F.size(slots) - 1 - F.when(F.element_at(slots, -1) == "", 1).otherwise(0)


def words(text: Column | str) -> Column:
    slots = _slots(text)
    return F.slice(slots, F.lit(2), _length(slots))


@dataclass
class Index:
    """postings: term, doc, body, place (1, 2, ...); sizes: doc, body, n_words. ``body`` tells texts under one id apart."""

    postings: DataFrame
    sizes: DataFrame


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(body).alias("body"), body.alias("text"))


def build_index(docs: DataFrame, terms: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> Index:
    """The postings of all ``terms`` (one row each), written once. No other word's list would ever be read.

    Spark sends ``terms`` to every task if the table is small enough for that, and else joins by word, hot words split.
    """
    slots = _keyed(docs, key, text).select("doc", "body", _slots("text").alias("slots"))
    each = slots.select("doc", "body", _length(F.col("slots")).alias("n"), F.posexplode("slots").alias("place", "term"))
    each = each.where("place = 0 or term <> ''")
    known = terms.select("term").unionByName(scratch.spark.range(1).select(F.lit(HEAD).alias("term")))
    known = scratch.settle(known.distinct(), "known")
    rows = each.join(known, "term").select("term", "doc", "body", F.when(F.col("place") == 0, F.col("n")).otherwise(F.col("place")).alias("place"))
    rows = scratch.settle(rows, "postings")
    sizes = rows.where(F.col("term") == HEAD).select("doc", "body", F.col("place").cast("long").alias("n_words"))
    return Index(rows.where(F.col("term") != HEAD), sizes)


def _item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    return items.select(F.col(key).cast("string").alias("item_id"), words(text).alias("words")).where(F.size("words") > 0)


def _segments(items: DataFrame, width: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Different segments (seg, words, width, core: first place in all windows), and the items (item_id, seg) that hold them."""
    n, run = F.size("words"), min(RUN, width)
    sized = items.withColumn("width", F.least(n, F.lit(width)))
    starts = sized.withColumn("low", F.explode(F.sequence(F.lit(0), n - F.col("width"), F.lit(run))))
    starts = starts.withColumn("high", F.least(F.col("low") + run - 1, n - F.col("width")))
    cut = F.slice("words", F.col("low") + 1, F.col("high") + F.col("width") - F.col("low"))
    places = scratch.settle(starts.select("item_id", cut.alias("words"), "width", (F.col("high") - F.col("low")).alias("core")), "places")
    segments = places.select("words", "width", "core").distinct().withColumn("seg", F.monotonically_increasing_id())
    segments = scratch.settle(segments, "segments")
    holders = places.join(segments, ["words", "width", "core"]).select("item_id", "seg").distinct()
    return segments, scratch.settle(holders, "holders")


def _rarest(segments: DataFrame, index: Index) -> DataFrame:
    """seg, and term1, at1, term2, at2: the rarest words that all windows of the segment share, and their places in it."""
    core = F.slice("words", F.col("core") + 1, F.col("width") - F.col("core"))
    each = segments.select("seg", "core", F.posexplode(core).alias("at", "term")).withColumn("at", F.col("at") + F.col("core"))
    counts = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("seg").orderBy("n", "at")
    two = ranked.withColumn("k", F.row_number().over(order)).where("k <= 2")
    pick = lambda name, k: F.max(F.when(F.col("k") == k, F.col(name))).alias(f"{name}{k}")
    return two.groupBy("seg").agg(*[pick(c, k) for k in (1, 2) for c in ("term", "at")])


def _candidates(index: Index, probes: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, body, seg, base (place of the segment's first word, were it there): lists of the two rarest words, intersected."""
    first = index.postings.join(probes.withColumnRenamed("term1", "term"), "term")
    first = first.select("doc", "body", "seg", (F.col("place") - F.col("at1")).alias("base"), "term2", "at2")
    first = scratch.settle(first, "first")
    single = first.where("term2 is null").select("doc", "body", "seg", "base")
    seconds = probes.where("term2 is not null").select(F.col("term2").alias("term")).distinct()
    second = index.postings.join(seconds, "term", "left_semi").withColumnRenamed("term", "term2")
    both = first.where("term2 is not null").withColumn("place", F.col("base") + F.col("at2"))
    both = both.join(second, ["doc", "body", "place", "term2"], "left_semi").select("doc", "body", "seg", "base")
    return scratch.settle(single.unionByName(both).distinct(), "candidates")


def _first_gap(marks: Column, otherwise: Column) -> Column:
    at = F.instr(marks, "0")
    return F.when(at == 0, otherwise).otherwise(at - 1)


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """All ``rows`` whose (doc, body) is in ``wanted``, and few others."""
    code = F.xxhash64("doc", "body")
    lane, bit = F.pmod(code, F.lit(LANES)), F.shiftright(code, 40).bitwiseAND(F.lit(63)).cast("int")
    marks = wanted.select(lane.alias("lane"), F.expr("1L").alias("one"), bit.alias("bit")).selectExpr("lane", "shiftleft(one, bit) AS mark")
    lanes = marks.groupBy("lane").agg(F.bit_or("mark").alias("marks"))
    met = rows.withColumn("lane", lane).withColumn("bit", bit).join(F.broadcast(lanes), "lane")
    return met.where(F.expr("getbit(marks, bit) = 1")).select(*rows.columns)


def phrase_spans(docs: DataFrame, index: Index, segments: DataFrame, margin: int, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, body, seg, low, high: stretches [low, high) of a document's words in which windows of the segment stand.

    ``margin`` is at least the number of words of a segment.
    """
    probes = scratch.settle(_rarest(segments, index), "probes")
    found = _candidates(index, probes, scratch)
    hit = scratch.settle(found.select("doc", "body").distinct(), "hit")
    texts = _likely(_keyed(docs, key, text), hit).join(hit, ["doc", "body"], "left_semi").select("doc", "body", _slots("text").alias("slots"))
    # A block holds the words of its candidates' cores and, on both sides, as many as a segment can have.
    many, slots = F.size("slots"), F.col("slots")
    side = lambda b: F.slice(slots, F.greatest(b * BLOCK - margin, F.lit(0)) + 1, F.lit(BLOCK + 2 * margin))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(many / BLOCK).cast("int")), lambda b: F.struct(b.alias("block"), side(b).alias("slots")))
    blocks = texts.select("doc", "body", F.explode(blocks).alias("b")).select("doc", "body", "b.block", "b.slots")
    place = F.floor((F.col("base") + F.col("core")) / BLOCK).cast("int")
    met = found.join(segments, "seg").withColumn("block", place).join(blocks, ["doc", "body", "block"])
    shift = F.col("base") - F.greatest(F.col("block") * BLOCK - margin, F.lit(0))
    same = F.transform("words", lambda w, i: F.when(F.get("slots", shift + i) == w, "1").otherwise("0"))
    met = met.select("doc", "body", "seg", "base", "core", "width", F.size("words").alias("n"), F.array_join(same, "").alias("same"))
    right = F.col("core") + _first_gap(F.substr("same", F.col("core") + 1), F.col("n") - F.col("core"))
    left = F.col("core") - _first_gap(F.reverse(F.substr("same", F.lit(1), F.col("core"))), F.col("core"))
    met = met.select("doc", "body", "seg", "width", "base", left.alias("left"), right.alias("right"))
    met = met.where("right - left >= width").select("doc", "body", "seg", (F.col("base") + F.col("left")).alias("low"), (F.col("base") + F.col("right")).alias("high"))
    return scratch.settle(met.distinct(), "spans")


def phrase_matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_id (string), low, high: every stretch of a document's words, counted from 0, in which windows of an item stand.

    A window is ``width`` consecutive words of an item, all words of a shorter one. Rows that repeat an id are told apart
    by their texts; texts without words, null or empty, match nothing. Empty tables give an empty result.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    spans, holders, _ = _search(docs, items, width, scratch, key, text, item_key, item_text)
    low, high = (F.col(c).cast("long") - 1 for c in ("low", "high"))
    return spans.join(holders, "seg").select(F.nullif("doc", F.lit(NO_ID)).alias(key), "item_id", low.alias("low"), high.alias("high")).distinct()


def _search(docs, items, width, scratch, key, text, item_key, item_text):
    cut = scratch.settle(_item_words(items, item_key, item_text), "items")
    segments, holders = _segments(cut, width, scratch)
    index = build_index(docs, cut.select(F.explode("words").alias("term")).distinct(), scratch, key, text)
    return phrase_spans(docs, index, segments, width + RUN, scratch, key, text), holders, index


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated: a row per row of ``docs``.

    Words are runs of a-z (A-Z folded), 0-9 and characters beyond ASCII. ``n_hit`` counts the words inside any occurrence
    of a window of ``width`` item words (an item of fewer words is one window), ``n_items`` the different ids of items
    with such windows; the digest is of these ids as text, sorted, joined by commas. Items without id make hits but are
    not counted. Null and empty texts have no words; repeated rows get equal results, and rows that share an id but not
    the text their own; a very long text is one row like any other. Other columns are ignored; without items nothing is hit.
    """
    scratch = Scratch(docs.sparkSession, "contamination")
    spans, holders, index = _search(docs, items, width, scratch, key, text, item_key, item_text)
    before = Window.partitionBy("doc", "body").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.select("doc", "body", "low", "high").distinct().withColumn("reach", F.max("high").over(before))
    fresh = F.greatest(F.lit(0), F.col("high") - F.greatest("low", F.coalesce("reach", F.lit(0))))
    hits = reach.groupBy("doc", "body").agg(F.sum(fresh).cast("long").alias("n_hit"))
    named = spans.select("doc", "body", "seg").distinct().join(holders.where("item_id is not null"), "seg").select("doc", "body", "item_id").distinct()
    names = named.groupBy("doc", "body").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items"))
    hits = scratch.settle(hits.join(names, ["doc", "body"], "left"), "hits")
    out = index.sizes.join(hits, ["doc", "body"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.nullif("doc", F.lit(NO_ID)).alias(key),
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, items: DataFrame, within: int, width: int = WIDTH, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item_id (string): documents in which all different words of a window stand, in any order, within ``within`` words.

    Places of the window's rarest word come from its list; the other words' lists are joined to them and keep what is
    nearer than ``within``, at most two rows a place. Each stretch that begins at such a row is then tested.
    """
    scratch = Scratch(docs.sparkSession, "proximity")
    cut = scratch.settle(_item_words(items, item_key, item_text), "items")
    n = F.size("words")
    starts = cut.withColumn("width", F.least(n, F.lit(width)))
    starts = starts.withColumn("low", F.explode(F.sequence(F.lit(0), n - F.col("width"))))
    sets = F.array_sort(F.array_distinct(F.slice("words", F.col("low") + 1, F.col("width"))))
    holders = scratch.settle(starts.select("item_id", sets.alias("terms")).distinct(), "sets")
    windows = scratch.settle(holders.select("terms").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    index = build_index(docs, cut.select(F.explode("words").alias("term")).distinct(), scratch, key, text)
    counts = index.postings.groupBy("term").agg(F.count("*").alias("n"))
    each = windows.select("win", F.size("terms").alias("size"), F.explode("terms").alias("term")).join(counts, "term", "left")
    each = scratch.settle(each.withColumn("n", F.coalesce("n", F.lit(0))), "each")
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("win").orderBy("n", "term"))).where("k = 1")
    seeds = index.postings.join(first.select("win", "size", "term"), "term").select("doc", "body", "win", "size", F.col("place").alias("seed")).distinct()
    wanted = seeds.join(each.select("win", "term"), "win")
    near = wanted.join(index.postings, ["doc", "body", "term"]).where(F.abs(F.col("place") - F.col("seed")) < within)
    found = near.groupBy("doc", "body", "win", "size", "seed").agg(F.collect_set(F.struct("place", "term")).alias("near"))
    inside = lambda s: F.filter("near", lambda x: (x["place"] >= s["place"]) & (x["place"] < s["place"] + within))
    complete = F.exists("near", lambda s: (s["place"] <= F.col("seed")) & (F.size(F.array_distinct(F.transform(inside(s), lambda x: x["term"]))) == F.col("size")))
    found = found.where(complete).select("doc", "body", "win").distinct()
    named = found.join(windows, "win").join(holders, "terms")
    return named.select(F.nullif("doc", F.lit(NO_ID)).alias(key), "item_id").distinct()
