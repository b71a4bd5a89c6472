"""Text rules as Column expressions.

Array rules work inside one row, so cleaning a corpus needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.arrays import let
from corpuslab.functions.words import COUNTERS

# Fixed value: characters a word may consist of after upper-casing.
WORD_CHARS = "가-힣ㄱ-ㅎㅏ-ㅣA-Z0-9"
_COUNTER = "|".join(dict.fromkeys(COUNTERS))
NUMBER_TOKEN = f"^[0-9]+({_COUNTER})?$"
COUNTER_TOKEN = f"^[0-9]+({_COUNTER})$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Drop spaces, tabs, line breaks and control characters at both ends."""
    return F.regexp_replace(_col(c), "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


def normalize(c: Column | str, upper: bool = True) -> Column:
    """Upper-case and turn every character that is no word character into a space.

    Runs of spaces are kept. ``upper=False`` leaves the case alone.
    """
    c = _col(c)
    if upper:
        return F.regexp_replace(F.upper(c), f"[^{WORD_CHARS}]", " ")
    return F.regexp_replace(c, f"[^{WORD_CHARS}a-z]", " ")


def tokenize(c: Column | str, min_length: int = 2) -> Column:
    """Words of the normalised text with at least ``min_length`` characters.

    Equal to normalising, splitting at spaces and filtering by length, in one
    pass of one regular expression.
    """
    return F.regexp_extract_all(F.upper(_col(c)), F.lit(f"[{WORD_CHARS}]{{{min_length},}}"), F.lit(0))


def is_counter(c: Column | str) -> Column:
    """True for a number followed by exactly one counter word."""
    return _col(c).rlike(COUNTER_TOKEN)


def drop_numbers(tokens: Column | str) -> Column:
    """Drop all-digit tokens and number-plus-counter tokens."""
    return F.filter(_col(tokens), lambda t: ~t.rlike(NUMBER_TOKEN))


def content_tokens(c: Column | str) -> Column:
    """Tokenise and drop numbers: the default token list of a document.

    Equal to ``drop_numbers(tokenize(c))``. The look-ahead refuses number tokens
    while matching, which keeps the expression inside generated code.
    """
    not_number = f"(?![0-9]+(?:{_COUNTER})?(?![{WORD_CHARS}]))"
    pattern = f"{not_number}(?<![{WORD_CHARS}])[{WORD_CHARS}]{{2,}}"
    return F.regexp_extract_all(F.upper(_col(c)), F.lit(pattern), F.lit(0))


def translate_tokens(tokens: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace whole tokens by their translation.

    The membership test is a hash-set lookup; the map is read only on a hit.
    """
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    keys = list(mapping)
    return F.transform(_col(tokens), lambda t: F.when(t.isin(keys), F.element_at(pairs, t)).otherwise(t))


def drop_stop_words(tokens: Column | str, stop_words: Sequence[str]) -> Column:
    """Drop stop words and empty tokens."""
    words = list(dict.fromkeys(stop_words))
    return F.filter(_col(tokens), lambda t: ~t.isin(words) & (F.length(t) > 0))


def append_title(tokens: Column | str, title: Column | str) -> Column:
    """Body tokens followed by the words of the normalised title.

    Title words skip the length and number rules.
    """
    return F.concat(_col(tokens), F.filter(F.split(normalize(title), " "), lambda t: t != ""))


def first_line(c: Column | str) -> Column:
    """Text up to the first line break."""
    return F.substring_index(_col(c), "\n", 1)


def plain_words(c: Column | str, min_length: int = 4) -> Column:
    """Lower-case words made of letters only, split at white space."""
    pattern = f"^\\p{{L}}{{{min_length},}}$"
    return F.filter(F.split(F.lower(_col(c)), "\\s"), lambda t: t.rlike(pattern))


def words_in(c: Column | str) -> Column:
    """Words, numbers and single punctuation marks, in order."""
    return F.regexp_extract_all(_col(c), F.lit("[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]"), F.lit(0))


def strip_codes(c: Column | str) -> Column:
    """Delete digits, parentheses, hyphens, slashes and colons."""
    return F.regexp_replace(_col(c), "[()0-9\\-/:]", "")


def clean_areas(c: Column | str, stop_areas: Sequence[str] = ()) -> Column:
    """Distinct area names: drop codes, split at ``/``, drop empty and stop names."""
    c = _col(c)
    parts = F.split(F.regexp_replace(c, "[\\-()0-9]", ""), "/")
    kept = F.array_distinct(F.filter(parts, lambda t: F.length(t) > 0))
    return F.when(c.isin(list(stop_areas)), F.array().cast("array<string>")).otherwise(kept) if stop_areas else kept


def program_fields(*columns: Column | str) -> Column:
    """One comma-joined list out of comma lists, without leading numeric codes."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(_col(c), F.lit("")), ",") for c in columns]))
    named = F.transform(parts, lambda p: strip(F.regexp_replace(p, "^[0-9]\\S*", "")))
    return F.array_join(F.filter(named, lambda p: F.length(p) > 0), ",")


def year_of(doc_id: Column | str) -> Column:
    """The year a document id begins with."""
    return F.substring(_col(doc_id), 1, 4).cast("int")


def document_path(doc_id: Column | str, folders: Mapping[int, str], default: str) -> Column:
    """Path of a document's text file: one folder per year."""
    year = year_of(doc_id)
    folder = F.lit(default)
    for key, value in folders.items():
        folder = F.when(year == key, F.lit(value)).otherwise(folder)
    return F.concat(folder, _col(doc_id), F.lit(".txt"))


def first_or_none(values: Column | str) -> Column:
    """First array element, or NONE for an empty array."""
    return F.coalesce(F.get(_col(values), F.lit(0)), F.lit("NONE"))


def trim_trailing_empty(values: Column | str) -> Column:
    """Drop empty strings at the end of an array, as Java's split does."""
    values = _col(values)
    joined = F.regexp_replace(F.array_join(values, "\u0000"), "\u0000+$", "")
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\u0000"))


def key_values(c: Column | str) -> Column:
    """Entries of a ``Key : value`` text with continuation lines.

    A line with a colon starts an entry; later lines without one continue its
    value, joined by spaces. The split point is found by a look-ahead, so one
    text is parsed inside its row. Line breaks at the end of the text do not
    count. Entries without a key are dropped unless
    they are the last one.
    """
    chunks = F.split(F.regexp_replace(_col(c), "\n+$", ""), "\n(?=[^\n]*:)")

    def entry(chunk: Column, i: Column) -> Column:
        lines = F.split(chunk, "\n")
        head = F.get(lines, F.lit(0))
        has_key = head.contains(":")
        key = F.when(has_key, strip(F.substring_index(head, ":", 1))).otherwise(F.lit(""))
        first = F.when(has_key, F.regexp_replace(head, "^[^:]*:", "")).otherwise(head)
        rest = F.slice(lines, F.lit(2), F.size(lines))
        # Nothing right after the colon adds no part; blank lines do.
        parts = F.concat(F.when(has_key & (first == ""), F.array().cast("array<string>")).otherwise(F.array(first)), rest)
        value = F.array_join(F.transform(parts, lambda line: strip(line)), " ")
        return F.struct(i.alias("pos"), key.alias("key"), value.alias("value"))

    def keep(entries: Column) -> Column:
        last = F.size(entries) - 1
        return let(last, lambda n: F.filter(entries, lambda e: (e["key"] != "") | (e["pos"] == n)))

    return let(F.transform(chunks, entry), keep)


def clip(c: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Limit a number to a range."""
    return F.greatest(F.least(_col(c), F.lit(high)), F.lit(low))


def binarize(c: Column | str, threshold: float = 0.0) -> Column:
    """1.0 above the threshold, else 0.0."""
    return (_col(c) > threshold).cast("double")


def hash_bucket(doc_id: Column | str, buckets: int = 100) -> Column:
    """A stable bucket number from the id's MD5, the same on every engine."""
    digits = F.substring(F.md5(_col(doc_id).cast("string")), 1, 4)
    return (F.conv(digits, 16, 10).cast("int") % buckets).cast("int")
