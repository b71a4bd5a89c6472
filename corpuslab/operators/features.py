"""Feature building on top of pyspark.ml and plain DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import HashingTF, IDF, Normalizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.arrays import elements
from corpuslab.functions.text import hash_bucket
from corpuslab.functions.vectors import sparse_vector
from corpuslab.operators.ordering import with_row_index
from corpuslab.session import materialize

# More classes than this are no classification, but an id column by mistake.
MAX_CLASSES = 1000


def classes_of(rows: DataFrame, label: str) -> list:
    """Sorted distinct labels on the driver, after their number was checked."""
    found = rows.where(F.col(label).isNotNull()).select(label).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} distinct values")
    return sorted(row[0] for row in found)


def label_index(rows: DataFrame, label: str) -> DataFrame:
    """label, idx: sorted distinct labels numbered from 0; any number of them, none on the driver."""
    distinct = rows.where(F.col(label).isNotNull()).select(label).distinct()
    return with_row_index(distinct, F.asc(label)).withColumn("idx", F.col("idx").cast("int"))


def with_label(rows: DataFrame, label: str, name: str = "label") -> DataFrame:
    """Add the class number as a double, taken from the label index."""
    return rows.join(label_index(rows, label), label).withColumn(name, F.col("idx").cast("double")).drop("idx")


def frequency_index(rows: DataFrame, category: str, out: str, encoded: str | None = None) -> DataFrame:
    """Category numbers by falling frequency, and optionally their one-hot vector."""
    indexed = StringIndexer(inputCol=category, outputCol=out, stringOrderType="frequencyDesc").fit(rows).transform(rows)
    if encoded is None:
        return indexed
    return OneHotEncoder(inputCol=out, outputCol=encoded).fit(indexed).transform(indexed)


def one_hot(rows: DataFrame, category: str) -> DataFrame:
    """category, vec: one 0/1 array per distinct category, in sorted order."""
    index = label_index(rows, category)
    k = index.count()
    vec = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == F.col("idx"), 1.0).otherwise(0.0))
    return index.select(category, vec.alias("vec"))


def indicator_columns(rows: DataFrame, label: str, *keep: str) -> DataFrame:
    """One 0/1 column per class beside ``keep``: built in the row, no join and no pivot shuffle."""
    flags = [(F.col(label) == c).cast("int").alias(f"is_{c}") for c in classes_of(rows, label)]
    return rows.select(*keep, *flags)


def assemble(rows: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(rows)


def hashed_counts(corpus: DataFrame, num_features: int = 1 << 20, tokens: str = "tokens", out: str = "tf") -> DataFrame:
    return HashingTF(inputCol=tokens, outputCol=out, numFeatures=num_features).transform(corpus)


def hashed_tfidf(
    corpus: DataFrame, num_features: int = 1 << 20, min_doc_freq: int = 0, tokens: str = "tokens", out: str = "features"
) -> DataFrame:
    """Hashed counts times ln((N + 1) / (df + 1)); stays sparse throughout."""
    counted = hashed_counts(corpus, num_features, tokens, "_tf")
    model = IDF(inputCol="_tf", outputCol=out, minDocFreq=min_doc_freq).fit(counted)
    return model.transform(counted).drop("_tf")


def hashed_unit(corpus: DataFrame, num_features: int = 1 << 16, tokens: str = "tokens", out: str = "features") -> DataFrame:
    """Hashed counts scaled to length 1."""
    return Normalizer(p=2.0, inputCol="_tf", outputCol=out).transform(
        hashed_counts(corpus, num_features, tokens, "_tf")
    ).drop("_tf")


def hash_terms(terms: DataFrame, num_features: int = 1 << 20) -> DataFrame:
    """term, idx: the feature each term hashes to (terms that collide share one)."""
    single = hashed_counts(terms.withColumn("_t", F.array("term")), num_features, "_t", "_v")
    # to_json exposes the one index of the sparse vector without densifying it.
    body = F.from_json(F.to_json(F.struct(F.col("_v").alias("v"))), "v struct<indices: array<int>>")
    return single.select("term", F.get(body["v"]["indices"], F.lit(0)).alias("idx"))


def terms_by_hash(terms: DataFrame, num_features: int = 1 << 20) -> DataFrame:
    """idx, terms: for each hashed feature the sorted terms that share it."""
    return hash_terms(terms, num_features).groupBy("idx").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def count_vectors(triplets: DataFrame, size: Column | int, doc: str, *keep: str, value: str = "tf", out: str = "features"):
    """One sparse vector per document out of (doc, term_id, value) rows.

    The vocabulary is never gathered: vectors are built from ids alone. A group
    is one document's distinct terms.
    """
    cells = F.sort_array(F.collect_list(F.struct("term_id", F.col(value).cast("double").alias("v"))))
    rows = triplets.groupBy(doc, *keep).agg(cells.alias("_c"))
    vec = sparse_vector(size, F.col("_c")["term_id"], F.col("_c")["v"])
    return rows.select(doc, *keep, vec.alias(out))


def class_term_counts(corpus: DataFrame, label: str, classes: Sequence, tokens: str = "tokens") -> DataFrame:
    """term, counts[class]: one row per term, all classes counted in one map-side aggregated pass."""
    terms = corpus.select(label, F.explode(elements(tokens)).alias("term"))
    sums = F.array(*[F.count_if(F.col(label) == c) for c in classes])
    return terms.groupBy("term").agg(sums.alias("counts"))


def chi2(corpus: DataFrame, label: str, tokens: str = "tokens") -> DataFrame:
    """term, chi2 of term counts against the class shares of documents."""
    classes = classes_of(corpus, label)
    share = corpus.agg(
        F.array(*[F.count_if(F.col(label) == c) / F.count("*").cast("double") for c in classes]).alias("s")
    ).scalar()
    counts = class_term_counts(corpus, label, classes, tokens)
    # The subquery becomes a column first: lambdas may not contain one.
    counts = counts.select(
        "term", "counts", share.alias("_s"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("_n")
    )
    parts = F.zip_with(
        "counts", "_s", lambda o, s: (o - s * F.col("_n")) * (o - s * F.col("_n")) / (s * F.col("_n"))
    )
    return counts.select("term", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("chi2"))


def presence_test(corpus: DataFrame, doc: str, label: str, tokens: str = "tokens") -> DataFrame:
    """term, statistic: the library's chi-squared test of a term's presence against the label, in its order of additions.

    A document is one (doc, label) with tokens; rows that repeat it add their terms to it, each once (the library refuses
    such vectors). Terms are counted per label before they meet, so a term is a row with its labels and no vectors are
    built. A term that no document lacks, or a single label, gives 0. Only the documents per label, one row, are sent to the
    tasks.
    """
    held = materialize(corpus.select(doc, label, F.array_compact(F.array_distinct(tokens)).alias("_t")).where(F.size("_t") > 0), "held_terms")
    keys = held.groupBy(doc, label).agg(F.count("*").alias("_rows"))
    docs = keys.groupBy(label).agg(F.count("*").cast("double").alias("n"))
    docs = docs.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "n"))).alias("_docs"))
    again = materialize(keys.where("_rows > 1").select(F.col(doc).alias("_doc"), F.col(label).alias("_label")), "repeated")
    cells = held.select(doc, label, F.explode("_t").alias("term"))
    if not again.isEmpty():
        same = held[doc].eqNullSafe(again["_doc"]) & held[label].eqNullSafe(again["_label"])
        merged = held.join(again, same, "left_semi").select(doc, label, F.explode("_t").alias("term")).distinct()
        cells = held.join(again, same, "left_anti").select(doc, label, F.explode("_t").alias("term")).unionByName(merged)
    counts = cells.groupBy("term", label).agg(F.count("*").cast("double").alias("n"))
    by_term = counts.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("_has")).crossJoin(F.broadcast(docs))
    has = lambda d: F.coalesce(F.try_element_at("_has", d["label"]), F.lit(0.0))
    cells = F.transform("_docs", lambda d: F.struct(has(d).alias("one"), (d["n"] - has(d)).alias("none")))
    total = lambda cells, name: F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + c[name])
    by_term = by_term.select("term", cells.alias("_c"))
    by_term = by_term.select("term", "_c", total("_c", "one").alias("_one"), total("_c", "none").alias("_none"))

    def part(cell: Column, name: str) -> Column:
        expected = (cell["one"] + cell["none"]) * F.col(f"_{name}") / (F.col("_one") + F.col("_none"))
        return (cell[name] - expected) * (cell[name] - expected) / expected

    sums = F.aggregate("_c", F.lit(0.0), lambda acc, c: acc + part(c, "none") + part(c, "one"))
    return by_term.select("term", F.when((F.col("_none") > 0) & (F.size("_c") > 1), sums).otherwise(0.0).alias("statistic"))


def split_by_hash(rows: DataFrame, doc: str, train_percent: int) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a stable hash of the id."""
    bucket = hash_bucket(doc)
    return rows.where(bucket < train_percent), rows.where(bucket >= train_percent)


def split_at_random(rows: DataFrame, shares: Sequence[float], seed: int) -> list[DataFrame]:
    return rows.randomSplit(list(shares), seed=seed)
