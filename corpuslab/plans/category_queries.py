"""Metadata joins, category counts and sets, labels and encodings, splits, ratings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpuslab.functions import text
from corpuslab.operators import categories, features, ratings, terms
from corpuslab.plans.registry import query
from corpuslab.plans.tables import BUCKET, DOCS, RATINGS, TF, cohort, corpus, rating_rows, table


@query(
    "metadata_join",
    "SELECT doc_id, lang, source, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def metadata_join(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return categories.attach(rows, table(spark, folder, "labels"))


@query("metadata_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def metadata_missing(spark, folder):
    return categories.missing_metadata(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"))


@query(
    "index_join_cohort",
    f"WITH {DOCS} SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_total FROM docs WHERE doc_id % 3 + 2013 = 2014",
)
def index_join_cohort(spark, folder):
    chosen = table(spark, folder, "documents").select("doc_id").where(cohort() == 2014)
    joined = corpus(spark, folder).join(chosen, "doc_id")
    return joined.select("doc_id", F.size("tokens").cast("long").alias("n_total"))


@query("category_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def category_counts(spark, folder):
    return categories.category_counts(table(spark, folder, "documents"), "lang", "source")


@query(
    "category_year",
    "SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderpriority AS area, count(*) AS n FROM orders GROUP BY 1, 2",
)
def category_year(spark, folder):
    rows = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("area"))
    return categories.category_counts(rows, "year", "area")


# Each year has the document sources of some of its ids: 20 sources minus those a year's rule leaves out.
_YEAR_AREAS = (
    "ya AS (SELECT CAST(doc_id % 3 + 2013 AS INT) AS year, source AS area FROM documents WHERE NOT"
    " ((doc_id % 3 = 0 AND source IN ('src1', 'src2')) OR (doc_id % 3 = 2 AND source = 'src5')))"
)


def year_areas(spark, folder):
    rows = table(spark, folder, "documents").select(cohort().alias("year"), F.col("source").alias("area"))
    left_out = ((F.col("year") == 2013) & F.col("area").isin("src1", "src2")) | ((F.col("year") == 2015) & (F.col("area") == "src5"))
    return rows.where(~left_out)


@query(
    "year_sets",
    f"WITH {_YEAR_AREAS} SELECT year, array_to_string(list_sort(list_distinct(list(area))), ',') AS areas FROM ya GROUP BY year",
)
def year_sets(spark, folder):
    found = categories.category_sets(year_areas(spark, folder), "year", "area")
    return found.select("year", F.array_join("areas", ",").alias("areas"))


@query(
    "year_set_diff",
    f"WITH {_YEAR_AREAS}, d AS (SELECT DISTINCT year, area FROM ya)"
    " SELECT year, area, 'added' AS change FROM d a WHERE year > 2013 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.year = a.year - 1 AND b.area = a.area)"
    " UNION ALL SELECT CAST(year + 1 AS INT), area, 'removed' FROM d a WHERE year < 2015 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.year = a.year + 1 AND b.area = a.area)",
)
def year_set_diff(spark, folder):
    return categories.category_changes(year_areas(spark, folder), "year", "area")


@query(
    "composition_grouping",
    "WITH j AS (SELECT lang, source, CAST(quality AS VARCHAR) AS quality, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'NONE' END AS toxic FROM documents JOIN labels USING (doc_id)),"
    " c AS (SELECT lang, 'source' AS kind, source AS value, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT lang, 'quality', quality, count(*) FROM j GROUP BY ALL"
    " UNION ALL SELECT lang, 'toxic', toxic, count(*) FROM j GROUP BY ALL)"
    " SELECT lang, kind, string_agg(value || ' - ' || n, ', ' ORDER BY n DESC, value) AS summary FROM c GROUP BY lang, kind",
)
def composition_grouping(spark, folder):
    meta = table(spark, folder, "labels")
    rows = table(spark, folder, "documents").select("doc_id", "lang", "source").join(meta, "doc_id")
    rows = rows.withColumn("toxic", F.when(F.col("toxic") == 1, "toxic").otherwise("NONE"))
    counts = categories.composition(rows, "lang", ["source", "quality", "toxic"])
    return categories.composition_text(counts, "lang")


@query(
    "class_share",
    "SELECT lang, count(*) FILTER (WHERE quality = 1) AS n_match, count(*) AS n_total,"
    " round(count(*) FILTER (WHERE quality = 1) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM documents JOIN labels USING (doc_id) GROUP BY lang",
)
def class_share(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id")
    return categories.share(rows, "lang", F.col("quality") == 1).withColumn("ratio", F.round("ratio", 6))


@query("binary_label", "SELECT doc_id, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM documents")
def binary_label(spark, folder):
    return table(spark, folder, "documents").select("doc_id", (F.col("lang") == "en").cast("double").alias("label"))


@query(
    "label_index",
    "SELECT doc_id, source, CAST(dense_rank() OVER (ORDER BY source) - 1 AS DOUBLE) AS label FROM documents",
)
def label_index(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source")
    return features.with_label(rows, "source")


@query(
    "one_hot",
    "WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type), r AS (SELECT p_type, row_number() OVER (ORDER BY n DESC, p_type) - 1 AS i, count(*) OVER () AS k FROM c)"
    " SELECT p_partkey, CAST(i AS DOUBLE) AS idx, array_to_string(list_transform(range(k - 1), lambda x: CASE WHEN x = i THEN 1 ELSE 0 END), ',') AS vec FROM part JOIN r USING (p_type)",
)
def one_hot(spark, folder):
    rows = table(spark, folder, "part").select("p_partkey", "p_type")
    encoded = features.frequency_index(rows, "p_type", "idx", "vec")
    flat = F.array_join(vector_to_array("vec").cast("array<int>").cast("array<string>"), ",")
    return encoded.select("p_partkey", "idx", flat.alias("vec"))


@query(
    "one_hot_plain",
    "WITH r AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT p_type FROM part))"
    " SELECT p_type, array_to_string(list_transform(range(k), lambda x: CASE WHEN x = i THEN 1 ELSE 0 END), ',') AS vec FROM r",
)
def one_hot_plain(spark, folder):
    found = features.one_hot(table(spark, folder, "part").select("p_type"), "p_type")
    return found.select("p_type", F.array_join(F.col("vec").cast("array<int>").cast("array<string>"), ",").alias("vec"))


@query(
    "indicator_matrix",
    "SELECT doc_id, CAST(lang = 'de' AS INT) AS is_de, CAST(lang = 'en' AS INT) AS is_en, CAST(lang = 'es' AS INT) AS is_es, CAST(lang = 'fr' AS INT) AS is_fr FROM documents",
)
def indicator_matrix(spark, folder):
    return features.indicator_columns(table(spark, folder, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(
    "assembled_vector",
    "SELECT p_partkey, CAST(p_size AS DOUBLE) AS f0, p_retailprice AS f1, CASE WHEN p_type = 'ECONOMY' THEN 1.0 ELSE 0.0 END::DOUBLE AS f2 FROM part",
)
def assembled_vector(spark, folder):
    rows = table(spark, folder, "part").withColumn("economy", (F.col("p_type") == "ECONOMY").cast("double"))
    merged = features.assemble(rows, ["p_size", "p_retailprice", "economy"])
    flat = merged.select("p_partkey", vector_to_array("features").alias("v"))
    return flat.select("p_partkey", *[F.get("v", F.lit(i)).alias(f"f{i}") for i in range(3)])


@query(
    "hash_split",
    f"SELECT CASE WHEN {BUCKET} < 70 THEN 'train' WHEN {BUCKET} < 95 THEN 'test' ELSE 'eval' END AS part, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY 1",
)
def hash_split(spark, folder):
    bucket = text.hash_bucket("doc_id")
    part = F.when(bucket < 70, "train").when(bucket < 95, "test").otherwise("eval")
    rows = table(spark, folder, "documents").select("doc_id", part.alias("part"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "random_split",
    "SELECT count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents",
)
def random_split(spark, folder):
    """The parts of a random split, put together again, are the whole table."""
    parts = features.split_at_random(table(spark, folder, "documents").select("doc_id"), [0.6, 0.4], 11)
    return parts[0].unionByName(parts[1]).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "name_lookup",
    f"WITH {TF}, top AS (SELECT term, count(*) AS df FROM tf GROUP BY term ORDER BY df DESC, term LIMIT 100), idx AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM top)"
    " SELECT doc_id, source, term, tf FROM tf JOIN idx USING (term) JOIN documents USING (doc_id)",
)
def name_lookup(spark, folder):
    rows = corpus(spark, folder)
    top = terms.term_index(terms.top_terms(terms.document_frequencies(rows), 100).select("term"))
    by_id = terms.count_triplets(rows, top, "doc_id")
    names = table(spark, folder, "documents").select("doc_id", "source")
    return by_id.join(top, "term_id").join(names, "doc_id").select("doc_id", "source", "term", "tf")


@query(
    "pair_join",
    f"WITH {RATINGS}, p AS (SELECT CAST(o_custkey AS INT) AS usr, CAST(l_partkey AS INT) AS item, max(l_quantity) AS prediction FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
    " SELECT usr AS user, item, prediction, round(rating, 6) AS rating FROM p JOIN ratings USING (usr, item)".replace("AS user", 'AS "user"'),
)
def pair_join(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    best = joined.groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item"))
    predicted = best.agg(F.max("l_quantity").alias("prediction"))
    return ratings.predicted_and_actual(predicted, rating_rows(spark, folder)).withColumn("rating", F.round("rating", 6))


@query("rating_lists", f'WITH {RATINGS} SELECT DISTINCT usr AS "user", item FROM ratings WHERE rating - 2.5 > 0')
def rating_lists(spark, folder):
    moved = ratings.scaled(rating_rows(spark, folder), -2.5).select("user", "item", F.col("shifted").alias("rating"))
    return ratings.relevant_items(moved)


@query(
    "rating_stats",
    f"WITH {RATINGS} SELECT count(*) AS n_ratings, count(DISTINCT usr) AS n_users, count(DISTINCT item) AS n_items, round(avg(rating), 6) AS mean_rating FROM ratings",
)
def rating_stats(spark, folder):
    return ratings.summary(rating_rows(spark, folder)).withColumn("mean_rating", F.round("mean_rating", 6))


@query(
    "rating_scale",
    f'WITH {RATINGS} SELECT usr AS "user", item, round(rating - 2.5, 6) AS shifted, CASE WHEN rating - 2.5 > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS liked,'
    " round(greatest(least(rating - 2.5, 1.0), 0.0), 6) AS clipped FROM ratings",
)
def rating_scale(spark, folder):
    found = ratings.scaled(rating_rows(spark, folder), -2.5)
    return found.select("user", "item", F.round("shifted", 6).alias("shifted"), "liked", F.round("clipped", 6).alias("clipped"))
