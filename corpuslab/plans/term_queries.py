"""Term statistics, vocabularies, weights, and corpus exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions.words import STOP_WORDS
from corpuslab.operators import explore, features, terms
from corpuslab.plans.registry import query
from corpuslab.plans.tables import DF, DOCS, TF, TOK, corpus, table
from corpuslab.plans.text_queries import sql_list


@query("term_freq_corpus", f"WITH {TOK} SELECT term, count(*) AS cf FROM tok GROUP BY term ORDER BY cf, term")
def term_freq_corpus(spark, folder):
    return terms.collection_frequencies(corpus(spark, folder)).orderBy("cf", "term")


@query(
    "collection_freq",
    f"WITH {TOK}, n AS (SELECT count(*) AS n FROM documents), cf AS (SELECT term, count(*) AS cf FROM tok GROUP BY term)"
    " SELECT term, cf, round(ln(CAST(n AS DOUBLE) / cf), 6) AS idf FROM cf, n",
)
def collection_freq(spark, folder):
    rows = corpus(spark, folder)
    n = terms.number_of(rows)
    found = terms.collection_frequencies(rows)
    return found.select("term", "cf", F.round(F.log(n / F.col("cf").cast("double")), 6).alias("idf"))


@query("doc_freq", f"WITH {DF} SELECT term, df FROM df")
def doc_freq(spark, folder):
    return terms.document_frequencies(corpus(spark, folder))


@query("area_term_df", f"WITH {TF} SELECT lang, term, count(*) AS n_docs FROM tf GROUP BY lang, term")
def area_term_df(spark, folder):
    return terms.area_document_frequencies(corpus(spark, folder, "lang"), "lang")


@query(
    "doc_length_stats",
    f"WITH {DOCS} SELECT doc_id, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_unique, CAST(len(tokens) AS BIGINT) AS n_total FROM docs",
)
def doc_length_stats(spark, folder):
    return terms.document_lengths(corpus(spark, folder), "doc_id")


@query(
    "term_stats",
    f"WITH {TOK} SELECT count(*) AS n_tokens, count(DISTINCT term) AS n_terms, (SELECT count(*) FROM documents) AS n_docs FROM tok",
)
def term_stats(spark, folder):
    return terms.corpus_totals(corpus(spark, folder))


@query("word_count", f"WITH {TOK} SELECT count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok WHERE term = 'TION'")
def word_count(spark, folder):
    return terms.count_of(corpus(spark, folder), "TION")


@query("top_terms_df", f"WITH {DF} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 500")
def top_terms_df(spark, folder):
    return terms.top_terms(terms.document_frequencies(corpus(spark, folder)), 500)


@query(
    "drop_frequent_terms",
    f"WITH {TOK}, cf AS (SELECT term, count(*) AS cf FROM tok GROUP BY term), top AS (SELECT term FROM cf ORDER BY cf DESC, term LIMIT 20),"
    f" kept AS (SELECT * FROM cf WHERE term NOT IN (SELECT term FROM top) AND term NOT IN ({sql_list(STOP_WORDS)}))"
    " SELECT term, cf, row_number() OVER (ORDER BY cf DESC, term) - 1 AS term_id FROM kept",
)
def drop_frequent_terms(spark, folder):
    kept = terms.drop_top_terms(terms.collection_frequencies(corpus(spark, folder)), 20, STOP_WORDS)
    return terms.term_index(kept, F.desc("cf"), F.asc("term"))


@query(
    "top_terms_per_area",
    f"WITH {TF}, a AS (SELECT lang, term, count(*) AS n_docs FROM tf GROUP BY lang, term)"
    " SELECT lang, term, n_docs, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_docs DESC, term) AS INT) AS rank FROM a QUALIFY rank <= 20",
)
def top_terms_per_area(spark, folder):
    found = terms.area_document_frequencies(corpus(spark, folder, "lang"), "lang")
    return terms.top_terms_per_area(found, "lang", 20)


_INDEX = "idx AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM df)"


@query("vocab_index", f"WITH {DF}, {_INDEX} SELECT term, term_id FROM idx")
def vocab_index(spark, folder):
    return terms.term_index(terms.document_frequencies(corpus(spark, folder)).select("term"))


@query("count_triplets", f"WITH {DF}, {_INDEX} SELECT doc_id, term_id, tf FROM tf JOIN idx USING (term)")
def count_triplets(spark, folder):
    rows = corpus(spark, folder)
    index = terms.term_index(terms.document_frequencies(rows))
    return terms.count_triplets(rows, index, "doc_id")


_N = "n AS (SELECT count(*) AS n FROM documents)"


@query(
    "idf_smoothed",
    f"WITH {DF}, {_N} SELECT term, df, round(CASE WHEN df >= 2 THEN ln((n + 1) / CAST(df + 1 AS DOUBLE)) ELSE 0.0 END, 6) AS idf FROM df, n",
)
def idf_smoothed(spark, folder):
    rows = corpus(spark, folder)
    found = terms.smoothed_idf(terms.document_frequencies(rows), terms.number_of(rows), 2)
    return found.withColumn("idf", F.round("idf", 6))


@query(
    "tfidf_explicit",
    f"WITH {DF}, {_N}, top AS (SELECT term, ln(CAST(n AS DOUBLE) / df) AS idf FROM df, n ORDER BY df DESC, term LIMIT 5000),"
    " totals AS (SELECT doc_id, sum(tf) AS total FROM tf GROUP BY doc_id)"
    " SELECT doc_id, term, round(idf * tf / total, 6) AS weight FROM tf JOIN top USING (term) JOIN totals USING (doc_id)",
)
def tfidf_explicit(spark, folder):
    found = terms.tfidf(corpus(spark, folder), "doc_id", 5000)
    return found.withColumn("weight", F.round("weight", 6))


def _unit_sql(tf: str, where: str) -> str:
    return (
        f"WITH {DF}, {_N}, w AS (SELECT doc_id, term, {tf} * (ln((n + 1) / CAST(df + 1 AS DOUBLE)) + 1) AS w FROM tf JOIN df USING (term), n{where})"
        " SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"
    )


@query("tfidf_l2", _unit_sql("tf", ""))
def tfidf_l2(spark, folder):
    return terms.tfidf_unit(corpus(spark, folder), "doc_id").withColumn("weight", F.round("weight", 6))


@query(
    "tfidf_l2_sublinear",
    _unit_sql("(1 + ln(CAST(tf AS DOUBLE)))", f" WHERE df <= 0.5 * n AND term NOT IN ({sql_list(STOP_WORDS)})"),
)
def tfidf_l2_sublinear(spark, folder):
    found = terms.tfidf_unit(corpus(spark, folder), "doc_id", sublinear=True, max_df=0.5, stop_words=STOP_WORDS)
    return found.withColumn("weight", F.round("weight", 6))


@query(
    "tfidf_neighbors",
    _unit_sql("tf", "").replace("SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w", "")
    + ", u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w)"
    " SELECT a.doc_id, round(sum(a.w * b.w), 6) AS score FROM u a JOIN u b ON a.term = b.term AND b.doc_id = 1 GROUP BY a.doc_id ORDER BY 2 DESC, 1 LIMIT 10",
)
def tfidf_neighbors(spark, folder):
    weights = terms.tfidf_unit(corpus(spark, folder), "doc_id")
    return terms.similar_documents(weights, "doc_id", 1, 10).withColumn("score", F.round("score", 6))


@query(
    "chi2_terms",
    f"WITH {TOK}, k AS (SELECT lang, count(*) / CAST((SELECT count(*) FROM documents) AS DOUBLE) AS s FROM documents GROUP BY lang),"
    " obs AS (SELECT lang, term, count(*) AS o FROM tok GROUP BY lang, term), tot AS (SELECT term, sum(o) AS n FROM obs GROUP BY term),"
    " cells AS (SELECT t.term, coalesce(o, 0) AS o, s * n AS e FROM tot t CROSS JOIN k LEFT JOIN obs ON obs.term = t.term AND obs.lang = k.lang),"
    " scored AS (SELECT term, sum((o - e) * (o - e) / e) AS chi2 FROM cells GROUP BY term)"
    " SELECT term, round(chi2, 4) AS chi2 FROM scored ORDER BY round(chi2, 4) DESC, term LIMIT 1000",
)
def chi2_terms(spark, folder):
    scored = features.chi2(corpus(spark, folder, "lang"), "lang").withColumn("chi2", F.round("chi2", 4))
    return terms.top_terms(scored, 1000, "chi2")


@query(
    "concordance",
    f"WITH {DOCS}, pos AS (SELECT doc_id, tokens, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS p FROM docs)"
    " SELECT doc_id, CAST(p - 1 AS BIGINT) AS pos, array_to_string(tokens[greatest(p - 5, 1):p - 1], ' ') AS left, word,"
    " array_to_string(tokens[p + 1:p + 5], ' ') AS right FROM pos WHERE word = 'THE'".replace("AS left", 'AS "left"').replace("AS right", 'AS "right"'),
)
def concordance(spark, folder):
    return explore.concordance(corpus(spark, folder), "doc_id", "THE", 5)


_CONTEXTS = (
    "pos AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS p FROM docs),"
    " ctx AS (SELECT DISTINCT term, coalesce(lag(term) OVER w, '') AS l, coalesce(lead(term) OVER w, '') AS r FROM pos WINDOW w AS (PARTITION BY doc_id ORDER BY p))"
)


@query(
    "similar_words",
    f"WITH {DOCS}, {_CONTEXTS} SELECT a.term, count(*) AS n_shared FROM ctx a JOIN ctx b ON a.l = b.l AND a.r = b.r"
    " WHERE b.term = 'THE' AND a.term <> 'THE' GROUP BY a.term ORDER BY n_shared DESC, a.term LIMIT 20",
)
def similar_words(spark, folder):
    return explore.similar_words(corpus(spark, folder), "THE", 20)


@query(
    "area_tokens",
    f"WITH {DOCS} SELECT doc_id, quality AS area, md5(array_to_string(tokens, ',')) AS digest FROM docs JOIN labels USING (doc_id)",
)
def area_tokens(spark, folder):
    areas = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("area"))
    found = explore.area_tokens(corpus(spark, folder), areas)
    return found.select("doc_id", "area", F.md5(F.array_join("tokens", ",")).alias("digest"))


@query(
    "weight_filter",
    f"WITH {TF}, tot AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id)"
    " SELECT doc_id, term, printf('%.3f', floor(tf * 1000.0::DOUBLE / n + 0.5) / 1000) AS weight FROM tf JOIN tot USING (doc_id) WHERE CAST(tf AS DOUBLE) / n > 0.1",
)
def weight_filter(spark, folder):
    rows = corpus(spark, folder).withColumn("n", F.size("tokens"))
    share = F.col("tf") / F.col("n")
    found = terms.term_frequencies(rows, "doc_id", "n").where(share > 0.1)
    return found.select("doc_id", "term", F.format_string("%.3f", share).alias("weight"))


@query("hashed_tfidf")
def hashed_tfidf(spark, folder):
    """Inverse document frequencies of hashed terms against the formula on exact terms; collisions show as lower values."""
    rows = corpus(spark, folder)
    weighted = features.hashed_tfidf(rows)
    body = F.from_json(F.to_json(F.struct(F.col("features").alias("v"))), "v struct<indices: array<int>, values: array<double>>")
    return weighted.select("doc_id", body["v"].alias("v")).select(
        "doc_id", F.size("v.indices").alias("n_features"), F.round(F.aggregate("v.values", F.lit(0.0), lambda a, x: a + x), 4).alias("weight")
    )


@query(
    "hashed_term_map",
    f"WITH {DF} SELECT term, CAST(1 AS BIGINT) AS n_features, true AS in_range FROM df",
)
def hashed_term_map(spark, folder):
    """Every term has one feature in range; terms that collide share it."""
    found = features.hash_terms(terms.document_frequencies(corpus(spark, folder)).select("term"))
    return found.groupBy("term").agg(
        F.count_distinct("idx").alias("n_features"), F.every(F.col("idx").between(0, (1 << 20) - 1)).alias("in_range")
    )


@query("hashed_term_lists", f"WITH {DF} SELECT term, CAST(1 AS BIGINT) AS n_lists, true AS same FROM df")
def hashed_term_lists(spark, folder):
    """Each term stands in one feature's list, that of its own feature."""
    names = terms.document_frequencies(corpus(spark, folder)).select("term")
    listed = features.terms_by_hash(names, 1 << 14).select(F.explode("terms").alias("term"), F.col("idx").alias("list_idx"))
    both = listed.join(features.hash_terms(names, 1 << 14), "term")
    return both.groupBy("term").agg(F.count("*").alias("n_lists"), F.every(F.col("idx") == F.col("list_idx")).alias("same"))


@query(
    "hashing_vectorizer",
    f"WITH {DOCS} SELECT doc_id, CASE WHEN len(tokens) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM docs",
)
def hashing_vectorizer(spark, folder):
    """Each hashed document has length 1, an empty one 0."""
    rows = features.hashed_unit(corpus(spark, folder))
    body = F.from_json(F.to_json(F.struct(F.col("features").alias("v"))), "v struct<values: array<double>>")
    squares = F.aggregate(body["v"]["values"], F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("doc_id", F.round(F.sqrt(squares), 6).alias("length"))
