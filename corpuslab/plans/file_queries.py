"""Readers and writers: tables go out in a file format and must come back unchanged."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.functions import text
from corpuslab.operators import bayes, learners, quality, terms, topics
from corpuslab.plans import prepare
from corpuslab.plans.model_queries import _CENTROID, _CONF, _LABELS, _VCONF, centroid_scores, lang_predictions
from corpuslab.plans.latent_queries import fitted
from corpuslab.plans.registry import query
from corpuslab.plans.tables import DF, DOCS, RATINGS, TF, corpus, documents, rating_rows, table, vectors
from corpuslab.session import new_path
from corpuslab.sources import readers, sheets, writers


@query("file_scan", "SELECT CAST(page_id AS VARCHAR) AS doc_id, md5(html) AS digest FROM pages")
def file_scan(spark, folder):
    """Files of a hundred pages at most, read back whole and split into their records."""
    path = new_path(spark, "files")
    record = F.concat(F.col("page_id").cast("string"), F.lit("\t"), "html", F.lit(readers.RECORD_END))
    table(spark, folder, "pages").select(record.alias("value")).write.option("maxRecordsPerFile", 100).text(path)
    records = readers.whole_records(spark, f"{path}/*.txt")
    page = F.split("value", "\t", 2)
    return records.select(page[0].alias("doc_id"), F.md5(page[1]).alias("digest"))


@query(
    "line_scan",
    "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l",
)
def line_scan(spark, folder):
    """Two folders of text read by one scan, line by line."""
    rows = documents(spark, folder)
    paths = [new_path(spark, "lines") for _ in range(2)]
    for part, path in enumerate(paths):
        rows.where(F.col("doc_id") % 2 == part).select("text").write.text(path)
    lines = readers.text_lines(spark, paths)
    return lines.agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


@query(
    "union_scan",
    "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
)
def union_scan(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "lang")
    odd, even = rows.where(F.col("doc_id") % 2 == 1), rows.where(F.col("doc_id") % 2 == 0)
    return odd.unionByName(even).groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "csv_header",
    "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY o_orderpriority",
)
def csv_header(spark, folder):
    """Every part file carries a header line; none of them becomes a row."""
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    path = new_path(spark, "csv")
    writers.table_csv(rows.repartition(4, "o_orderpriority"), path)
    back = readers.csv_with_header(spark, path, rows.schema)
    return back.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"), F.round(F.sum("o_totalprice"), 2).alias("price")
    )


def _customer_cell(i: int):
    if i == 21:
        return F.concat(F.lit("2015R"), F.col("c_custkey").cast("string"))
    if i == 22:
        return F.col("c_name")
    return F.concat(F.lit(f"({i})"), "c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"))


@query(
    "csv_positional",
    "SELECT '2015R' || c_custkey AS doc_id, c_name AS title, array_to_string(list_transform(range(4), lambda i: c_mktsegment), '|') AS main_area,"
    " array_to_string(list_transform(range(10), lambda i: c_mktsegment), '|') AS nation_area, array_to_string(list_transform(range(10), lambda i: c_mktsegment), '|') AS sixt_area FROM customer",
)
def csv_positional(spark, folder):
    path = new_path(spark, "meta")
    line = F.concat_ws(",", *[_customer_cell(i) for i in range(65)])
    table(spark, folder, "customer").select(line.alias("value")).write.text(path)
    meta = readers.metadata_csv(spark, path)
    return meta.select("doc_id", "title", *[F.array_join(c, "|").alias(c) for c in ("main_area", "nation_area", "sixt_area")])


@query(
    "sheet_split",
    "SELECT 'S' || s_suppkey AS doc_id, md5(array_to_string(list_transform(range(65, 70), lambda i: 'part ' || i || '  ' || s_name), chr(10) || chr(10))) AS digest,"
    " 'cell 0  ' || s_name || ' ' || s_nationkey AS first_cell, 65::BIGINT AS n_cells FROM supplier",
)
def sheet_split(spark, folder):
    """A 70-column sheet with commas, quotes and line breaks in its cells."""
    name = F.col("s_name")

    def cell(i: int):
        if i == 21:
            return F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
        if i < 65:
            return F.concat(F.lit(f" cell {i},\n"), name, F.lit('"'), F.col("s_nationkey").cast("string"))
        return F.concat(F.lit(f"part {i}\n,"), name, F.lit(" "))

    sheet = table(spark, folder, "supplier").select(*[cell(i).alias(f"c{i}") for i in range(70)])
    body = sheets.content(sheet, "c21").select("doc_id", F.md5("text").alias("digest"))
    path = new_path(spark, "sheet")
    sheets.metadata_lines(sheet).write.text(path)
    cells = F.split("value", ",")
    meta = readers.text_lines(spark, path).select(
        F.get(cells, F.lit(21)).alias("doc_id"), F.get(cells, F.lit(0)).alias("first_cell"), F.size(cells).cast("long").alias("n_cells")
    )
    return body.join(meta, "doc_id")


@query("sheet_width", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE s_suppkey % 5 = 0) AS n_bad_width FROM supplier")
def sheet_width(spark, folder):
    short = F.col("s_suppkey") % 5 == 0
    cells = [F.when(short, F.lit(None)).otherwise(F.col("s_name")) if i == 69 else F.col("s_name") for i in range(70)]
    lines = table(spark, folder, "supplier").select(F.concat_ws("\t", *cells).alias("value"))
    return sheets.width_check(lines)


@query(
    "meta_record_roundtrip",
    "SELECT '2014R' || c_custkey AS doc_id, c_name AS title, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_mktsegment END AS main_area, CAST(CASE WHEN c_nationkey % 3 = 0 THEN 0 ELSE 1 END AS INT) AS n_main,"
    " c_mktsegment || '|' || c_nationkey AS nation_area FROM customer",
)
def meta_record_roundtrip(spark, folder):
    """Trailing blank areas come back as an empty list."""
    blank = F.lit("")
    main = F.when(F.col("c_nationkey") % 3 == 0, blank).otherwise(F.col("c_mktsegment"))
    meta = table(spark, folder, "customer").select(
        F.concat(F.lit("2014R"), F.col("c_custkey").cast("string")).alias("doc_id"),
        F.col("c_name").alias("title"),
        F.array(main, blank, blank).alias("main_area"),
        F.array("c_mktsegment", F.col("c_nationkey").cast("string"), blank).alias("nation_area"),
        F.array(blank, blank).alias("sixt_area"),
    )
    path = new_path(spark, "records")
    writers.metadata_text(meta, path)
    back = readers.metadata_records(spark, path)
    return back.select(
        "doc_id", "title", F.array_join("main_area", "|").alias("main_area"), F.size("main_area").alias("n_main"),
        F.array_join("nation_area", "|").alias("nation_area"),
    )


@query(
    "award_files",
    "SELECT 'a' || s_suppkey AS file, 'Study of ' || s_name || ' and more' AS title, 'About ' || s_name AS abstract, 'NAME,' || 'FIELD ' || s_nationkey AS fields FROM supplier",
)
def award_files(spark, folder):
    """Key/value records, a hundred to a file at most, with a continuation line and coded program names."""
    key = F.col("s_suppkey").cast("string")
    body = F.concat(
        F.lit("Title       : Study of "), "s_name", F.lit("\n        and more\nFile        : a"), key,
        F.lit("\nNSF Program : 1234      NAME,\nFld Applictn: FIELD "), F.col("s_nationkey").cast("string"),
        F.lit("\nAbstract    :\n        About "), "s_name",
    )
    path = new_path(spark, "awards")
    record = F.concat(body, F.lit(readers.RECORD_END))
    table(spark, folder, "supplier").select(record.alias("value")).write.option("maxRecordsPerFile", 100).text(path)
    return readers.award_records(spark, f"{path}/*.txt").drop("path")


@query(
    "prepared_reload",
    f"WITH {DOCS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(array_to_string(tokens, ',')) AS digest, CAST(len(tokens) AS BIGINT) AS n_tokens FROM docs",
)
def prepared_reload(spark, folder):
    """Comma-joined corpus lines with their ids read back as token lists; nothing after the id is an empty document."""
    path = new_path(spark, "corpus")
    writers.corpus_text(corpus(spark, folder), path, doc="doc_id")
    line = F.split("value", "\t", 2)
    lines = readers.text_lines(spark, path).select(line[0].alias("doc_id"), line[1].alias("value"))
    back = readers.token_lines(lines)
    return back.select("doc_id", F.md5(F.array_join("tokens", ",")).alias("digest"), F.size("tokens").cast("long").alias("n_tokens"))


@query(
    "libsvm_roundtrip",
    "SELECT CAST(label AS DOUBLE) AS label, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 4) AS total, round(sum(embedding[1]::DOUBLE), 5) AS first FROM embeddings GROUP BY label".replace("AS first", 'AS "first"'),
)
def libsvm_roundtrip(spark, folder):
    path = new_path(spark, "libsvm")
    rows = vectors(spark, folder).select(F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("features"))
    rows.write.format("libsvm").save(path)
    back = readers.libsvm(spark, path, 64).select("label", vector_to_array("features").alias("v"))
    return back.groupBy("label").agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)), 4).alias("total"),
        F.round(F.sum(F.get("v", F.lit(0))), 5).alias("first"),
    )


_INDEX = f"WITH {DF}, idx AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM df)"


def indexed_terms(spark, folder):
    """The corpus and the number of each of its terms, with document frequencies."""
    rows = corpus(spark, folder)
    return rows, terms.term_index(terms.document_frequencies(rows))


@query(
    "matrix_text_roundtrip",
    f'{_INDEX} SELECT doc_id AS "row", CAST(term_id AS INT) AS term_id, CAST(tf AS DOUBLE) AS value FROM tf JOIN idx USING (term)',
)
def matrix_text_roundtrip(spark, folder):
    path = new_path(spark, "matrix")
    rows, index = indexed_terms(spark, folder)
    triplets = terms.count_triplets(rows, index, "doc_id").select(F.col("doc_id").alias("row"), "term_id", F.col("tf").cast("double").alias("value"))
    writers.matrix_lines(triplets, index.count()).write.text(path)
    return readers.matrix_text(spark, path)


@query(
    "ldac_roundtrip",
    f"{_INDEX} SELECT doc_id, CAST(term_id AS INT) AS term_id, CAST(tf AS INT) AS cnt FROM tf JOIN idx USING (term)",
)
def ldac_roundtrip(spark, folder):
    path = new_path(spark, "ldac")
    lines = writers.bag_of_words_lines(terms.count_triplets(*indexed_terms(spark, folder), "doc_id").withColumnRenamed("tf", "cnt"), "doc_id")
    writers.table_csv(lines, path, header=False)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("value", T.StringType())])
    return readers.bag_of_words(spark.read.csv(path, schema=schema), "doc_id")


@query(
    "vocabulary_lines",
    f"{_INDEX} SELECT term, term_id FROM idx",
)
def vocabulary_lines(spark, folder):
    """Terms written in order, one per line and with their number, come back as the same index."""
    _, index = indexed_terms(spark, folder)
    path = new_path(spark, "vocabulary")
    index.select(F.concat_ws(":", "term", "term_id").alias("value")).write.text(path)
    value = F.col("value")
    return readers.text_lines(spark, path).select(
        F.substring_index(value, ":", 1).alias("term"), F.substring_index(value, ":", -1).cast("long").alias("term_id")
    )


@query("vocabulary_by_line", f"{_INDEX} SELECT term, term_id FROM idx")
def vocabulary_by_line(spark, folder):
    """Vocabulary files without numbers: the line of a term, over the files in order, is its id."""
    kept = terms.document_frequencies(corpus(spark, folder)).select("term")
    path = new_path(spark, "vocabulary")
    kept.orderBy("term").write.text(path)
    return readers.numbered_lines(spark, path).select(F.col("value").alias("term"), F.col("line").alias("term_id"))


@query("ratings_roundtrip", f'WITH {RATINGS} SELECT usr AS "user", item, round(rating - 2.5, 4) AS rating FROM ratings')
def ratings_roundtrip(spark, folder):
    path = new_path(spark, "ratings")
    rating_rows(spark, folder).select(F.concat_ws("::", "user", "item", "rating").alias("value")).write.text(path)
    return readers.ratings(spark, path, -2.5).withColumn("rating", F.round("rating", 4))


_AREA_TOPICS = (
    f"WITH {TF}, a AS (SELECT lang, term, count(*) AS n_docs FROM tf GROUP BY lang, term), k AS (SELECT *, dense_rank() OVER (ORDER BY lang) - 1 AS topic, row_number() OVER (PARTITION BY lang ORDER BY n_docs DESC, term) AS rank FROM a QUALIFY rank <= 20),"
    " t AS (SELECT CAST(topic AS INT) AS topic, term, CAST(n_docs AS DOUBLE) / 1000 AS weight FROM k)"
)


def area_topics(spark, folder):
    """topic, term, weight: the heaviest terms of each language."""
    found = terms.area_document_frequencies(corpus(spark, folder, "lang"), "lang")
    best = terms.top_terms_per_area(found, "lang", 20)
    number = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    return best.select(number.alias("topic"), "term", (F.col("n_docs").cast("double") / 1000).alias("weight"))


@query("topics_csv_roundtrip", f"{_AREA_TOPICS} SELECT topic, term, weight FROM t")
def topics_csv_roundtrip(spark, folder):
    path = new_path(spark, "topics")
    writers.table_csv(area_topics(spark, folder), path)
    return readers.topic_terms_csv(spark, path)


@query("topic_term_lists", f"{_AREA_TOPICS} SELECT topic, string_agg(term, ',' ORDER BY weight DESC, term) AS terms FROM t GROUP BY topic")
def topic_term_lists(spark, folder):
    lists = readers.topic_term_lists(area_topics(spark, folder))
    return lists.select("topic", F.array_join("terms", ",").alias("terms"))


@query("topic_overview", f"{_AREA_TOPICS} SELECT topic, string_agg(term, ',' ORDER BY weight DESC, term) AS terms FROM t GROUP BY topic")
def topic_overview(spark, folder):
    return topics.overview(area_topics(spark, folder))


@query(
    "topic_json_export",
    f"{_AREA_TOPICS}, c AS (SELECT topic, string_agg('{{\"name\":\"' || term || '\",\"size\":' || CAST(floor(weight * 1000) AS INT) || '}}', ',' ORDER BY weight DESC, term) AS s FROM t GROUP BY topic)"
    " SELECT '{\"name\":\"lda\",\"children\":[' || string_agg('{\"name\":\"topic ' || topic || '\",\"children\":[' || s || ']}', ',' ORDER BY topic) || ']}' AS json FROM c",
)
def topic_json_export(spark, folder):
    return writers.topic_json(area_topics(spark, folder))


# Word lengths modulo five serve as topics whose document shares are exactly known.
_LENGTH_TOPICS = (
    f"WITH {TF}, tot AS (SELECT doc_id, sum(tf)::DOUBLE AS n FROM tf GROUP BY doc_id), w AS (SELECT doc_id, CAST(length(term) % 5 AS INT) AS topic, round(sum(tf) / any_value(n), 6) AS weight FROM tf JOIN tot USING (doc_id) GROUP BY 1, 2)"
)


def length_topics(spark, folder):
    """doc_id, topic, weight."""
    rows = corpus(spark, folder).withColumn("n", F.size("tokens"))
    counted = terms.term_frequencies(rows, "doc_id", "n").withColumn("topic", F.length("term") % 5)
    return counted.groupBy("doc_id", "topic").agg(F.round(F.sum("tf") / F.max("n").cast("double"), 6).alias("weight"))


@query(
    "topic_documents",
    f"{_LENGTH_TOPICS} SELECT doc_id, topic, weight, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, doc_id) AS INT) AS rank FROM w QUALIFY rank <= 100",
)
def topic_documents(spark, folder):
    return topics.topic_documents(length_topics(spark, folder), "doc_id", 100)


@query(
    "document_topics",
    f"{_LENGTH_TOPICS} SELECT doc_id, topic, weight, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic) AS INT) AS rank FROM w QUALIFY rank <= 3",
)
def document_topics(spark, folder):
    return topics.document_topics(length_topics(spark, folder), "doc_id", 3)


@query(
    "topics_used",
    f"{_LENGTH_TOPICS}, u AS (SELECT doc_id, count(*) FILTER (WHERE weight > 0.1) AS n_topics FROM w GROUP BY doc_id) SELECT n_topics, count(*) AS n_docs FROM u GROUP BY n_topics",
)
def topics_used(spark, folder):
    return topics.topics_used(length_topics(spark, folder), "doc_id", 0.1)


@query(
    "topic_docs_export",
    f"{_LENGTH_TOPICS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, doc_id) AS rank FROM w QUALIFY rank <= 1000)"
    " SELECT topic, doc_id, source AS area, weight FROM r JOIN documents USING (doc_id) WHERE weight > 0.2",
)
def topic_docs_export(spark, folder):
    best = topics.topic_documents(length_topics(spark, folder), "doc_id", 1000)
    areas = table(spark, folder, "documents").select("doc_id", F.col("source").alias("area"))
    path = new_path(spark, "topic_docs")
    table_ = writers.topic_documents(best, areas)
    writers.table_csv(table_, path)
    return readers.csv_with_header(spark, path, table_.schema)


@query(
    "docs_topics_export",
    f"{_LENGTH_TOPICS} SELECT doc_id, md5(replace(any_value(string_split(text, chr(10))[1]), ',', ' ')) AS title, any_value(source) AS area,"
    " string_agg(topic || ':' || printf('%.3f', floor(weight * 1000 + 0.5) / 1000), ', ' ORDER BY weight DESC, topic) AS topics FROM w JOIN documents USING (doc_id) GROUP BY doc_id",
)
def docs_topics_export(spark, folder):
    meta = documents(spark, folder, "source").select("doc_id", text.first_line("text").alias("title"), F.col("source").alias("area"))
    best = topics.document_topics(length_topics(spark, folder), "doc_id", 30)
    found = writers.document_topics(best, meta)
    # Weights are compared at three digits, since number formats differ.
    pairs = F.transform(
        F.split("topics", ", "),
        lambda p: F.concat(F.substring_index(p, ":", 1), F.lit(":"), F.format_string("%.3f", F.substring_index(p, ":", -1).cast("double"))),
    )
    return found.select("doc_id", F.md5("title").alias("title"), "area", F.array_join(pairs, ", ").alias("topics"))


@query(
    "predictions_roundtrip",
    f"WITH {_CENTROID} SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(arg_max(class, score) AS DOUBLE) AS prediction, CAST(any_value(label) AS DOUBLE) AS label FROM cs GROUP BY vec_id",
)
def predictions_roundtrip(spark, folder):
    best = bayes.best_class(centroid_scores(spark, folder), "vec_id", "label")
    path = new_path(spark, "predictions")
    rows = best.select(F.col("vec_id").alias("doc_id"), F.col("prediction").cast("double"), F.col("label").cast("double"))
    writers.table_csv(rows, path, mode="ignore", header=False)
    writers.table_csv(rows, path, mode="ignore", header=False)
    return readers.predictions(spark, path)


@query("confusion_csv", f"{_VCONF} SELECT label, prediction, n FROM c")
def confusion_csv(spark, folder):
    counts = quality.confusion(bayes.best_class(centroid_scores(spark, folder), "vec_id", "label"))
    path = new_path(spark, "confusion")
    writers.table_csv(counts, path)
    return readers.csv_with_header(spark, path, counts.schema)


@query(
    "confusion_matrix_csv",
    f"WITH {_CONF} SELECT label, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE prediction = '{c}'), 0) AS BIGINT) AS as_{c}" for c in ("de", "en", "es", "fr")) + " FROM c GROUP BY label",
)
def confusion_matrix_csv(spark, folder):
    """The confusion matrix as a file with a column per predicted class."""
    matrix = quality.confusion_matrix(quality.confusion(lang_predictions(spark, folder)))
    path = new_path(spark, "matrix")
    writers.table_csv(matrix, path)
    return readers.csv_with_header(spark, path, matrix.schema)


@query(
    "label_metrics_csv",
    f'{_VCONF}{_LABELS} SELECT label, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f1, 6) AS f1 FROM m',
)
def label_metrics_csv(spark, folder):
    """Precision and recall per label as a file."""
    counts = quality.confusion(bayes.best_class(centroid_scores(spark, folder), "vec_id", "label"))
    found = quality.label_metrics(counts).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
    path = new_path(spark, "metrics")
    writers.table_csv(found, path)
    return readers.csv_with_header(spark, path, found.schema)


@query("docfreq_tsv", f"WITH {DF} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 5000")
def docfreq_tsv(spark, folder):
    path = new_path(spark, "docfreq")
    found = terms.top_terms(terms.document_frequencies(corpus(spark, folder)), 5000)
    writers.frequency_tsv(found, path)
    return spark.read.csv(path, schema=found.schema, sep="\t")


@query(
    "prepared_store",
    f"WITH {DOCS} SELECT doc_id, CAST(len(list_filter(tokens, lambda t: t <> 'THE')) AS BIGINT) AS n_tokens FROM docs",
)
def prepared_store(spark, folder):
    """Built on the first call, only read on the second."""
    path = new_path(spark, "prepared")

    def build():
        rows = corpus(spark, folder)
        return rows.select("doc_id", text.drop_stop_words("tokens", ["THE"]).alias("tokens"))

    readers.load_or_build(spark, path, build)
    stored = readers.load_or_build(spark, path, lambda: build().limit(0))
    writers.corpus_table(stored.limit(0), path, mode="ignore")
    return stored.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


@query(
    "prepared_cohort",
    "SELECT CAST(doc_id % 3 + 2013 AS INT) AS year, count(*) AS n_docs FROM documents WHERE doc_id % 3 = 2 GROUP BY 1",
)
def prepared_cohort(spark, folder):
    """The stored corpus read for one year only: the id prefix is pushed into the scan."""
    year = (F.col("doc_id") % 3 + 2013).cast("string")
    rows = documents(spark, folder).select(F.concat(year, F.lit("R"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    rows = rows.withColumn("title", text.first_line("text"))
    found = prepare.prepared_corpus(spark, new_path(spark, "prepared"), rows, 2015)
    return found.groupBy(text.year_of("doc_id").alias("year")).agg(F.count("*").alias("n_docs"))


@query("model_store", "SELECT CAST(t AS INT) AS topic, true AS same FROM range(20) r(t)")
def model_store(spark, folder):
    """A saved topic model describes the same topics after loading."""
    model = fitted(spark, folder)
    path = new_path(spark, "model")
    topics.save(model, path)
    loaded = topics.load(spark, path)
    before, after = topics.topic_terms(model, 10), topics.topic_terms(loaded, 10).withColumnRenamed("weight", "again")
    both = before.join(after, ["topic", "term"], "full_outer")
    close = F.coalesce(F.abs(F.col("weight") - F.col("again")) < 1e-9, F.lit(False))
    return both.groupBy("topic").agg(F.every(close).alias("same"))


@query("classifier_store", "SELECT CAST(vec_id AS BIGINT) AS vec_id, true AS same FROM embeddings")
def classifier_store(spark, folder):
    rows = vectors(spark, folder).select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("features"))
    model = learners.decision_tree().fit(rows)
    path = new_path(spark, "classifier")
    writers.save_model(model, path)
    again = type(model).load(path).transform(rows).select("vec_id", F.col("prediction").alias("again"))
    both = model.transform(rows).select("vec_id", "prediction").join(again, "vec_id")
    return both.select("vec_id", (F.col("prediction") == F.col("again")).alias("same"))
