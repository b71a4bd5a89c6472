"""Cleaning and tokenising documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslab.functions import text
from corpuslab.functions.words import AWARD_STOP_WORDS, STOP_WORDS, TRANSLATIONS
from corpuslab.operators import categories, lexicon, terms
from corpuslab.plans import prepare
from corpuslab.plans.registry import query
from corpuslab.plans.tables import DF, DOCS, NORMAL, TF, TOK, cohort, corpus, documents, table


def sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(words))


@query(
    "normalize_tokens",
    f"WITH {DF} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 50",
)
def normalize_tokens(spark, folder):
    return terms.top_terms(terms.document_frequencies(corpus(spark, folder)), 50)


@query(
    "token_counts",
    f"WITH {TF} SELECT doc_id, term, tf FROM tf",
)
def token_counts(spark, folder):
    return terms.term_frequencies(corpus(spark, folder), "doc_id")


@query(
    "normalized_text",
    f"SELECT doc_id, md5({NORMAL}) AS digest FROM documents",
)
def normalized_text(spark, folder):
    return documents(spark, folder).select("doc_id", F.md5(text.normalize("text")).alias("digest"))


@query(
    "strip_codes",
    "SELECT p_partkey, regexp_replace('(' || p_size || ')' || p_type || '-' || p_brand, '[()0-9\\-/:]', '', 'g') AS area FROM part",
)
def strip_codes(spark, folder):
    part = table(spark, folder, "part")
    code = F.concat(F.lit("("), "p_size", F.lit(")"), "p_type", F.lit("-"), "p_brand")
    return part.select("p_partkey", text.strip_codes(code).alias("area"))


@query(
    "area_clean",
    "SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter("
    "string_split(regexp_replace('(' || p_size || ')' || p_type || '/' || p_name || '/' || p_type, '[\\-()0-9]', '', 'g'), '/'),"
    " x -> length(x) > 0))), '|') END AS areas FROM part".replace("x -> ", "lambda x: "),
)
def area_clean(spark, folder):
    part = table(spark, folder, "part")
    code = F.concat(F.lit("("), "p_size", F.lit(")"), "p_type", F.lit("/"), "p_name", F.lit("/"), "p_type")
    # A stop area is dropped before it is split, so the rule sees the bare type.
    raw = F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).otherwise(code)
    areas = text.clean_areas(raw, ["ECONOMY"])
    return part.select("p_partkey", F.array_join(F.sort_array(areas), "|").alias("areas"))


# English function words stand in for the project terms, which this text hardly has.
TEST_TRANSLATIONS = {**TRANSLATIONS, "THE": "그", "DIE": "그", "LES": "그", "WITH": "함께", "AVEC": "함께", "NOT": "아니"}
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in TEST_TRANSLATIONS.items())


@query(
    "term_translate",
    f"WITH {TOK}, words(a, b) AS (VALUES {_PAIRS}), moved AS (SELECT doc_id, coalesce(b, term) AS term FROM tok LEFT JOIN words ON term = a)"
    " SELECT term, count(*) AS cf FROM moved GROUP BY term",
)
def term_translate(spark, folder):
    rows = corpus(spark, folder)
    return terms.collection_frequencies(rows.select(text.translate_tokens("tokens", TEST_TRANSLATIONS).alias("tokens")))


@query(
    "stopword_corpus",
    f"WITH {TOK} SELECT doc_id, term, count(*) AS tf FROM tok WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
    f" AND term NOT IN ({sql_list(STOP_WORDS)}) GROUP BY doc_id, term",
)
def stopword_corpus(spark, folder):
    blocked = table(spark, folder, "labels").where(F.col("toxic") == 1).select("doc_id")
    rows = categories.without_documents(corpus(spark, folder), blocked)
    kept = rows.select("doc_id", text.drop_stop_words("tokens", STOP_WORDS).alias("tokens"))
    return terms.term_frequencies(kept, "doc_id")


_TITLE_WORDS = NORMAL.replace("text", "string_split(text, chr(10))[1]")
_PROJECT_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in TRANSLATIONS.items())


@query(
    "title_merge",
    f"WITH {DOCS}, words(a, b) AS (VALUES {_PROJECT_PAIRS}), body AS (SELECT doc_id, unnest(tokens) AS t FROM docs),"
    " translated AS (SELECT doc_id, coalesce(b, t) AS term FROM body LEFT JOIN words ON t = a),"
    f" title AS (SELECT doc_id, unnest(string_split({_TITLE_WORDS}, ' ')) AS term FROM documents),"
    " merged AS (SELECT * FROM translated UNION ALL SELECT * FROM title)"
    f" SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM merged WHERE term <> '' AND term NOT IN ({sql_list(STOP_WORDS)}) GROUP BY doc_id",
)
def title_merge(spark, folder):
    rows = documents(spark, folder).withColumn("title", text.first_line("text"))
    lengths = terms.document_lengths(prepare.corpus(rows), "doc_id").where(F.col("n_total") > 0)
    return lengths.select("doc_id", F.col("n_total").alias("n_tokens"), F.col("n_unique").alias("n_terms"))


@query(
    "english_tokens",
    "WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s'), lambda t: length(t) > 3 AND"
    " regexp_full_match(t, '\\p{L}+')) AS w FROM documents)"
    " SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, array_to_string(w, ' ') AS words FROM words WHERE len(w) > 1",
)
def english_tokens(spark, folder):
    words = documents(spark, folder).select("doc_id", text.plain_words("text").alias("w")).where(F.size("w") > 1)
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.array_join("w", " ").alias("words"))


@query(
    "year_from_id",
    "SELECT doc_id, CAST(doc_id % 3 + 2013 AS INT) AS year, (doc_id % 3 = 2) AS is_2015,"
    " '/data/content' || (doc_id % 3 + 2013) || '/' || (doc_id % 3 + 2013) || 'R' || doc_id || '.txt' AS path FROM documents",
)
def year_from_id(spark, folder):
    code = F.concat(cohort().cast("string"), F.lit("R"), F.col("doc_id").cast("string"))
    rows = table(spark, folder, "documents").select("doc_id", code.alias("code"))
    folders = {y: f"/data/content{y}/" for y in (2013, 2014, 2015)}
    return rows.select(
        "doc_id",
        text.year_of("code").alias("year"),
        F.col("code").startswith("2015").alias("is_2015"),
        text.document_path("code", folders, folders[2013]).alias("path"),
    )


@query(
    "first_or_none",
    "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'NONE' END AS first_area FROM labels",
)
def first_or_none(spark, folder):
    labels = table(spark, folder, "labels")
    areas = F.array(
        F.when(F.col("toxic") == 1, F.lit("toxic")), F.when(F.col("quality") == 1, F.lit("good"))
    )
    return labels.select("doc_id", text.first_or_none(F.filter(areas, lambda a: a.isNotNull())).alias("first_area"))


@query(
    "program_fields",
    "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_size || ' ' || p_type || ',' || p_brand || ', ,' || p_name || ',7', ','),"
    " lambda p: trim(regexp_replace(p, '^[0-9]\\S*', ''))), lambda p: length(p) > 0), ',') AS fields FROM part",
)
def program_fields(spark, folder):
    program = F.concat_ws(" ", "p_size", "p_type")
    rest = F.concat(F.col("p_brand"), F.lit(", ,"), F.col("p_name"), F.lit(",7"))
    return table(spark, folder, "part").select("p_partkey", text.program_fields(program, rest).alias("fields"))


@query(
    "kv_records",
    "WITH raw AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(role || ': ' || text, '\n+$', ''), chr(10))) AS line,"
    " generate_subscripts(string_split(regexp_replace(role || ': ' || text, '\n+$', ''), chr(10)), 1) AS ln FROM conversations),"
    " marked AS (SELECT *, sum(CASE WHEN contains(line, ':') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY ln) AS e FROM raw),"
    " entries AS (SELECT conv_id, turn, e, trim(string_split(arg_min(line, ln), ':')[1]) AS key,"
    " array_to_string(list(trim(CASE WHEN contains(line, ':') THEN regexp_replace(line, '^[^:]*:', '') ELSE line END) ORDER BY ln) FILTER (WHERE NOT (contains(line, ':') AND regexp_replace(line, '^[^:]*:', '') = '')), ' ') AS value,"
    " max(e) OVER (PARTITION BY conv_id, turn) AS last_e FROM marked GROUP BY conv_id, turn, e)"
    " SELECT conv_id, turn, CAST(e - 1 AS INT) AS pos, key, value FROM entries WHERE key <> '' OR e = last_e",
)
def kv_records(spark, folder):
    turns = table(spark, folder, "conversations")
    entries = text.key_values(F.concat("role", F.lit(": "), "text"))
    return turns.select("conv_id", "turn", F.explode(entries).alias("e")).select("conv_id", "turn", "e.*")


# The lexicon is derived from the corpus: plural forms are two-way ambiguous, -TION words are compounds.
_ANALYSES = (
    "analyses AS (SELECT term AS surface, 1 AS rank, 'N' AS pos, CASE WHEN term LIKE '%S' THEN substr(term, 1, length(term) - 1) ELSE term END AS stem,"
    " CASE WHEN length(term) > 6 AND term LIKE '%TION' THEN [substr(term, 1, length(term) - 4), 'TION'] ELSE [] END AS parts FROM df WHERE term NOT LIKE '%EN'"
    " UNION ALL SELECT term, 2, 'N', term || 'X', [] FROM df WHERE term LIKE '%S'"
    " UNION ALL SELECT term, 1, 'V', term, [] FROM df WHERE term LIKE '%EN')"
)


def derived_lexicon(rows):
    """surface, rank, pos, stem, parts for every term of the corpus, by suffix rules."""
    term = F.col("term")
    none = F.array().cast("array<string>")
    plural, verb = term.endswith("S"), term.endswith("EN")
    compound = (F.length(term) > 6) & term.endswith("TION")
    head = F.expr("substr(term, 1, length(term) - 4)")
    stem = F.when(plural, F.expr("substr(term, 1, length(term) - 1)")).otherwise(term)

    def analysis(rank, pos, stem, parts):
        return F.struct(F.lit(rank).alias("rank"), F.lit(pos).alias("pos"), stem.alias("stem"), parts.alias("parts"))

    noun = analysis(1, "N", stem, F.when(compound, F.array(head, F.lit("TION"))).otherwise(none))
    second = analysis(2, "N", F.concat(term, F.lit("X")), none)
    found = F.when(verb, F.array(analysis(1, "V", term, none))).when(plural, F.array(noun, second)).otherwise(F.array(noun))
    distinct = terms.document_frequencies(rows).select("term")
    return distinct.select(term.alias("surface"), F.explode(found).alias("a")).select("surface", "a.*")


@query(
    "lexicon_nouns",
    f"WITH {DF}, {_ANALYSES}, resolved AS (SELECT surface, count(*) AS n, arg_min(stem, rank) AS stem, arg_min(parts, rank) AS parts"
    " FROM analyses WHERE pos = 'N' GROUP BY surface), words AS (SELECT surface, unnest(CASE WHEN n = 1 AND len(parts) > 1 THEN parts ELSE [stem] END) AS word FROM resolved)"
    " SELECT doc_id, word AS term, CAST(sum(tf) AS BIGINT) AS tf FROM tf JOIN words ON term = surface WHERE length(word) > 1 AND"
    " NOT regexp_full_match(word, '[0-9]+') GROUP BY doc_id, word",
)
def lexicon_nouns(spark, folder):
    rows = corpus(spark, folder)
    used = terms.document_frequencies(rows)
    return lexicon.lexicon_terms(terms.term_frequencies(rows, "doc_id"), derived_lexicon(rows), used, "doc_id")


@query(
    "compound_parts",
    f"WITH {DF}, {_ANALYSES} SELECT DISTINCT surface, unnest(parts) AS part FROM analyses WHERE len(parts) > 1",
)
def compound_parts(spark, folder):
    return lexicon.compound_parts(derived_lexicon(corpus(spark, folder)))


@query(
    "lexicon_lemma",
    f"WITH {DF}, lem AS (SELECT lower(CASE WHEN term LIKE '%ING' THEN substr(term, 1, length(term) - 3) ELSE term END) AS lemma, doc_id, tf FROM tf)"
    " SELECT doc_id, lemma AS term, CAST(sum(tf) AS BIGINT) AS tf FROM lem WHERE length(lemma) > 2 AND regexp_full_match(lemma, '\\p{L}+')"
    f" AND lemma NOT IN ({sql_list(AWARD_STOP_WORDS + ['the', 'and'])}) GROUP BY doc_id, lemma",
)
def lexicon_lemma(spark, folder):
    rows = corpus(spark, folder)
    used = terms.document_frequencies(rows)
    found = used.where(F.col("term").endswith("ING"))
    table_ = found.select(F.col("term").alias("surface"), F.expr("substr(term, 1, length(term) - 3)").alias("lemma"))
    counted = terms.term_frequencies(rows, "doc_id")
    return lexicon.lemmas(counted, table_, used, "doc_id", AWARD_STOP_WORDS + ["the", "and"])


@query(
    "regex_words",
    "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]')) AS BIGINT) AS n_words,"
    " array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]'), ' ') AS words FROM documents",
)
def regex_words(spark, folder):
    rows = documents(spark, folder).select("doc_id", text.words_in("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words"))
