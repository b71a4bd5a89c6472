from pyspark.sql import functions as F

from corpuslab.functions import text
from corpuslab.functions.vectors import sparse_vector, unit
from corpuslab.functions.words import STOP_WORDS, TRANSLATIONS
from corpuslab.plans import prepare


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression.alias("r")).first()["r"]


def many(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r["r"] for r in rows.select("i", expression.alias("r")).orderBy("i").collect()]


def test_normalize(spark):
    found = one(spark, "aaaaa한글ab-b123*b)ccc•dd (Net: i-SAN) é ß", text.normalize("v"))
    assert found == "AAAAA한글AB B123 B CCC DD  NET  I SAN    SS"
    assert one(spark, "aB-c", text.normalize("v", upper=False)) == "aB c"


def test_word_tables_have_their_documented_size():
    assert len(TRANSLATIONS) == 84
    assert len(STOP_WORDS) == 150 and len(set(STOP_WORDS)) == 145


def test_counter_tokens(spark):
    tokens = ["1차", "2개", "4점", "3차전", "110개"]
    assert many(spark, tokens, text.is_counter("v")) == [True, True, True, False, True]


def test_content_tokens_equal_the_step_by_step_rules(spark):
    values = ["1차 3차전 110개 12 a1 7 x 12ab 5년차 2016년도", "", "A", "(12) 2016년 ab-cd", "차 12차년도의 99"]
    steps = F.filter(F.split(text.normalize("v"), " "), lambda t: F.length(t) > 1)
    assert many(spark, values, text.content_tokens("v")) == many(spark, values, text.drop_numbers(steps))
    assert many(spark, values, text.content_tokens("v"))[0] == ["3차전", "A1", "12AB", "2016년도"]


def test_strip_codes(spark):
    assert one(spark, "(5)ICT·융합연구-a/b:c", text.strip_codes("v")) == "ICT·융합연구abc"


def test_translation_comes_before_stop_words(spark):
    rows = spark.createDataFrame([("d", "CELL CELLS system Research energy 12", "The new 1 cell")], "doc_id string, text string, title string")
    # CELL, SYSTEM and RESEARCH turn into stop words; title words skip translation, length and number rules.
    assert prepare.corpus(rows).first()["tokens"] == ["세포", "에너지", "NEW", "1", "CELL"]


def test_areas_and_years(spark):
    assert one(spark, "(5)ICT/(3)의학/", text.clean_areas("v")) == ["ICT", "의학"]
    assert one(spark, "6T", text.clean_areas("v", ["6T"])) == []
    assert one(spark, "2015R1A1A1A05000898", text.year_of("v")) == 2015
    assert one(spark, "2016R1", text.document_path("v", {2014: "b/", 2015: "c/"}, "a/")) == "a/2016R1.txt"


def test_first_or_none_and_trailing_blanks(spark):
    parts = text.trim_trailing_empty(F.split("v", ","))
    assert one(spark, ",,,", parts) == []
    assert one(spark, "a,,b,,", parts) == ["a", "", "b"]
    assert one(spark, ",,,", text.first_or_none(parts)) == "NONE"


def test_program_fields(spark):
    rows = spark.createDataFrame([("1234      NAME ONE, 99 X,7,", None)], "a string, b string")
    # Only a code at the very start of an item is dropped.
    assert rows.select(text.program_fields("a", "b").alias("r")).first()["r"] == "NAME ONE,99 X"


def test_key_values(spark):
    body = "lost line\nTitle : One: two\n   more \n\nEmpty:\nAbstract :\n  text"
    found = one(spark, body, text.key_values("v"))
    assert [(e["key"], e["value"]) for e in found] == [("Title", "One: two more "), ("Empty", ""), ("Abstract", "text")]
    assert [(e["key"], e["value"]) for e in one(spark, "no key", text.key_values("v"))] == [("", "no key")]


def test_plain_words(spark):
    assert one(spark, "Some text5 WITH a Été words", text.plain_words("v")) == ["some", "with", "words"]


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in rows.select(unit("v")).collect()] == [[0.6, 0.8], [None, None]]
    made = rows.limit(1).select(sparse_vector(5, F.array(F.lit(1), F.lit(3)), "v").alias("s")).first()["s"]
    assert made.size == 5 and list(made.indices) == [1, 3] and list(made.values) == [3.0, 4.0]
