import json

import pytest
from pyspark.sql import functions as F

from corpuslab import session
from corpuslab.schemas import CORPUS
from corpuslab.sources import readers, sheets, writers


def test_whole_files_take_their_id_from_the_name(spark, tmp_path):
    (tmp_path / "2015R1.txt").write_text("line one\nline two", encoding="utf-8")
    (tmp_path / "2015R2.txt").write_text("", encoding="utf-8")
    found = {r.doc_id: r.text for r in readers.whole_files(spark, f"{tmp_path}/*.txt").collect()}
    assert found["2015R1"] == "line one\nline two"


def test_award_file(spark, tmp_path):
    (tmp_path / "a1.txt").write_text(
        "Title       : A study\n              goes on\nFile        : a1\nNSF Program : 1234 NAME, 55\nFld Applictn: 0000099   Other: x\nFile        : a2\nAbstract    :\n  Words.",
        encoding="utf-8",
    )
    # A code after a space stays: only an item that starts with a digit loses its code.
    found = readers.award_records(spark, f"{tmp_path}/*.txt").first()
    assert (found.file, found.title, found.abstract, found.fields) == ("a2", "A study goes on", "Words.", "NAME,55,Other: x")


def test_metadata_line(spark, tmp_path):
    (tmp_path / "m.txt").write_text("2013R1A1A1004576-title - x:::m0,m1,m2,m3:::n0,,n2:::,,,\n", encoding="utf-8")
    found = readers.metadata_records(spark, str(tmp_path)).first()
    assert found.doc_id == "2013R1A1A1004576" and found.title == "title - x"
    assert found.main_area == ["m0", "m1", "m2", "m3"] and found.nation_area == ["n0", "", "n2"] and found.sixt_area == []


def test_short_metadata_row_is_padded(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",".join(f"({i})v{i}" for i in range(40)), encoding="utf-8")
    found = readers.metadata_csv(spark, str(tmp_path)).first()
    assert found.doc_id == "(21)v21" and found.main_area[0] == "v" and found.sixt_area == [""] * 10


def test_matrix_text_shape(spark, tmp_path):
    (tmp_path / "p").write_text("(0,(4167,[0,1,4],[1.0,2.0,1.0]))\n", encoding="utf-8")
    found = sorted(map(tuple, readers.matrix_text(spark, str(tmp_path)).collect()))
    assert found == [(0, 0, 1.0), (0, 1, 2.0), (0, 4, 1.0)]


def test_empty_document_reloads_empty(spark):
    lines = spark.createDataFrame([("a,b",), ("",)], "value string")
    assert [r.tokens for r in readers.token_lines(lines).collect()] == [["a", "b"], []]


def test_schema_and_pandas_round_trip(spark):
    rows = spark.createDataFrame([("d", ["x", "y"])], CORPUS)
    again = spark.createDataFrame(rows.toPandas(), CORPUS)
    assert again.schema == CORPUS and again.first().tokens == ["x", "y"]


def test_cells_of_unknown_type(spark):
    row = spark.createDataFrame([(' a,"b"\n', None)], "c0 string, c1 string")
    known = row.select(sheets.clean_cell("c0").alias("a"), sheets.clean_cell("c1").alias("b"), sheets.clean_cell("c0", F.lit(False)).alias("c"))
    assert tuple(known.first()) == ("a  b ", "", "*******")


def test_topic_json_is_valid(spark):
    rows = spark.createDataFrame([(0, "x", 0.5), (0, "y", 0.7004), (1, "z", 0.1)], "topic int, term string, weight double")
    found = json.loads(writers.topic_json(rows).first().json)
    assert [c["name"] for c in found["children"]] == ["topic 0", "topic 1"]
    assert found["children"][0]["children"] == [{"name": "y", "size": 700}, {"name": "x", "size": 500}]


def test_load_or_build_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("d", ["x"])], CORPUS)

    for _ in range(2):
        assert readers.load_or_build(spark, f"{tmp_path}/prepared", build).count() == 1
    assert calls == [1]


def test_shared_folder_refuses_a_private_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_lines_are_numbered_in_file_order_across_splits(spark, tmp_path):
    (tmp_path / "vocab.txt").write_text("\n".join(f"term {i}" for i in range(20000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        found = readers.numbered_lines(spark, f"{tmp_path}/vocab.txt")
        assert found.where(F.col("value") != F.concat(F.lit("term "), F.col("line").cast("string"))).count() == 0
        assert found.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_comma_list(spark):
    lines = spark.createDataFrame([("a,b,c",)], "value string")
    assert [tuple(r) for r in readers.comma_list(lines).collect()] == [(0, "a"), (1, "b"), (2, "c")]
