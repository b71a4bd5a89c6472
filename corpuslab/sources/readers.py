"""Scans. Each returns a DataFrame with an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from corpuslab import schemas
from corpuslab.functions import text
from corpuslab.operators.ordering import with_row_index

# Closes a record in a file of several: the record separator control character.
RECORD_END = "\u001e"
FILE_STEM = r"([^/]+)\.[^./]+$"


def text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per line, over one path, a glob or a list of paths."""
    return spark.read.text(paths)


def whole_files(spark: SparkSession, paths: str | Sequence[str], id_pattern: str = FILE_STEM) -> DataFrame:
    """One row per file: ``doc_id`` cut from the path (by default the name without extension), and its text."""
    files = spark.read.text(paths, wholetext=True)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, id_pattern, 1).alias("doc_id"), F.col("value").alias("text"))


def whole_records(spark: SparkSession, paths: str | Sequence[str], end: str = RECORD_END) -> DataFrame:
    """value, path: one row per record of files that hold several, each closed by ``end`` and a line break."""
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    records = files.select(F.explode(F.split("value", f"{end}\n?")).alias("value"), "path")
    return records.where(F.col("value") != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line: the lines of a file numbered from 0 in file order, across its splits."""
    at = ["_file", "_start", "_row"]
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return with_row_index(lines, *[F.asc(c) for c in at], name="line").select("value", "line")


def comma_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """pos, value of the names in a comma-joined line."""
    return lines.select(F.posexplode(F.split(F.col(column), ",")).alias("pos", "value"))


def positional_csv(spark: SparkSession, paths: str | Sequence[str], width: int) -> DataFrame:
    """Comma-split lines with no quoting; missing cells become empty strings."""
    cells = F.split("value", ",")
    return text_lines(spark, paths).select(
        *[F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(width)]
    )


def metadata_from_cells(cells: DataFrame) -> DataFrame:
    """Metadata records out of a table with columns c0..c64."""

    def areas(positions: Sequence[int]):
        return F.array(*[text.strip_codes(f"c{i}") for i in positions])

    return cells.select(
        F.col(f"c{schemas.ID_COLUMN}").alias("doc_id"),
        F.col(f"c{schemas.TITLE_COLUMN}").alias("title"),
        areas(schemas.MAIN_AREA_COLUMNS).alias("main_area"),
        areas(schemas.NATION_AREA_COLUMNS).alias("nation_area"),
        areas(schemas.SIXT_AREA_COLUMNS).alias("sixt_area"),
    )


def metadata_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The 65-column metadata sheet."""
    return metadata_from_cells(positional_csv(spark, paths, schemas.META_WIDTH))


def csv_with_header(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, **options) -> DataFrame:
    """CSV whose files each begin with a header line."""
    return spark.read.csv(paths, schema=schema, header=True, **options)


def parse_metadata_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id-title:::a,b:::c:::d`` lines; the id ends at the first hyphen."""
    value = F.col(column)
    record = F.split(F.regexp_replace(value, "^[^-]*-", ""), ":::")

    def areas(i: int):
        return text.trim_trailing_empty(F.split(F.coalesce(F.get(record, F.lit(i)), F.lit("")), ","))

    return lines.select(
        F.substring_index(value, "-", 1).alias("doc_id"),
        F.get(record, F.lit(0)).alias("title"),
        areas(1).alias("main_area"),
        areas(2).alias("nation_area"),
        areas(3).alias("sixt_area"),
    )


def metadata_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_metadata_records(text_lines(spark, paths))


def token_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Comma-joined tokens; an empty line is an empty document, not one empty token."""
    return lines.withColumn("tokens", F.filter(F.split(F.col(column), ","), lambda t: t != "")).drop(column)


def award_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Award files of ``Key : value`` lines, one record each or several: file, title, abstract, fields, path."""
    files = whole_records(spark, paths).select(F.map_from_entries(_last_wins(text.key_values("value"))).alias("kv"), "path")
    return files.select(
        F.col("kv")["File"].alias("file"),
        F.col("kv")["Title"].alias("title"),
        F.col("kv")["Abstract"].alias("abstract"),
        text.program_fields(F.col("kv")["NSF Program"], F.col("kv")["Fld Applictn"]).alias("fields"),
        "path",
    )


def _last_wins(entries):
    """Key/value pairs with the last value of each repeated key."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))

    def latest(key):
        values = F.transform(F.filter(entries, lambda e: e["key"] == key), lambda e: e["value"])
        return F.struct(key.alias("key"), F.element_at(values, -1).alias("value"))

    return F.transform(keys, latest)


def libsvm(spark: SparkSession, path: str, num_features: int | None = None) -> DataFrame:
    """Columns label and features from ``label i:v ...`` lines."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", num_features) if num_features else reader).load(path)


def matrix_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(row,(size,[indices],[values]))`` lines as triplets row, term_id, value."""
    value = F.col("value")
    cells = text_lines(spark, paths).select(
        F.regexp_extract(value, r"^\(([0-9]+),", 1).cast("long").alias("row"),
        F.from_json(F.regexp_extract(value, r"^\([0-9]+,\([0-9]+,(\[[^\]]*\])", 1), "array<int>").alias("ids"),
        F.from_json(F.regexp_extract(value, r"(\[[^\[\]]*\])\)\)$", 1), "array<double>").alias("values"),
    )
    return cells.select("row", F.explode(F.arrays_zip("ids", "values")).alias("cell")).select(
        "row", F.col("cell.ids").alias("term_id"), F.col("cell.values").alias("value")
    )


def bag_of_words(lines: DataFrame, doc: str, column: str = "value") -> DataFrame:
    """``N id:count ...`` lines as triplets doc, term_id, cnt."""
    pairs = F.filter(F.split(F.col(column), " "), lambda t: t.contains(":"))
    return lines.select(doc, F.explode(pairs).alias("pair")).select(
        doc,
        F.substring_index("pair", ":", 1).cast("int").alias("term_id"),
        F.substring_index("pair", ":", -1).cast("int").alias("cnt"),
    )


def topic_terms_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``topicid, term, weight`` rows."""
    return csv_with_header(spark, paths, schemas.TOPIC_TERM, ignoreLeadingWhiteSpace=True)


def topic_term_lists(rows: DataFrame) -> DataFrame:
    """Per topic, its terms by falling weight. A topic holds a fixed number of top terms."""
    by_weight = F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))), lambda e: e["term"]
    )
    return rows.groupBy("topic").agg(by_weight.alias("terms"))


def ratings(spark: SparkSession, paths: str | Sequence[str], shift: float = 0.0) -> DataFrame:
    """``user::item::rating`` lines; ``shift`` is added to the rating."""
    rows = spark.read.csv(paths, schema=schemas.RATING, sep="::")
    return rows.withColumn("rating", F.col("rating") + F.lit(shift))


def predictions(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``doc_id,prediction,label`` rows."""
    return spark.read.csv(paths, schema=schemas.PREDICTION)


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The prepared table at ``path``; built and saved first when it is absent."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    build().write.parquet(path)
    return spark.read.parquet(path)
