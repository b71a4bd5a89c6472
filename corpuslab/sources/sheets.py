"""Split of a wide project sheet into metadata cells and document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.functions.text import strip
from corpuslab.schemas import META_WIDTH, SHEET_WIDTH

# Fixed value: what a cell of unknown type is replaced by.
UNKNOWN_CELL = "*******"


def clean_cell(c: Column | str, known: Column | None = None) -> Column:
    """Trim, and turn commas, line breaks and quotes into spaces; blank for a missing cell."""
    c = F.col(c) if isinstance(c, str) else c
    cell = F.coalesce(F.regexp_replace(strip(c), '[,\n"]', " "), F.lit(""))
    return cell if known is None else F.when(known, cell).otherwise(F.lit(UNKNOWN_CELL))


def metadata_cells(sheet: DataFrame) -> DataFrame:
    """Columns c0..c64, cleaned."""
    return sheet.select(*[clean_cell(f"c{i}").alias(f"c{i}") for i in range(META_WIDTH)])


def metadata_lines(sheet: DataFrame) -> DataFrame:
    """The metadata cells of each row as one comma-joined line."""
    return sheet.select(F.concat_ws(",", *[clean_cell(f"c{i}") for i in range(META_WIDTH)]).alias("value"))


def content(sheet: DataFrame, id_column: str) -> DataFrame:
    """Document text: the content cells joined by a blank line."""
    cells = [clean_cell(f"c{i}") for i in range(META_WIDTH, SHEET_WIDTH)]
    return sheet.select(F.col(id_column).alias("doc_id"), F.concat_ws("\n\n", *cells).alias("text"))


def width_check(lines: DataFrame, column: str = "value", width: int = SHEET_WIDTH) -> DataFrame:
    """How many rows do not have ``width`` tab-separated cells."""
    cells = F.size(F.split(F.col(column), "\t", -1))
    return lines.agg(F.count("*").alias("n_rows"), F.count_if(cells != width).alias("n_bad_width"))
