"""Explicit schemas; nothing is inferred from files."""

from pyspark.sql import types as T

META_WIDTH = 65
SHEET_WIDTH = 70

# Column positions in the metadata sheet.
ID_COLUMN = 21
TITLE_COLUMN = 22
MAIN_AREA_COLUMNS = [31, 32, 33, 34]
NATION_AREA_COLUMNS = [35, 36, 38, 39, 41, 42, 44, 45, 47, 48]
SIXT_AREA_COLUMNS = [50, 51, 53, 54, 56, 57, 59, 60, 62, 63]


def text_columns(count: int) -> T.StructType:
    """``count`` string columns named c0, c1, ..."""
    return T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(count)])


META = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("main_area", T.ArrayType(T.StringType())),
        T.StructField("nation_area", T.ArrayType(T.StringType())),
        T.StructField("sixt_area", T.ArrayType(T.StringType())),
    ]
)

CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("tokens", T.ArrayType(T.StringType())),
    ]
)

RATING = T.StructType(
    [
        T.StructField("user", T.IntegerType()),
        T.StructField("item", T.IntegerType()),
        T.StructField("rating", T.DoubleType()),
    ]
)

PREDICTION = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("prediction", T.DoubleType()),
        T.StructField("label", T.DoubleType()),
    ]
)

TOPIC_TERM = T.StructType(
    [
        T.StructField("topic", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
