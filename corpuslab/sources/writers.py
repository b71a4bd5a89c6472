"""Sinks. Tables are written in parallel; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_text(corpus: DataFrame, path: str, mode: str = "errorifexists", doc: str | None = None) -> None:
    """Token lists as comma-joined lines, after the document's id and a tab if ``doc`` names it."""
    line = F.array_join("tokens", ",")
    line = line if doc is None else F.concat(F.col(doc).cast("string"), F.lit("\t"), line)
    corpus.select(line.alias("value")).write.mode(mode).text(path)


def corpus_table(corpus: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The prepared corpus as Parquet; ``mode='ignore'`` writes only if absent."""
    corpus.write.mode(mode).parquet(path)


def metadata_line() -> Column:
    """``id-title:::main:::nation:::sixt``."""
    areas = [F.array_join(c, ",") for c in ("main_area", "nation_area", "sixt_area")]
    return F.concat(F.col("doc_id"), F.lit("-"), F.concat_ws(":::", "title", *areas))


def metadata_text(meta: DataFrame, path: str, mode: str = "errorifexists") -> None:
    meta.select(metadata_line().alias("value")).write.mode(mode).text(path)


def frequency_tsv(frequencies: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Term and document frequency, tab-separated."""
    frequencies.select("term", "df").write.mode(mode).csv(path, sep="\t")


def table_csv(table: DataFrame, path: str, mode: str = "errorifexists", header: bool = True) -> None:
    """Any metric, topic or prediction table as CSV."""
    table.write.mode(mode).csv(path, header=header)


def topic_documents(top_docs: DataFrame, areas: DataFrame, min_weight: float = 0.2) -> DataFrame:
    """topic, doc_id, area and weight of documents above ``min_weight``."""
    kept = top_docs.where(F.col("weight") > min_weight)
    return kept.join(areas, "doc_id").select("topic", "doc_id", "area", "weight")


def document_topics(top_topics: DataFrame, meta: DataFrame) -> DataFrame:
    """doc_id, title without commas, area, and ``topic:weight`` pairs by falling weight.

    A document has at most as many pairs as topics were asked for.
    """
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "topic", "weight")))
    lists = top_topics.groupBy("doc_id").agg(pairs.alias("pairs"))
    joined = F.array_join(F.transform("pairs", lambda p: F.concat_ws(":", p["topic"], p["weight"])), ", ")
    return lists.join(meta, "doc_id").select(
        "doc_id", F.translate("title", ",", " ").alias("title"), "area", joined.alias("topics")
    )


def topic_json(topic_terms: DataFrame, name: str = "lda") -> DataFrame:
    """One nested JSON row: topics with their terms, size = whole thousandths of the weight.

    The table holds topics x top terms, both fixed parameters.
    """
    term = F.struct(F.col("term").alias("name"), (F.col("weight") * 1000).cast("int").alias("size"))
    per_topic = topic_terms.groupBy("topic").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("term").alias("t"), term.alias("e")))),
            lambda x: x["e"],
        ).alias("children")
    )
    named = per_topic.select(
        "topic", F.struct(F.concat(F.lit("topic "), "topic").alias("name"), "children").alias("node")
    )
    nodes = named.agg(F.sort_array(F.collect_list(F.struct("topic", "node"))).alias("nodes"))
    children = F.transform("nodes", lambda x: x["node"])
    return nodes.select(F.to_json(F.struct(F.lit(name).alias("name"), children.alias("children"))).alias("json"))


def matrix_lines(triplets: DataFrame, size: int) -> DataFrame:
    """``(row,(size,[indices],[values]))`` lines; one row holds one document's terms."""
    cells = F.sort_array(F.collect_list(F.struct("term_id", "value")))
    rows = triplets.groupBy("row").agg(cells.alias("cells"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("cells", lambda c: c[field].cast("string")), ",")

    return rows.select(
        F.format_string(f"(%s,({size},[%s],[%s]))", F.col("row").cast("string"), joined("term_id"), joined("value")).alias("value")
    )


def bag_of_words_lines(triplets: DataFrame, doc: str) -> DataFrame:
    """``N id:count ...`` lines, with the document key kept beside the line."""
    cells = F.sort_array(F.collect_list(F.struct("term_id", "cnt")))
    rows = triplets.groupBy(doc).agg(cells.alias("cells"))
    pairs = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["term_id"], c["cnt"])), " ")
    return rows.select(doc, F.concat_ws(" ", F.size("cells"), pairs).alias("value"))


def save_model(model, path: str, overwrite: bool = False) -> None:
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)
