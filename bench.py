"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from corpuslab import build_session
from corpuslab.plans import load_queries
from corpuslab.plans.registry import QUERIES

HEADLINE = [
    "normalize_tokens",
    "token_counts",
    "doc_freq",
    "collection_freq",
    "area_term_df",
    "stopword_corpus",
    "lexicon_nouns",
    "vocab_index",
    "tfidf_explicit",
    "tfidf_l2_sublinear",
    "chi2_terms",
    "hashed_tfidf",
    "similar_words",
    "concordance",
    "kv_records",
    "nb_multiclass",
    "nb_one_vs_rest",
    "threshold_curve",
    "roc_macro",
    "label_metrics",
    "ranking_metrics",
    "knn_classify",
    "lsa_doc_neighbors",
    "lsa_concepts",
    "lda_topics",
    "topic_documents",
    "ml_forest",
    "als_recs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_queries()
    QUERIES["normalize_tokens"](spark, folder).collect()  # JVM warm-up
    seconds = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
