"""Every stage of the pipeline against brute force, on what its predecessor kept."""

from collections import Counter, defaultdict

import pytest
from agreement import database
from test_files_and_packing import check_pieces
from test_repeats import brute_components

import corpus_pipeline
from corpuslab.llm.common import Scratch
from corpuslab.llm.queries import mix_sql


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The documents and what each stage made of them, written and read again."""
    scratch = Scratch(spark, "test_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(scratch.settle(stage(spark, out[-1], folder), f"stage{k}"))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay_until_the_last_stage(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_clean_documents_stay(spark, folder, stages):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    before, after = rows(stages[0]), rows(stages[1])
    assert not Counter(after) - Counter(before)
    lost = {i for i, _ in before} - {i for i, _ in after}
    assert len(lost & clean) <= 0.02 * len(clean)


def test_one_of_equal_texts_stays(stages):
    best = {}
    for i, t in rows(stages[1]):
        best[t] = max(i, best.get(t, i))
    assert sorted(rows(stages[2])) == sorted((i, t) for t, i in best.items())


def test_one_of_near_texts_stays(stages):
    before = rows(stages[2])
    heads = {i for i, _, c in brute_components(before) if i == c}
    assert sorted(rows(stages[3])) == sorted((i, t) for i, t in before if i in heads)


def test_mix_takes_what_the_sql_says(folder, stages):
    base = database(folder)
    base.execute("CREATE TABLE kept (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    base.executemany("INSERT INTO kept VALUES (?, ?, ?)", [tuple(r) for r in stages[3].select("doc_id", "text", "source").collect()])
    wanted = dict(base.execute(f"WITH {mix_sql('kept')} SELECT doc_id, copies FROM mixed WHERE copies > 0").fetchall())
    assert Counter(i for i, _ in rows(stages[4])) == Counter(wanted)


def test_all_ids_are_packed(stages):
    padding = check_pieces(stages[5].collect(), rows(stages[4]))
    assert padding < 0.03


def test_repeated_and_null_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    some = docs.limit(5)
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", None, 0)], docs.schema)
    kept = corpus_pipeline.drop_exact(spark, some.unionByName(some).unionByName(odd), folder)
    counts = defaultdict(int)
    for i, _ in rows(kept):
        counts[i] += 1
    assert set(counts.values()) == {1} and 900001 in counts and None not in counts
    assert corpus_pipeline.mix_sources(spark, kept, folder).columns == docs.columns
    assert corpus_pipeline.pack(spark, docs.limit(0), folder).count() == 0


def test_clashing_columns_stay(spark, folder):
    """Columns named like those a stage makes keep their values, and the same rows come out."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    names = ["_h", "_id", "_k", "_copies", "_copy", "hash", "size", "count", "copies", "kept", "component_id"]
    odd = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    for stage in (corpus_pipeline.drop_exact, corpus_pipeline.drop_near, corpus_pipeline.mix_sources):
        plain, found = rows(stage(spark, docs, folder)), stage(spark, odd, folder)
        assert found.columns == odd.columns
        found = found.collect()
        assert Counter((r.doc_id, r.text) for r in found) == Counter(plain)
        assert all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)
        assert stage(spark, odd.limit(0), folder).count() == 0
