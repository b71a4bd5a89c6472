"""The topic model on collections whose topics are known."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslab.operators import topic_fit, topics
from corpuslab.session import dealt, shared_folder

FRUIT, TOOLS = ["apple", "pear", "plum", "fig"], ["saw", "axe", "file", "drill"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [str(w) for w in rng.choice(FRUIT if i % 2 else TOOLS, 30)]) for i in range(60)]
    rows += [(100, []), (101, ["once"]), (102, ["apple"])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


@pytest.fixture(scope="module")
def model(corpus):
    return topics.fit(corpus, "doc_id", 2, 60, alpha=0.5)


def test_topics_are_found(model):
    found = {}
    for r in topics.topic_terms(model, 4).collect():
        found.setdefault(r.topic, set()).add(r.term)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, (FRUIT, TOOLS)))


def test_every_document_is_there(corpus, model):
    shares = {r.doc_id: r.weights for r in model.documents.collect()}
    assert set(shares) == {r.doc_id for r in corpus.collect()}
    assert all(abs(sum(w) - 1) < 1e-9 and len(w) == 2 for w in shares.values())
    assert shares[100] == [0.5, 0.5]
    fruit = int(np.argmax(shares[1]))
    assert all(int(np.argmax(shares[i])) == (fruit if i % 2 else 1 - fruit) for i in range(60))
    assert int(np.argmax(shares[102])) == fruit


def test_weights_of_a_topic_add_up(model):
    total = model.terms.agg(*[F.sum(F.get("weights", F.lit(i))) for i in range(2)]).first()
    assert model.terms.count() == 9 and all(abs(x - 1) < 1e-6 for x in total)


def test_perplexity_falls_to_the_vocabulary_of_a_topic(model):
    assert model.perplexity == sorted(model.perplexity, reverse=True) and 3.5 < model.perplexity[-1] < 5


def test_blocks_agree_with_one_block(corpus, model, monkeypatch):
    """Blocks that stand still meanwhile find the same topics, and no count is lost between them."""
    monkeypatch.setattr(topic_fit, "BLOCK_CELLS", 60)
    split = topics.fit(corpus, "doc_id", 2, 60, alpha=0.5)
    assert abs(split.perplexity[-1] - model.perplexity[-1]) < 0.2
    a, b = ({r.doc_id: r.weights for r in m.documents.where("doc_id < 100").collect()} for m in (model, split))
    turned = np.argmax(a[1]) != np.argmax(b[1])
    assert max(abs(a[i][0] - b[i][1 if turned else 0]) for i in a) < 0.05
    cells = corpus.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    cells = cells.withColumn("term_id", F.dense_rank().over(topics_order()) - 1).drop("term").cache()
    _, counts, totals, _ = topic_fit.fit(cells, "doc_id", 3, 7, 9, 0.5, 0.1, 1)
    per_term = {r.term_id: sum(r.w) for r in counts.collect()}
    wanted = {r.term_id: r.tf for r in cells.groupBy("term_id").agg(F.sum("tf").alias("tf")).collect()}
    assert per_term.keys() == wanted.keys() and all(abs(per_term[t] - wanted[t]) < 1e-3 for t in wanted)
    assert abs(totals.sum() - sum(wanted.values())) < 1e-2


def topics_order():
    from pyspark.sql import Window

    return Window.orderBy("term")


def test_reruns_agree(corpus, model):
    again = topics.fit(corpus.repartition(3), "doc_id", 2, 60, alpha=0.5)
    a, b = ({r.term: r.weights for r in m.terms.collect()} for m in (model, again))
    assert all(np.allclose(a[t], b[t], atol=1e-4) for t in a)


def test_a_stored_model_comes_back(spark, model, tmp_path):
    topics.save(model, str(tmp_path / "model"))
    again = topics.load(spark, str(tmp_path / "model"))
    assert (again.doc, again.k, again.perplexity) == (model.doc, model.k, model.perplexity)
    assert sorted(map(tuple, topics.topic_terms(again, 3).collect())) == sorted(map(tuple, topics.topic_terms(model, 3).collect()))


def test_no_tokens_at_all(spark):
    empty = spark.createDataFrame([(1, []), (2, None)], "doc_id long, tokens array<string>")
    found = topics.fit(empty, "doc_id", 2, 10)
    assert found.terms.count() == 0 and {r.doc_id: r.weights for r in found.documents.collect()} == {1: [0.5, 0.5], 2: [0.5, 0.5]}


def test_blocks_grow_with_the_cells():
    """A term is sent once per block that holds it, so a large corpus must not fall into many small blocks."""
    assert topic_fit.block_number(0, 20) == topic_fit.block_number(99_000, 20) == 1 and topic_fit.block_number(1_000_000, 20) == 10
    assert topic_fit.block_number(14_000_000, 20) == 24 and topic_fit.block_number(144_000_000, 20) == 72


def test_what_an_exchange_sends(spark):
    """A block's counts travel as one row per part of the terms; added up by part they are the counts of all its tokens."""
    rows = [(d, t, 1 + (d + t) % 3) for d in range(12) for t in range(d % 5, 40, 1 + d % 4)]
    cells = spark.createDataFrame(rows, "doc long, term_id long, tf long")
    packed = topic_fit._packed(cells, "doc", 3, 7)
    moving = topic_fit._started(packed, 2, 4).cache()
    assert moving.count() <= 3 * (4 + 1) and moving.where("part < 0").count() == packed.count()
    found = {r.term_id: sum(r.w) for r in topic_fit._term_counts(moving, 2, 4).collect()}
    wanted = {}
    for _, t, tf in rows:
        wanted[t] = wanted.get(t, 0) + tf
    assert found.keys() == wanted.keys() and all(abs(found[t] - wanted[t]) < 1e-4 for t in wanted)


def test_a_sweep_is_that_of_single_cells():
    """Cells in slices and runs, of terms with few and with many documents, give the shares and counts of one after the other."""
    rng = np.random.default_rng(4)
    ptr = np.arange(0, 60 * 12, 12)
    term = np.concatenate([rng.choice(np.append(np.arange(40), np.zeros(9, int)), 12) for _ in ptr])
    term = np.unique(term, return_inverse=True)[1].astype(np.int32)
    tf, k, alpha, beta = rng.integers(1, 5, len(term)).astype(np.float32), 3, 0.5, 0.1
    cells = topic_fit._Cells(ptr, term, tf)
    assert {r.each > 0 for r in cells.runs} == {True, False}
    shares = rng.dirichlet(np.ones(k), len(term)).T.astype(np.float32)
    theta, phi = rng.random((k, len(ptr))).astype(np.float32) + 1, rng.random((k, cells.n_terms)).astype(np.float32) + 1
    total, doc = phi.sum(axis=1) + 5.0, np.repeat(np.arange(len(ptr)), 12)
    wanted = (theta[:, doc] - shares + alpha) * (phi[:, term] - shares + beta) / (total[:, None] - shares)
    wanted /= wanted.sum(axis=0)
    mine = np.ascontiguousarray(shares[:, cells.order])
    by_doc, by_place = cells.sweep(theta, cells.placed(phi), total, alpha, beta, mine)
    assert np.allclose(mine, wanted[:, cells.order], rtol=1e-4)
    by_term = cells.by_term(by_place)
    for topic in range(k):
        assert np.allclose(by_doc[topic], np.bincount(doc, wanted[topic] * tf), rtol=1e-4)
        assert np.allclose(by_term[topic], np.bincount(term, wanted[topic] * tf), rtol=1e-4)


def test_only_the_model_stays_on_disk(spark, corpus, monkeypatch):
    """Counts of an exchange go when the next has its own; in the end only the two tables of the model are left."""
    folder = Path(shared_folder(spark)) / "corpuslab"
    before, most, remove = {p.name for p in folder.glob("*")}, [], topic_fit.remove
    found = lambda: {p.name for p in folder.glob("*")} - before
    monkeypatch.setattr(topic_fit, "remove", lambda *a: (most.append(sum("topic_counts" in n for n in found())), remove(*a)))
    model = topics.fit(corpus, "doc_id", 2, 40, alpha=0.5)
    assert len(most) == 2 + 5 and max(most) == 2
    assert sorted(n.split("-")[0] for n in found()) == ["described_documents", "described_terms"]
    assert model.terms.count() == 9 and model.documents.count() == 63


def test_blocks_are_dealt_one_to_a_partition(spark):
    rows = spark.range(24 * 10).select(dealt(spark, F.col("id") % 24, 24).alias("block")).repartition(24, "block")
    per = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count_distinct("block").alias("n")).collect()
    assert len(per) == 24 and {r.n for r in per} == {1}
