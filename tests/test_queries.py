"""Every query against its SQL on the smallest tables; every other query must return rows."""

import pytest
from agreement import compare, database

from corpuslab.operators import features, terms
from corpuslab.plans import load_queries
from corpuslab.plans.registry import QUERIES, SQL
from corpuslab.plans.tables import corpus

load_queries()

@pytest.fixture(scope="module")
def duck(folder):
    return database(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, folder, duck, name):
    assert compare(spark, duck, folder, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_returns_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).limit(1).count() == 1


def test_learners_see_the_whole_vocabulary(spark, folder):
    """A term of few documents can be a keyword and a selected feature."""
    rows = features.with_label(corpus(spark, folder, "lang"), "lang")
    n_terms = terms.document_frequencies(rows).count()
    found = QUERIES["ml_keywords"](spark, folder).toPandas()
    assert (found.dimensions == n_terms * found["class"].nunique()).all()
    index = terms.term_index(terms.document_frequencies(rows)).toPandas()
    by_term = term_presence(rows).merge(index, on="term")
    chosen = {r.feature for r in QUERIES["ml_chi2_selection"](spark, folder).collect()}
    others = by_term[~by_term.term_id.isin(chosen)]
    assert len(chosen) == 50 and chosen <= set(by_term.term_id)
    assert by_term[by_term.term_id.isin(chosen)].score.min() >= others.score.max() - 1e-9


def term_presence(rows):
    """term, score: the chi-squared test of each term's presence against the label, from the counts."""
    docs = rows.select("label", "tokens").toPandas()
    total = docs.label.value_counts().sort_index()
    held = docs.assign(term=docs.tokens.map(set)).explode("term").dropna(subset="term")
    table = held.groupby(["term", "label"]).size().unstack(fill_value=0).reindex(columns=total.index, fill_value=0)
    n, df = total.sum(), table.sum(axis=1)
    score = sum((table[c] - df * k / n) ** 2 * (n / (df * k) + n / ((n - df) * k).where(df < n, float("inf"))) for c, k in total.items())
    return score.rename("score").reset_index()


def test_flagship_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    found = entry.entry(spark)
    assert found.columns == ["term", "df"] and found.count() == 50
