"""Every registered query of the engine runs; those with SQL give its rows."""

import pytest

from querylens import catalog, plans  # noqa: F401

from .oracle import connect, same

SF = "/root/testdata/sf0.001"
WEAK = {"review_sample", "bootstrap_ci", "sign_randomization", "hashed_word_vectors", "retrieval_stages", "skeleton_tfidf", "gmm_categories", "pca_2d", "skeleton_components", "category_selection", "variant_experiment"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    frame = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(frame.columns) == len(set(frame.columns))
    if name in catalog.SQL:
        same(con, catalog.SQL[name], frame)
    else:
        assert name in WEAK and len(frame)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
