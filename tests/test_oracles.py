"""Every query against its SQL."""

import pytest

from tests.compare import connect, difference
from trialspark.plans import catalog, oracle


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in oracle.SELECTS:
        assert difference(df, con, oracle.statement(name)) == ""
    else:
        assert df.collect()


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


# Subjects caught on the benchmark tables, known from the table design.
EXPECTED = {
    "sf0.001": {"below_fillers": 6, "training_structure_test": 2, "linear_test": 2},
    "sf0.01": {"below_fillers": 58, "training_structure_test": 19, "linear_test": 19},
    "sf0.1": {"below_fillers": 596, "training_structure_test": 196, "linear_test": 204},
}


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_expected_counts(spark, scale):
    for name, count in EXPECTED[scale].items():
        df = catalog.QUERIES[name](spark, f"/root/testdata/{scale}")
        assert df.select("subject").distinct().count() == count
