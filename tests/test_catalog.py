import pytest

from vellumite import catalog

from .compare import duck, rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    """Every query runs; where SQL says the same, the rows are equal."""
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in catalog.ORACLES:
        assert rows(got) == rows(duck(sf_dir).execute(catalog.ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
