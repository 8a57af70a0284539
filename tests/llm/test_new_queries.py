import pytest

from tests.compare import duck, rows
from vellumite.llm import oracles, queries


@pytest.mark.parametrize("name", ["op12_secret_scan", "op13_conversation_trie"])
def test_as_sql_says(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) and rows(got) == rows(duck(sf_dir).execute(oracles.ORACLES[name]).df())
