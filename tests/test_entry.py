import os

import pytest

import __spark_entry__ as entry


def test_names_agree():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 90
    assert all(isinstance(s, str) and callable(queries[n]) for n, s in oracles.items())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the test tables aren't here")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "dist", "rank"]
