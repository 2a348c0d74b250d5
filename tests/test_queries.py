"""Every query with SQL equals DuckDB on the smallest tables; the others run."""

import os

import duckdb
import pytest

from tessella import catalogue
from tessella.cli import main as cli

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{DATA}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    got = catalogue.queries()[name](spark, DATA)
    want = con.execute(catalogue.oracle_sql()[name])
    assert normal(got.columns, got.collect()) == normal([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert len(catalogue.queries()[name](spark, DATA).take(1)) == 1


def test_set_solvers_agree(spark):
    q = catalogue.queries()
    a = {(r.query_id, r.id): r.dist for r in q["set_emd"](spark, DATA).collect()}
    b = {(r.query_id, r.id): r.dist for r in q["set_myemd"](spark, DATA).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 2e-6 for k in a)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_bytes(b"abc" * 4000)
    assert cli(["compress", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-v"]) == 0
    assert "Chunks:" in capsys.readouterr().out
    assert cli(["restore", "-i", str(tmp_path / "out"), "-o", str(tmp_path / "back")]) == 0
    assert bytes(spark.read.parquet(str(tmp_path / "back")).first().content) == b"abc" * 4000
    assert cli(["queries"]) == 0 and cli(["generate", "-o", str(tmp_path / "text"), "--lines", "5"]) == 0
    assert cli(["matrix", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "m"), "--windows", "32", "--repeat", "1"]) == 0
