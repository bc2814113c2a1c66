"""Every query of the catalogue against SQL, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__
from sparklog import parse
from sparklog import queries as catalogue
from sparklog.terms import Kind

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, tiny, name):
    df = catalogue.queries()[name](spark, tiny)
    expected = duck.sql(catalogue.SQL[name])
    columns = sorted(expected.columns)
    assert sorted(df.columns) == columns
    places = [expected.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in places) for r in expected.fetchall())


def test_proof_query(spark, tiny):
    lines = [r["line"] for r in catalogue.queries()["q33_proof"](spark, tiny).orderBy("step").collect()]
    assert len(lines) == 5 and lines[0].startswith("local(") and {c.kind for c in parse(" ".join(x.replace(" % from a source", "") for x in lines))} == {Kind.ASSERT}


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["c0", "c1"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
