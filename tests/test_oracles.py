"""Every query with SQL gives the rows of that SQL on the smallest test tables."""

import glob
import math
import os

import pytest

from gridproof.oracles import ORACLE_SQL
from gridproof.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    answer = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == columns
    kinds = {x[0]: str(x[1]) for x in answer.description}
    assert not {c for c, t in df.dtypes if not kinds[c].startswith(("NUMBER", "STRING", "bool")) and TYPES[t] != kinds[c]}
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=str)
    assert mine == theirs


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
