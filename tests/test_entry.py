from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__
from lexcheck import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
#: All that SQL can say.
CHECKED = [*queries.SQL]


def compare(frame, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(sql)
    columns = sorted(frame.columns)
    assert sorted(want.columns) == columns
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    rows = lambda found, names: sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found), key=str)
    assert rows([tuple(r) for r in frame.collect()], frame.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    compare(queries.QUERIES[name](spark, DATA), queries.SQL[name])


def test_registry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert not __spark_entry__.entry(spark).isEmpty()
