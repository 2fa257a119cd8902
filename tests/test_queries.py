"""Every query against its SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="no tables")


def plain(value):
    if type(value).__name__ == "Decimal":
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value) if type(value).__name__ in ("datetime", "Timestamp") else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    found = duck.execute(entry.oracle_sql()[name])
    expected = rows([d[0] for d in found.description], found.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected
