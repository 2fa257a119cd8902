"""Queries against their SQL on rows that the given tables don't have."""

import duckdb
import pytest

import __spark_entry__ as entry
from test_queries import rows


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    expected = rows([d[0] for d in found.description], found.fetchall())
    df = entry.queries()[name](spark, str(folder))
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected


def documents(spark, *texts):
    return spark.createDataFrame([(i, t, 60 if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")


def test_relations_that_a_text_states(spark, tmp_path):
    same(spark, tmp_path, "all_relations", documents=documents(spark, "NASA uses ESA data\nIBM vs NASA\nBMW", None, "", "# ESA\nIBM increases BMW"))


@pytest.mark.parametrize("name", ["compress_quantize", "mean_pooling"])
def test_odd_vectors(spark, tmp_path, name):
    nan, whole = float("nan"), [i / 3 for i in range(64)]
    vectors = [(1, whole, 0), (2, None, 0), (3, [None, *whole[1:]], 0), (4, [1.0] * 64, 1), (5, [nan, *whole[1:]], 2), (6, whole[:10], 3), (7, [*whole, 1.0], 4), (8, None, 5), (9, whole[::-1], None), (10, [None] * 64, 6)]
    same(spark, tmp_path, name, embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int"))


def test_odd_invoices(spark, tmp_path):
    from datetime import datetime

    day = datetime(1996, 2, 1)
    lines = [(1, 11, 1, 1.5, 0.05, day), (2, 12, 1, 2.5, 0.05, day), (3, 13, 1, -3.0, 0.05, day), (4, 14, 1, None, 0.05, day), (5, 15, 1, 7.0, None, day), (6, 16, 1, 8.0, 0.1, None), (7, None, 1, 9.0, 0.1, day), (None, 17, 1, 9.0, 0.1, day), (8, 18, 2, 9.0, 0.1, day), (2, 12, 1, 2.5, 0.05, day)]
    same(spark, tmp_path, "mentions_money", lineitem=spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_shipdate timestamp_ntz"))


def test_odd_texts(spark, tmp_path):
    texts = ["ßeta gamma delta", "İx y zed", "ΑΣ ΟΔΟΣ Σ", "a\x0bb c d e", "ŉa b c", "ﬁx it now", "ᾳb c d", None, "", " \t ", "é x é"]
    rows_ = [(3 * i + k, t, 60 if t is None else len(t)) for i, t in enumerate(texts) for k in range(3)] + [(100, "abc def ghi " * 20, -7), (101, "abc def", None)]
    same(spark, tmp_path, "text_places", documents=spark.createDataFrame(rows_, "doc_id long, text string, n_chars int"))
