"""The search of vectors: against its SQL on odd rows, and without comparing row by row."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import search
from docloom.plans import queries


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(20, [1.0, 0.0, 0.0])] + [(i, [1.0, 1e-4 * (30 - i) / 30, 0.0]) for i in range(21, 40)] + [(40, [-1.0, 0.5, 2.0]), (41, None), (60, [0.25, 0.25, -3.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def expected(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    return sorted(con.execute(queries.SQL[name]).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["knn_cosine", "knn_threshold"])
def test_rounded_scores_are_ranked(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == expected(folder, name)
    assert "NestedLoopJoin" not in plan(df) and "CartesianProduct" not in plan(df)


def test_odd_vectors(spark):
    pool = spark.createDataFrame([("a", [3.0, 4.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0, None]), ("e", [1.0]), ("7", [4.0, 3.0])], "id string, vector array<double>")
    asked = spark.createDataFrame([(7, [4.0, 3.0]), (8, None)], "query_id long, vector array<double>")
    found = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in search.nearest_vectors(asked, pool, 5, digits=6).collect()}
    assert [found[7, i] for i in range(1, 6)] == [("a", 0.96), ("e", 0.8), ("c", 0.0), ("b", None), ("d", None)]
    assert [found[8, i] for i in range(1, 6)] == [(x, None) for x in "7abcd"]
    empty = pool.where("id = 'none'")
    assert search.nearest_vectors(asked, empty, 5).count() == 0 == search.nearest_vectors(asked.where("query_id = 0"), pool, None, 0.1).count()


def test_all_hits_stream_past_the_questions(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in (rng.normal(size=5) + 1.5) * 10.0 ** rng.choice([-120, 0, 3])]) for i in range(60)]
    rows += [(60, None), (61, [0.0] * 5), (62, [1.0, None, 1.0, 1.0, 1.0]), (63, [float("nan")] * 5), (64, [1e200] * 5), (65, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = frame.where("id % 4 = 0 OR id > 59").withColumnRenamed("id", "query_id")
    want = sorted(map(repr, (tuple(r) for r in search.nearest_vectors(asked, frame, 1000, 0.6, 6).select("query_id", "id", "score").collect())))
    for name, value in {"HIT_CELL": 7, "HIT_GROUP": 9, "HIT_PRODUCT": 3, "HITS": 5}.items():
        monkeypatch.setattr(search, name, value)
    df = search.nearest_vectors(asked, frame, None, 0.6, 6)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == want and len(want) > 100
    names = frame.select(F.concat(F.lit("n"), "id").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    named = search.nearest_vectors(asked, names, None, 0.6, 2)
    assert named.where("id = 'n61' AND query_id < 60").count() == 0 < named.where("query_id = 4 AND id = 'n4'").count()
    assert "FlatMapCoGroups" not in plan(df)  # no block's hits are held at once
