"""Small tables against plain Python."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import budget, entities, graph, mentions, pixels, regions, search, spatial
from docloom.plans.engine import Config, Engine, deep_merge
from docloom.sources import files
from docloom.sources import regions as S

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
REGION = f"doc_id long, page_num int, ord long, region_id string, block_type string, bbox {BOX}, text string, token_count int"


def page(spark, rows):
    return spark.createDataFrame([(1, 0, i, n, kind, box, text, 1) for i, (n, kind, box, text) in enumerate(rows)], REGION)


def pairs(df):
    return {(r["source"], r["target"]) for r in df.collect()}


def test_adjacency(spark):
    n = page(spark, [("A", "paragraph", (0.0, 0.0, 1.0, 0.1), "a"), ("B", "paragraph", (0.0, 0.15, 1.0, 0.3), "b")])
    row = spatial.vertical_edges(n).first()
    assert (row["source"], row["target"]) == ("A", "B") and row["weight"] == pytest.approx(0.851064, abs=1e-6)
    h = page(spark, [("A", "paragraph", (0.0, 0.0, 0.45, 0.5), "a"), ("B", "paragraph", (0.5, 0.0, 1.0, 0.5), "b")])
    assert pairs(spatial.horizontal_edges(h)) == {("A", "B")}


def test_caption_and_hierarchy(spark):
    around = lambda x, y: (x - 0.01, y - 0.01, x + 0.01, y + 0.01)
    n = page(spark, [("f", "figure", around(0.5, 0.4), ""), ("c1", "caption", around(0.5, 0.55), ""), ("c2", "caption", around(0.5, 0.5), ""), ("c3", "caption", around(0.9, 0.45), "")])
    assert spatial.figure_captions(n).first()["caption_id"] == "c2"
    t = page(spark, [("h", "header", around(0.5, 0.1), "")] + [(f"p{i}", "paragraph", around(0.5, 0.2 + i / 10), "") for i in range(5)])
    assert pairs(spatial.hierarchical_edges(t)) == {("h", "p0"), ("h", "p1"), ("h", "p2")}


def test_merge_and_relations(spark):
    kind = "doc_id long, page_num int, region_id string, block_type string, bbox " + BOX + ", text string, norm string, label string, start int, ord long, context string, entity_type string, confidence double"
    rows = [(1, p, r, "paragraph", None, n.upper(), n, "x", 0, i, n, "CONCEPT", c) for i, (n, r, p, c) in enumerate([("a", "r1", 2, 0.9), ("a", "r2", 1, 0.6), ("a", "r3", 2, 0.9), ("b", "r1", 2, 1.0), ("b", "r2", 1, 1.0), ("b", "r3", 2, 1.0)])]
    found = spark.createDataFrame(rows, kind)
    e = entities.merge_entities(found)
    a = e.join(entities.entity_details(found), "norm").where("norm = 'a'").first()
    assert a["mention_count"] == 3 and a["confidence"] == pytest.approx(0.8) and [p["page_num"] for p in a["pages"]] == [1, 2] and a["regions"] == ["r1", "r2", "r3"]
    assert entities.cooccurrences(entities.entity_regions(e, found)).first()["weight"] == pytest.approx(0.6)
    assert entities.entity_pages(e, found).where("block_types[0] = 'paragraph'").count() == 4


def test_relation_dedup(spark):
    rel = spark.createDataFrame([("a", "b", "x", 0.3, 1), ("a", "b", "x", 0.8, 2), ("b", "a", "x", 0.5, 3)], "source string, target string, rel_type string, weight double, ord int")
    assert {(r["source"], r["target"], r["weight"]) for r in entities.unique_relations(rel).collect()} == {("a", "b", 0.8), ("b", "a", 0.5)}


def test_hops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "source string, target string")
    found = graph.k_hops(edges, spark.createDataFrame([("a",)], "node string"), 2)
    assert {(r["node"], r["hop"]) for r in found.collect()} == {("b", 1), ("c", 2)}


def test_search_scores(spark):
    e = spark.createDataFrame([("e1", "apache spark", "", 2, 0.8, 1, "PRODUCT")], "entity_id string, name string, description string, mention_count int, confidence double, ord int, entity_type string")
    q = spark.createDataFrame([(1, "spark"), (2, "apache is fast")], "query_id long, question string")
    got = {r["query_id"]: r["score"] for r in search.search_entities(q, e).collect()}
    assert got[1] == pytest.approx(0.864) and got[2] == pytest.approx(1 / 3 * 0.6 * 1.2 * 0.8)


def test_budgets(spark):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([4, 5, 3, 1])], "g int, id int, tokens long")
    take = lambda d: [r["id"] for r in d.orderBy("id").collect()]
    assert take(budget.before_overflow(df, 10, ("g",), ("id",))) == [0, 1]
    assert take(budget.until_reached(df, 10, ("g",), ("id",))) == [0, 1, 2]
    assert take(budget.skipping(df, 10, ("g",), ("id",))) == [0, 1, 3]


def test_sections_and_lines(spark):
    docs = spark.createDataFrame([(1, "# T\n\nAbstract: x\n\na | b"), (2, None)], "doc_id long, text string")
    rows = S.regions_from_sections(docs).orderBy("ord").collect()
    assert [(r["block_type"], r["bbox"]["y1"]) for r in rows] == [("header", 50), ("abstract", 170), ("table", 290)]
    lines = S.regions_from_lines(spark.createDataFrame([(1, "# T\n\n- i\np")], "doc_id long, text string")).orderBy("ord").collect()
    assert [(r["block_type"], r["bbox"]["y1"]) for r in lines] == [("header", 50), ("list", 120), ("paragraph", 160)]


def test_tagged_output(spark):
    raw = "<|ref|>one<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|><|ref|>two<|/ref|>"
    got = spark.createDataFrame([(raw,)], "t string").select(S.parse_tagged_output(F.col("t")).alias("s")).first()["s"]
    assert [(s["text"], s["bbox"]) for s in got] == [("one", [1, 2, 3, 4]), ("two", None)]


def test_greedy_regions(spark):
    n = page(spark, [("a", "p", (0.0, 0.0, 1.0, 1.0), "the quick brown fox jumps"), ("b", "p", (0.0, 0.0, 1.0, 1.0), "the quick brown fox jumped"), ("c", "p", (0.0, 0.0, 1.0, 1.0), "another text altogether")])
    assert {r["region_id"] for r in regions.near_unique(n).collect()} == {"a", "c"}
    boxes = page(spark, [("a", "p", (0.0, 0.0, 1.0, 1.0), ""), ("b", "p", (0.1, 0.1, 0.9, 0.9), ""), ("c", "p", (5.0, 5.0, 6.0, 6.0), "")])
    assert [r["merged"] for r in regions.merge_overlaps(boxes).orderBy("ord").collect()] == [2, 1]


def test_merge_runs(spark):
    kind = f"doc_id long, ord int, kind string, text string, bbox {BOX}, confidence double"
    rows = [(1, 0, "p", "a", (0.0, 0.0, 1.0, 1.0), 1.0), (1, 1, "p", "b", (0.0, 200.0, 1.0, 201.0), 0.5), (1, 2, "q", "c", (0.0, 900.0, 1.0, 901.0), 1.0)]
    got = regions.merge_runs(spark.createDataFrame(rows, kind)).orderBy("ord").collect()
    assert [(r["text"], r["confidence"]) for r in got] == [("a b", 0.75), ("c", 1.0)]


def test_engine_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# NASA report\n\nNASA uses IBM machines for training.\nThe IBM Group improves processing.")], "doc_id long, text string")
    engine = Engine(spark, Config.merged({"formatter": "json", "other": 1})).index(docs)
    engine.save(str(tmp_path / "g"))
    again = Engine(spark).load(str(tmp_path / "g"))
    q = spark.createDataFrame([(1, "What is NASA?"), (2, "Compare IBM versus NASA"), (3, "Why IBM?"), (4, "Explain the chart")], "query_id long, question string")
    got = {r["query_id"]: r["context"] for r in again.retrieve(q).collect()}
    assert "NASA" in got[1] and "NASA" in got[2]
    assert "NASA" in engine.ask("What is NASA?")
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_stream(spark, tmp_path):
    from docloom.streaming.incremental import SCHEMA, document_stream, index_stream, indexed_entities

    spark.createDataFrame([(1, "NASA and IBM met.", "en", "s", 17)], SCHEMA).write.parquet(str(tmp_path / "in"))
    index_stream(document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {"nasa", "ibm"} <= {r["norm"] for r in indexed_entities(spark, str(tmp_path / "out")).collect()}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo\fthree")
    got = files.scan_documents(spark, str(tmp_path), start=1, end=3).orderBy("page_num").collect()
    assert [(r["page_num"], r["text"]) for r in got] == [(1, "two"), (2, "three")]
    assert files.document_info(spark, str(tmp_path)).first()["num_pages"] == 3
    with pytest.raises(ValueError):
        files.scan_documents(spark, str(tmp_path), start=2, end=2)


def test_pixels(spark):
    import numpy as np

    image = np.full((40, 40), 255.0)
    image[10:25, 5:35] = 0
    assert pixels.line_runs(image) == [(10, 25)] and pixels.crop(image, 0, 0, 0, 0).shape == (1, 1)
    row = pixels.image_figures(spark.createDataFrame([(1, bytearray(image.astype("uint8").tobytes()), 40, 40)], "image_id long, data binary, width int, height int")).first()
    assert row["lines"] == 1 and len(row["embedding"]) == 512


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "query_id"


def test_fuzzy_mentions(spark):
    m = spark.createDataFrame([(1, "nasa", "x", 0.9, 1), (1, "nasa report", "x", 0.8, 2), (1, "ibm", "x", 0.7, 3)], "doc_id long, norm string, label string, confidence double, ord long")
    assert {r["norm"] for r in mentions.fuzzy_unique(m).collect()} == {"nasa", "ibm"}


def test_searches_without_a_cap(spark, tmp_path):
    from docloom.plans import queries

    vectors = spark.createDataFrame([(i, [1.0, i % 7 - 3.0]) for i in range(101)], "id long, vector array<float>")
    asked = vectors.where("id = 50").withColumnRenamed("id", "query_id")
    found = search.nearest_vectors(asked, vectors, None, 0.3)
    assert found.columns == ["query_id", "id", "score"]
    assert {r["id"] for r in found.collect()} == {r["id"] for r in search.nearest_vectors(asked, vectors, 100).where("score >= 0.3").collect()} != set()
    texts = spark.createDataFrame([(i, "r", f"solar panel number {i} on a roof") for i in range(30)], "doc_id long, region_id string, text string")
    hits = search.search_text_index(spark.createDataFrame([(1, "solar panel")], "query_id long, question string"), *search.build_text_index(texts), None, 0.0)
    assert hits.columns == ["query_id", "doc_id", "region_id", "score"] and hits.count() == 30
    vectors.selectExpr("id AS vec_id", "vector AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    texts.selectExpr("doc_id AS item_id", "text").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, "user", "solar panel")], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for q in (queries.knn_threshold, queries.tfidf_search):
        df = q(spark, str(tmp_path))
        assert df.count() > 0 and "row_number" not in df._jdf.queryExecution().toString()


def test_region_likeness(spark):
    from pyspark.sql import functions as F

    box = lambda x: (x, 0.1, x + 0.2, 0.3)
    plain = page(spark, [("A", "table", box(0.1), "one two"), ("B", "table", box(0.1), "one two"), ("C", "figure", box(0.7), "three")]).withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    probe = plain.where("region_id = 'A'").withColumn("query_id", F.lit(1))
    found = {r["region_id"]: r["score"] for r in search.similar_regions(probe, plain, least=0.0).collect()}
    assert found["B"] == pytest.approx(0.4 + 0.2 + 0.2 + 0.15 + 0.05 * 0.5) and found["C"] < found["B"]
    assert [r["region_id"] for r in search.similar_regions(probe, plain, least=0.0, same_type=True).collect()] == ["B"]
    quality = F.when(F.col("region_id") == "A", 0.8).otherwise(0.4)
    looks = plain.withColumn("visual_complexity", F.lit(0.5)).withColumn("text_to_visual_ratio", F.lit(1.0)).withColumn("quality_metrics", F.create_map(F.lit("overall"), quality))
    measured = search.similar_regions(looks.where("region_id = 'A'").withColumn("query_id", F.lit(1)), looks, least=0.0, measured=True)
    assert measured.where("region_id = 'B'").first()["score"] == pytest.approx(0.95 + 0.05 * 0.5)


def test_extraction_backends(spark):
    r = page(spark, [("A", "paragraph", (0.0, 0.0, 1.0, 0.1), "NASA launched")])
    mentions.register_extractor("none", lambda regions: mentions.extract_mentions(regions).limit(0))
    assert mentions.extracted(r, "none").count() == 0 < mentions.extracted(r, "unknown").count() == mentions.extracted(r).count()
