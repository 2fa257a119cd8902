"""Literal cases with values worked out by hand or by plain Python."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import text as T
from docloom.functions import typing as Y
from docloom.functions import vectors as V
from docloom.functions.encode import to_markdown, to_toon
from docloom.operators import mentions as M
from docloom.operators import regions as R


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return row.select(column.alias("x")).first()["x"]


def texts(spark, f, text):
    return [m["text"] for m in one(spark, f(F.col("t")), t=text)]


def test_money(spark):
    found = one(spark, M.money(F.col("t")), t="Revenue rose to $4.5 billion from $300 million; fee $20.")
    assert [(m["text"], m["label"]) for m in found] == [("$4.5 billion", "money_billion"), ("$300 million", "money_million"), ("$20", "money_dollar")]


def test_dates(spark):
    found = one(spark, M.dates(F.col("t")), t="In Q3 2023 and FY 2024, between 2019-2021, on March 5, 2022 and Jan 2020.")
    kinds = {}
    for m in found:
        kinds.setdefault(m["label"], set()).add(m["text"])
    assert kinds["quarter"] == {"Q3 2023"} and kinds["fiscal_year"] == {"FY 2024"} and kinds["year_range"] == {"2019-2021"}
    assert kinds["full_date"] == {"March 5, 2022"} and kinds["month_year"] == {"Jan 2020"} and kinds["year"] == {"2023", "2024", "2019", "2021", "2022", "2020"}


def test_percentages(spark):
    assert texts(spark, M.percentages, "Up +12.5%, down -3%, flat 0%") == ["+12.5%", "-3%", "0%"]


def test_metrics(spark):
    assert texts(spark, M.metrics, "Total Cost: 1,250.50 and Rate: 7; 300 pages") == ["Total Cost: 1,250.50", "pages: 300"]


def test_organisations(spark):
    assert texts(spark, M.organisations, "We met Acme Widgets Inc. and Blue Sky Group today")[:2] == ["Acme Widgets Inc", "Blue Sky Group"]


def test_hyphen_terms_and_processes(spark):
    assert texts(spark, M.hyphen_terms, "state-of-the-art and re-do co-op") == ["state-of-the-art"]
    assert texts(spark, M.processes, "Government running a creation, training; the movement") == ["running", "training", "creation", "government", "movement"]


def test_readability(spark):
    r = one(spark, T.readability("t"), t="The cat sat. It was done.")
    assert (r["words"], r["sentences"], r["syllables"]) == (6, 2, 7) and r["flesch"] == pytest.approx(1.0509, abs=1e-4)


def test_quality_text(spark):
    assert [one(spark, R.is_quality_text(F.col("t")), t=t) for t in ("aaaaaaaaaaaa", "abc", "abc" * 200, "ab")] == [False, True, False, False]


def test_similar_text():
    assert R.similar_text("the quick brown fox jumps", "the quick brown fox jumped")
    assert not R.similar_text("abcdefghij", "abcdefghxy")


def test_types(spark):
    kinds = [one(spark, Y.map_entity_type(F.col("l"), F.col("t"), F.lit("")), l=a, t=b) for a, b in (("technology", "x"), ("language", "x"), ("research", "x"), ("zzz", "2023"), ("zzz", "12%"), ("zzz", "docker"), ("zzz", "thing"))]
    assert kinds == ["PRODUCT", "TECHNICAL_TERM", "CONCEPT", "DATE_TIME", "PERCENTAGE", "PRODUCT", "CONCEPT"]
    assert [one(spark, Y.map_relation(F.col("l")), l=a) for a in ("cites", "works for", "foo bar")] == ["REFERENCES", "WORKS_FOR", "FOO_BAR"]


def test_vectors(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ((1, 0), (1, 1), (0, 0)))
    assert one(spark, V.cosine(a, b)) == pytest.approx(0.707107, abs=1e-6) and one(spark, V.cosine(a, z)) == 0
    assert one(spark, V.sparse(F.array(F.lit(0.1), F.lit(-0.9), F.lit(0.5)), 2)) == [0.0, -0.9, 0.5]
    assert sum(x * x for x in one(spark, V.hashed(F.lit("word"), 16))) == pytest.approx(1)


def test_boxes(spark):
    b = G.box(0.0, 0.0, 0.5, 0.2)
    assert one(spark, G.area(b)) == pytest.approx(0.1) and one(spark, G.intersects(b, G.box(0.5, 0.2, 1, 1)))
    assert one(spark, G.position_label(b, G.box(0, 0.5, 1, 1))) == "above"


def test_context(spark):
    assert one(spark, T.compress_context("t", 20), t="x" * 100) == "x" * 80 + "..."
    assert one(spark, T.prepare("t"), t="a  b , c\n\n1.x •y") == "a b, c 1. x • y"


SEEDS = {
    1: "What is the main topic?|Who is the author?|Define the term|When was this published?|List the key points|What are the main entities?|Which method is used?|Name the components",
    2: "Why does this approach work better?|How do these components interact?|Explain the relationship between X and Y|Analyze the impact of this decision|What causes this effect?",
    3: "Compare approach A versus approach B|What are the differences between these methods?|Summarize all the experiments|How do multiple papers address this problem?|Compare the results across all studies",
    4: "What does Figure 1 show?|Describe the chart on page 5|Explain the diagram|What is shown in the table?|Analyze the visualization|What trends appear in the plot?",
}


def test_query_levels(spark):
    rows = [(level, q) for level, qs in SEEDS.items() for q in qs.split("|")]
    df = spark.createDataFrame(rows, "level int, question string")
    assert df.where(Y.query_level(F.col("question")) != F.col("level")).count() == 0


def test_encoders():
    value = {"q": "a, b", "rows": [{"x": 1, "y": "u"}, {"x": 2, "y": "v"}], "tags": ["p", "q"]}
    assert to_toon(value) == 'q: "a, b"\nrows[2]{x,y}:\n  1,u\n  2,v\ntags[2]: p,q'
    assert "| x | y |" in to_markdown(value)
