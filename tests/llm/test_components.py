"""Connected components in one task and in steps, and what near dedup joins with whole sets."""

import random

import pytest

from docloom.llm import components, neardup


def brute(edges):
    root = {}
    for u, v in edges:
        if None not in (u, v) and u != v:
            a, b = ([k for k, s in root.items() if x in s] for x in (u, v))
            merged = {u, v}.union(*(root.pop(k) for k in {*a, *b}))
            root[min(merged)] = merged
    return {(n, k) for k, s in root.items() for n in s}


EDGES = [(random.Random(i).randint(-40, 200), random.Random(-i - 1).randint(-40, 200)) for i in range(120)] + [(7, 7), (None, 3), (1000, 1001), (1001, 1000), (1000, 1001), *((i, i + 1) for i in range(2000, 2100))]


@pytest.mark.parametrize("few", [200_000, 0])
@pytest.mark.parametrize("edges", [EDGES, []])
def test_components_both_ways(spark, monkeypatch, few, edges):
    monkeypatch.setattr(components, "FEW", few)
    frame = spark.createDataFrame(edges, "u long, v long")
    assert {tuple(r) for r in components.connected_components(frame).collect()} == brute(edges)


def test_few_edges_take_no_steps(spark, monkeypatch):
    written, put = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: written.append(name) or put(df, name))
    components.connected_components(spark.createDataFrame(EDGES, "u long, v long"))
    assert written == ["edges", "components"]


def test_a_class_meets_its_set_once(spark, monkeypatch):
    plans, put = {}, neardup.materialise
    monkeypatch.setattr(neardup, "LARGE", 1)
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "materialise", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or put(df, name))
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[: 190 + i])) for i in range(4)]
    found = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(i, 0) for i in range(4)}
    above = plans["open-bands"].split("Join Inner, (node")[0]
    assert "Generate explode(_b" in above
