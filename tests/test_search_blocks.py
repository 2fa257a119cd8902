"""Searches and strategies of retrieval in bounded blocks, against plain Python."""

import random

import pytest

from docloom.operators import graph, retrieval, search

LETTERS = "abc"


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 7)))


def plan(df):
    return df._jdf.queryExecution().toString()


def compared(df):
    return "NestedLoopJoin" in plan(df) or "CartesianProduct" in plan(df)


@pytest.fixture(scope="module")
def layer(spark):
    rng = random.Random(3)
    rows = [(f"e{i}", (a := word(rng)) + (" " + word(rng) if i % 3 else ""), f"  {' '.join(word(rng) for _ in range(6))} {a}" if i % 5 else None, "T", rng.randint(1, 9), rng.choice([0.5, 0.75, 0.8]), (i % 7, i)) for i in range(200)]
    asked = [(1, ""), (2, None), (3, " "), (4, rows[7][1].upper()), (5, " ".join(rows[11][2].split()[1:5])), (6, "ab\ncabca  b")] + [(i, " ".join(word(rng) for _ in range(rng.randint(1, 6)))) for i in range(7, 60)]
    frame = spark.createDataFrame(rows, "entity_id string, name string, description string, entity_type string, mention_count long, confidence double, ord struct<doc_id:long,ord:long>")
    return rows, asked, frame, spark.createDataFrame(asked, "query_id long, question string")


def best_entities(rows, asked, k):
    out = set()
    for query_id, question in asked:
        q, ws, scored = (question or "").lower().strip(" "), list(dict.fromkeys((question or "").lower().split())), []
        for e, name, about, _, n, confidence, ord_ in rows:
            about = about or ""
            w = set(name.split()) | set(about.split())
            if question is None:
                continue
            if q in name or q in about:
                base = 1.0 if q == name else 0.9 if q in name else 0.7
            elif w & set(ws):
                base = len(w & set(ws)) / len(ws) * 0.6
            else:
                base = 0.4 if any(len(x) > 3 and (x in name or x in about) for x in ws) else 0
            if (score := round(base * ((1 + min(n * 0.1, 0.5)) * confidence), 9)) > 0:
                scored.append((-score, ord_, e))
        out |= {(query_id, r, e, -s) for r, (s, _, e) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_entities_in_blocks(spark, layer, monkeypatch):
    monkeypatch.setattr(search, "ENTITY_BLOCK", (64, 16), raising=False)
    rows, asked, entities, questions = layer
    df = search.search_entities(questions, entities, 4)
    assert {(r["query_id"], r["rank"], r["entity_id"], r["score"]) for r in df.collect()} == best_entities(rows, asked, 4)
    assert not compared(df)
    assert search.search_entities(questions.where("query_id = 0"), entities).count() == 0 == search.search_entities(questions, entities.where("name = '-'")).count()


def corpus(spark, layer):
    rng = random.Random(5)
    rows, _, entities, _ = layer
    regions = spark.createDataFrame([(i % 9, i % 4, f"r{i}", "figure" if i % 5 == 0 else "paragraph", i, " ".join(word(rng) for _ in range(12))) for i in range(150)], "doc_id long, page_num int, region_id string, block_type string, ord long, text string")
    relations = sorted({(f"e{rng.randint(0, 199)}", f"e{rng.choice([1, 2, rng.randint(0, 199)])}", rng.choice(["x", "y"]), rng.choice([0.3, 0.5, 0.9])) for _ in range(400)})
    relations = list({r[:3]: r for r in relations}.values())
    bridge = sorted({(rows[rng.choice([1, 2, 3, rng.randint(0, 199)])][0], f"r{rng.randint(0, 149)}", 0) for _ in range(400)})
    return retrieval.Corpus(regions, entities, spark.createDataFrame(relations, "source string, target string, rel_type string, weight double"), spark.createDataFrame(bridge, "entity_id string, region_id string, ord long")), relations, bridge


def test_lookup_builds_no_index_that_no_question_needs(spark, layer):
    c, _, _ = corpus(spark, layer)
    asked = retrieval.analyse(spark.createDataFrame([(1, "aabb abca bcab"), (2, "ccaa abab")], "query_id long, question string"))
    assert retrieval.entity_lookup(asked, c).count() > 0
    assert c.postings is None


def test_hybrid_relations_meet_by_both_ends(spark, layer):
    c, relations, _ = corpus(spark, layer)
    found = {1: ["e1", "e2", "e3"], 2: ["e2", "e5"]}
    frame = spark.createDataFrame([(q, e) for q, es in found.items() for e in es], "query_id long, entity_id string")
    got = {(r["query_id"], r["source"], r["target"], r["rel_type"]) for r in retrieval._relations_of(frame, c.relations, 10, 3).collect()}
    want = set()
    for q, es in found.items():
        scored = sorted((-w * (1.0 if s in es and t in es else 0.7), s, t, k) for s, t, k, w in relations if s in es or t in es)[:10]
        want |= {(q, s, t, k) for _, s, t, k in scored}
    assert got == want
    starts = frame.withColumnRenamed("entity_id", "node")
    steps = {(r["start"], r["node"]): r["hop"] for r in graph.k_hops(c.relations, starts, 2).collect()}
    around = {}
    for r in retrieval._around(frame, c, 20).collect():
        around.setdefault(r["query_id"], {})[r["entity_id"]] = r["hop"]
    place = {e[0]: (e[6], e[0]) for e in layer[0]}
    for q, es in found.items():
        hops = {e: 0 for e in es}
        for (s, n), hop in steps.items():
            if s in es and n not in es:
                hops[n] = min(hop, hops.get(n, 9))
        first = lambda h: sorted(h.items(), key=lambda x: (x[1], place[x[0]]))[:20]
        assert first(around[q]) == first(hops)


def test_hierarchical_takes_no_regions_beyond_the_budget(spark, layer):
    c, _, bridge = corpus(spark, layer)
    found = spark.createDataFrame([(1, "e1", 1), (1, "e2", 2), (1, "e3", 3), (2, "e3", 1)], "query_id long, entity_id string, rank int")
    text = {r["region_id"]: r["text"] for r in c.regions.collect()}
    got = {}
    for r in retrieval._held_regions(found, c, 60).collect():
        got.setdefault(r["query_id"], set()).add((r["rank"], r["region_id"]))
    for q, es in {1: ["e1", "e2", "e3"], 2: ["e3"]}.items():
        ranks = {}
        for rank, e in enumerate(es, 1):
            for b in bridge:
                if b[0] == e:
                    ranks.setdefault(b[1], rank)
        first, used = [], 0
        for row in sorted((r, x) for x, r in ranks.items()):
            if used < 60:
                first.append(row)
                used += len(text[row[1]]) // 4
        assert sorted(got[q])[: len(first)] == first and len(got[q]) < len(ranks) + (q == 2)


def test_all_levels_run_only_where_they_are_asked(spark, layer, monkeypatch):
    c, _, _ = corpus(spark, layer)

    def refuse(asked, corpus):
        raise AssertionError("no question is of this level")

    monkeypatch.setitem(retrieval.STRATEGIES, "hybrid", refuse)
    monkeypatch.setitem(retrieval.STRATEGIES, "hierarchical", refuse)
    asked = spark.createDataFrame([(1, "aabb abca", 1)], "query_id long, question string, override_level int")
    assert {r["query_id"] for r in retrieval.retrieve(asked, c).collect()} == {1}
    assert retrieval.retrieve(asked.where("query_id = 0"), c).count() == 0


def test_visual_fusion_limits_regions_before_questions(spark, layer):
    c, _, _ = corpus(spark, layer)
    asked = retrieval.analyse(spark.createDataFrame([(1, "figure of aabb", 4), (2, "see page 1 and page 3", 4)], "query_id long, question string, override_level int"))
    df = retrieval.visual_fusion(asked, c, 7)
    got = {q: {(r["rank"], r["ref"]) for r in df.where(f"query_id = {q} AND kind = 'region'").collect()} for q in (1, 2)}
    rows = [(r["doc_id"], r["ord"], r["region_id"], r["block_type"], r["page_num"]) for r in c.regions.collect()]
    want = {1: sorted(r for r in rows if r[3] == "figure"), 2: sorted(r for r in rows if r[4] in (1, 3))}
    assert got == {q: {(i, r[2]) for i, r in enumerate(v[:7], 1)} for q, v in want.items()}
    assert "GlobalLimit" in plan(df) or "TakeOrdered" in plan(df)


@pytest.mark.parametrize("name", ["entity_ranking", "entity_search"])
def test_only_entities_are_written(spark, name, monkeypatch):
    from docloom.plans import queries

    written, put = [], queries.materialise
    monkeypatch.setattr(queries, "materialise", lambda df, name: written.append(name) or put(df, name))
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert written == ["entities"] and not compared(df)


def test_relations_are_made_only_where_they_are_read(spark, monkeypatch, tmp_path):
    from docloom.plans import engine

    written, put = [], engine.materialise
    monkeypatch.setattr(engine, "materialise", lambda df, name: written.append(name) or put(df, name))
    docs = spark.createDataFrame([(1, "The API of NASA uses JSON.\nESA and NASA use XML in the figure."), (2, "NASA and ESA have an API for JSON files.")], "doc_id long, text string")
    e = engine.Engine(spark).index(docs)
    asked = spark.createDataFrame([(1, "figure of NASA", 4)], "query_id long, question string, override_level int")
    assert e.retrieve(asked).count() == 1
    assert not {"relationships", "entity-region"} & set(written)
    assert e.retrieve(asked.withColumn("override_level", asked.query_id.cast("int"))).count() == 1
    assert written.count("relationships") == written.count("entity-region") == 1
    e.save(str(tmp_path / "g"))
    assert engine.Engine(spark).load(str(tmp_path / "g")).tables["relationships"].count() == e.tables["relationships"].count() == len(e.tables.get("relationships").collect())


def test_entity_hits_are_numbers_until_they_are_shown(spark, layer):
    _, _, entities, questions = layer
    meet = [line for line in search.search_entities(questions, entities, 4)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "FlatMapCoGroupsInArrow" in line]
    assert len(meet) == 1 and "_n#" in meet[0] and "entity_id" not in meet[0] and "name" not in meet[0]


def test_large_blocks_move_few_copies(spark, layer, monkeypatch):
    rows, asked, entities, questions = layer
    monkeypatch.setattr(search, "LEAST_CELL", 8)
    df = search.search_entities(questions, entities, 4)
    assert {(r["query_id"], r["rank"], r["entity_id"], r["score"]) for r in df.collect()} == best_entities(rows, asked, 4)
    assert search.ENTITY_BLOCK[0] * search.ENTITY_BLOCK[1] >= 1 << 28


def test_regions_of_equal_text_and_entities_meet_questions_once(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(word(rng) for _ in range(6)) for _ in range(12)]
    rows = [(i % 9, f"r{i:03}", 300 - i, texts[rng.randrange(12)] if i % 50 else None) for i in range(300)]
    bridge = sorted({(f"e{rng.randrange(4)}", f"r{rng.randrange(300):03}") for _ in range(40)})
    asked = [(i, " ".join(word(rng) + "ab" for _ in range(rng.randint(1, 5)))) for i in range(40)]
    found = [(i, f"e{rng.randrange(4)}") for i in range(0, 40, 2)] + [(i, "e9") for i in range(0, 40, 3)]
    met, meet = [], search._meet
    monkeypatch.setattr(search, "_meet", lambda asked, pool, *rest: met.append(pool.count()) or meet(asked, pool, *rest))
    frame = spark.createDataFrame(rows, "doc_id long, region_id string, ord long, text string")
    df = search.rank_regions(spark.createDataFrame(asked, "query_id long, question string"), frame, 3, spark.createDataFrame(found, "query_id long, entity_id string"), spark.createDataFrame(bridge, "entity_id string, region_id string"))
    want = set()
    for query_id, question in asked:
        ws = list(dict.fromkeys(w for w in question.split() if len(w) > 3))
        scored = []
        for doc_id, region_id, ord_, text in rows:
            if n := sum(any(w in own for own in (text or "").split()) for w in ws):
                near = sum((e, region_id) in bridge for q, e in found if q == query_id)
                scored.append((-min(1.0, n / len(ws) + min(0.5, near * 0.1)), doc_id, ord_, region_id, n))
        want |= {(query_id, i, r, n, round(-s, 9)) for i, (s, _, _, r, n) in enumerate(sorted(scored)[:3], 1)}
    assert {(r["query_id"], r["rank"], r["region_id"], r["matches"], round(r["score"], 9)) for r in df.collect()} == want
    own = {r: tuple(sorted(e for e, x in bridge if x == r)) for _, r, _, _ in rows}
    assert met == [len({(text, own[r]) for _, r, _, text in rows})] and met[0] < len(rows) / 2


def test_relations_are_moved_as_numbers(spark):
    from docloom.plans import engine

    lists = zip("ABCDEF", "CDABEF", ("settle", "govern", "invest", "deploy", "docu", "treat"), strict=True)
    lines = [f"The {a}{b} and {b}{a} are processing {c}ment" for a, b, c in lists]
    docs = spark.createDataFrame([(i, "\n".join([f"{x} in {'2019 vs 2020' if i % 2 else '5%'}" for x in lines[i % 3 : i + 2]])) for i in range(6)], "doc_id long, text string")
    e = engine.Engine(spark).index(docs)
    names = [r["entity_id"] for r in e.tables["entities"].orderBy("entity_id").collect()]
    found = spark.createDataFrame([(q, n) for q in range(6) for n in names[q::5]], "query_id long, entity_id string")
    rows = lambda df: {(r["query_id"], r["rank"], r["source"], r["target"], r["rel_type"], r["score"]) for r in df.collect()}
    got = rows(e.corpus().related(found, 10, 5))
    assert got and got == rows(retrieval._relations_of(found, e.tables["relationships"], 10, 5))
    kinds = dict(e.tables.numbered["relations"].dtypes)
    assert kinds["source"] == kinds["target"] == "bigint" and dict(e.tables["relationships"].dtypes)["source"] == "string"


def test_text_index_shuffles_terms_once(spark):
    regions = spark.createDataFrame([(i % 4, f"r{i}", "alpha beta gamma alpha delta" if i % 3 else f"beta number{i} beta gamma") for i in range(12)], "doc_id long, region_id string, text string")
    postings, vocabulary = search.build_text_index(regions, 5)
    # terms of equal totals come by name: "alpha beta" is the fifth
    assert {(r["term"], r["df"]) for r in vocabulary.collect()} == {("alpha", 8), ("beta", 12), ("gamma", 12), ("beta gamma", 12), ("alpha beta", 8)}
    shuffles = [line for line in postings._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "term" not in shuffles[0].split("ENSURE")[0]
