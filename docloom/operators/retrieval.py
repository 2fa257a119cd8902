"""Retrieval strategies over batches of questions.

A strategy returns context rows (query_id, part, rank, kind, ref, content, tokens): what goes into each
question's context, within its budget. Each is one plan for all questions of a level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import lexicon as L
from docloom.functions.text import token_estimate, words
from docloom.functions.typing import query_level
from docloom.operators.budget import before_overflow, until_reached
from docloom.operators.graph import undirected
from docloom.sources.store import at_once, sweep
from docloom.sources.store import compressed as materialise
from docloom.operators.search import _asked, append_missing, build_text_index, fuse_candidates, nearest_vectors, rank_entities, rank_regions, ranked, search_entities, search_text_index


@dataclass
class Corpus:
    """The tables that retrieval reads."""

    regions: DataFrame
    entities: DataFrame
    relations: DataFrame
    bridge: DataFrame
    captions: DataFrame | None = None
    postings: DataFrame | None = None
    vocabulary: DataFrame | None = None

    def index(self) -> tuple[DataFrame, DataFrame]:
        if self.postings is None:
            postings, vocabulary = build_text_index(self.regions)
            self.postings, self.vocabulary = materialise(postings, "postings"), vocabulary
            sweep(self.regions.sparkSession)
        return self.postings, self.vocabulary

    def related(self, found: DataFrame, most: int, nodes: int) -> DataFrame:
        """Per question the heaviest relations that touch its entities."""
        return _relations_of(found, self.relations, most, nodes)


def levels(spark) -> DataFrame:
    """The four levels of questions with their budgets."""
    return spark.createDataFrame(L.QUERY_LEVELS, "level int, name string, max_tokens int, max_nodes int, strategy string")


def analyse(queries: DataFrame) -> DataFrame:
    """Questions with level, budgets and strategy; ``override_level`` wins where it is given."""
    level = F.coalesce("override_level", query_level(F.col("question"))) if "override_level" in queries.columns else query_level(F.col("question"))
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, ("level", "name", "max_tokens", "max_nodes", "strategy"), strict=True)]) for row in L.QUERY_LEVELS])
    return queries.withColumn("_l", F.get(table, level - 1)).select("query_id", "question", "_l.*", F.size(words("question")).alias("word_count"))


def _rows(df: DataFrame, part: int, kind: str, ref, content) -> DataFrame:
    return df.select("query_id", F.lit(part).alias("part"), "rank", F.lit(kind).alias("kind"), ref.cast("string").alias("ref"), content.alias("content"), token_estimate(content).cast("long").alias("tokens"))


def _entity_rows(found: DataFrame, part: int = 0) -> DataFrame:
    return _rows(found, part, "entity", F.col("entity_id"), F.concat_ws(" ", "name", F.concat(F.lit("("), F.col("entity_type"), F.lit(")"))))


def _region_rows(found: DataFrame, regions: DataFrame, part: int, most: int = 100_000) -> DataFrame:
    return _rows(found.join(regions.select("region_id", "text"), "region_id"), part, "region", F.col("region_id"), F.substring("text", 1, most))


def _relations_of(found: DataFrame, relations: DataFrame, most: int, nodes: int, once: bool = False) -> DataFrame:
    """Per question the heaviest relations that touch its entities: both ends found, full weight; one, 0.7.

    Relations between found entities are looked up by both ends. Of the others an entity gives its
    heaviest: ``most``, and as many as the found entities (``nodes``) may have with it, so that none is missed.
    ``once``: the relations are known to hold each (source, target, rel_type) once.
    """
    f = found.select("query_id", "entity_id").distinct()
    each = relations if once else relations.groupBy("source", "target", "rel_type").agg(F.max("weight").alias("weight"))
    each = each.select("source", "target", "rel_type", "weight")
    ids = _asked(f.select("entity_id").distinct())
    inside = each
    for end in ("source", "target"):  # only relations between entities of some question are moved
        inside = inside.join(ids.withColumnRenamed("entity_id", end), end, "left_semi")
    pairs = f.withColumnRenamed("entity_id", "source").join(f.withColumnRenamed("entity_id", "target"), "query_id")
    both = pairs.join(inside, ["source", "target"]).select("query_id", "source", "target", "rel_type", "weight", F.col("weight").alias("score"))
    kinds = relations.select("rel_type").distinct().count()
    ends = each.select(F.col("source").alias("entity_id"), "*").unionByName(each.select(F.col("target").alias("entity_id"), "*"))
    asked = ends.join(ids, "entity_id", "left_semi")
    heavy = asked.withColumn("_r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("weight"), "source", "target", "rel_type"))).where(F.col("_r") <= most + 2 * (nodes + 1) * kinds)
    other = F.when(F.col("source") == F.col("entity_id"), F.col("target")).otherwise(F.col("source"))
    one = f.join(heavy.withColumn("other", other), "entity_id").join(f.select("query_id", F.col("entity_id").alias("other")), ["query_id", "other"], "left_anti")
    one = one.select("query_id", "source", "target", "rel_type", "weight", (F.col("weight") * 0.7).alias("score"))
    return ranked(both.unionByName(one), "score", most, "source", "target", "rel_type")


def _within_budget(rows: DataFrame, asked: DataFrame) -> DataFrame:
    limited = rows.join(F.broadcast(asked.select("query_id", "max_tokens")), "query_id")
    return until_reached(limited, "max_tokens", ("query_id",), ("part", "rank", "ref")).drop("before", "max_tokens")


def _by_index(poor: DataFrame, corpus: Corpus) -> DataFrame:
    """Regions by the text index, which is only built if there is a question for it."""
    poor = materialise(poor, "poor")
    if poor.isEmpty():
        fields = corpus.regions.schema
        kinds = {"query_id": poor.schema["query_id"].dataType, "doc_id": fields["doc_id"].dataType, "region_id": fields["region_id"].dataType}
        return poor.sparkSession.createDataFrame([], ", ".join([*[f"{c} {t.simpleString()}" for c, t in kinds.items()], "score double, rank int"]))
    return materialise(search_text_index(poor, *corpus.index()), "by-index")


def inferred_entities(region_hits: DataFrame, corpus: Corpus, known: DataFrame, most: int = 5) -> DataFrame:
    """Entities of found regions that are not found yet, at most ``most`` for a question."""
    near = region_hits.select("query_id", "region_id", F.col("rank").alias("region_rank")).join(corpus.bridge.select("region_id", "entity_id", "ord"), "region_id")
    once = near.groupBy("query_id", "entity_id").agg(F.min(F.struct("region_rank", "ord")).alias("o")).join(known.select("query_id", "entity_id"), ["query_id", "entity_id"], "left_anti")
    few = once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "entity_id"))).where(F.col("rank") <= most)
    return few.join(corpus.entities.select("entity_id", "name", "entity_type"), "entity_id").select("query_id", "entity_id", "name", "entity_type", "rank")


def _first_neighbours(corpus: Corpus, most: int) -> DataFrame:
    """(entity_id, node): the first ``most`` neighbours of each entity in the order of entities."""
    steps = undirected(corpus.relations).join(corpus.entities.select(F.col("entity_id").alias("neighbour"), "ord"), "neighbour").where(F.col("node") != F.col("neighbour"))
    few = steps.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("ord", "neighbour"))).where(F.col("_r") <= most)
    return few.select(F.col("node").alias("entity_id"), F.col("neighbour").alias("node"))


def _around(starts: DataFrame, corpus: Corpus, nodes: int) -> DataFrame:
    """(query_id, entity_id, hop): entities within two steps of the starts, of each question at least the first ``nodes`` by hop and order.

    An entity gives its first neighbours: ``nodes``, and as many as may be in the pool already. The second step is
    only made for questions that the first leaves with too few.
    """
    few = materialise(_first_neighbours(corpus, 2 * nodes + 10), "neighbours")
    start = starts.select("query_id", "entity_id").distinct()
    step = lambda front: front.join(few, "entity_id").select("query_id", F.col("node").alias("entity_id")).distinct()
    one = step(start).join(start, ["query_id", "entity_id"], "left_anti")
    pool = materialise(start.withColumn("hop", F.lit(0)).unionByName(one.withColumn("hop", F.lit(1))), "one-step")
    poor = pool.join(pool.groupBy("query_id").count().where(F.col("count") >= nodes), "query_id", "left_anti")
    two = step(poor.where("hop = 1").select("query_id", "entity_id")).join(pool, ["query_id", "entity_id"], "left_anti")
    return pool.unionByName(two.withColumn("hop", F.lit(2)))


def _held_regions(found: DataFrame, corpus: Corpus, most: int) -> DataFrame:
    """(query_id, region_id, rank): regions of found entities with the rank of the first that has them, as far as ``most`` tokens reach.

    An entity's regions are taken in order until they alone reach the budget, and entities until one before
    them does: what follows lies beyond the budget, whatever else is in the context.
    """
    tokens = corpus.regions.select("region_id", token_estimate(F.substring("text", 1, 100_000)).cast("long").alias("tokens"))
    asked = corpus.bridge.select("entity_id", "region_id").distinct().join(found.select("entity_id").distinct(), "entity_id", "left_semi").join(tokens, "region_id")
    near = materialise(until_reached(asked, most, ("entity_id",), ("region_id",)).select("entity_id", "region_id", "tokens"), "near")
    total = near.groupBy("entity_id").agg(F.sum("tokens").alias("total"))
    before = F.max("total").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    needed = found.select("query_id", "entity_id", "rank").join(total, "entity_id").withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < most)
    return needed.join(near.select("entity_id", "region_id"), "entity_id").groupBy("query_id", "region_id").agg(F.min("rank").alias("rank"))


def entity_lookup(asked: DataFrame, corpus: Corpus, nodes: int = 5) -> DataFrame:
    """Level 1: a few entities, their relations and regions; the text index where those are missing."""
    found, bridge = at_once(lambda: materialise(rank_entities(asked, corpus.entities, nodes), "found"), lambda: corpus.bridge)
    sweep(asked.sparkSession)

    def hits() -> tuple[DataFrame, DataFrame]:
        by_words = materialise(rank_regions(asked, corpus.regions, min(3, nodes), found, bridge), "by-words")
        sweep(asked.sparkSession)
        poor = asked.join(found.select("query_id").distinct(), "query_id", "left_anti").unionByName(asked.join(by_words.select("query_id").distinct(), "query_id", "left_anti")).distinct()
        return by_words, _by_index(poor, corpus)

    (by_words, by_index), rel = at_once(hits, lambda: materialise(corpus.related(found, 10, nodes), "related"))
    sweep(asked.sparkSession)
    regions = append_missing(by_words.select("query_id", "region_id", "rank"), by_index.select("query_id", "region_id", "rank"))
    more = inferred_entities(by_index, corpus, found)
    rows = _entity_rows(found).unionByName(_entity_rows(more, 1)).unionByName(_rows(rel, 2, "relation", F.concat_ws("|", "source", "target", "rel_type"), F.concat_ws(" ", "source", "rel_type", "target"))).unionByName(_region_rows(regions, corpus.regions, 3))
    return _within_budget(rows, asked)


def hybrid(asked: DataFrame, corpus: Corpus, nodes: int = 20) -> DataFrame:
    """Level 2: entities, what lies within two steps of them, the relations between, and regions."""
    found = materialise(rank_entities(asked, corpus.entities, 5), "found")
    few = found.groupBy("query_id").agg(F.count("*").alias("n"))
    poor = asked.join(few.where("n >= 3"), "query_id", "left_anti")
    by_index = _by_index(poor, corpus)
    more = inferred_entities(by_index, corpus, found)
    starts = found.select("query_id", "entity_id").unionByName(more.select("query_id", "entity_id"))
    pool = _around(starts, corpus, nodes)
    order = corpus.entities.select("entity_id", "name", "entity_type", "ord")
    chosen = pool.join(order, "entity_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "ord", "entity_id"))).where(F.col("rank") <= nodes)
    chosen = materialise(chosen, "chosen")
    inside = chosen.select("query_id", "entity_id")
    pairs = inside.withColumnRenamed("entity_id", "source").join(inside.withColumnRenamed("entity_id", "target"), "query_id")
    rel = pairs.join(corpus.relations, ["source", "target"])
    rel = ranked(rel, "weight", 100, "source", "target", "rel_type")
    by_words = materialise(rank_regions(asked, corpus.regions, 5, found, corpus.bridge), "by-words")
    regions = append_missing(by_words.select("query_id", "region_id", "rank"), by_index.select("query_id", "region_id", "rank"))
    rows = _entity_rows(chosen).unionByName(_rows(rel, 1, "relation", F.concat_ws("|", "source", "target", "rel_type"), F.concat_ws(" ", "source", "rel_type", "target"))).unionByName(_region_rows(regions, corpus.regions, 2, 300))
    return _within_budget(rows, asked)


def hierarchical(asked: DataFrame, corpus: Corpus, nodes: int = 10) -> DataFrame:
    """Level 3: entities grouped by type, their direct relatives, and the regions of the first eight."""
    found = materialise(search_entities(asked, corpus.entities, nodes), "found")
    groups = found.groupBy("query_id", "entity_type").agg(F.min("rank").alias("rank"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda e: e["name"]), ", ").alias("names"))
    steps = undirected(corpus.relations).where(F.col("node") != F.col("neighbour"))
    first = steps.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("neighbour"))).where(F.col("_r") <= 3)
    first = first.select(F.col("node").alias("entity_id"), F.col("neighbour").alias("node"))
    relatives = found.select("query_id", "entity_id", "rank").join(first, "entity_id").join(corpus.entities.select(F.col("entity_id").alias("node"), "name"), "node")
    held = _held_regions(found.where(F.col("rank") <= 8), corpus, asked.agg(F.max("max_tokens")).first()[0] or 0)
    rows = (
        _rows(groups, 0, "group", F.col("entity_type"), F.concat_ws(": ", "entity_type", "names"))
        .unionByName(_rows(relatives, 1, "relative", F.col("node"), F.col("name")))
        .unionByName(_region_rows(held, corpus.regions, 2))
    )
    return _within_budget(rows, asked)


def asked_pages(asked: DataFrame) -> DataFrame:
    """Questions with the pages, figures and tables they name."""
    named = lambda what: F.transform(F.regexp_extract_all(F.lower("question"), F.lit(rf"{what}\s+([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))
    return asked.withColumn("pages", named("page")).withColumn("figures", named("figure")).withColumn("tables", named("table"))


def visual_fusion(asked: DataFrame, corpus: Corpus, nodes: int = 30) -> DataFrame:
    """Level 4: regions of the pages a question names, or else all visual ones, with captions and entities."""
    q = asked_pages(asked).select("query_id", "pages")
    r = corpus.regions.select("doc_id", "page_num", "region_id", "block_type", "text", "ord")
    # Only the first regions of a page's number, and of all visual ones, can be among a question's first.
    on_page = r.withColumn("_r", F.row_number().over(Window.partitionBy("page_num").orderBy("doc_id", "ord", "region_id"))).where(F.col("_r") <= nodes).drop("_r")
    on_pages = on_page.join(q.select("query_id", F.explode("pages").alias("page_num")), "page_num")
    drawn = r.where(F.col("block_type").isin("figure", "table", "chart")).orderBy("doc_id", "ord", "region_id").limit(nodes)
    visual = q.where("size(pages) = 0").select("query_id").crossJoin(F.broadcast(drawn))
    pool = on_pages.select("query_id", "doc_id", "region_id", "text", "ord").unionByName(visual.select("query_id", "doc_id", "region_id", "text", "ord"))
    first = pool.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id", "ord", "region_id"))).where(F.col("rank") <= nodes)
    rows = _rows(first, 0, "region", F.col("region_id"), F.col("text"))
    if corpus.captions is not None:
        cap = first.join(corpus.captions, F.col("region_id") == F.col("figure_id")).join(corpus.regions.select(F.col("region_id").alias("caption_id"), F.col("text").alias("caption")), "caption_id")
        rows = rows.unionByName(_rows(cap, 1, "caption", F.col("caption_id"), F.when(F.length("caption") > 100, F.concat(F.substring("caption", 1, 100), F.lit("..."))).otherwise(F.col("caption"))))
    rows = rows.unionByName(_entity_rows(search_entities(asked, corpus.entities, 10), 2))
    return _within_budget(rows, asked)


STRATEGIES = {"entity_lookup": entity_lookup, "hybrid": hybrid, "hierarchical": hierarchical, "visual_fusion": visual_fusion}


def retrieve(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """Context rows of all questions, each by the strategy of its level; an unknown one looks up entities."""
    asked = materialise(analyse(queries), "questions")
    parts = []
    for name, strategy in STRATEGIES.items():
        own = asked.where(F.col("strategy") == name) if name != "entity_lookup" else asked.where((F.col("strategy") == name) | ~F.col("strategy").isin(*STRATEGIES))
        if not own.isEmpty():
            parts.append(strategy(own, corpus))
    return reduce(DataFrame.unionByName, parts) if parts else entity_lookup(asked, corpus)


def assemble(rows: DataFrame) -> DataFrame:
    """One row per question: the context string in order, and its tokens."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "rank", "ref", "kind", "content")))
    return rows.groupBy("query_id").agg(ordered.alias("r"), F.sum("tokens").alias("tokens")).select("query_id", F.array_join(F.transform("r", lambda x: F.concat(F.lit("["), x["kind"], F.lit("] "), x["content"])), "\n").alias("context"), F.size("r").alias("items"), "tokens")


def visual_retrieve(queries: DataFrame, regions: DataFrame, corpus: Corpus, budget: int = 6000, weight: float = 0.6, k: int = 20) -> DataFrame:
    """Regions by vector within a token budget, fused with regions by words: queries hold a vector."""
    pool = regions.where("embedding is not null")
    near = nearest_vectors(queries.select("query_id", "vector"), pool.select(F.col("region_id").alias("id"), F.col("embedding").alias("vector")), k)
    sized = near.withColumnRenamed("id", "region_id").join(regions.select("region_id", token_estimate("text").alias("tokens")), "region_id")
    visual = before_overflow(sized, budget, ("query_id",), (F.desc("score"), "region_id"))
    by_words = rank_regions(queries, regions, k)
    return ranked(fuse_candidates(visual, by_words, weight), "score", k, "region_id")


def context_from_layers(queries: DataFrame, corpus: Corpus, budget: int = 6000) -> DataFrame:
    """Ten entities for each question with three relatives and two regions of each, cut to the budget."""
    rows = hierarchical(analyse(queries).withColumn("max_tokens", F.lit(budget)), corpus)
    made = assemble(rows)
    cut = F.when(F.length("context") / 4 > budget, F.concat(F.substring("context", 1, budget * 4), F.lit("\n...[truncated]"))).otherwise(F.col("context"))
    return made.withColumn("context", cut)
