"""Entities merged from mentions, and the relationships between them.

Pairs come from bridge tables keyed by region or page, never from all entities against all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import lexicon as L


def merge_entities(mentions: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """One entity for each normalised name, over all documents or (scope=("doc_id",)) in each.

    The first mention, by document and order, gives id, name and type; confidence is the mean. A row has
    a bounded size however common the name: where an entity stands is in the bridges
    (:func:`entity_regions`, :func:`entity_pages`). One aggregation with partial results.
    """
    place = F.struct("doc_id", "ord")
    first = F.min_by(F.struct("region_id", "start", "text", "label", "entity_type"), place)
    described = F.min_by("context", F.struct(-F.length("context"), "doc_id", "ord"))
    merged = mentions.groupBy(*scope, "norm").agg(
        first.alias("f"), described.alias("description"), F.array_sort(F.collect_set("block_type")).alias("block_types"), F.avg("confidence").alias("confidence"), F.count("*").alias("mention_count"), F.min(place).alias("ord")
    )
    name = F.concat_ws("_", F.lit("entity"), F.col("f.region_id"), F.col("f.start").cast("string"), F.xxhash64(*scope, "norm").cast("string"))
    return merged.select(*scope, name.alias("entity_id"), F.col("f.text").alias("name"), "norm", F.col("f.entity_type").alias("entity_type"), F.col("f.label").alias("label"), "description", "block_types", "confidence", "mention_count", "ord")


def entity_details(mentions: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Per name the lists of its regions, pages and boxes: for entities of one document or a few, not for a corpus."""
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "ord", "bbox"))), lambda b: b["bbox"])
    return mentions.groupBy(*scope, "norm").agg(F.array_sort(F.collect_set("region_id")).alias("regions"), F.array_sort(F.collect_set(F.struct("doc_id", "page_num"))).alias("pages"), boxes.alias("grounding_boxes"))


def entity_regions(entities: DataFrame, mentions: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The bridge (entity_id, region_id), made once from the mentions and used by all that joins entities to regions."""
    keys = [*scope, "norm"]
    return mentions.select(*keys, "region_id").distinct().join(entities.select(*keys, "entity_id", "ord", "entity_type"), keys).select("entity_id", "ord", "entity_type", "region_id")


def entity_pages(entities: DataFrame, mentions: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The bridge (entity_id, doc_id, page_num) with what pairs of a page need."""
    keys = [*scope, "norm"]
    named = entities.select(*keys, "entity_id", F.col("ord").alias("e_ord"), "block_types")
    return mentions.select(*dict.fromkeys([*keys, "doc_id", "page_num"])).distinct().join(named, keys).select("entity_id", F.col("e_ord").alias("ord"), "block_types", "doc_id", "page_num")


def linked_regions(bridge: DataFrame, nodes: DataFrame) -> DataFrame:
    """The bridge without regions that are no nodes."""
    return bridge.join(nodes.select("region_id").distinct(), "region_id", "left_semi")


def region_entities(bridge: DataFrame, least: int = 1) -> DataFrame:
    """Per region its entities in order, where there are at least ``least``."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "entity_id"))), lambda e: e["entity_id"])
    return bridge.groupBy("region_id").agg(listed.alias("entities"), F.count("*").alias("n")).where(F.col("n") >= least)


def _pairs(bridge: DataFrame, *more: str) -> DataFrame:
    """Pairs of entities of one region, the earlier first."""
    a = bridge.select("region_id", F.col("entity_id").alias("source"), F.col("ord").alias("ord_a"), *[F.col(c).alias(f"{c}_a") for c in more])
    b = bridge.select("region_id", F.col("entity_id").alias("target"), F.col("ord").alias("ord_b"), *[F.col(c).alias(f"{c}_b") for c in more])
    return a.join(b, "region_id").where((F.col("ord_a") < F.col("ord_b")) | (F.col("ord_a") == F.col("ord_b")) & (F.col("source") < F.col("target")))


def cooccurrences(bridge: DataFrame) -> DataFrame:
    """Entities that share regions: weight 0.2 for each, at most 1."""
    return _pairs(bridge).groupBy("source", "target").agg(F.least(F.count("*") * 0.2, F.lit(1.0)).alias("weight"), F.array_sort(F.collect_set("region_id")).alias("regions")).withColumn("rel_type", F.lit("co_occurs_with"))


def same_page(pages: DataFrame, cooccurring: DataFrame) -> DataFrame:
    """Entities that share a page (rows of :func:`entity_pages`) but no region: weight 0.3."""
    keys = ["doc_id", "page_num"]
    a = pages.select(*keys, F.col("entity_id").alias("source"), F.col("ord").alias("ord_a"))
    b = pages.select(*keys, F.col("entity_id").alias("target"), F.col("ord").alias("ord_b"))
    pairs = a.join(b, keys).where((F.col("ord_a") < F.col("ord_b")) | (F.col("ord_a") == F.col("ord_b")) & (F.col("source") < F.col("target"))).select("source", "target").distinct()
    return pairs.join(cooccurring.select("source", "target"), ["source", "target"], "left_anti").select("source", "target", F.lit("same_page").alias("rel_type"), F.lit(0.3).alias("weight"))


def semantic_relations(bridge: DataFrame, regions: DataFrame) -> DataFrame:
    """Pairs of a region whose text states a relation: the first region and pattern count once each."""
    low = F.lower("text")
    kinds = F.filter(F.array(*[F.when(low.rlike("|".join(patterns)), kind) for kind, patterns in L.RELATION_PATTERNS.items()]), lambda k: k.isNotNull())
    stated = regions.select("region_id", kinds.alias("kinds"), F.substring("text", 1, 200).alias("evidence"), F.col("ord").alias("region_ord")).where("size(kinds) > 0")
    pairs = _pairs(bridge).join(stated, "region_id").select("source", "target", F.explode("kinds").alias("rel_type"), "region_id", "evidence", "region_ord")
    return pairs.groupBy("source", "target", "rel_type").agg(F.lit(0.8).alias("weight"), F.min_by("region_id", F.struct("region_ord", "region_id")).alias("region_id"), F.min_by("evidence", F.struct("region_ord", "region_id")).alias("evidence"))


def table_relations(entities: DataFrame, bridge: DataFrame) -> DataFrame:
    """Entities of tables that share a region: weight 0.9."""
    inside = entities.where(F.array_contains("block_types", "table")).select("entity_id")
    return _pairs(bridge.join(inside, "entity_id", "left_semi")).select("source", "target").distinct().select("source", "target", F.lit("table_related").alias("rel_type"), F.lit(0.9).alias("weight"))


def header_relations(pages: DataFrame) -> DataFrame:
    """Entities of headers to entities of paragraphs of a shared page: weight 0.6.

    An entity that stands in both describes itself.
    """
    keys = ["doc_id", "page_num"]
    heads = pages.where(F.array_contains("block_types", "header")).select(*keys, F.col("entity_id").alias("source"))
    body = pages.where(F.array_contains("block_types", "paragraph")).select(*keys, F.col("entity_id").alias("target"))
    return heads.join(body, keys).select("source", "target").distinct().select("source", "target", F.lit("header_describes").alias("rel_type"), F.lit(0.6).alias("weight"))


def typed_relations(bridge: DataFrame) -> DataFrame:
    """Amounts with percentages, and dates with metrics, of a shared region."""
    kind = F.upper("entity_type")
    typed = bridge.withColumn("kind", kind)
    rules = (("MONEY", "PERCENTAGE", "financial_metric", 0.85), ("DATE_TIME", "METRIC", "temporal_context", 0.7))
    found = []
    for one, two, name, weight in rules:
        a = typed.where(F.col("kind") == one).select("region_id", F.col("entity_id").alias("source"))
        b = typed.where(F.col("kind") == two).select("region_id", F.col("entity_id").alias("target"))
        found.append(a.join(b, "region_id").select("source", "target").distinct().select("source", "target", F.lit(name).alias("rel_type"), F.lit(weight).alias("weight")))
    return found[0].unionByName(found[1])


def named_relations(pairs: DataFrame, entities: DataFrame, bridge: DataFrame) -> DataFrame:
    """Relations of a model (region_id, source, target as names, type, confidence) between entities of the region."""
    inside = bridge.join(entities.select("entity_id", "norm"), "entity_id").select("region_id", "entity_id", "norm")
    a = inside.select("region_id", F.col("norm").alias("_s"), F.col("entity_id").alias("source"))
    b = inside.select("region_id", F.col("norm").alias("_t"), F.col("entity_id").alias("target"))
    p = pairs.select("region_id", F.lower(F.trim("source")).alias("_s"), F.lower(F.trim("target")).alias("_t"), F.coalesce("type", F.lit("related_to")).alias("rel_type"), F.coalesce("confidence", F.lit(0.75)).alias("weight"))
    return p.join(a, ["region_id", "_s"]).join(b, ["region_id", "_t"]).select("source", "target", "rel_type", "weight")


def unique_relations(relations: DataFrame) -> DataFrame:
    """One row for each (source, target, rel_type), directed: the first row's fields, the greatest weight."""
    rest = [c for c in relations.columns if c not in ("source", "target", "rel_type", "weight", "ord")]
    first = [F.min_by(c, "ord").alias(c) for c in rest]
    return relations.groupBy("source", "target", "rel_type").agg(F.max("weight").alias("weight"), *first, F.min("ord").alias("ord"))


#: The strategies of :func:`all_relations`, in the order in which the first names a relation's fields.
STRATEGIES = ("semantic", "cooccurrence", "page", "table", "header", "typed")


def all_relations(entities: DataFrame, bridge: DataFrame, pages: DataFrame, regions: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """Relations of all strategies, or of those named, in their order, each (source, target, rel_type) once.

    A strategy gives each of its relations once, and no two give the same rel_type: nothing is left to merge.
    """
    together = cooccurrences(bridge)
    made = {
        "semantic": lambda: semantic_relations(bridge, regions), "cooccurrence": lambda: together, "page": lambda: same_page(pages, together),
        "table": lambda: table_relations(entities, bridge), "header": lambda: header_relations(pages), "typed": lambda: typed_relations(bridge),
    }
    listed = [made[name]().select("source", "target", "rel_type", F.col("weight").cast("double").alias("weight"), F.lit(i).alias("ord")) for i, name in enumerate(STRATEGIES) if name in strategies]
    return reduce(DataFrame.unionByName, listed)


def image_entities(regions: DataFrame, bridge: DataFrame, band: float = 0.15) -> DataFrame:
    """Images (image_path) with the entities of their region, or else of regions at about their height."""
    images = regions.where("image_path is not null").select("doc_id", "page_num", "region_id", "image_path", ((F.col("bbox.y1") + F.col("bbox.y2")) / 2).alias("y"))
    own = images.join(bridge, "region_id").select("image_path", "entity_id")
    alone = images.join(own.select("image_path").distinct(), "image_path", "left_anti")
    around = regions.select("doc_id", "page_num", "region_id", ((F.col("bbox.y1") + F.col("bbox.y2")) / 2).alias("yy"))
    near = alone.drop("region_id").join(around, ["doc_id", "page_num"]).where(F.abs(F.col("y") - F.col("yy")) < band).join(bridge, "region_id").select("image_path", "entity_id")
    return own.unionByName(near).distinct()


def numbered(entities: DataFrame) -> DataFrame:
    """(entity_id, number, place): numbers in the order of the ids and in that of arrival. To be written before it is used."""
    by_id = entities.select("entity_id", "ord").orderBy("entity_id").withColumn("number", F.monotonically_increasing_id())
    return by_id.orderBy("ord", "entity_id").select("entity_id", "number", F.monotonically_increasing_id().alias("place"))


def by_number(table: DataFrame, numbers: DataFrame) -> DataFrame:
    """A table of entities with their numbers as entity_id, and their places as ord."""
    rest = [c for c in table.columns if c not in ("entity_id", "ord")]
    return table.join(numbers, "entity_id").select(F.col("number").alias("entity_id"), F.col("place").alias("ord"), *rest)


def by_name(relations: DataFrame, numbers: DataFrame) -> DataFrame:
    """Relations of numbers with the entities' ids."""
    out = relations
    for end in ("source", "target"):
        out = out.join(numbers.select(F.col("number").alias(end), F.col("entity_id").alias("_id")), end).drop(end).withColumnRenamed("_id", end)
    return out.select(*relations.columns)


def type_distribution(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("mention_count").alias("mentions")).orderBy(F.desc("n"), "entity_type")


def relation_distribution(relations: DataFrame, top: int = 10) -> DataFrame:
    return relations.groupBy("rel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel_type").limit(top)


def related_by_endpoint(relations: DataFrame, wanted: DataFrame, top: int = 20) -> DataFrame:
    """Relations with an end among ``wanted`` (entity_id): full weight with both ends, 0.7 of it with one."""
    w = wanted.select("entity_id").distinct()
    flagged = relations.join(w.select(F.col("entity_id").alias("source"), F.lit(True).alias("s")), "source", "left").join(w.select(F.col("entity_id").alias("target"), F.lit(True).alias("t")), "target", "left")
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    scored = flagged.where("s or t").withColumn("relevance", F.col("weight") * F.when(both, 1.0).otherwise(0.7))
    return scored.select("source", "target", "rel_type", "weight", "relevance").orderBy(F.desc("relevance"), "source", "target", "rel_type").limit(top)


def first_in_group(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits each partition's groups before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def find_entities(entities: DataFrame, entity_id: str | None = None, name: str | None = None, entity_type: str | None = None) -> DataFrame:
    """Entities with an id, a name (without regard to case and outer spaces) or a type: filters that reach the scan."""
    out = entities
    if entity_id is not None:
        out = out.where(F.col("entity_id") == entity_id)
    if name is not None:
        out = out.where(F.col("norm") == name.lower().strip())
    return out if entity_type is None else out.where(F.col("entity_type") == entity_type)
