"""Graphs as edge tables (source, target): neighbours, k hops, induced parts and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.store import materialise


def collapsed(edges: DataFrame, order: str = "ord") -> DataFrame:
    """One edge for each (source, target): the last that was added."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    return edges.groupBy("source", "target").agg(F.max_by(F.struct(*rest), order).alias("e")).select("source", "target", "e.*")


def undirected(edges: DataFrame, kinds: tuple[str, ...] | None = None, kind_column: str = "edge_type") -> DataFrame:
    """Both directions of each edge as (node, neighbour), each once."""
    e = edges if kinds is None else edges.where(F.col(kind_column).isin(*kinds))
    out = e.select(F.col("source").alias("node"), F.col("target").alias("neighbour"))
    return out.unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("neighbour"))).distinct()


def neighbours(edges: DataFrame, start: DataFrame, kinds: tuple[str, ...] | None = None, kind_column: str = "edge_type") -> DataFrame:
    """(start, node) one step from each start node."""
    return k_hops(edges, start, 1, kinds, kind_column).drop("hop")


def k_hops(edges: DataFrame, start: DataFrame, k: int, kinds: tuple[str, ...] | None = None, kind_column: str = "edge_type") -> DataFrame:
    """(start, node, hop) for all nodes within k steps of each start node, with the fewest steps.

    Each step joins only the nodes that are new, and the start itself is no result.
    """
    steps = undirected(edges, kinds, kind_column)
    if k > 1:  # what the edges are made of would else stand in the plan once for each step
        steps = materialise(steps, "steps")
    first = start.select(F.col("node").alias("start")).distinct()
    seen = first.select("start", F.col("start").alias("node"), F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, k + 1):
        reached = front.join(steps, "node").select("start", F.col("neighbour").alias("node")).distinct()
        front = reached.join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (node)."""
    ends = nodes.select("node").distinct()
    return edges.join(ends.withColumnRenamed("node", "source"), "source", "left_semi").join(ends.withColumnRenamed("node", "target"), "target", "left_semi")


def page_part(nodes: DataFrame, edges: DataFrame, doc_id, page_num: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of one page and the edges between them; a page that is not there has none."""
    part = nodes.where((F.col("doc_id") == doc_id) & (F.col("page_num") == page_num))
    return part, induced(edges, part.select(F.col("region_id").alias("node")))


def degrees(edges: DataFrame) -> DataFrame:
    """node and degree in the collapsed directed graph, both ends counted."""
    once = edges.select("source", "target").distinct()
    return once.select(F.col("source").alias("node")).unionByName(once.select(F.col("target").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def top_degrees(edges: DataFrame, k: int = 5) -> DataFrame:
    return degrees(edges).orderBy(F.desc("degree"), "node").limit(k)


def graph_statistics(nodes: DataFrame, edges: DataFrame, node_kind: str, edge_kind: str) -> DataFrame:
    """Figures of a graph as rows (figure, kind, value): nodes and edges by kind, and the mean degree."""
    by_node = nodes.groupBy(F.col(node_kind).alias("kind")).agg(F.count("*").cast("double").alias("value")).select(F.lit("nodes").alias("figure"), "kind", "value")
    by_edge = edges.groupBy(F.col(edge_kind).alias("kind")).agg(F.count("*").cast("double").alias("value")).select(F.lit("edges").alias("figure"), "kind", "value")
    ends = edges.select("source", "target").distinct().agg((F.count("*") * 2).alias("ends"))
    mean = ends.crossJoin(nodes.agg(F.count("*").alias("n"))).select(F.lit("mean_degree").alias("figure"), F.lit("all").alias("kind"), F.when(F.col("n") > 0, F.col("ends") / F.col("n")).otherwise(0.0).alias("value"))
    return by_node.unionByName(by_edge).unionByName(mean)


def entity_context(entity: DataFrame, relations: DataFrame, depth: int = 2, most: int = 20) -> DataFrame:
    """Per entity (entity_id): its relations and at most ``most`` entities within ``depth`` steps."""
    starts = entity.select(F.col("entity_id").alias("node")).distinct()
    reached = k_hops(relations, starts, depth)
    few = reached.withColumn("r", F.row_number().over(Window.partitionBy("start").orderBy("hop", "node"))).where(F.col("r") <= most)
    related = few.groupBy(F.col("start").alias("entity_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]).alias("related"))
    touching = relations.select(F.col("source").alias("entity_id"), "source", "target", "rel_type", "weight").unionByName(relations.select(F.col("target").alias("entity_id"), "source", "target", "rel_type", "weight"))
    own = touching.join(starts.withColumnRenamed("node", "entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_set(F.struct("source", "target", "rel_type", "weight"))).alias("relations"))
    return entity.select("entity_id").distinct().join(own, "entity_id", "left").join(related, "entity_id", "left")


def hybrid_query(start_entities: DataFrame, start_regions: DataFrame, relations: DataFrame, edges: DataFrame, bridge: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Entities and regions around both kinds of starts, crossing layers, and what connects them.

    Each row comes once (relations are not repeated for each end).
    """
    e0, r0 = start_entities.select(F.col("entity_id").alias("node")).distinct(), start_regions.select(F.col("region_id").alias("node")).distinct()
    entities = e0.unionByName(k_hops(relations, e0, hops).select("node")).distinct()
    crossed = bridge.join(entities.select(F.col("node").alias("entity_id")), "entity_id", "left_semi").select(F.col("region_id").alias("node"))
    regions = r0.unionByName(k_hops(edges, r0, hops).select("node")).distinct().unionByName(crossed).distinct()
    back = bridge.join(regions.select(F.col("node").alias("region_id")), "region_id", "left_semi").select(F.col("entity_id").alias("node"))
    entities = entities.unionByName(back).distinct()
    return entities, regions, induced(relations, entities), induced(edges, regions)
