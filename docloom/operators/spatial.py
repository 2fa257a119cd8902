"""Edges between regions: order, adjacency, hierarchy, likeness, captions and boxes.

Pairs are only ever made inside a page, on the key (doc_id, page_num).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions.text import word_jaccard
from docloom.functions.vectors import cosine, norm

PAGE = ("doc_id", "page_num")


def _edges(df: DataFrame, source: str, target: str, kind: str, weight: Column, note: Column | None = None) -> DataFrame:
    return df.select("doc_id", "page_num", F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("edge_type"), weight.cast("double").alias("weight"), (note if note is not None else F.lit(None).cast("string")).alias("note"))


def reading_order_edges(nodes: DataFrame) -> DataFrame:
    """Each region of a page to the next in arrival order; the note is its place."""
    order = Window.partitionBy(*PAGE).orderBy("ord")
    n = nodes.select(*PAGE, "region_id", F.lead("region_id").over(order).alias("next"), (F.row_number().over(order) - 1).alias("place")).where("next is not null")
    return _edges(n, "region_id", "next", "reading_order", F.lit(1.0), F.col("place").cast("string"))


def _sorted(nodes: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy(G.center_y(F.col("bbox")), G.center_x(F.col("bbox")), "ord"))
    return nodes.select(*PAGE, "region_id", "bbox", "ord", rank.alias("rn"))


def adjacency_weight(a: Column, b: Column) -> Column:
    return 1 / (1 + G.center_distance(a, b))


def vertical_edges(nodes: DataFrame, gap: float = 0.1, overlap: float = 0.3, relative: bool = False) -> DataFrame:
    """Regions that follow each other in page order with a small gap below and enough overlap in x (a share of the page)."""
    order = Window.partitionBy(*PAGE).orderBy("rn")
    n = _sorted(nodes).withColumn("t", F.lead(F.struct("region_id", "bbox")).over(order)).where("t is not null").select(*PAGE, "region_id", "bbox", F.col("t.region_id").alias("target"), F.col("t.bbox").alias("other"))
    space = F.col("other.y1") - F.col("bbox.y2")
    kept = n.where((space >= 0) & (space < gap) & (G.overlap_x(F.col("bbox"), F.col("other"), relative) > overlap))
    return _edges(kept, "region_id", "target", "adjacent", adjacency_weight(F.col("bbox"), F.col("other")), F.lit("vertical"))


def _page_pairs(nodes: DataFrame, *more: str) -> DataFrame:
    s = _sorted(nodes) if not more else _sorted(nodes).join(nodes.select(*PAGE, "region_id", *more), [*PAGE, "region_id"])
    a = s.select(*PAGE, *[F.col(c).alias(f"{c}_a") for c in ("region_id", "bbox", "rn", "ord", *more)])
    b = s.select(*PAGE, *[F.col(c).alias(f"{c}_b") for c in ("region_id", "bbox", "rn", "ord", *more)])
    return a.join(b, list(PAGE))


def horizontal_edges(nodes: DataFrame, gap: float = 0.1, overlap: float = 0.3, relative: bool = False) -> DataFrame:
    """Pairs of a page in page order with a small gap to the right and enough overlap in y (a share of the page)."""
    space = F.col("bbox_b.x1") - F.col("bbox_a.x2")
    pairs = _page_pairs(nodes).where((F.col("rn_a") < F.col("rn_b")) & (space >= 0) & (space < gap) & (G.overlap_y(F.col("bbox_a"), F.col("bbox_b"), relative) > overlap))
    return _edges(pairs, "region_id_a", "region_id_b", "adjacent", adjacency_weight(F.col("bbox_a"), F.col("bbox_b")), F.lit("horizontal"))


def semantic_edges(nodes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of a page of kinds that go together, similar by embedding or else by words."""
    more = ["block_type", "text"] + (["embedding"] if "embedding" in nodes.columns else [])
    ta, tb = F.col("block_type_a"), F.col("block_type_b")
    related = ((ta == "figure") & (tb == "caption")) | ((ta == "caption") & (tb == "figure")) | (ta == "table") | (tb == "table") | (ta == tb)
    pairs = _page_pairs(nodes, *more).where((F.col("ord_a") < F.col("ord_b")) & related)
    likeness = word_jaccard("text_a", "text_b")
    if "embedding" in nodes.columns:
        known = F.col("embedding_a").isNotNull() & F.col("embedding_b").isNotNull() & (norm(F.col("embedding_a")) > 0) & (norm(F.col("embedding_b")) > 0)
        likeness = F.when(known, cosine(F.col("embedding_a"), F.col("embedding_b"))).otherwise(likeness)
    kept = pairs.withColumn("likeness", likeness).where(F.col("likeness") > threshold)
    return _edges(kept, "region_id_a", "region_id_b", "semantic", F.col("likeness"))


def hierarchical_edges(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Each header to the first ``most`` regions below it that are no headers, in arrival order."""
    heads = nodes.where("block_type = 'header'").select(*PAGE, F.col("region_id").alias("head"), G.center_y(F.col("bbox")).alias("y"))
    below = nodes.where("block_type != 'header'").select(*PAGE, "region_id", "ord", G.center_y(F.col("bbox")).alias("yy"))
    rank = F.row_number().over(Window.partitionBy(*PAGE, "head").orderBy("ord"))
    kept = heads.join(below, list(PAGE)).where("yy > y").withColumn("r", rank).where(F.col("r") <= most)
    return _edges(kept, "head", "region_id", "hierarchical", F.lit(0.8))


def spatial_edges(nodes: DataFrame) -> DataFrame:
    """All kinds of edges of the first layer."""
    kinds = (reading_order_edges, vertical_edges, horizontal_edges, semantic_edges, hierarchical_edges)
    found = [f(nodes) for f in kinds]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def figure_captions(nodes: DataFrame, below: float = 0.2, aside: float = 0.3) -> DataFrame:
    """Each figure to its nearest caption a little below it on the page; a caption may serve several."""
    figures = nodes.where("block_type = 'figure'").select(*PAGE, F.col("region_id").alias("figure_id"), F.col("bbox").alias("f"))
    captions = nodes.where("block_type = 'caption'").select(*PAGE, F.col("region_id").alias("caption_id"), F.col("bbox").alias("c"), "ord")
    dy, dx = G.center_y(F.col("c")) - G.center_y(F.col("f")), G.center_x(F.col("c")) - G.center_x(F.col("f"))
    near = figures.join(captions, list(PAGE)).where((dy > 0) & (dy < below) & (F.abs(dx) < aside))
    return near.groupBy(*PAGE, "figure_id").agg(F.min_by("caption_id", F.struct(G.center_distance(F.col("c"), F.col("f")), "ord")).alias("caption_id"))


def neighbour_relations(regions: DataFrame, reach: float = 0.1) -> DataFrame:
    """Ordered pairs of a page whose centres are close, with where one lies as seen from the other."""
    pairs = _page_pairs(regions).where(F.col("region_id_a") != F.col("region_id_b"))
    distance = G.center_distance(F.col("bbox_a"), F.col("bbox_b"))
    return pairs.withColumn("distance", distance).where(F.col("distance") < reach).select(*PAGE, F.col("region_id_a").alias("source"), F.col("region_id_b").alias("target"), "distance", G.position_label(F.col("bbox_a"), F.col("bbox_b")).alias("relation"))


def in_area(regions: DataFrame, b: Column) -> DataFrame:
    """Regions whose box meets ``b``; touching counts."""
    return regions.where(G.intersects(F.col("bbox"), b))


def near_place(regions: DataFrame, b: Column, reach: float = 0.2, k: int = 10) -> DataFrame:
    """The k regions whose centres are nearest to that of ``b`` within reach."""
    return regions.withColumn("distance", G.center_distance(F.col("bbox"), b)).where(F.col("distance") <= reach).orderBy("distance", "ord").limit(k)


def overlapping_pairs(left: DataFrame, right: DataFrame, cell: float = 0.1) -> DataFrame:
    """Pairs (a, b) of boxes that meet. Grid cells are the join key, so no page is compared whole."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))
    dealt = lambda df, name: df.select(*PAGE, F.col("region_id").alias(name), F.col("bbox").alias(f"box_{name}"), span(F.col("bbox.x1"), F.col("bbox.x2")).alias("gx")).select("*", span(F.col(f"box_{name}.y1"), F.col(f"box_{name}.y2")).alias("gy"))
    met = dealt(left, "a").join(dealt(right, "b"), [*PAGE, "gx", "gy"]).where(G.intersects(F.col("box_a"), F.col("box_b")))
    return met.select(*PAGE, "a", "b").distinct()


def region_similarity(a: str, b: str, measured: bool = False) -> Column:
    """struct(embedding, spatial, structural, content, quality, overall, ...) of two region structs' columns.

    Regions whose looks were measured have visual_complexity, text_to_visual_ratio and quality_metrics (a
    map); others count as 0.5, 1 and 0.5. A region without a vector has no likeness by vector.
    """
    x, y = F.col(a), F.col(b)
    features = lambda r: F.array(r["bbox"]["x1"], r["bbox"]["y1"], r["bbox"]["x2"], r["bbox"]["y2"], G.width(r["bbox"]), G.height(r["bbox"]), G.area(r["bbox"]), G.center_x(r["bbox"]), G.center_y(r["bbox"]))
    close = F.zip_with(features(x), features(y), lambda p, q: F.when((F.abs(p) < 0.001) & (F.abs(q) < 0.001), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(p - q) / F.greatest(F.abs(p), F.abs(q)))))
    spatial = F.aggregate(close, F.lit(0.0), lambda s, v: s + v) / 9
    looks = lambda r: (F.coalesce(r["visual_complexity"], F.lit(0.5)), F.coalesce(r["text_to_visual_ratio"], F.lit(1.0))) if measured else (F.lit(0.5), F.lit(1.0))
    numbers = lambda r: F.array(G.area(r["bbox"]), G.width(r["bbox"]) / F.greatest(F.lit(0.001), G.height(r["bbox"])), r["token_count"].cast("double"), *looks(r))
    like = F.zip_with(numbers(x), numbers(y), lambda p, q: 1 - F.abs(p - q) / F.greatest(F.abs(p), F.abs(q), F.lit(1.0)))
    structural = (F.aggregate(like, F.lit(0.0), lambda s, v: s + v) + (x["block_type"] == y["block_type"]).cast("double")) / 6
    quality = F.lit(0.5)
    if measured:
        metric = lambda m: F.greatest(F.lit(0.0), 1 - F.abs(x["quality_metrics"][m] - y["quality_metrics"][m]) / F.greatest(x["quality_metrics"][m], y["quality_metrics"][m], F.lit(0.1)))
        known = F.filter(F.array(*[F.when(x["quality_metrics"][m].isNotNull() & y["quality_metrics"][m].isNotNull(), metric(m)) for m in ("overall", "clarity", "contrast", "sharpness")]), lambda v: v.isNotNull())
        quality = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known)).otherwise(0.5)
    content = word_jaccard(x["text"], y["text"])
    vectors = F.coalesce(cosine(x["embedding"], y["embedding"]), F.lit(0.0))
    parts = F.array(vectors, spatial, structural, content, quality)
    overall = vectors * 0.4 + spatial * 0.2 + structural * 0.2 + content * 0.15 + quality * 0.05
    names = F.array(*[F.lit(n) for n in ("embedding", "spatial", "structural", "content", "quality")])
    ranked = F.array_sort(F.zip_with(parts, names, lambda v, n: F.struct(v.alias("v"), n.alias("n"))))
    return F.struct(
        vectors.alias("embedding"),
        spatial.alias("spatial"),
        structural.alias("structural"),
        content.alias("content"),
        quality.alias("quality"),
        overall.alias("overall"),
        (F.size(F.filter(parts, lambda v: v > 0)) / 5).alias("confidence"),
        F.get(ranked, F.lit(4))["n"].alias("strongest"),
        F.get(ranked, F.lit(0))["n"].alias("weakest"),
    )
