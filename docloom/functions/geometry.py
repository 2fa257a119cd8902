"""Bounding boxes: structs of doubles x1, y1, x2, y2, in shares of the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    values = [c if isinstance(c, Column) else F.lit(float(c)) for c in (x1, y1, x2, y2)]
    return F.struct(*[v.cast("double").alias(n) for v, n in zip(values, ("x1", "y1", "x2", "y2"), strict=True)])


def width(b: Column, clamp: bool = False) -> Column:
    w = b["x2"] - b["x1"]
    return F.greatest(F.lit(0.0), w) if clamp else w


def height(b: Column, clamp: bool = False) -> Column:
    h = b["y2"] - b["y1"]
    return F.greatest(F.lit(0.0), h) if clamp else h


def area(b: Column, clamp: bool = False) -> Column:
    return width(b, clamp) * height(b, clamp)


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def to_list(b: Column) -> Column:
    return F.array(b["x1"], b["y1"], b["x2"], b["y2"])


def from_list(a: Column) -> Column:
    return box(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(a, F.lit(2)), F.get(a, F.lit(3)))


def normalise(b: Column, page_width: Column, page_height: Column) -> Column:
    """A box in pixels as shares of the page."""
    return box(b["x1"] / page_width, b["y1"] / page_height, b["x2"] / page_width, b["y2"] / page_height)


def overlap_x(a: Column, b: Column, relative: bool = False) -> Column:
    """Overlap in x, negative for boxes apart; ``relative``: over the narrower width, at least 0."""
    shared = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    return F.greatest(F.lit(0.0), shared) / F.greatest(F.least(width(a), width(b)), F.lit(1e-9)) if relative else shared


def overlap_y(a: Column, b: Column, relative: bool = False) -> Column:
    shared = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0.0), shared) / F.greatest(F.least(height(a), height(b)), F.lit(1e-9)) if relative else shared


def center_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(center_x(a) - center_x(b), 2) + F.pow(center_y(a) - center_y(b), 2))


def intersects(a: Column, b: Column) -> Column:
    """Closed boxes that share a point; touching counts."""
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller area."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h / F.greatest(F.least(area(a), area(b)), F.lit(1e-9))


def position_label(a: Column, b: Column, margin: float = 0.02) -> Column:
    """Where ``a`` lies as seen from ``b``."""
    return (
        F.when(a["y2"] < b["y1"] + margin, "above")
        .when(a["y1"] > b["y2"] - margin, "below")
        .when(a["x2"] < b["x1"] + margin, "left_of")
        .when(a["x1"] > b["x2"] - margin, "right_of")
        .when(intersects(a, b), "overlapping")
        .otherwise("nearby")
    )


def spatial_features(b: Column) -> Column:
    xc = center_x(b)
    return F.struct(
        xc.alias("x_center"),
        center_y(b).alias("y_center"),
        width(b).alias("width"),
        height(b).alias("height"),
        area(b).alias("area"),
        (width(b) / F.greatest(F.lit(0.001), height(b))).alias("aspect_ratio"),
        ((1 - b["y1"]) * 0.6 + (1 - F.abs(0.5 - xc)) * 0.4).alias("position_score"),
        (b["y1"] < 0.15).alias("is_header"),
        (b["y2"] > 0.85).alias("is_footer"),
        (b["x1"] < 0.1).alias("is_left_aligned"),
        (b["x2"] > 0.9).alias("is_right_aligned"),
        (F.abs(0.5 - xc) < 0.1).alias("is_centered"),
    )


#: FIXED VALUES: visual weight of block types, 1 for others.
TYPE_WEIGHTS = {"header": 1.5, "paragraph": 1.0, "table": 1.3, "figure": 1.4, "formula": 1.2, "list": 1.0, "caption": 0.9}


def layout_features(b: Column, block_type: Column, text: Column) -> Column:
    xc, yc = center_x(b), center_y(b)
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for item in TYPE_WEIGHTS.items() for v in item]), block_type), F.lit(1.0))
    return F.struct(
        F.when(block_type == "header", "title").when(block_type == "list", "bullet_points").when(width(b) > 0.8, "full_width").otherwise("column").alias("layout_pattern"),
        F.when(b["x1"] < 0.1, "left").when(b["x2"] > 0.9, "right").otherwise("center").alias("alignment"),
        F.when(block_type == "header", 1).when(block_type == "paragraph", 2).otherwise(3).alias("hierarchy_level"),
        ((1 - b["y1"]) * 0.7 + (1 - b["x1"]) * 0.3).alias("reading_score"),
        F.when(b["y1"] < 0.2, "top").when(b["y1"] > 0.8, "bottom").otherwise("middle").alias("vertical"),
        F.when(xc < 0.33, "left").when(xc < 0.66, "center").otherwise("right").alias("horizontal"),
        F.concat(F.when(yc < 0.5, "top").otherwise("bottom"), F.lit("-"), F.when(xc < 0.5, "left").otherwise("right")).alias("quadrant"),
        F.when(xc < 0.33, 1).when(xc < 0.66, 2).otherwise(3).alias("column"),
        ((area(b) + (1 - b["y1"]) * 0.5 + weight) / 3).alias("visual_weight"),
        F.when(block_type == "header", "title")
        .when(block_type == "paragraph", F.when(F.length(text) > 500, "long_text").otherwise("short_text"))
        .when(block_type == "table", "data")
        .when(block_type == "figure", "visual")
        .when(block_type == "formula", "mathematical")
        .otherwise("other")
        .alias("content_category"),
    )


def grid_key(b: Column, cell: float = 0.1) -> Column:
    """The grid cell of a box's corner."""
    return F.concat_ws("_", F.floor(b["x1"] / cell), F.floor(b["y1"] / cell))
