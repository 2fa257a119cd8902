"""Readers that turn texts, pages and model output into region rows.

A region row has doc_id, page_num, ord (its place in the document), region_id, block_type, bbox, text,
token_count and confidence. Keys hold the document's id, so that rows of different documents never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.geometry import box
from docloom.functions.text import words

COLUMNS = ("doc_id", "page_num", "ord", "region_id", "block_type", "bbox", "text", "token_count", "confidence")


def _region_id(page: Column, name: Column) -> Column:
    return F.concat_ws("_", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.lit("p"), page.cast("string")), name)


def _exploded(docs: DataFrame, separator: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), separator)).alias("pos", "line"))


def regions_from_lines(docs: DataFrame) -> DataFrame:
    """One region for each line that is not blank, stacked down the page by running sums.

    A blank line is 30 high, a line 25 with a gap of 15 below. ``#``, ``##`` and bullets tell the type
    and the indent.
    """
    lines = _exploded(docs, "\n")
    blank = F.trim(F.col("line")) == ""
    above = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    y = F.lit(50) + F.coalesce(F.sum(F.when(blank, 30).otherwise(40)).over(above), F.lit(0))
    t = F.trim(F.col("line"))
    kind = F.when(t.startswith("# "), "header").when(t.startswith("## "), "subheader").when(t.startswith("- ") | t.startswith("* "), "list").otherwise("paragraph")
    left = F.when(F.col("block_type") == "header", 50).when(F.col("block_type") == "list", 100).otherwise(70)
    right = F.when(F.col("block_type").isin("header", "list"), 600).when(F.col("block_type") == "subheader", 580).otherwise(700)
    out = lines.withColumn("y", y).where(~blank).withColumn("text", t).withColumn("block_type", kind)
    return out.select(
        "doc_id",
        F.lit(0).alias("page_num"),
        F.col("pos").cast("long").alias("ord"),
        _region_id(F.lit(0), F.col("pos").cast("string")).alias("region_id"),
        "block_type",
        box(left, F.col("y"), right, F.col("y") + 25).alias("bbox"),
        "text",
        F.floor(F.size(words("text")) / 3).cast("int").alias("token_count"),
        F.lit(0.9).alias("confidence"),
    )


def regions_from_sections(docs: DataFrame) -> DataFrame:
    """One region for each part between blank lines, 100 high and 120 apart."""
    parts = _exploded(docs, "\n\n")
    t = F.trim(F.col("line"))
    kept = parts.where(t != "").withColumn("text", t)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    kind = (
        F.when(F.col("text").startswith("#"), "header")
        .when(F.contains("text", F.lit("|")) | (F.contains("text", F.lit("Model")) & F.contains("text", F.lit("Score"))), "table")
        .when(F.col("text").startswith("Abstract:"), "abstract")
        .otherwise("paragraph")
    )
    y = 50 + place * 120
    return kept.withColumn("block_type", kind).select(
        "doc_id",
        F.lit(0).alias("page_num"),
        F.col("pos").cast("long").alias("ord"),
        _region_id(F.lit(0), F.concat(F.lit("s"), F.col("pos").cast("string"))).alias("region_id"),
        "block_type",
        box(F.lit(50), y, F.lit(550), y + 100).alias("bbox"),
        "text",
        F.size(words("text")).alias("token_count"),
        F.lit(0.95).alias("confidence"),
    )


def regions_from_layout(pages: DataFrame) -> DataFrame:
    """Five regions of a page's lines: the top tenth, three equal parts of the body, the bottom tenth.

    ``pages`` has doc_id, page_num and text. Where only text is known, lines stand for heights.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    n = F.col("n")
    head, foot = F.greatest(F.lit(1), F.floor(n / 10).cast("int")), F.floor(n / 10).cast("int")
    chunk = F.floor((n - head - foot) / 3).cast("int")
    part = lambda name, kind, start, size, top, bottom: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), start.cast("int").alias("start"), size.cast("int").alias("size"), box(0, top, 1, bottom).alias("bbox"))
    third = 0.8 / 3
    parts = F.array(
        part("header", "header", F.lit(1), head, 0.0, 0.1),
        *[part(f"body{k}", "paragraph", head + k * chunk + 1, chunk if k < 2 else n - head - foot - 2 * chunk, 0.1 + k * third, 0.1 + (k + 1) * third) for k in range(3)],
        part("footer", "footer", n - foot + 1, foot, 0.9, 1.0),
    )
    split = pages.withColumn("lines", lines).withColumn("n", F.size("lines")).where("n > 0")
    each = split.select("doc_id", "page_num", "lines", F.posexplode(parts).alias("ord", "p"))
    text = F.array_join(F.slice("lines", F.col("p.start"), F.greatest(F.col("p.size"), F.lit(0))), "\n")
    out = each.where("p.size > 0").withColumn("text", text).where("trim(text) != ''")
    return out.select("doc_id", "page_num", F.col("ord").cast("long").alias("ord"), _region_id(F.col("page_num"), F.col("p.name")).alias("region_id"), F.col("p.kind").alias("block_type"), F.col("p.bbox").alias("bbox"), "text", F.size(words("text")).alias("token_count"), F.lit(0.9).alias("confidence"))


def regions_whole_page(pages: DataFrame) -> DataFrame:
    """A page as one region."""
    t = F.trim(F.coalesce("text", F.lit("")))
    return pages.where(t != "").select("doc_id", "page_num", F.lit(0).cast("long").alias("ord"), _region_id(F.col("page_num"), F.lit("full_page")).alias("region_id"), F.lit("page").alias("block_type"), box(0, 0, 1, 1).alias("bbox"), t.alias("text"), F.size(words("text")).alias("token_count"), F.lit(0.9).alias("confidence"))


#: Elements of a web page and the block types they become.
_ELEMENTS = {"h1": "header", "h2": "subheader", "p": "paragraph", "li": "list", "footer": "footer", "table": "table", "figcaption": "caption", "pre": "code"}


def regions_from_html(pages: DataFrame) -> DataFrame:
    """Regions of web pages (page_id, html): one for each element of a known kind that has text.

    An element's text ends where the next element of a known kind opens or closes.
    """
    tags = "|".join(_ELEMENTS)
    # Control characters mark where elements open, where their content begins, and where any closes.
    opened = F.regexp_replace(F.coalesce("html", F.lit("")), rf"<({tags})\b[^>]*>", "\u0001$1\u0002")
    marked = F.regexp_replace(opened, rf"</({tags})>", "\u0003")
    pieces = F.split(marked, "\u0001")
    inner = lambda piece: F.substring_index(F.substring_index(piece, "\u0002", -1), "\u0003", 1)
    text = lambda piece: F.trim(F.regexp_replace(F.regexp_replace(inner(piece), "<[^>]+>", " "), r"\s+", " "))
    # Bound to variables and made inside the list: written out, pages would be split twice and texts cleaned for the filter, too.
    listed = lambda p: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda piece: F.struct(F.substring_index(piece, "\u0002", 1).alias("tag"), text(piece).alias("text")))
    each = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.get(F.transform(F.array(pieces), listed), F.lit(0))).alias("ord", "e"))
    kind = F.element_at(F.create_map(*[F.lit(v) for item in _ELEMENTS.items() for v in item]), F.col("e.tag"))
    out = each.select("doc_id", F.lit(0).alias("page_num"), F.col("ord").cast("long").alias("ord"), kind.alias("block_type"), F.col("e.text").alias("text")).where("text != ''")
    size = F.count("*").over(Window.partitionBy("doc_id"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    out = out.withColumn("n", size).withColumn("k", place)
    return out.select("doc_id", "page_num", "ord", _region_id(F.lit(0), F.col("ord").cast("string")).alias("region_id"), "block_type", box(F.lit(0.1), F.col("k") / F.col("n"), F.lit(0.9), (F.col("k") + 0.8) / F.col("n")).alias("bbox"), "text", F.size(words("text")).alias("token_count"), F.lit(0.9).alias("confidence"))


def parse_tagged_output(raw: Column) -> Column:
    """Segments of model output: texts between ref marks, with the box of the same place in the list.

    A box is four integers or null where there is none; blank texts are left out and use up no box.
    """
    texts = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"(?s)<\|ref\|>(.*?)<\|/ref\|>"), F.lit(1)), F.trim), lambda t: t != "")
    boxes = F.transform(F.regexp_extract_all(raw, F.lit(r"(?s)<\|det\|>\s*\[\[(.*?)\]\]\s*<\|/det\|>"), F.lit(1)), lambda b: F.split(b, r"\s*,\s*").cast("array<int>"))
    return F.transform(F.arrays_zip(texts.alias("text"), boxes.alias("bbox")), lambda s: F.struct(s["text"].alias("text"), s["bbox"].alias("bbox"), F.lit(0.9).alias("confidence")))


def pages_from_regions(regions: DataFrame) -> DataFrame:
    """A row per page: its text in reading order, regions and tokens."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"]), "\n")
    return regions.groupBy("doc_id", "page_num").agg(joined.alias("full_text"), F.count("*").alias("regions"), F.sum(F.coalesce("token_count", F.size(words("text")))).alias("total_tokens"))
