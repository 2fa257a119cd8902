"""Queries for each operator family over the given tables, with equivalent SQL where SQL can say it.

Every query runs over its whole table. Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import geometry as G
from docloom.functions import lexicon as L
from docloom.functions import text as T
from docloom.functions import typing as Y
from docloom.functions import vectors as V
from docloom.operators import budget, entities, graph, mentions, regions, search, spatial, statistics
from docloom.sources import regions as S
from docloom.sources.store import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions_from_lines(table(spark, sf_dir, "documents"))


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions_from_html(table(spark, sf_dir, "pages"))


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def boxed(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.round(F.col(f"bbox.{c}"), 6).alias(c) for c in ("x1", "y1", "x2", "y2")]).drop("bbox")


# --- SQL building blocks ------------------------------------------------------------------------

_LINES = """
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), placed AS (
  SELECT *, 50 + coalesce(sum(CASE WHEN trim(line, ' ') = '' THEN 30 ELSE 40 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM lines
), regions AS (
  SELECT doc_id, 0 AS page_num, CAST(pos AS BIGINT) AS ord, 'd' || doc_id || '_p0_' || pos AS region_id, trim(line, ' ') AS text, y,
    CASE WHEN trim(line, ' ') LIKE '# %' THEN 'header' WHEN trim(line, ' ') LIKE '## %' THEN 'subheader' WHEN trim(line, ' ') LIKE '- %' OR trim(line, ' ') LIKE '* %' THEN 'list' ELSE 'paragraph' END AS block_type
  FROM placed WHERE trim(line, ' ') <> ''
)"""

_HTML = r"""
marked AS (
  SELECT page_id, string_split(regexp_replace(regexp_replace(html, '<(h1|h2|p|li|footer|table|figcaption|pre)\b[^>]*>', chr(1) || '\1' || chr(2), 'g'), '</(h1|h2|p|li|footer|table|figcaption|pre)>', chr(3), 'g'), chr(1)) AS pieces FROM pages
), found AS (
  SELECT page_id, unnest(pieces[2:]) AS piece, unnest(range(len(pieces) - 1)) AS pos FROM marked
), kept AS (
  SELECT page_id AS doc_id, 0 AS page_num, CAST(pos AS BIGINT) AS ord, 'd' || page_id || '_p0_' || pos AS region_id,
    CASE string_split(piece, chr(2))[1] WHEN 'h1' THEN 'header' WHEN 'h2' THEN 'subheader' WHEN 'p' THEN 'paragraph' WHEN 'li' THEN 'list' WHEN 'footer' THEN 'footer' WHEN 'table' THEN 'table' WHEN 'figcaption' THEN 'caption' ELSE 'code' END AS block_type,
    trim(regexp_replace(regexp_replace(string_split(string_split(piece, chr(2))[-1], chr(3))[1], '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS text
  FROM found
), html_regions AS (
  SELECT *, 0.1::DOUBLE AS x1, k / n::DOUBLE AS y1, 0.9::DOUBLE AS x2, (k + 0.8) / n::DOUBLE AS y2
  FROM (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::DOUBLE AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM kept WHERE text <> '')
)"""


def _words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda w: w <> '')"


def _tokens(expr: str) -> str:
    return f"regexp_extract_all({expr}, '[\\p{{L}}\\p{{N}}_]+')"


# --- sources --------------------------------------------------------------------------------------


@query(
    f"WITH {_LINES} SELECT doc_id, page_num, ord, region_id, block_type, text, CAST(len({_words('text')}) // 3 AS INTEGER) AS token_count, 0.9 AS confidence, "
    "CAST(CASE block_type WHEN 'header' THEN 50 WHEN 'list' THEN 100 ELSE 70 END AS DOUBLE) AS x1, CAST(y AS DOUBLE) AS y1, CAST(CASE block_type WHEN 'header' THEN 600 WHEN 'list' THEN 600 WHEN 'subheader' THEN 580 ELSE 700 END AS DOUBLE) AS x2, CAST(y + 25 AS DOUBLE) AS y2 FROM regions"
)
def regions_from_text(spark, sf_dir):
    return boxed(lines(spark, sf_dir))


@query(
    f"""WITH parts AS (
  SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10) || chr(10))), ' ') AS text, unnest(range(len(string_split(coalesce(text, ''), chr(10) || chr(10))))) AS pos FROM documents
), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS k FROM parts WHERE text <> '')
SELECT doc_id, CAST(pos AS BIGINT) AS ord,
  CASE WHEN text LIKE '#%' THEN 'header' WHEN contains(text, '|') OR (contains(text, 'Model') AND contains(text, 'Score')) THEN 'table' WHEN text LIKE 'Abstract:%' THEN 'abstract' ELSE 'paragraph' END AS block_type,
  CAST(len({_words("text")}) AS INTEGER) AS token_count, CAST(50 + 120 * k AS DOUBLE) AS y1, CAST(150 + 120 * k AS DOUBLE) AS y2 FROM k"""
)
def regions_from_sections(spark, sf_dir):
    return boxed(S.regions_from_sections(table(spark, sf_dir, "documents"))).select("doc_id", "ord", "block_type", "token_count", "y1", "y2")


@query(f"WITH {_HTML} SELECT doc_id, page_num, ord, region_id, block_type, text, round(y1, 6) AS y1, round(y2, 6) AS y2 FROM html_regions")
def regions_from_pages(spark, sf_dir):
    return boxed(html(spark, sf_dir)).select("doc_id", "page_num", "ord", "region_id", "block_type", "text", "y1", "y2")


@query(f"WITH {_LINES} SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY ord) AS full_text, count(*) AS regions, CAST(sum(len({_words('text')}) // 3) AS BIGINT) AS total_tokens FROM regions GROUP BY ALL")
def pages_from_lines(spark, sf_dir):
    return S.pages_from_regions(lines(spark, sf_dir))


@query()
def layout_regions(spark, sf_dir):
    """Five-part pages; the parts are lists of lines, which only the tests compare."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_num"), "text")
    return boxed(S.regions_from_layout(docs))


# --- filters and classifiers ---------------------------------------------------------------------

_QUALITY = "length(text) >= 3 AND len(list_distinct(string_split(text, ''))) >= 3 AND (length(text) < 20 OR len(list_distinct(string_split(text, ''))) / length(text) >= 0.05)"


@query(f"WITH {_LINES} SELECT doc_id, region_id, text FROM regions WHERE length(text) >= 10 AND {_QUALITY}")
def region_quality_filter(spark, sf_dir):
    return regions.admitted(lines(spark, sf_dir)).select("doc_id", "region_id", "text")


@query(
    f"""WITH {_LINES} SELECT doc_id, region_id, CASE
  WHEN length(text) < 100 AND upper(text) = text AND lower(text) <> text AND length(text) > 5 THEN 'heading'
  WHEN length(text) < 50 AND text LIKE '%:' THEN 'heading'
  WHEN regexp_matches(text, '^[•◦▪▫‣⁃*→➤-]') OR regexp_matches(text, '^[1-9][0-9]?\\.') THEN 'list'
  WHEN regexp_matches(text, '\\{{|\\}}|\\(\\)|=>|function|def |class |import |const ') AND len(regexp_extract_all(text, '[{{}}();]')) > length(text) * 0.1 THEN 'code'
  WHEN regexp_matches(text, '^(Figure|Table|Fig\\.|Image|Chart|Diagram)') AND length(text) < 200 THEN 'caption'
  WHEN length(text) > 200 THEN 'paragraph' ELSE 'text' END AS node_type FROM regions"""
)
def node_type_classify(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "region_id", regions.node_type(F.col("text"), F.lit("text")).alias("node_type"))


@query(
    f"""WITH {_LINES} SELECT doc_id, region_id, CASE
  WHEN length(text) < 50 AND upper(text) = text AND lower(text) <> text THEN 'header'
  WHEN regexp_matches(lower(text), '^[•*-]') OR regexp_matches(text, '^[0-9]+\\.') THEN 'list'
  WHEN len({_words("text")}) >= 3 AND len(list_filter({_words("text")}, lambda w: length(w) >= 20)) = 0 THEN 'table'
  WHEN regexp_matches(lower(text), 'figure|fig\\.|image|photo') THEN 'caption'
  WHEN text LIKE '"%' AND text LIKE '%"' THEN 'quote' ELSE 'paragraph' END AS kind FROM regions"""
)
def segment_classify(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "region_id", regions.segment_type(F.col("text")).alias("kind"))


@query(f"WITH {_LINES}, a AS (SELECT * FROM regions WHERE length(text) >= 10 AND {_QUALITY}) SELECT doc_id, text, min(ord) AS ord FROM a GROUP BY doc_id, text")
def region_exact_unique(spark, sf_dir):
    return regions.exact_unique(regions.admitted(lines(spark, sf_dir))).select("doc_id", "text", "ord")


@query()
def region_near_unique(spark, sf_dir):
    """Greedy character-level deduplication per page; not SQL, tested against a plain loop."""
    return regions.near_unique(regions.admitted(html(spark, sf_dir))).select("doc_id", "region_id", "text")


@query(f"WITH {_HTML} SELECT doc_id, region_id, round((x1 + x2) / 2, 6) AS pos_x, round((y1 + y2) / 2, 6) AS pos_y, round((x2 - x1) * (y2 - y1), 6) AS area FROM html_regions")
def node_projection(spark, sf_dir):
    return regions.nodes(html(spark, sf_dir)).select("doc_id", "region_id", r6("pos_x"), r6("pos_y"), r6("area"))


# --- edges ----------------------------------------------------------------------------------------


@query(f"WITH {_LINES}, n AS (SELECT doc_id, region_id AS source, lead(region_id) OVER (PARTITION BY doc_id ORDER BY ord) AS target, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS place FROM regions) SELECT doc_id, source, target, 1.0 AS weight, CAST(place AS VARCHAR) AS note FROM n WHERE target IS NOT NULL")
def reading_order_edges(spark, sf_dir):
    return spatial.reading_order_edges(lines(spark, sf_dir)).select("doc_id", "source", "target", "weight", "note")


@query(
    f"""WITH {_HTML}, s AS (SELECT *, lead(struct_pack(r := region_id, x1 := x1, y1 := y1, x2 := x2, y2 := y2)) OVER (PARTITION BY doc_id ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, ord) AS t FROM html_regions)
SELECT doc_id, region_id AS source, t.r AS target, round(1 / (1 + sqrt(pow((x1 + x2) / 2 - (t.x1 + t.x2) / 2, 2) + pow((y1 + y2) / 2 - (t.y1 + t.y2) / 2, 2))), 6) AS weight
FROM s WHERE t IS NOT NULL AND t.y1 - y2 >= 0 AND t.y1 - y2 < 0.1 AND least(x2, t.x2) - greatest(x1, t.x1) > 0.3"""
)
def vertical_adjacency(spark, sf_dir):
    return spatial.vertical_edges(html(spark, sf_dir)).select("doc_id", "source", "target", r6("weight"))


def _grid(spark, sf_dir, down: float = 0.2, high: float = 0.15, wide: float = 0.15):
    """Boxes on pages made of suppliers: five columns, and as many rows of the height ``down`` as a page holds."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    page = 5 * round(1 / down)
    i = (F.col("k") % page).cast("double")
    x, y = (i % 5) * 0.2, F.floor(i / 5).cast("double") * down
    return s.select(
        F.floor(F.col("k") / page).alias("doc_id"), F.lit(0).alias("page_num"), F.col("k").alias("ord"), F.concat(F.lit("b"), F.col("k").cast("string")).alias("region_id"),
        F.when(F.col("k") % 3 == 0, "figure").when(F.col("k") % 3 == 1, "caption").otherwise("paragraph").alias("block_type"),
        F.struct(x.alias("x1"), y.alias("y1"), (x + wide).alias("x2"), (y + high).alias("y2")).alias("bbox"), F.lit("text").alias("text"), F.lit(1).alias("token_count"),
    )


def _grid_sql(page: int = 25, down: float = 0.2, high: float = 0.15, wide: float = 0.15) -> str:
    x, y = "(s_suppkey % 5)::DOUBLE * 0.2::DOUBLE", f"(s_suppkey % {page} // 5)::DOUBLE * {down}::DOUBLE"
    return f"""grid AS (
  SELECT s_suppkey // {page} AS doc_id, s_suppkey AS ord, 'b' || s_suppkey AS region_id, CASE s_suppkey % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'caption' ELSE 'paragraph' END AS block_type,
    {x} AS x1, {y} AS y1, {x} + {wide}::DOUBLE AS x2, {y} + {high}::DOUBLE AS y2 FROM supplier
)"""


_GRID = _grid_sql()


@query(f"WITH {_grid_sql(10, 0.5, 0.45)} SELECT a.doc_id, a.region_id AS source, b.region_id AS target, round(1 / (1 + sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2))), 6) AS weight FROM grid a JOIN grid b USING (doc_id) WHERE b.x1 - a.x2 >= 0 AND b.x1 - a.x2 < 0.1 AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0.3")
def horizontal_adjacency(spark, sf_dir):
    return spatial.horizontal_edges(_grid(spark, sf_dir, 0.5, 0.45)).select("doc_id", "source", "target", r6("weight"))


@query(f"WITH {_GRID} SELECT a.doc_id, a.region_id AS source, b.region_id AS target FROM grid a JOIN grid b USING (doc_id) WHERE b.x1 - a.x2 >= 0 AND b.x1 - a.x2 < 0.1 AND (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / 0.15 > 0.3")
def horizontal_adjacency_relative(spark, sf_dir):
    """The overlap as a share of the lower box: an option that is off by default."""
    return spatial.horizontal_edges(_grid(spark, sf_dir), relative=True).select("doc_id", "source", "target")


@query(f"WITH {_GRID}, p AS (SELECT f.doc_id, f.region_id AS figure_id, c.region_id AS caption_id, row_number() OVER (PARTITION BY f.region_id ORDER BY round(sqrt(pow(c.x1 - f.x1, 2) + pow(c.y1 - f.y1, 2)), 9), c.ord) AS r FROM grid f JOIN grid c USING (doc_id) WHERE f.block_type = 'figure' AND c.block_type = 'caption' AND c.y1 - f.y1 > 0.001 AND c.y1 - f.y1 < 0.25 AND abs(c.x1 - f.x1) < 0.3) SELECT doc_id, figure_id, caption_id FROM p WHERE r = 1")
def nearest_caption(spark, sf_dir):
    return spatial.figure_captions(_grid(spark, sf_dir), below=0.25).select("doc_id", "figure_id", "caption_id")


@query(f"WITH {_grid_sql(25, 0.2, 0.25, 0.25)} SELECT DISTINCT a.doc_id, a.region_id AS a, b.region_id AS b FROM grid a JOIN grid b USING (doc_id) WHERE a.block_type = 'figure' AND b.block_type = 'paragraph' AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2")
def bbox_intersect(spark, sf_dir):
    g = _grid(spark, sf_dir, high=0.25, wide=0.25)
    return spatial.overlapping_pairs(g.where("block_type = 'figure'"), g.where("block_type = 'paragraph'")).select("doc_id", "a", "b")


@query(f"WITH {_HTML}, p AS (SELECT h.doc_id, h.region_id AS source, b.region_id AS target, row_number() OVER (PARTITION BY h.region_id ORDER BY b.ord) AS r FROM html_regions h JOIN html_regions b USING (doc_id) WHERE h.block_type = 'header' AND b.block_type <> 'header' AND b.y1 > h.y1) SELECT doc_id, source, target, 0.8 AS weight FROM p WHERE r <= 3")
def hierarchical_edges(spark, sf_dir):
    return spatial.hierarchical_edges(html(spark, sf_dir)).select("doc_id", "source", "target", "weight")


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, list_distinct({_words("lower(text)")}) AS w FROM conversations),
j AS (SELECT a.conv_id AS doc_id, a.turn AS ta, b.turn AS tb, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS j FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.role = b.role)
SELECT doc_id, 't' || ta AS source, 't' || tb AS target, round(j, 6) AS weight FROM j WHERE j > 0.1"""
)
def semantic_edges_jaccard(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("page_num"), F.col("turn").alias("ord"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("region_id"), F.col("role").alias("block_type"), "text", G.box(0, 0, 1, 1).alias("bbox"))
    return spatial.semantic_edges(turns, 0.1).select("doc_id", "source", "target", r6("weight"))


# --- mentions and entities -----------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in L.ACRONYM_STOPS)
_ACRONYMS = f"""{_LINES}, acronyms AS (
  SELECT doc_id, region_id, ord, a AS text FROM (SELECT doc_id, region_id, ord, unnest(list_distinct(list_filter({_tokens("text")}, lambda t: regexp_full_match(t, '[A-Z]{{2,6}}') AND t NOT IN ({_STOPS})))) AS a FROM regions)
)"""


@query(f"WITH {_ACRONYMS} SELECT doc_id, region_id, text FROM acronyms")
def mentions_acronym(spark, sf_dir):
    return mentions.extract_mentions(lines(spark, sf_dir), ("acronym",)).select("doc_id", "region_id", "text")


@query(
    f"""WITH {_LINES}, c AS (SELECT doc_id, region_id, unnest(list_distinct(list_slice(regexp_extract_all(text, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+'), 1, 10))) AS t FROM regions)
SELECT doc_id, region_id, t AS text FROM c WHERE length(t) > 8 AND regexp_split_to_array(t, '\\s+')[1] NOT IN ({", ".join(f"'{w}'" for w in L.CONCEPT_STOPS)})"""
)
def mentions_concept(spark, sf_dir):
    return mentions.extract_mentions(lines(spark, sf_dir), ("concept",)).select("doc_id", "region_id", "text")


@query(
    f"""WITH {_LINES}, w AS (SELECT doc_id, region_id, {_tokens("lower(text)")} AS t FROM regions),
p AS (SELECT doc_id, region_id, list_concat(list_concat(list_filter(t, lambda x: x LIKE '%ing' AND length(x) > 6), list_filter(t, lambda x: x LIKE '%tion' AND length(x) > 6)), list_filter(t, lambda x: x LIKE '%ment' AND length(x) > 6)) AS l FROM w),
e AS (SELECT doc_id, region_id, unnest(l) AS t, unnest(range(len(l))) AS k FROM p),
f AS (SELECT doc_id, region_id, t, min(k) AS k FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, region_id ORDER BY k) AS r FROM f)
SELECT doc_id, region_id, t AS text FROM r WHERE r <= 5"""
)
def mentions_process(spark, sf_dir):
    return mentions.extract_mentions(lines(spark, sf_dir), ("process",)).select("doc_id", "region_id", "text")


@query(f"WITH {_LINES} SELECT doc_id, region_id, unnest(regexp_extract_all(text, '[-+]?[0-9]+(?:\\.[0-9]+)?%')) AS text FROM regions")
def mentions_percent(spark, sf_dir):
    return mentions.extract_mentions(lines(spark, sf_dir), ("percentage",)).select("doc_id", "region_id", "text")


_DATES = (
    ("quarter", r"(?i)Q[1-4]\s+[0-9]{4}"),
    ("fiscal_year", r"(?i)FY\s*[0-9]{4}"),
    ("year_range", r"[0-9]{4}-[0-9]{4}"),
    ("full_date", r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+[0-9]{1,2},?\s+[0-9]{4}"),
    ("month_year", r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+[0-9]{4}"),
    ("year", r"(?:19|20)[0-9]{2}"),
)


def _dates_sql(source: str) -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, region_id, '{k}' AS label, {i} AS k, unnest(list_distinct(regexp_extract_all(text, '{p}'))) AS text FROM {source}" for i, (k, p) in enumerate(_DATES))
    return f"d AS ({each}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, region_id, text ORDER BY k) AS r FROM d) SELECT doc_id, region_id, label, text FROM r WHERE r = 1"


@query(f"WITH {_LINES}, {_dates_sql('regions')}")
def mentions_date(spark, sf_dir):
    return mentions.extract_mentions(lines(spark, sf_dir), ("date",)).select("doc_id", "region_id", "label", "text")


# An acronym of two to six capitals gets 0.1 more where its type is an organisation or a term, and 0.05 near a mark of a heading.
_CONTEXT = "lower(substr(region_text, greatest(strpos(region_text, text) - 51, 0) + 1, (strpos(region_text, text) - 1 + length(text) + 50) - greatest(strpos(region_text, text) - 51, 0)))"
_SURE = f"""{_ACRONYMS}, surely AS (
  SELECT a.doc_id, a.region_id, a.text, lower(a.text) AS norm, least(1.0, 0.8 + least(0.3, CASE WHEN lower(a.text) IN ('aws', 'gcp', 'java', 'keras', 'ai') THEN 0 ELSE 0.1 END + CASE WHEN regexp_matches({_CONTEXT}, '#|title|heading') THEN 0.05 ELSE 0 END)) AS confidence
  FROM (SELECT a.*, r.text AS region_text FROM acronyms a JOIN regions r USING (region_id)) a
)"""


@query(f"WITH {_SURE}, o AS (SELECT lower(text) AS norm, min_by(text, doc_id * 100000000 + ord) AS any_name FROM acronyms GROUP BY lower(text)) SELECT norm, count(*) AS mention_count, list_sort(list(DISTINCT region_id)) AS regions, list_sort(list(DISTINCT doc_id)) AS docs, any_name, round(avg(confidence), 6) AS confidence FROM surely JOIN o USING (norm) GROUP BY norm, any_name")
def entity_merge(spark, sf_dir):
    m = materialise(mentions.extract_mentions(lines(spark, sf_dir), ("acronym",)), "acronyms")
    return entities.merge_entities(m).join(entities.entity_details(m), "norm").select("norm", "mention_count", "regions", F.transform("pages", lambda p: p["doc_id"]).alias("docs"), F.col("name").alias("any_name"), r6("confidence"))


def _acronym_layer(spark, sf_dir):
    """Regions, mentions, entities and the bridge of acronyms in the documents' lines, and names by entity."""
    r = materialise(lines(spark, sf_dir), "regions")
    m = materialise(mentions.extract_mentions(r, ("acronym",)), "acronyms")
    e = materialise(entities.merge_entities(m), "entities")
    return r, m, e, materialise(entities.entity_regions(e, m), "bridge")


def _acronym_entities(spark, sf_dir) -> DataFrame:
    """The entities alone: neither regions nor mentions are written."""
    return materialise(entities.merge_entities(mentions.extract_mentions(lines(spark, sf_dir), ("acronym",))), "entities")


def _named(rel: DataFrame, e: DataFrame, *more) -> DataFrame:
    """Relations with names for ids."""
    names = e.select("entity_id", "norm")
    out = rel.join(names.select(F.col("entity_id").alias("source"), F.col("norm").alias("s")), "source").join(names.select(F.col("entity_id").alias("target"), F.col("norm").alias("t")), "target")
    return out.select("s", "t", *more)


@query(f"WITH {_ACRONYMS}, b AS (SELECT DISTINCT lower(text) AS n, region_id FROM acronyms) SELECT x.n AS a, y.n AS b, count(*) AS shared, round(least(count(*) * 0.2, 1.0), 6) AS weight FROM b x JOIN b y ON x.region_id = y.region_id AND x.n < y.n GROUP BY ALL")
def rel_cooccurs(spark, sf_dir):
    _, _, e, bridge = _acronym_layer(spark, sf_dir)
    return _named(entities.cooccurrences(bridge), e, F.size("regions").cast("long").alias("shared"), r6("weight")).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "shared", "weight")


@query(f"WITH {_ACRONYMS}, b AS (SELECT DISTINCT lower(text) AS n, region_id FROM acronyms) SELECT region_id, list_sort(list(n)) AS names, count(*) AS n FROM b GROUP BY region_id HAVING count(*) >= 2")
def region_entity_lists(spark, sf_dir):
    _, _, e, bridge = _acronym_layer(spark, sf_dir)
    listed = entities.region_entities(bridge, 2).select("region_id", "n", F.explode("entities").alias("entity_id")).join(e.select("entity_id", "norm"), "entity_id")
    return listed.groupBy("region_id", "n").agg(F.array_sort(F.collect_list("norm")).alias("names"))


_RELATED = "CASE event_type WHEN 'click' THEN 'cites' WHEN 'view' THEN 'Works For' WHEN 'purchase' THEN 'compares to' WHEN 'signup' THEN 'acquired' WHEN 'login' THEN 'authored' ELSE 'foo ' || event_type END"


@query(f"SELECT event_id, CASE replace(lower({_RELATED}), ' ', '_') WHEN 'cites' THEN 'REFERENCES' WHEN 'compares_to' THEN 'COMPARED_TO' WHEN 'authored' THEN 'AUTHORED_BY' WHEN 'acquired' THEN 'ACQUIRED_BY' ELSE upper(replace({_RELATED}, ' ', '_')) END AS relation FROM events")
def relation_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", Y.map_relation(F.expr(_RELATED)).alias("relation"))


_LABEL = "CASE event_id % 5 WHEN 0 THEN 'Technology' WHEN 1 THEN 'research' WHEN 2 THEN 'zzz' WHEN 3 THEN 'price tag' ELSE 'zzz loc' END"
_TEXT = "CASE CAST(floor(event_id / 5) AS BIGINT) % 10 WHEN 0 THEN '2023' WHEN 1 THEN '12.5%' WHEN 2 THEN '7 percent' WHEN 3 THEN '$1,200' WHEN 4 THEN '3-4' WHEN 5 THEN 'v1.2' WHEN 6 THEN 'Keras' WHEN 7 THEN 'Some Name' WHEN 8 THEN 'NASA' ELSE 'something else' END"


@query(
    f"""WITH m AS (SELECT event_id, {_LABEL} AS label, {_TEXT} AS text FROM events)
SELECT event_id, label, text, CASE label WHEN 'Technology' THEN 'PRODUCT' WHEN 'research' THEN 'CONCEPT' ELSE
  CASE text WHEN '2023' THEN 'DATE_TIME' WHEN '12.5%' THEN 'PERCENTAGE' WHEN '7 percent' THEN 'PERCENTAGE' WHEN '$1,200' THEN 'MONEY' WHEN '3-4' THEN 'METRIC' WHEN 'v1.2' THEN 'PRODUCT' WHEN 'Keras' THEN 'PRODUCT' ELSE
    CASE label WHEN 'price tag' THEN 'MONEY' WHEN 'zzz loc' THEN 'LOCATION' ELSE CASE text WHEN 'Some Name' THEN 'PERSON' WHEN 'NASA' THEN 'ORGANIZATION' ELSE 'CONCEPT' END END END END AS entity_type FROM m"""
)
def entity_type_map(spark, sf_dir):
    m = table(spark, sf_dir, "events").select("event_id", F.expr(_LABEL).alias("label"), F.expr(_TEXT).alias("text"))
    return m.select("event_id", "label", "text", Y.map_entity_type(F.col("label"), F.col("text"), F.lit("around it")).alias("entity_type"))


# --- graph ----------------------------------------------------------------------------------------
# Orders as a graph: customers - suppliers that met in an order.

_META = "e AS (SELECT DISTINCT 'c' || o_custkey AS source, 's' || l_suppkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _trade(spark, sf_dir) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    met = o.select("o_orderkey", "o_custkey").join(li.select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return met.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target")).distinct()


@query(f"WITH {_META}, u AS (SELECT source AS node FROM e UNION ALL SELECT target FROM e) SELECT node, count(*) AS degree FROM u GROUP BY node")
def graph_degrees(spark, sf_dir):
    return graph.degrees(_trade(spark, sf_dir))


@query(f"WITH {_META} SELECT 's1' AS start, source AS node FROM e WHERE target = 's1'")
def neighbours_one(spark, sf_dir):
    return graph.neighbours(_trade(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"))


@query(f"WITH {_META}, u AS (SELECT source AS a, target AS b FROM e UNION ALL SELECT target, source FROM e), h1 AS (SELECT b AS node FROM u WHERE a = 's1'), h2 AS (SELECT DISTINCT u.b AS node FROM h1 JOIN u ON h1.node = u.a WHERE u.b <> 's1' AND u.b NOT IN (SELECT node FROM h1)) SELECT 's1' AS start, node, 1 AS hop FROM h1 UNION ALL SELECT 's1', node, 2 FROM h2")
def neighbours_two(spark, sf_dir):
    return graph.k_hops(_trade(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), 2)


@query(f"WITH {_META}, n AS (SELECT DISTINCT 'c' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal > 0) SELECT source, target FROM e WHERE source IN (SELECT node FROM n) AND target IN (SELECT node FROM n)")
def induced_subgraph(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return graph.induced(_trade(spark, sf_dir), c.unionByName(s))


@query("SELECT o_custkey AS source, o_orderpriority AS target, 'ordered' AS rel_type, max(o_totalprice) AS weight, arg_min(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY ALL")
def relation_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rel = o.select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("target"), F.lit("ordered").alias("rel_type"), F.col("o_totalprice").alias("weight"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ord"))
    return entities.unique_relations(rel).drop("ord")


# --- ranking --------------------------------------------------------------------------------------

_ASK = "q AS (SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user')"


def _questions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))


@query(
    f"""WITH {_ASK}, k AS (SELECT query_id, list_filter(list_distinct({_words("lower(question)")}), lambda w: length(w) > 3) AS kw FROM q),
m AS (SELECT query_id, item_id, len(list_filter(kw, lambda w: contains(lower(text), w))) AS matches, len(kw) AS n FROM k, benchmark),
r AS (SELECT *, least(1.0, matches / n) AS score, row_number() OVER (PARTITION BY query_id ORDER BY matches DESC, item_id) AS rank FROM m WHERE matches > 0)
SELECT query_id, item_id AS doc_id, matches, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
)
def region_keyword_rank(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("region_id"), F.lit(0).alias("ord"), "text")
    return search.rank_regions(_questions(spark, sf_dir), b, 5).select("query_id", "doc_id", F.col("matches").cast("long").alias("matches"), r6("score"), F.col("rank").cast("long").alias("rank"))


_STOPLIST = ", ".join(f"'{w}'" for w in L.STOP_WORDS)


def _terms(expr: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({_STOPLIST}))"
    return f"list_concat({kept}, list_transform(range(1, greatest(1, len({kept}))::BIGINT), lambda i: {kept}[i] || ' ' || {kept}[i + 1]))"


_INDEX = f"""w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({_STOPLIST})) AS l FROM benchmark WHERE length(trim(text, ' ')) > 10),
t AS (SELECT item_id, unnest(list_concat(l, list_transform(range(1, greatest(1, len(l))::BIGINT), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM w),
c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT 5000),
x AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM w)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term)),
p AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM x)"""


@query(f"WITH {_INDEX} SELECT item_id AS doc_id, term, round(weight, 6) AS weight FROM p")
def tfidf_index(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("r").alias("region_id"), "text")
    return search.build_text_index(b)[0].select("doc_id", "term", r6("weight"))


@query(
    f"""WITH {_INDEX}, {_ASK}, qw AS (SELECT query_id, list_filter(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({_STOPLIST})) AS l FROM q),
qt AS (SELECT query_id, unnest(list_concat(l, list_transform(range(1, greatest(1, len(l))::BIGINT), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM qw),
qc AS (SELECT query_id, term, count(*) AS tf FROM qt GROUP BY ALL),
qx AS (SELECT query_id, term, tf * (ln((1 + (SELECT count(*) FROM w)) / (1 + df)) + 1) AS w FROM qc JOIN v USING (term)),
qp AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qx),
s AS (SELECT query_id, item_id, round(sum(qp.weight * p.weight), 6) AS score FROM qp JOIN p USING (term) GROUP BY ALL)
SELECT query_id, item_id AS doc_id, score FROM s WHERE score > 0.05"""
)
def tfidf_search(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("r").alias("region_id"), "text")
    postings, vocabulary = search.build_text_index(b)
    return search.search_text_index(_questions(spark, sf_dir), postings, vocabulary, None, 0.0).select("query_id", "doc_id", r6("score")).where("score > 0.05")


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score FROM r WHERE rank <= 10")
def knn_cosine(spark, sf_dir):
    """Every twentieth vector asks; all others answer."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.nearest_vectors(e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), e, 10, digits=6).select("query_id", "id", "score")


@query(f"SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id WHERE {_COS} >= 0.3")
def knn_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.nearest_vectors(e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), e, None, 0.3, 6).select("query_id", "id", "score")


@query(
    "WITH r AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY -abs(x), i) AS r FROM r) SELECT vec_id, list(CASE WHEN r <= 8 THEN round(x, 6) ELSE 0 END ORDER BY i) AS v FROM k GROUP BY vec_id"
)
def compress_sparse(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.sparse(F.col("embedding"), 8), lambda x: F.round(x, 6)).alias("v"))


@query(
    "WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_min(embedding::DOUBLE[]) AS lo, list_max(embedding::DOUBLE[]) AS hi FROM embeddings) SELECT vec_id, list_transform(e, lambda x: round(floor((x - lo) / ((hi - lo) / 255)) * ((hi - lo) / 255) + lo, 6)) AS v FROM m"
)
def compress_quantize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.quantised(F.col("embedding"), constant=False), lambda x: F.round(x, 6)).alias("v"))


@query("SELECT label, list_transform(range(1, 65), lambda i: round(avg_i[i], 5)) AS v FROM (SELECT label, list(m ORDER BY i) AS avg_i FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)")
def mean_pooling(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(regions.mean_components(F.col("embedding"), 64).alias("v"))
    return e.select("label", F.transform("v", lambda x: F.round(x, 5)).alias("v"))


@query("WITH n AS (SELECT sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n, len(embedding) AS s, len(list_filter(embedding, lambda x: abs(x) < 1e-6)) AS z FROM embeddings) SELECT count(*) AS count, max(s)::INTEGER AS size, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm, round(sum(z) / sum(s), 6) AS sparsity, round(sum(s) * 4 / 1024, 6) AS kilobytes FROM n")
def embedding_stats(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("embedding").alias("vector"))
    return statistics.embedding_statistics(e).select("count", "size", r6("mean_norm"), r6("std_norm"), r6("sparsity"), r6("kilobytes"))


@query(
    """WITH v AS (SELECT label AS q, vec_id AS id, round(list_sum(embedding::DOUBLE[]), 6) AS s FROM embeddings WHERE embedding[1] > 0), t AS (SELECT label AS q, vec_id AS id, embedding[2]::DOUBLE AS s FROM embeddings WHERE embedding[2] > 0)
SELECT coalesce(v.q, t.q)::BIGINT AS query_id, coalesce(v.id, t.id) AS region_id, round(coalesce(v.s, 0) * 0.6 + coalesce(t.s, 0) * 0.4, 5) AS score, CASE WHEN v.q IS NOT NULL AND t.q IS NOT NULL THEN 'both' WHEN v.q IS NOT NULL THEN 'visual' ELSE 'text' END AS origin FROM v FULL JOIN t ON v.q = t.q AND v.id = t.id"""
)
def visual_text_fusion(spark, sf_dir):
    """Two lists by the rows' own components: each row with a positive first or second one is in the list of that."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("region_id"), "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    v = e.where("embedding[0] > 0").select("query_id", "region_id", F.round(total, 6).alias("score"))
    t = e.where("embedding[1] > 0").select("query_id", "region_id", F.col("embedding")[1].cast("double").alias("score"))
    return search.fuse_candidates(v, t).select("query_id", "region_id", F.round("score", 5).alias("score"), "origin")


# --- budgets --------------------------------------------------------------------------------------

_TOK = "t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS tokens, l_partkey FROM lineitem)"


def _sized(spark, sf_dir):
    """Short ranked lists, as of questions: the lines of an order, with their quantity for tokens."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("tokens"), "l_partkey")


_RANKED = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, tokens"


@query(f"WITH {_TOK}, u AS (SELECT *, sum(tokens) OVER ({_RANKED} ROWS UNBOUNDED PRECEDING) AS used FROM t) SELECT l_orderkey, l_linenumber, l_partkey, tokens, CAST(used AS BIGINT) AS used FROM u WHERE used <= 80")
def budget_prefix(spark, sf_dir):
    return budget.before_overflow(_sized(spark, sf_dir), 80, ("l_orderkey",), ("l_linenumber", "l_partkey", "tokens"))


@query(f"WITH {_TOK}, u AS (SELECT *, coalesce(sum(tokens) OVER ({_RANKED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t) SELECT l_orderkey, l_linenumber, l_partkey, tokens, CAST(before AS BIGINT) AS before FROM u WHERE before < 80")
def budget_after(spark, sf_dir):
    return budget.until_reached(_sized(spark, sf_dir), 80, ("l_orderkey",), ("l_linenumber", "l_partkey", "tokens"))


@query(
    f"""WITH RECURSIVE {_TOK}, o AS (SELECT *, row_number() OVER ({_RANKED}) AS r FROM t),
f AS (SELECT l_orderkey, r, l_partkey, CASE WHEN tokens <= 80 THEN tokens ELSE 0 END AS used, tokens <= 80 AS taken FROM o WHERE r = 1
  UNION ALL SELECT o.l_orderkey, o.r, o.l_partkey, f.used + CASE WHEN f.used + o.tokens <= 80 THEN o.tokens ELSE 0 END, f.used + o.tokens <= 80 FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.r = f.r + 1)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY r) - 1 AS INTEGER) AS place, l_partkey FROM f WHERE taken"""
)
def budget_greedy(spark, sf_dir):
    """Skips what overflows and goes on."""
    return budget.skipping(_sized(spark, sf_dir), 80, ("l_orderkey",), ("l_linenumber", "l_partkey"), row="l_partkey")


# --- text functions -------------------------------------------------------------------------------


@query(f"SELECT doc_id, length(text) // 4 AS by_chars, CAST(floor(len({_words('text')}) * 0.75) AS BIGINT) AS by_words FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("by_chars"), T.token_estimate("text", "words").alias("by_words"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 197) || '...' END AS cut, CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 150) || '~' || right(text, 150) END AS squeezed FROM documents")
def text_compress(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate("text", 200).alias("cut"), T.squeeze("text", 400, "~").alias("squeezed"))


@query("WITH l AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS line FROM documents) SELECT doc_id, CASE WHEN length(text) / 4 <= 500 THEN text WHEN length(line) / 4 <= 500 THEN line ELSE substr(line, 1, 2000) || '...' END AS context FROM l")
def context_compress(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.compress_context("text", 500).alias("context"))


@query("SELECT doc_id, replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), '``', '\"'), '''''', '\"') AS clean FROM documents")
def ocr_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_ocr("text").alias("clean"))


_PREPARED = "text"
for _pattern, _by in ((r"\s+([.,;:!?)])", r"\1"), (r"([({])\s+", r"\1"), (r"\s{2,}", " "), (r"([0-9]+)\.(\S)", r"\1. \2"), (r"([•*])(\S)", r"\1 \2"), ("–+", "-"), ("—+", "-")):
    _PREPARED = f"regexp_replace({_PREPARED}, '{_pattern}', '{_by}', 'g')"


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_PREPARED}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10)) AS prepared FROM documents")
def ner_preprocess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.prepare("text").alias("prepared"))


@query("SELECT doc_id, round(length(text) / 1000, 6) AS length, round(len(regexp_extract_all(text, '\\p{Lu}')) / greatest(length(text), 1), 6) AS upper_ratio, round(len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1), 6) AS digit_ratio, round(len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s]')) / greatest(length(text), 1), 6) AS punctuation_ratio FROM documents")
def text_stats(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", T.text_statistics("text").alias("s")).select("doc_id", "s.*")
    return s.select("doc_id", r6("length"), r6("upper_ratio"), r6("digit_ratio"), r6("punctuation_ratio"))


@query(
    f"""WITH b AS (SELECT doc_id, text, {_words("text")} AS w, len(list_filter(string_split(text, '.'), lambda s: trim(s, ' ') <> '')) AS s FROM documents),
y AS (SELECT doc_id, text, len(w) AS n, s, coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - CASE WHEN lower(x) LIKE '%e' AND len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))), 0) AS t FROM b)
SELECT doc_id, n AS words, CAST(t AS BIGINT) AS syllables, round(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(0, least(100, (206.835 - 1.015 * n / greatest(1, s) - 84.6 * CASE WHEN n > 0 THEN t / n ELSE 1 END) / 100)) END, 5) AS flesch FROM y"""
)
def readability(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select("doc_id", T.readability("text").alias("r")).select("doc_id", "r.*")
    return r.select("doc_id", F.col("words").cast("long").alias("words"), F.col("syllables").cast("long").alias("syllables"), F.round("flesch", 5).alias("flesch"))


@query(
    f"""WITH {_ASK}, c AS (SELECT *, lower(question) AS low, {_words("question")} AS w FROM q) SELECT query_id,
CASE WHEN regexp_matches(low, '\\b(figure|chart|diagram|table|visualization|plot|image|screenshot|graph|picture|layout|illustration)\\b') THEN 4
  WHEN regexp_matches(low, '\\b(compare|contrast|differences?|versus|summarize|synthesize|across|multiple|all sections|all the experiments|between these methods)\\b') THEN 3
  WHEN regexp_matches(low, '\\b(why|how|explain|analyze|causes?|correlation|relationship|impact|reasoning|interact)\\b') THEN 2 ELSE 1 END AS level,
CASE WHEN regexp_matches(low, 'show|figure|chart|graph|image') THEN 'visual' WHEN regexp_matches(low, 'table|row|column|cell') THEN 'table' WHEN regexp_matches(low, 'layout|structure|format|design') THEN 'layout' WHEN regexp_matches(low, 'formula|equation|math|symbol') THEN 'mathematical' ELSE 'general' END AS kind,
CASE WHEN regexp_matches(low, 'what|define|explain|describe') THEN 'definition' WHEN regexp_matches(low, 'how|way|method|process') THEN 'process' WHEN regexp_matches(low, 'find|locate|where|position') THEN 'location' WHEN regexp_matches(low, 'compare|difference|versus|vs') THEN 'comparison' ELSE 'search' END AS intent,
round(CASE WHEN len(w) = 0 THEN 0 ELSE (least(1.0, len(w) / 20) + least(1.0, len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w)) + least(1.0, list_sum(list_transform(w, lambda x: length(x))) / len(w) / 10)) / 3 END, 6) AS complexity FROM c"""
)
def query_classify(spark, sf_dir):
    q = F.col("question")
    return _questions(spark, sf_dir).select("query_id", Y.query_level(q).alias("level"), Y.query_type(q).alias("kind"), Y.query_intent(q).alias("intent"), F.round(Y.query_complexity(q), 6).alias("complexity"))


# Keywords of each kind of document and patterns, as they are defined.
_KINDS = {
    "academic": ("abstract introduction methodology results discussion conclusion references bibliography doi arxiv journal conference paper research study experiment hypothesis theorem proof algorithm dataset benchmark evaluation performance accuracy precision recall f1-score", [r"\b(?:Fig\.|Figure)\s+\d+", r"\b(?:Tab\.|Table)\s+\d+", r"\b(?:Eq\.|Equation)\s*\(\d+\)", r"\b\d{4}\.\s*[A-Za-z]+", r"\barxiv:\d+\.\d+", r"\bdoi:\s*10\.\d+/\S+"]),
    "business": ("revenue profit loss market sales customer client company corporation ceo cfo cto executive quarter annual report earnings stock share investment funding merger acquisition partnership budget cost expense strategy growth performance", [r"\$\d+(?:,\d{3})*(?:\.\d{2})?\s*(?:million|billion|trillion)", r"\b\d+(?:\.\d+)?%\s*(?:growth|increase|decrease)", r"\bQ[1-4]\s+20\d{2}", r"\bFY\s+20\d{2}"]),
    "technical": ("api sdk framework library module function class method algorithm data_structure database server client frontend backend architecture deployment configuration installation version bug error issue fix patch update release code programming development testing debugging", [r"\b[A-Z][a-z]*[A-Z][a-z]*\b", r"\b\w+(?:\.\w+)+\b", r"function\s+\w+\s*\(", r"class\s+\w+\s*:", r"def\s+\w+\s*\(", r"<[^>]+>", r"www\.\S+\.\S+", r"https?://\S+"]),
    "legal": ("court judge lawyer attorney plaintiff defendant case lawsuit verdict ruling judgment decision contract agreement clause regulation statute legal evidence testimony witness objection sustained overruled appealed filed motion", [r"\b\d+:\d+\s*(?:AM|PM|am|pm)", r"\bCourt\s+of\s+\w+", r"\bNo\.\s+\d+-\d+", r"\b§\s*\d+", r"\b\d+\s+U\.S\.C\."]),
    "medical": ("patient doctor physician nurse hospital clinic diagnosis treatment therapy medication drug medicine symptom disease condition procedure surgery test lab result blood pressure temperature dose prescription medical health clinical", [r"\b\d+\s*mg\b", r"\b\d+\s*ml\b", r"\b\d+/\d+/\d{4}", r"\bBP:\s*\d+/\d+", r"\bHR:\s*\d+", r"\bTemp:\s*\d+\.?\d*°(?:C|F)"]),
    "news": ("reported announced said according_to sources journalist reporter editor breaking update story article headline press media interview commentary opinion statement confirmed denied", [r"\b[A-Z][a-z]+,\s+[A-Z][a-z]+\s+\-\-", r"\b\d+\s+(?:years?|months?|weeks?|days?)\s+ago", r"\b[A-Z][a-z]+\s+\(AP\)", r"\b\d+:\d+\s*[APM|ampm]"]),
}


def _bordered(pattern: str) -> str:
    """The pattern with words of all scripts, for an engine whose own words are ASCII."""
    letter = r"[\p{L}\p{N}_]"
    pattern = re.sub(r"^\\b(?=§)", lambda _: letter, pattern)
    pattern = re.sub(r"^\\b", lambda _: r"(?:^|[^\p{L}\p{N}_])", pattern)
    return re.sub(r"\\b$", lambda _: r"(?:[^\p{L}\p{N}_]|$)", pattern).replace(r"\w", letter)


def _score_sql(keywords: str, patterns: list[str]) -> str:
    hits = [f"contains(lower(text), '{k.replace('_', ' ')}')::INT" for k in keywords.split()] + [f"2 * regexp_matches(text, '{_bordered(p)}')::INT" for p in patterns]
    return " + ".join(hits)


@query(
    "WITH s AS (SELECT doc_id, " + ", ".join(f"{_score_sql(*spec)} AS {name}" for name, spec in _KINDS.items()) + " FROM documents), g AS (SELECT *, greatest(" + ", ".join(_KINDS) + ") AS g, " + " + ".join(_KINDS) + " AS total FROM s) SELECT doc_id, CASE WHEN g = 0 THEN 'general' "
    + " ".join(f"WHEN {n} = g THEN '{n}'" for n in _KINDS) + " END AS name, round(CASE WHEN g = 0 THEN 0.5 ELSE g / total END, 6) AS confidence FROM g"
)
def doc_type_classify(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", Y.document_type(F.col("text")).alias("d"))
    return d.select("doc_id", "d.name", F.round("d.confidence", 6).alias("confidence"))


# --- figures --------------------------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, 1::BIGINT AS pages, count(*) AS regions, CAST(sum(len({_words('text')}) // 3) AS BIGINT) AS tokens, round(CASE WHEN sum(len({_words('text')}) // 3) > 0 THEN 2500 / sum(len({_words('text')}) // 3) ELSE 0 END, 6) AS ratio, CAST(2500 - sum(len({_words('text')}) // 3) AS BIGINT) AS saved FROM regions GROUP BY doc_id")
def indexing_stats(spark, sf_dir):
    return statistics.indexing_statistics(lines(spark, sf_dir)).select("doc_id", "pages", "regions", "tokens", r6("ratio"), "saved")


@query(
    f"""WITH {_HTML} SELECT doc_id, count(*) AS regions, count(*) FILTER (y1 < 0.2) AS header_zone, count(*) FILTER (y1 >= 0.2 AND y2 > 0.8) AS footer_zone, count(*) FILTER (y1 >= 0.2 AND y2 <= 0.8) AS body_zone,
CASE WHEN count(*) FILTER (block_type = 'header') > 0 AND count(*) FILTER (block_type = 'paragraph') > 0 THEN 'standard_article' ELSE 'simple_text' END AS pattern, round((least(1.0, count(*) / 20) + least(1.0, count(DISTINCT block_type) / 7)) / 2, 6) AS complexity,
round(CASE WHEN sum(x2 - x1) > 0 THEN 1 - abs(coalesce(sum(x2 - x1) FILTER ((x1 + x2) / 2 < 0.5), 0) - coalesce(sum(x2 - x1) FILTER ((x1 + x2) / 2 >= 0.5), 0)) / sum(x2 - x1) ELSE 1 END, 6) AS balance, count(*) FILTER (block_type IN ('table', 'figure', 'formula', 'chart')) AS visual, round(sum(length(text)) / greatest(1.0, sum((x2 - x1) * (y2 - y1))), 4) AS density FROM html_regions GROUP BY doc_id"""
)
def page_layout_stats(spark, sf_dir):
    return regions.page_structure(html(spark, sf_dir)).select("doc_id", "regions", "header_zone", "footer_zone", "body_zone", "pattern", r6("complexity"), r6("balance"), "visual", F.round("density", 4).alias("density"))


def _flow_sql(source: str) -> str:
    order = "PARTITION BY doc_id ORDER BY y1, x1, ord"
    return f"l AS (SELECT *, lag(block_type) OVER ({order}) AS b, lag(x1) OVER ({order}) AS left_before, row_number() OVER ({order}) - 1 AS position FROM {source}) SELECT doc_id, region_id, position, CASE WHEN b IS NULL THEN 'sequential' WHEN b <> block_type THEN 'transition' WHEN x1 < left_before - 0.05 THEN 'column_change' ELSE 'sequential' END AS flow FROM l"


@query(f"WITH {_HTML}, {_flow_sql('html_regions')}")
def content_flow(spark, sf_dir):
    return regions.content_flow(html(spark, sf_dir)).select("doc_id", "region_id", F.col("position").cast("long").alias("position"), "flow")


@query(f"WITH {_GRID}, kinds AS (SELECT * REPLACE (CASE WHEN ord % 25 < 12 THEN 'paragraph' ELSE block_type END AS block_type) FROM grid), {_flow_sql('kinds')}")
def content_flow_columns(spark, sf_dir):
    """Pages of several columns, where a row that begins anew changes the column."""
    g = _grid(spark, sf_dir).withColumn("block_type", F.when(F.col("ord") % 25 < 12, "paragraph").otherwise(F.col("block_type")))
    return regions.content_flow(g).select("doc_id", "region_id", F.col("position").cast("long").alias("position"), "flow")


@query(f"WITH {_SURE}, o AS (SELECT s.*, a.ord, row_number() OVER (PARTITION BY s.doc_id, norm ORDER BY s.confidence DESC, a.ord, a.text DESC) AS r FROM surely s JOIN acronyms a ON s.region_id = a.region_id AND s.text = a.text) SELECT doc_id, norm, count(*) AS mention_count, list_sort(list(DISTINCT region_id)) AS regions, max(region_id) FILTER (r = 1) AS best, round(max(confidence), 6) AS confidence FROM o GROUP BY doc_id, norm")
def coreference(spark, sf_dir):
    m = mentions.extract_mentions(lines(spark, sf_dir), ("acronym",))
    c = mentions.coreferences(m)
    return c.select("doc_id", "norm", "mention_count", F.array_sort(F.array_union(F.array("region_id"), F.col("others"))).alias("regions"), F.col("region_id").alias("best"), r6("confidence"))


@query("SELECT event_type AS strategy, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY event_type")
def retrieval_stats(spark, sf_dir):
    return statistics.retrieval_statistics(table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.col("event_type").alias("strategy"))).select("strategy", "n", r6("percent"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from docloom.streaming.incremental import event_windows as windows

    return windows(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT l_orderkey, 'items[' || count(*) || ']{part,quantity}:' || chr(10) || string_agg('  ' || l_partkey || ',' || l_quantity::INT, chr(10) ORDER BY l_linenumber, l_partkey, l_quantity) AS toon FROM lineitem GROUP BY l_orderkey")
def toon_encode(spark, sf_dir):
    from docloom.functions.encode import toon_table

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("quantity"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "part", "quantity"))).alias("items"))
    return rows.select("l_orderkey", toon_table("items", F.col("items"), ("part", "quantity")).alias("toon"))


# --- whole retrieval ------------------------------------------------------------------------------


_indexed: list[tuple] = []


def _engine(spark, sf_dir):
    """The index of the pages, made once for the queries that follow one another over the same tables."""
    from docloom.plans.engine import Engine

    if not _indexed or _indexed[0][:2] != (spark, sf_dir):
        _indexed[:] = [(spark, sf_dir, Engine(spark).index_regions(html(spark, sf_dir)))]
    return _indexed[0][2]


_DESCRIBED = _CONTEXT.replace("lower(substr(", "(substr(")
_ENTITIES = f"""{_SURE}, described AS (
  SELECT lower(text) AS norm, arg_min(text, o) AS name, arg_min(c, [-length(c), doc_id, o]) AS about, min(o) AS o
  FROM (SELECT a.doc_id, a.text, (a.doc_id * 100000 + a.ord) * 100000 + list_position({_tokens('region_text')}, a.text) AS o, {_DESCRIBED} AS c FROM (SELECT a.*, r.text AS region_text FROM acronyms a JOIN regions r USING (region_id)) a) GROUP BY lower(text)
), entities AS (SELECT norm, lower(any_value(name)) AS n, lower(any_value(about)) AS d, any_value(o) AS o, count(*) AS mention_count, avg(confidence) AS confidence FROM surely JOIN described USING (norm) GROUP BY norm)"""


def _found_sql(k: int) -> str:
    return f"""WITH {_ENTITIES}, {_ASK}, k AS (SELECT query_id, lower(trim(question, ' ')) AS q, list_distinct({_words("lower(question)")}) AS qw FROM q),
w AS (SELECT *, list_distinct(list_concat({_words("n")}, {_words("d")})) AS w FROM entities),
s AS (SELECT query_id, norm, o, mention_count, confidence, CASE WHEN contains(n, q) OR contains(d, q) THEN CASE WHEN q = n THEN 1.0 WHEN contains(n, q) THEN 0.9 ELSE 0.7 END WHEN len(list_intersect(qw, w)) > 0 THEN len(list_intersect(qw, w)) / len(qw) * 0.6
  WHEN len(list_filter(qw, lambda x: length(x) > 3 AND (contains(n, x) OR contains(d, x)))) > 0 THEN 0.4 ELSE 0 END AS base FROM k, w),
r AS (SELECT *, round(base * (1 + least(mention_count * 0.1, 0.5)) * confidence, 9) AS score FROM s WHERE base > 0),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, o) AS rank FROM r QUALIFY rank <= {k})"""


@query(_found_sql(10) + " SELECT query_id, norm, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM found")
def entity_search(spark, sf_dir):
    e = _acronym_entities(spark, sf_dir)
    return search.search_entities(_questions(spark, sf_dir), e, 10).join(e.select("entity_id", "norm"), "entity_id").select("query_id", "norm", r6("score"), "rank")


@query(_found_sql(5) + " SELECT query_id, norm, round(least(1.0, mention_count * 0.3 + confidence * 0.7), 6) AS relevance, CAST(rank AS INTEGER) AS rank FROM found")
def entity_ranking(spark, sf_dir):
    e = _acronym_entities(spark, sf_dir)
    return search.rank_entities(_questions(spark, sf_dir), e, 5).join(e.select("entity_id", "norm"), "entity_id").select("query_id", "norm", r6("relevance"), "rank")


@query(
    f"""WITH {_SURE}, t AS (SELECT *, CASE WHEN norm IN ('aws', 'gcp', 'java', 'keras') THEN 'PRODUCT' WHEN norm = 'ai' THEN 'CONCEPT' ELSE 'ORGANIZATION' END AS kind FROM surely),
g AS (SELECT doc_id, count(*) AS mentions, avg(confidence) AS c, count(DISTINCT kind) AS types FROM t GROUP BY doc_id)
SELECT doc_id, mentions, round(c, 6) AS mean_confidence, types, round(greatest(0.0, 0.4 * c + 0.3 * least(1.0, types / 12) + 0.2 - 0.1 * ((c < 0.5)::INT + (types < 2)::INT)), 6) AS score FROM g"""
)
def extraction_quality(spark, sf_dir):
    return mentions.extraction_quality(mentions.extract_mentions(lines(spark, sf_dir), ("acronym",))).select("doc_id", "mentions", r6("mean_confidence"), "types", r6("score"))


@query()
def all_relations_of_pages(spark, sf_dir):
    """Relations of every kind of mention in the pages; the parts have queries of their own with SQL."""
    return _engine(spark, sf_dir).tables["relationships"].select("source", "target", "rel_type", "weight")


def _retrieved(spark, sf_dir, level: int | None):
    asked = _questions(spark, sf_dir)
    if level:
        asked = asked.withColumn("override_level", F.lit(level))
    return _engine(spark, sf_dir).retrieve(asked)


@query()
def retrieve_all(spark, sf_dir):
    """Every question answered from the pages by the strategy of its level; the strategies are tested against plain Python."""
    return _retrieved(spark, sf_dir, None)


@query()
def retrieve_entity_lookup(spark, sf_dir):
    return _retrieved(spark, sf_dir, 1)


@query()
def retrieve_hybrid(spark, sf_dir):
    return _retrieved(spark, sf_dir, 2)


@query()
def retrieve_hierarchical(spark, sf_dir):
    return _retrieved(spark, sf_dir, 3)


@query()
def retrieve_visual_fusion(spark, sf_dir):
    return _retrieved(spark, sf_dir, 4)
