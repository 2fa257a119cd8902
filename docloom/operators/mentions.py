"""Entity mentions from region texts by patterns: the built-in backend of entity extraction.

Each extractor returns an array of mention structs (text, label, confidence) for a text; the order is
that of the text. Patterns with word borders work on tokens, so that letters of all scripts count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import lexicon as L
from docloom.functions.text import tokens, window_around
from docloom.functions.typing import boosted_confidence, map_entity_type


def _mentions(found: Column, label: str, confidence: float) -> Column:
    return F.transform(found, lambda t: F.struct(t.alias("text"), F.lit(label).alias("label"), F.lit(confidence).alias("confidence")))


def _all(text: Column, pattern: str, group: int = 0, needs: Column | None = None) -> Column:
    """What a pattern finds; ``needs`` is a cheaper test that all texts with a match pass."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return found if needs is None else F.when(needs, found).otherwise(F.array().cast("array<string>"))


def _numeric(text: Column) -> Column:
    return text.rlike("[0-9]")


def money(text: Column) -> Column:
    """Amounts in dollars with their scale word; each amount once, at its full length."""
    found = F.transform(_all(text, r"(?i)\$-?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s*(?:billion|million|thousand|[BMK])\b)?", 0, F.contains(text, F.lit("$"))), F.trim)
    scaled = lambda t: F.when(t.rlike(r"(?i)(billion|b)$"), "billion").when(t.rlike(r"(?i)(million|m)$"), "million").when(t.rlike(r"(?i)(thousand|k)$"), "thousand").otherwise("dollar")
    return F.transform(found, lambda t: F.struct(t.alias("text"), F.concat(F.lit("money_"), scaled(t)).alias("label"), F.lit(0.9).alias("confidence")))


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: Kinds of dates, in the order in which the first that fits names a value.
DATE_KINDS = (
    ("quarter", r"(?i)Q[1-4]\s+[0-9]{4}"),
    ("fiscal_year", r"(?i)FY\s*[0-9]{4}"),
    ("year_range", r"[0-9]{4}-[0-9]{4}"),
    ("full_date", rf"(?i)(?:{_MONTHS})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}"),
    ("month_year", rf"(?i)(?:{_SHORT})\.?\s+[0-9]{{4}}"),
    ("year", r"(?:19|20)[0-9]{2}"),
)


def _labelled(label: str, confidence: float):
    return lambda t: F.struct(t.alias("text"), F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))


def _unnamed(done: Column, part: Column) -> Column:
    """Mentions of ``part`` whose text ``done`` has not."""
    return F.filter(part, lambda m: ~F.exists(done, lambda d: d["text"] == m["text"]))


def dates(text: Column) -> Column:
    parts = [F.transform(F.array_distinct(_all(text, p, 0, _numeric(text))), _labelled(k, 0.85)) for k, p in DATE_KINDS]
    return reduce(lambda done, part: F.concat(done, _unnamed(done, part)), parts[1:], parts[0])


def percentages(text: Column) -> Column:
    return _mentions(_all(text, r"[-+]?[0-9]+(?:\.[0-9]+)?%", 0, F.contains(text, F.lit("%"))), "percentage", 0.9)


def metrics(text: Column) -> Column:
    """``Label: number`` and ``number unit``, where the number has more than one character."""
    label, value = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*:\s*([0-9,]+(?:\.[0-9]+)?)", r"([0-9,]+(?:\.[0-9]+)?)\s+(tokens?|pages?|visual_regions?|entities|nodes?|edges?)"
    some, colon = _numeric(text), F.contains(text, F.lit(":"))
    named = F.zip_with(_all(text, label, 1, colon), _all(text, label, 2, colon), lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    unit = F.zip_with(_all(text, value, 2, some), _all(text, value, 1, some), lambda n, v: F.struct(n.alias("n"), v.alias("v")))
    kept = F.filter(F.concat(named, unit), lambda p: F.length(p["v"]) > 1)
    return F.transform(kept, lambda p: F.struct(F.concat(p["n"], F.lit(": "), p["v"]).alias("text"), F.lit("metric").alias("label"), F.lit(0.8).alias("confidence")))


def organisations(text: Column) -> Column:
    """Names with a legal suffix (its full stop left out) and well-known technology names."""
    suffix = r"\b[A-Z][A-Za-z&\-]+(?:\s+[A-Z][A-Za-z&\-]+)*\s+(?:Inc|Corp|Ltd|LLC|Co|Company|Corporation|Group|Foundation)\b"
    names = F.filter(F.array(*[F.lit(n) for n in L.TECHNOLOGY_NAMES]), lambda n: F.contains(text, n))
    return F.concat(_mentions(F.array_distinct(_all(text, suffix, 0, text.rlike("Inc|Corp|Ltd|LLC|Co|Group|Foundation"))), "organization", 0.90), _mentions(names, "technology", 0.85))


def acronyms(text: Column) -> Column:
    some = F.when(text.rlike("[A-Z]{2}"), tokens(text)).otherwise(F.array().cast("array<string>"))
    found = F.filter(some, lambda t: t.rlike("^[A-Z]{2,6}$") & ~t.isin(*L.ACRONYM_STOPS))
    return _mentions(F.array_distinct(found), "acronym", 0.80)


def hyphen_terms(text: Column) -> Column:
    found = F.filter(_all(F.lower(text), r"(?<![\p{L}\p{N}_])[a-z]+-[a-z]+(?:-[a-z]+)*(?![\p{L}\p{N}_])", 0, F.contains(text, F.lit("-"))), lambda t: F.length(t) > 5)
    return _mentions(F.array_distinct(found), "technical_term", 0.75)


def concepts(text: Column, most: int = 10) -> Column:
    """Capitalised phrases of several words among the first ``most``."""
    first = F.slice(_all(text, r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"), 1, most)
    kept = F.filter(F.array_distinct(first), lambda t: (F.length(t) > 8) & ~F.get(F.split(t, r"\s+"), F.lit(0)).isin(*L.CONCEPT_STOPS))
    return _mentions(kept, "concept", 0.70)


def processes(text: Column, most: int = 5) -> Column:
    """Words in -ing, -tion and -ment of more than six letters, the first ``most`` in that order."""
    # The words are bound to a variable: written out, they would be split again for each ending.
    ending = lambda low, end: F.filter(low, lambda t: t.endswith(end) & (F.length(t) > 6))
    ends = F.transform(F.array(tokens(F.lower(text))), lambda low: F.concat(*[ending(low, e) for e in ("ing", "tion", "ment")]))
    return _mentions(F.slice(F.array_distinct(F.get(ends, F.lit(0))), 1, most), "process", 0.65)


EXTRACTORS = {"money": money, "date": dates, "percentage": percentages, "metric": metrics, "organization": organisations, "acronym": acronyms, "term": hyphen_terms, "concept": concepts, "process": processes}


def extract_mentions(regions: DataFrame, kinds: tuple[str, ...] = tuple(EXTRACTORS)) -> DataFrame:
    """A row per mention: region keys, text, label, entity type, place, context, confidence and ord.

    One projection over the regions; ord numbers the mentions of a document in order.
    """
    found = F.concat(*[EXTRACTORS[k](F.col("text")) for k in kinds])
    each = regions.select("doc_id", "page_num", "region_id", "block_type", "bbox", F.col("ord").alias("region_ord"), F.col("text").alias("region_text"), F.posexplode(found).alias("k", "m"))
    start = (F.instr(F.col("region_text"), F.col("m.text")) - 1).cast("int")
    out = each.select(
        "doc_id", "page_num", "region_id", "block_type", "bbox", F.col("m.text").alias("text"), F.lower(F.trim(F.col("m.text"))).alias("norm"), F.col("m.label").alias("label"), F.col("m.confidence").alias("base"), start.alias("start"), "region_text", (F.col("region_ord") * 1_000_000 + F.col("k")).alias("ord")
    )
    context = window_around(F.col("region_text"), F.col("start"), F.col("start") + F.length("text"))
    out = out.withColumn("context", context).withColumn("entity_type", map_entity_type(F.col("label"), F.col("text"), F.col("context")))
    confidence = boosted_confidence(F.col("base"), F.col("text"), F.col("entity_type"), F.col("context"))
    return out.withColumn("confidence", confidence).withColumn("end", F.col("start") + F.length("text")).drop("base", "region_text")


def valid_mentions(mentions: DataFrame, least: float | None = None) -> DataFrame:
    kept = mentions.where("trim(text) != ''")
    return kept if least is None else kept.where(F.col("confidence") >= least)


def unique_mentions(mentions: DataFrame) -> DataFrame:
    """The first mention of each (document, text, label)."""
    rest = [c for c in mentions.columns if c not in ("doc_id", "text", "label")]
    return mentions.groupBy("doc_id", "text", "label").agg(F.min_by(F.struct(*rest), "ord").alias("r")).select("doc_id", "text", "label", "r.*").select(*mentions.columns)


def fuzzy_unique(mentions: DataFrame, threshold: float = 0.8):
    """Mentions of a document, most confident first, without those like one that stays.

    Alike: equal, one inside the other, or character sets with a Jaccard similarity of ``threshold``.
    Greedy, so a document's mentions are what one task holds.
    """
    import pandas as pd

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["confidence", "ord"], ascending=[False, True], kind="stable")
        kept: list[tuple[str, set]] = []
        stays = []
        for name in group["norm"]:
            mine = set(name)
            like = any(name == k or name in k or k in name or len(mine & s) >= threshold * len(mine | s) for k, s in kept)
            stays.append(not like)
            if not like:
                kept.append((name, mine))
        return group.loc[stays, ["doc_id", "norm", "label", "confidence", "ord"]]

    kind = dict(mentions.dtypes)["doc_id"]
    return mentions.select("doc_id", "norm", "label", "confidence", "ord").groupBy("doc_id").applyInPandas(greedy, f"doc_id {kind}, norm string, label string, confidence double, ord long")


def coreferences(mentions: DataFrame) -> DataFrame:
    """Per document, normalised name and label: the surest mention, the number, and the other regions."""
    best = F.max_by(F.struct("region_id", "text", "confidence"), F.struct("confidence", -F.col("ord")))
    return mentions.groupBy("doc_id", "norm", "label").agg(best.alias("best"), F.count("*").alias("mention_count"), F.array_sort(F.collect_set("region_id")).alias("regions"), F.array_sort(F.collect_set("page_num")).alias("pages")).select(
        "doc_id", "norm", "label", "best.*", "mention_count", F.array_except("regions", F.array("best.region_id")).alias("others"), "pages"
    )


def by_requested_types(mentions: DataFrame, requested: DataFrame) -> DataFrame:
    """For each requested label its mentions, an empty list for none."""
    lists = mentions.groupBy("label").agg(F.array_sort(F.collect_set("norm")).alias("names"))
    return requested.join(lists, "label", "left").select("label", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def extraction_quality(mentions: DataFrame, kinds: int = 12) -> DataFrame:
    """Per document: mean confidence, variety of types and grounding as one score."""
    grounded = F.avg((F.col("region_id").isNotNull() & F.col("bbox").isNotNull()).cast("double"))
    issues = (F.avg("confidence") < 0.5).cast("int") + (F.count_distinct("entity_type") < 2).cast("int")
    score = 0.4 * F.avg("confidence") + 0.3 * F.least(F.lit(1.0), F.count_distinct("entity_type") / kinds) + 0.2 * grounded - 0.1 * issues
    return mentions.groupBy("doc_id").agg(F.count("*").alias("mentions"), F.avg("confidence").alias("mean_confidence"), F.count_distinct("entity_type").alias("types"), F.greatest(F.lit(0.0), score).alias("score"))


def document_summary(mentions: DataFrame) -> DataFrame:
    """Per document and type: counts and the spread of confidences."""
    return mentions.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("least"), F.max("confidence").alias("most"), F.count_distinct("region_id").alias("regions"))


def proximity_pairs(mentions: DataFrame, reach: int = 100, least: float = 0.6) -> DataFrame:
    """Pairs of sure mentions of a region that begin within ``reach`` characters: RELATED_TO, 0.5."""
    keys = ["doc_id", "region_id"]
    a = mentions.where(F.col("confidence") >= least).select(*keys, F.col("norm").alias("a"), F.col("start").alias("start_a"), F.col("ord").alias("ord_a"))
    b = mentions.where(F.col("confidence") >= least).select(*keys, F.col("norm").alias("b"), F.col("start").alias("start_b"), F.col("ord").alias("ord_b"))
    near = a.join(b, keys).where((F.col("ord_a") < F.col("ord_b")) & (F.abs(F.col("start_a") - F.col("start_b")) < reach))
    return near.select(*keys, "a", "b", F.lit("RELATED_TO").alias("rel_type"), F.lit(0.5).alias("confidence"))


def best_entity_match(names: DataFrame, entities: DataFrame) -> DataFrame:
    """For each name (name_id, name) the entity (ord, name) that equals it, or else one inside or around it.

    Equal names are a hash join; only names without one are compared as substrings.
    """
    e = entities.select(F.col("ord").alias("e_ord"), F.lower(F.trim("name")).alias("e_name"))
    n = names.select("name_id", F.lower(F.trim("name")).alias("n_name"))
    equal = n.join(e, F.col("n_name") == F.col("e_name")).groupBy("name_id").agg(F.min("e_ord").alias("ord"))
    rest = n.join(equal, "name_id", "left_anti")
    inside = rest.join(e, F.contains("n_name", F.col("e_name")) | F.contains("e_name", F.col("n_name"))).groupBy("name_id").agg(F.min("e_ord").alias("ord"))
    return equal.unionByName(inside)


def layout_relations(mentions: DataFrame, regions: DataFrame) -> DataFrame:
    """Mentions of a region with those of the next region in page order, typed by their labels."""
    from docloom.functions.typing import layout_pair_allowed, pair_relation

    order = Window.partitionBy("doc_id").orderBy("page_num", "bbox.y1", "bbox.x1", "ord")
    steps = regions.select("doc_id", "region_id", "block_type", F.lead("region_id").over(order).alias("next")).where("next is not null")
    a = mentions.select("doc_id", "region_id", F.col("norm").alias("a"), F.col("entity_type").alias("type_a"), F.col("confidence").alias("conf_a"))
    b = mentions.select("doc_id", F.col("region_id").alias("next"), F.col("norm").alias("b"), F.col("entity_type").alias("type_b"), F.col("confidence").alias("conf_b"))
    pairs = steps.join(a, ["doc_id", "region_id"]).join(b, ["doc_id", "next"]).where(layout_pair_allowed(F.col("region_id"), F.col("next"), F.col("type_a"), F.col("type_b")))
    return pairs.select("doc_id", "region_id", "next", "a", "b", pair_relation(F.col("type_a"), F.col("type_b"), F.col("block_type")).alias("rel_type"), F.least("conf_a", "conf_b").alias("confidence"))


def region_proximity_relations(mentions: DataFrame, reach: int = 50) -> DataFrame:
    """Mentions of one region that follow closely, where their types have a name for it."""
    from docloom.functions.typing import proximity_relation

    keys = ["doc_id", "region_id"]
    side = lambda s: mentions.select(*keys, F.col("norm").alias(s), F.col("entity_type").alias(f"type_{s}"), F.col("confidence").alias(f"conf_{s}"), F.col("start").alias(f"start_{s}"), F.col("end").alias(f"end_{s}"), F.col("ord").alias(f"ord_{s}"))
    pairs = side("a").join(side("b"), keys).where((F.col("ord_a") < F.col("ord_b")) & (F.col("start_b") - F.col("end_a") < reach))
    kind = proximity_relation(F.col("type_a"), F.col("type_b"))
    return pairs.withColumn("rel_type", kind).where("rel_type is not null").select(*keys, "a", "b", "rel_type", (F.least("conf_a", "conf_b") * 0.9).alias("confidence"))


def hierarchy_relations(mentions: DataFrame) -> DataFrame:
    """Primary titles of a document with what its other regions hold: 0.85 of the smaller confidence."""
    from docloom.functions.typing import visual_hierarchy

    ranked = mentions.withColumn("level", visual_hierarchy(F.col("entity_type"), F.col("block_type"), F.col("start")))
    top = ranked.where("level = 'primary_title'").select("doc_id", F.col("region_id").alias("top_region"), F.col("norm").alias("a"), F.col("confidence").alias("conf_a"))
    low = ranked.where("level in ('secondary_title', 'topic_sentence', 'supporting_content')").select("doc_id", "region_id", F.col("norm").alias("b"), F.col("confidence").alias("conf_b"))
    pairs = top.join(low, "doc_id").where("top_region != region_id")
    return pairs.select("doc_id", "a", "b", F.lit("hierarchical").alias("rel_type"), (F.least("conf_a", "conf_b") * 0.85).alias("confidence"))


def quality_relations(relations: DataFrame) -> DataFrame:
    """Relations that reach the least confidence of their method and type."""
    c, method, kind = F.col("confidence"), F.col("method"), F.col("rel_type")
    return relations.where(~((method == "cooccurrence") & (c < 0.6) | (method == "schema") & (c < 0.75) | (c < 0.5) | (kind == "RELATED_TO") & (c < 0.7)))


def region_labels(block: Column) -> Column:
    """All labels asked of a model in a block: those of the types in focus, or of all types."""
    from docloom.functions.typing import focus_types

    labels = F.create_map(*[v for t, words in L.SCHEMA_LABELS.items() for v in (F.lit(t), F.array(*[F.lit(w) for w in words]))])
    every = F.array(*[F.lit(w) for words in L.SCHEMA_LABELS.values() for w in words])
    focused = F.flatten(F.transform(focus_types(block), lambda t: F.coalesce(F.element_at(labels, t), F.array(F.lower(t)))))
    return F.array_sort(F.array_distinct(F.coalesce(focused, every)))


#: FIXED VALUES: types that often stand side by side, in either order.
SIDE_BY_SIDE = (("PERSON", "ORGANIZATION"), ("METRIC", "ORGANIZATION"), ("DATE_TIME", "PERSON"), ("LOCATION", "ORGANIZATION"))


def neighbour_mentions(mentions: DataFrame, neighbours: DataFrame, reach: float = 0.1) -> DataFrame:
    """Mentions with those of neighbouring regions (source, target, distance) that go with them by type.

    Equal types go together within ``reach``, the pairs of SIDE_BY_SIDE at any distance of a neighbour.
    """
    a = mentions.select(F.col("region_id").alias("source"), F.col("norm").alias("a"), F.col("entity_type").alias("type_a"))
    b = mentions.select(F.col("region_id").alias("target"), F.col("norm").alias("b"), F.col("entity_type").alias("type_b"))
    listed = reduce(lambda x, y: x | y, [(F.col("type_a") == p) & (F.col("type_b") == q) | (F.col("type_a") == q) & (F.col("type_b") == p) for p, q in SIDE_BY_SIDE])
    pairs = neighbours.join(a, "source").join(b, "target").where(((F.col("type_a") == F.col("type_b")) & (F.col("distance") < reach)) | listed)
    return pairs.select("source", "target", "a", "b", "distance")


def supported_confidence(mentions: DataFrame, related: DataFrame) -> DataFrame:
    """Mentions (region_id, norm, confidence) with 0.05 more for each related one, at most 0.2, where there are several."""
    counted = related.groupBy(F.col("source").alias("region_id"), F.col("a").alias("norm")).agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > 1, F.least(F.lit(0.2), F.col("n") * 0.05)).otherwise(0.0)
    return mentions.join(counted, ["region_id", "norm"], "left").withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + more)).drop("n")


def caption_relations(mentions: DataFrame, regions: DataFrame, gap: float = 0.1) -> DataFrame:
    """Mentions of figures with those of captions of the page that begin about where the figure ends: 0.9 of the smaller confidence."""
    page = ["doc_id", "page_num"]
    f = regions.where("block_type = 'figure'").select(*page, F.col("region_id").alias("figure"), F.col("bbox.y2").alias("y2"))
    c = regions.where("block_type = 'caption'").select(*page, F.col("region_id").alias("caption"), F.col("bbox.y1").alias("y1"))
    near = f.join(c, page).where(F.abs(F.col("y2") - F.col("y1")) < gap)
    a = mentions.select(F.col("region_id").alias("figure"), F.col("norm").alias("a"), F.col("confidence").alias("conf_a"))
    b = mentions.select(F.col("region_id").alias("caption"), F.col("norm").alias("b"), F.col("confidence").alias("conf_b"))
    return near.join(a, "figure").join(b, "caption").select("figure", "caption", "a", "b", F.lit("caption").alias("rel_type"), (F.least("conf_a", "conf_b") * 0.9).alias("confidence"))


#: Extraction backends by name: functions of a region table that return mentions as :func:`extract_mentions` does.
BACKENDS = {"patterns": extract_mentions}


def register_extractor(name: str, backend) -> None:
    """Make a model's extraction available: ``backend(regions) -> mentions``, best as an iterator pandas UDF inside."""
    BACKENDS[name] = backend


def extracted(regions: DataFrame, backend: str = "patterns") -> DataFrame:
    """Mentions by a registered backend; patterns where there is none of that name."""
    return BACKENDS.get(backend, extract_mentions)(regions)
