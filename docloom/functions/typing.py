"""Entity and relation typing rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import lexicon as L
from docloom.functions.text import is_title, is_upper, words

# FIXED VALUES: looks of dates, amounts and percentages.
_DATE_LOOK = r"(?i)^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$|(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+[0-9]{1,2},?\s+[0-9]{4}"
_MONEY_LOOK = r"(?i)^\$[0-9,]+\.?[0-9]*|^[0-9,]+\.?[0-9]*\s*(USD|EUR|GBP|dollars?|euros?)$"
_PERCENT_LOOK = r"(?i)^[0-9]+\.?[0-9]*%|^[0-9]+\.?[0-9]*\s*percent$"


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for item in values.items() for v in item]), key)


def first_of(rules, test, otherwise) -> Column:
    """``CASE WHEN`` over (value, pattern) rules in order."""
    return reduce(lambda c, rule: c.when(test(rule), F.lit(rule[0])), rules[1:], F.when(test(rules[0]), F.lit(rules[0][0]))).otherwise(otherwise)


def map_entity_type(label: Column, text: Column, context: Column) -> Column:
    """Entity type of a labelled text: by label, by shape, by name, by parts of the label, by looks."""
    name, plain = F.lower(F.trim(label)), F.lower(F.trim(text))
    shape = reduce(lambda c, rule: c.when(text.rlike(rule[0]), rule[1]), L.SHAPE_TYPES[1:], F.when(text.rlike(L.SHAPE_TYPES[0][0]), L.SHAPE_TYPES[0][1]))
    any_part = lambda parts: reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in parts])
    part = reduce(lambda c, rule: c.when(any_part(rule[0]), rule[1]), L.LABEL_PARTS[1:], F.when(any_part(L.LABEL_PARTS[0][0]), L.LABEL_PARTS[0][1]))
    known = F.coalesce(context, F.lit("")) != ""
    look = (
        F.when(known & is_title(text) & (F.size(words(text)) <= 3), "PERSON")
        .when(known & is_upper(text) & (F.length(text) <= 10), "ORGANIZATION")
        .when(text.rlike(_DATE_LOOK), "DATE_TIME")
        .when(text.rlike(_MONEY_LOOK), "MONEY")
        .when(text.rlike(_PERCENT_LOOK), "PERCENTAGE")
        .otherwise("CONCEPT")
    )
    return F.coalesce(lookup(L.LABEL_TYPES, name), shape, lookup(L.NAME_TYPES, plain), part, look)


def confidence_boost(text: Column, kind: Column, context: Column) -> Column:
    """What shape, type and context add to a confidence, at most 0.3."""
    around = F.lower(F.coalesce(context, F.lit("")))
    looks = ((kind == "DATE_TIME") & text.rlike(_DATE_LOOK)) | ((kind == "MONEY") & text.rlike(_MONEY_LOOK)) | ((kind == "PERCENTAGE") & text.rlike(_PERCENT_LOOK))
    total = (
        F.when(is_title(text) & kind.isin("PERSON", "ORGANIZATION", "PRODUCT"), 0.1).otherwise(0.0)
        + F.when(is_upper(text) & F.length(text).between(2, 6) & kind.isin("ORGANIZATION", "TECHNICAL_TERM"), 0.1).otherwise(0.0)
        + F.when(around.rlike("#|title|heading"), 0.05).otherwise(0.0)
        + F.when(looks, 0.1).otherwise(0.0)
    )
    return F.least(total, F.lit(0.3))


def boosted_confidence(confidence: Column, text: Column, kind: Column, context: Column) -> Column:
    return F.least(F.lit(1.0), confidence + confidence_boost(text, kind, context))


def map_relation(label: Column) -> Column:
    name = F.replace(F.lower(label), F.lit(" "), F.lit("_"))
    return F.coalesce(lookup(L.RELATION_NAMES, name), F.upper(name))


def pair_relation(label1: Column, label2: Column, block1: Column) -> Column:
    """Relation of entities in neighbouring regions."""
    return (
        F.when((label1 == "PERSON") & (label2 == "ORGANIZATION"), "works_at")
        .when((label1 == "ORGANIZATION") & (label2 == "PERSON"), "employs")
        .when((label1 == "LOCATION") & (label2 == "ORGANIZATION"), "located_in")
        .when((label1 == "DATE_TIME") & label2.isin("PERSON", "ORGANIZATION"), "published_on")
        .when((block1 == "table") & label2.isin("METRIC", "PERCENTAGE"), "contains_metric")
        .otherwise("related_to")
    )


def proximity_relation(label1: Column, label2: Column) -> Column:
    """Relation of entities close together in one region; null for other pairs."""
    return (
        F.when((label1 == label2) & label1.isin("PERSON", "ORGANIZATION", "LOCATION"), "and")
        .when(label1.isin("METRIC", "MONEY") & label2.isin("PERCENTAGE", "RATE"), "at_rate")
        .when((label1 == "DATE_TIME") & label2.isin("MONEY", "METRIC"), "on_date")
    )


def layout_pair_allowed(region1: Column, region2: Column, label1: Column, label2: Column) -> Column:
    return (region1 != region2) & ~((label1 == label2) & label1.isin("DATE_TIME", "PERCENTAGE"))


def visual_hierarchy(label: Column, block: Column, start: Column) -> Column:
    return (
        F.when(block == "header", F.when(label.isin("PERSON", "ORGANIZATION"), "primary_title").otherwise("secondary_title"))
        .when(block == "paragraph", F.when((label == "PERSON") & (start == 0), "topic_sentence").otherwise("supporting_content"))
        .when(block == "table", F.when(label == "ORGANIZATION", "table_header").otherwise("table_data"))
        .otherwise("standard")
    )


def focus_types(block: Column) -> Column:
    """Entity types in focus in a block, null for none."""
    return F.element_at(F.create_map(*[v for b, types in L.FOCUS_TYPES.items() for v in (F.lit(b), F.array(*[F.lit(t) for t in types]))]), block)


def position_in_text(start: Column, text: Column) -> Column:
    share = start / F.greatest(F.length(text), F.lit(1))
    return F.when(share < 0.3, "start").when(share > 0.7, "end").otherwise("middle")


def visual_score(label: Column, block: Column, features: Column, quality: Column, word_count: Column) -> Column:
    """How well the looks of a region support an entity (0.5 to 1)."""
    position = features["position_score"] * F.when((label == "PERSON") & features["is_centered"], 1.2).when(label.isin("ORGANIZATION", "CONCEPT") & features["is_header"], 1.3).otherwise(1.0)
    density = F.when(label.isin("METRIC", "PERCENTAGE", "MONEY"), F.least(F.lit(1.0), word_count / 100 * 1.5)).otherwise(word_count / 100)
    bonus = F.when((block == "table") & label.isin("METRIC", "PERCENTAGE"), 0.3).when((block == "figure") & (label == "REFERENCE"), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + quality * 0.3 + position * 0.2 + density * 0.2 + bonus)


def enhanced_confidence(confidence: Column, visual: Column, block: Column, label: Column) -> Column:
    """Model and visual evidence blended 6 to 4, with small boosts for telling blocks."""
    boost = F.when((block == "header") & label.isin("ORGANIZATION", "PERSON"), 1.1).when((block == "table") & label.isin("METRIC", "PERCENTAGE"), 1.05).otherwise(1.0)
    return F.least(F.lit(1.0), (confidence * 0.6 + visual * 0.4) * boost)


def strict_value(text: Column, block: Column, most_digits: int = 10) -> Column:
    """Optional filter of dates and bare numbers: true where such a text may be an entity."""
    number = text.rlike(r"^[0-9]+$")
    year = text.rlike(r"^[0-9]{4}$")
    return (
        F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$|^[A-Z][a-z]+ [0-9]{1,2},? [0-9]{4}$|^[0-9]{1,2} [A-Z][a-z]+ [0-9]{4}$"), True)
        .when(year, text.cast("int").between(1900, 2100))
        .when(number & (F.length(text) <= 3), block.isin("heading", "header", "title"))
        .when(number, F.length(text) > most_digits)
        .otherwise(~text.rlike(r"^[0-9]+(\.[0-9]+)?\s*[A-Za-z]{1,3}$"))
    )


def ocr_error(text: Column) -> Column:
    """True for texts that look like misread characters."""
    n = F.greatest(F.length(text), F.lit(1))
    vietnamese = text.rlike("(?i)[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]") & text.rlike("[A-Za-z]") & (F.length(text) < 20) & ~text.rlike(r"^\p{Lu}")
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) / n > 0.3
    capitals = (F.length(text) > 30) & ~F.contains(text, F.lit(" ")) & (F.regexp_count(text, F.lit(r"\p{Lu}")) / n > 0.3)
    return vietnamese | marks | capitals


def document_type(text: Column) -> Column:
    """struct(name, confidence, scores): keyword hits and twice the pattern hits; ties go to the first.

    Words and their borders in patterns are those of all scripts.
    """
    low = F.lower(text)
    scores = []
    for name, (keywords, patterns) in L.DOCUMENT_TYPES.items():
        hits = [F.contains(low, F.lit(k.lower())).cast("int") for k in keywords] + [text.rlike(f"(?U){p}").cast("int") * 2 for p in patterns]
        scores.append((name, reduce(lambda a, b: a + b, hits)))
    table = F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores)])
    best = lambda t: F.array_max(t)
    total = lambda t: F.aggregate(t, F.lit(0), lambda a, x: a + x["score"])
    result = lambda t: F.struct(
        F.when(best(t)["score"] > 0, best(t)["name"]).otherwise("general").alias("name"),
        F.when(best(t)["score"] > 0, best(t)["score"] / total(t)).otherwise(0.5).alias("confidence"),
        F.map_from_arrays(F.transform(t, lambda x: x["name"]), F.transform(t, lambda x: x["score"])).alias("scores"),
    )
    # The table of scores stands in a list of one, so that it is worked out once.
    return F.get(F.transform(F.array(table), result), F.lit(0))


def query_level(question: Column) -> Column:
    """1 simple, 2 complex, 3 several documents, 4 visual, by the first family of words that fits."""
    return first_of(L.LEVEL_WORDS, lambda rule: F.lower(question).rlike(rf"\b({rule[1]})\b"), F.lit(1))


def query_type(question: Column) -> Column:
    return first_of(L.QUERY_TYPES, lambda rule: F.lower(question).rlike(rule[1]), F.lit("general"))


def query_intent(question: Column) -> Column:
    return first_of(L.QUERY_INTENTS, lambda rule: F.lower(question).rlike(rule[1]), F.lit("search"))


def query_complexity(question: Column) -> Column:
    w = words(question)
    n, distinct = F.size(w), F.size(F.array_distinct(F.transform(w, F.lower)))
    letters = F.aggregate(F.transform(w, F.length), F.lit(0), lambda a, x: a + x)
    return F.when(n == 0, 0.0).otherwise((F.least(F.lit(1.0), n / 20) + F.least(F.lit(1.0), distinct / n) + F.least(F.lit(1.0), letters / n / 10)) / 3)


def search_strategy(question: Column, forced: Column | None = None, image: Column | None = None) -> Column:
    """multimodal, cross_modal or text, by what the question asks for."""
    visual, hard = F.lower(question).rlike(L.VISUAL_WORDS), query_complexity(question) > 0.7
    base = F.when(visual & hard, "multimodal").when(visual | hard, "cross_modal").otherwise("text")
    if image is not None:
        base = F.when(image, "multimodal").otherwise(base)
    return F.when(forced, "multimodal").otherwise(base) if forced is not None else base


def query_patterns(question: Column) -> Column:
    number, date = question.rlike(r"[0-9]+%|[0-9]+\.[0-9]+"), question.rlike(r"\b[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\b|\b[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}\b")
    return F.filter(F.array(F.when(number, "numeric"), F.when(date, "date"), F.when(question.rlike(r"\b\p{Lu}{2,}\b"), "proper_noun")), lambda p: p.isNotNull())


def pattern_share(patterns: Column, text: Column) -> Column:
    """Share of a question's patterns that a region's text has."""
    hit = lambda p: F.when(p == "numeric", text.rlike("[0-9]")).when(p == "date", F.lower(text).rlike(r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|\b[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}")).otherwise(text.rlike(r"\p{Lu}"))
    return F.when(F.size(patterns) == 0, 0.0).otherwise(F.size(F.filter(patterns, hit)) / F.size(patterns))


def layout_score(kind: Column, block: Column) -> Column:
    return (
        F.when((kind == "visual") & block.isin("figure", "table", "formula"), 0.8)
        .when((kind == "table") & (block == "table"), 0.9)
        .when((kind == "layout") & (block == "header"), 0.7)
        .otherwise(0.3)
    )


def visual_mode(question: Column, level: Column, has_vectors: Column, forced: bool = False) -> Column:
    """Whether a question is answered by looks: forced, or vectors exist and its words or its level ask for them."""
    if forced:
        return F.lit(True)
    return has_vectors & (F.lower(question).rlike(L.VISUAL_MODE_WORDS) | (level >= 3))
