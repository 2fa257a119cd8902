"""Licence scans: ordered signature rules, gated by keywords, with overlaps resolved.

All work is done by built-in expressions. A text becomes its lower-case words; where it holds none of a
few literals no rule is tried. Otherwise the rules whose own literal it holds run, and of overlapping
detections one inside another is suppressed, and of two that overlap in part the one with the lower
priority.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.license_rules import BASE, GATES, rules

#: Anything but ASCII digits, ASCII letters and characters beyond ASCII separates words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised(text: Column) -> Column:
    """The words of a text in lower case (A-Z), each with a space before and after; a space if none.

    The Kelvin sign would become a plain k under Unicode's rules; other letters beyond ASCII stay
    beyond ASCII, where their case makes no difference to any rule.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), _BETWEEN, " ")


def base_places() -> str:
    """SQL over column words_text: every place of a base phrase as (word, label)."""
    tests = []
    for phrase, label in BASE:
        same = " AND ".join(f"get(w, i + {k}) = '{word}'" for k, word in enumerate(phrase.split()))
        tests.append(f"if(contains(words_text, ' {phrase} '), transform(filter(sequence(0, size(w) - 1), i -> {same}), i -> named_struct('word', cast(i as bigint), 'label', '{label}')), array())")
    any_base = " OR ".join(f"contains(words_text, ' {phrase} ')" for phrase, _ in BASE)
    # A one-element array binds the split words to a name, so that they are made once.
    return f"if({any_base}, transform(array(split(trim(words_text), ' ')), w -> concat({', '.join(tests)}))[0], cast(array() as array<struct<word:bigint,label:string>>))"


_SPANS = """
flatten(transform(filter(rules, r -> contains(words_text, r.gate)), r ->
  transform(array(split(regexp_replace(words_text, r.regex, '\\u0001$0\\u0002'), '\\u0001')), p ->
    aggregate(sequence(1, size(p)), named_struct('at', cast(length(p[0]) as bigint), 'found', cast(array() as array<struct<start:bigint,back:bigint,priority:int,label:string,confidence:double>>)),
      (a, i) -> if(i >= size(p), a, named_struct('at', a.at + length(p[i]) - 1, 'found', array_append(a.found, named_struct('start', a.at, 'back', -(a.at + locate('\\u0002', p[i]) - 1), 'priority', r.priority, 'label', r.label, 'confidence', r.confidence)))),
      a -> a.found))[0]))
"""

_RESOLVE = """
aggregate(array_sort(spans), cast(array() as array<struct<start:bigint,back:bigint,priority:int,label:string,confidence:double>>), (kept, d) ->
  CASE WHEN size(kept) = 0 OR d.start >= -kept[size(kept) - 1].back THEN array_append(kept, d)
       WHEN d.back >= kept[size(kept) - 1].back OR d.priority >= kept[size(kept) - 1].priority THEN kept
       ELSE array_append(slice(kept, 1, size(kept) - 1), d) END)
"""


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base places and the detections that stay.

    ``base`` lists the places of base phrases as (word, label), ``detections`` the spans as (start,
    end, label, confidence) with character offsets in the normalised words; ``base_labels`` and
    ``labels`` are distinct and sorted; ``score`` is the greatest confidence, 0 without a detection.

    Null and empty texts have no words and no labels; texts of any length are scanned whole; repeated
    rows give repeated results; equal spans keep the rule of higher priority; an empty table gives an
    empty one; other columns are not read. One projection, no shuffle.
    """
    table = F.from_json(F.lit(json.dumps([r._asdict() for r in rules()])), "array<struct<label:string,gate:string,regex:string,priority:int,confidence:double>>")
    gated = reduce(lambda a, b: a | b, [F.contains(F.col("words_text"), F.lit(g)) for g in GATES])
    nothing = F.array().cast("array<struct<start:bigint,back:bigint,priority:int,label:string,confidence:double>>")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("words_text"))
    counted = text.select("doc_id", "words_text", table.alias("rules"), (F.length("words_text") - F.length(F.replace(F.col("words_text"), F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"))
    spans = counted.select("doc_id", "n_words", F.expr(base_places()).alias("base"), F.when(gated, F.expr(_SPANS)).otherwise(nothing).alias("spans"))
    kept = spans.select("doc_id", "n_words", "base", F.expr(_RESOLVE).alias("kept"))
    detections = F.transform("kept", lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), d["confidence"].alias("confidence")))
    out = kept.select("doc_id", "n_words", "base", detections.alias("detections"))
    base_labels = F.array_distinct("base.label")
    # A base phrase is a detection of its own, as sure as a phrase rule.
    score = F.greatest(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0))
    return out.select(
        "*",
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("detections.label"))), ",").alias("labels"),
        score.alias("score"),
    )


def license_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"), "base_labels", "labels", "score"
    )
