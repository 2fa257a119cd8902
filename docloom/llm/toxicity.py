"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import documents, held_out, slices
from docloom.llm.labelled import SAMPLE, labelled_sample
from docloom.llm.quality import logistic

#: Words that count as toxic before anything is learned, and their weight.
SEEDS = (
    "arsehole asshole bastard bitch bullshit cretin cunt degenerate dickhead dimwit dipshit disgusting douchebag dumbass faggot filth fuck fucker fucking "
    "halfwit idiot imbecile jackass jerk loser lowlife moron motherfucker nitwit pathetic pig prick retard retarded scumbag scum shithead shit slut "
    "stupid subhuman swine trash twat vermin wanker whore worthless clown"
).split()
SEED_WEIGHT = 3.0
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "trash pickup", "take out the trash", "empty the trash", "clown fish", "class clown", "circus clown", "clown car",
    "sore loser", "winner and loser", "loser bracket", "idiot proof", "idiot light", "guinea pig", "pig iron", "pig farm", "piggy bank", "jerk chicken", "knee jerk", "jerk seasoning", "scum line", "pond scum",
)
#: Letters of other scripts that look like Latin ones, and digits that stand for letters.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "χ": "x", "η": "n", "ω": "w", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    # l, I and 1 are confused with each other: all become i, in texts and in the lexicon.
    "l": "i", "|": " ",
}
_TABLE = str.maketrans(_LOOKALIKES | dict.fromkeys("­​‌‍⁠﻿", None))
_INSIDE = {"@": re.compile(r"@(?=[^\W_])"), "$": re.compile(r"\$(?=[^\W_])")}
_BETWEEN = re.compile(r"[\W_]+")
#: Lengths of word beginnings that may become lexicon entries, the contexts an entry needs, the most that its
#: rate in clean documents may be of that in toxic ones, and the different words of a beginning. With fewer
#: contexts, small label sets make entries of chance words; the seed words are what they have instead.
STEMS, CONTEXTS, SHARE, STEM_WORDS = (4, 5, 6, 7), 12, 0.1, 6


def fold(text: str) -> str:
    """The words of a text, folded, each with a space before and after."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    for mark, letter in (("@", "a"), ("$", "s")):
        if mark in text:
            text = _INSIDE[mark].sub(letter, text)
    return f" {_BETWEEN.sub(' ', text.lower().translate(_TABLE)).strip()} "


def _terms(word: str) -> list[str]:
    return [f" {word} ", *(f" {word[:n]}" for n in STEMS if len(word) > n)]


@dataclass(frozen=True)
class Lexicon:
    """Folded entries with weights (" word " or, for a word's beginning, " stem"), and the calibration."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = field(default=tuple(fold(x) for x in EXCEPTIONS))
    coefficients: tuple[float, ...] = (1.0, 0.0, -1.5)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None))
        a.make_automaton()
        return a


def measure(text: str, automaton) -> tuple[float, float, int]:
    """Sum of the weights of entries outside exception phrases, its length-normalised form, and words.

    Of entries that begin at the same place the heaviest counts.
    """
    folded = fold(text)
    n = max(1, folded.count(" ") - 1)
    hits: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    for end, (size, w) in automaton.iter(folded):
        start = end - size + 1
        if w is None:
            safe.append((start, end))
        elif w > hits.get(start, 0.0):
            hits[start] = w
    if safe and hits:
        spans = iter(sorted(safe))
        last, upcoming = -1, next(spans, None)
        for start in sorted(hits):
            while upcoming and upcoming[0] <= start:
                last, upcoming = max(last, upcoming[1]), next(spans, None)
            if start < last:
                del hits[start]
    total = sum(hits.values())
    return total, total / (n + 50) ** 0.5, n


def _features(text: str, automaton) -> list[float]:
    total, normalised, _ = measure(text, automaton)
    return [np.log1p(total), np.log1p(normalised)]


def mine(rows: DataFrame) -> dict[str, float]:
    """Lexicon entries from labelled (y, text) rows: words and word beginnings of toxic documents.

    A term counts once per document. It becomes an entry if toxic documents have it in at
    least CONTEXTS different surroundings (copies of one document are one surrounding) and its
    rate in clean documents is at most SHARE of that in toxic ones; a beginning also needs STEM_WORDS
    different words. Its weight is the smoothed log odds. All terms that reach the bounds come to the
    driver: words of the sampled rows, whose number does not grow with the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update({t for w in set(fold(text).split()) for t in _terms(w)})
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "clean", "toxic"])

    summed = rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    toxic_rows, clean_rows = rows.where("y = 1").count(), rows.where("y = 0").count()
    enriched = summed.where((F.col("toxic") >= CONTEXTS) & (F.col("clean") * toxic_rows <= F.col("toxic") * clean_rows * SHARE))
    found = {r["term"]: (r["clean"], r["toxic"]) for r in enriched.collect()}
    if not found:
        return {}
    known = rows.sparkSession.sparkContext.broadcast(frozenset(found))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[str, int, str]] = set()
            for text in batch.column(1).to_pylist():
                words = fold(text).split()
                for before, word, after in zip([None, *words], words, [*words[1:], None], strict=False):
                    for t in _terms(word):
                        if t in known.value:
                            seen.add((t, xxhash.xxh3_64_intdigest(f"{before} {after}") >> 1, word))
            columns = list(zip(*seen, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["term", "context", "word"])

    around = rows.where("y = 1").mapInArrow(contexts, "term string, context long, word string").groupBy("term").agg(F.approx_count_distinct("context").alias("contexts"), F.approx_count_distinct("word").alias("words"))
    varied = {r["term"]: r["words"] for r in around.where(F.col("contexts") >= CONTEXTS).collect()}
    odds = lambda c, t: float(np.log((t + 0.5) / (toxic_rows + 1)) - np.log((c + 0.5) / (clean_rows + 1)))
    out: dict[str, float] = {}
    for term in sorted(varied, key=lambda t: (len(t), t)):
        whole = term.endswith(" ")
        if not whole and varied[term] < STEM_WORDS:
            continue
        if not any(term[:n] in out for n in range(4, len(term))):
            out[term] = min(6.0, max(1.0, odds(*found[term])))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """The seed words and what is mined from at most ``sample`` labelled rows of each class.

    Rows that are held out take no part. The terms of :func:`mine` and two numbers per sampled row
    come to the driver.
    """
    rows, counts = labelled_sample(docs, labels, label, sample)
    weights = {f" {fold(w).strip()} ": SEED_WEIGHT for w in SEEDS} | mine(rows)
    plain = Lexicon(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = plain.automaton()
        for batch in batches:
            x = pa.array([_features(t, a) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["y", "x"])

    found = rows.mapInArrow(run, "y int, x array<double>").collect()
    found.sort(key=lambda r: (r["y"], r["x"]))
    y = np.array([r["y"] for r in found])
    if min((y == 0).sum(), (y == 1).sum()) < 1:
        return plain
    share = {c: counts.get(c, 0) / (y == c).sum() for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return Lexicon(weights, coefficients=tuple(logistic(np.array([r["x"] for r in found]), y, weight / weight.mean(), ridge=0.1)))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1, higher: toxic), predicted, weight and words.

    Null and empty texts have no entries and the score of none; texts of any length are read whole;
    equal texts get equal scores; an empty table gives an empty one; other columns are not read. One
    pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, (*slopes, constant) = lexicon.automaton(), lexicon.coefficients
        for batch in slices(batches):
            found = [measure(t, a) for t in batch.column(1).to_pylist()]
            x = np.array([[np.log1p(total), np.log1p(normalised)] for total, normalised, _ in found]).reshape(-1, 2)
            score = 1.0 / (1.0 + np.exp(-np.clip(x @ np.array(slopes) + constant, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score, pa.float64()), pa.array([f[0] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int64())], ["doc_id", "score", "weight", "words"]
            )

    scored = documents(docs).mapInArrow(run, "doc_id long, score double, weight double, words long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "weight", "words")
