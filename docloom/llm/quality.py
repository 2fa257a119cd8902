"""Quality classifier: regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bound_batches, documents, held_out, slices
from docloom.llm.labelled import SAMPLE, labelled_sample

#: Shares of a class's covariance that come from the pooled covariance and from its diagonal's mean.
POOLED, RIDGE = 0.2, 0.02
FEATURES = ("words", "word_length", "distinct", "repeats", "lines_repeated", "short", "sentence_marks", "capitals", "digits", "pipes", "shouts", "symbols", "beyond_ascii", "line_length")

_GROUPS = np.zeros((256, 8))
for _column, _characters in enumerate((range(65, 91), range(97, 123), range(48, 58), b"|", b"!", b"#$%&*@^~<>{}[]=+\\/_`", range(128, 256), b".,;:?")):
    _GROUPS[list(_characters), _column] = 1


def _log_ratio(part: float, whole: float) -> float:
    """The logarithm of a smoothed share: near-Gaussian over documents, and finite at 0."""
    return math.log((part + 0.5) / (whole + 1.0))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text; an empty text has those of no words."""
    words, data = text.split(), text.encode()
    n, size = len(words), len(data)
    lines = [x for x in text.split("\n") if x]
    upper, lower, digits, pipes, shouts, symbols, beyond, marks = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _GROUPS).tolist() if size else [0.0] * 8
    distinct = len(set(words))
    return [
        math.log1p(n),
        math.log1p(size / n) if n else 0.0,
        math.log1p(distinct) / math.log1p(n) if n else 1.0,
        _log_ratio(sum(map(eq, words, words[1:])), n),
        _log_ratio(len(lines) - len(set(lines)), len(lines)),
        _log_ratio(sum(len(w) <= 3 for w in words), n),
        _log_ratio(marks, n),
        _log_ratio(upper, upper + lower),
        _log_ratio(digits, size),
        _log_ratio(pipes, n),
        _log_ratio(shouts, n),
        _log_ratio(symbols, n),
        _log_ratio(beyond, size),
        math.log1p(n / max(1, len(lines))),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Class means with cached inverse Cholesky factors, and the calibration of the difference."""

    means: np.ndarray
    inverse: np.ndarray
    log_norm: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        density = [self.log_norm[c] - 0.5 * (((x - self.means[c]) @ self.inverse[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients (the last is the constant) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    b, penalty = np.zeros(x.shape[1]), ridge * np.diag([*[1.0] * (x.shape[1] - 1), 1e-6])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit_discriminant(x: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> Discriminant | None:
    """Fits both classes; None where one has no row. Covariances shrink to the pooled one and a ridge."""
    if min((y == 0).sum(), (y == 1).sum()) < 1:
        return None
    size = x.shape[1]
    means = np.stack([x[y == c].mean(axis=0) for c in (0, 1)])
    centred = [x[y == c] - means[c] for c in (0, 1)]
    pooled = sum(z.T @ z for z in centred) / max(1, len(x) - 2)
    inverse, log_norm = [], []
    for z in centred:
        own = z.T @ z / max(1, len(z) - 1)
        shrunk = (1 - POOLED) * own + POOLED * pooled
        shrunk = (1 - RIDGE) * shrunk + RIDGE * (np.trace(shrunk) / size + 1e-6) * np.eye(size)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        log_norm.append(-np.log(np.diag(factor)).sum())
    model = Discriminant(means, np.stack(inverse), np.array(log_norm))
    share = {c: counts.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    slope, shift = logistic(np.clip(model.difference(x), -200, 200)[:, None], y, weight / weight.mean(), ridge=1e-3)
    return Discriminant(means, model.inverse, model.log_norm, max(float(slope), 1e-6), float(shift))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Discriminant | None:
    """Learns from at most ``sample`` labelled rows of each class that are not held out.

    The statistics of those rows, and nothing else, come to the driver: at most twice ``sample`` rows.
    """
    rows, counts = labelled_sample(docs, labels, label, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], ["y", "x"])

    found = rows.mapInArrow(run, "y int, x array<double>").collect()
    found.sort(key=lambda r: (r["y"], r["x"]))
    if not found:
        return None
    return fit_discriminant(np.array([r["x"] for r in found]), np.array([r["y"] for r in found]), counts)


def score_quality(docs: DataFrame, model: Discriminant | None, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1, higher: better quality) and predicted.

    Null and empty texts are scored as texts without words; texts of any length are measured whole;
    equal texts get equal scores; without a model (no labels of one class) all score 0.5; an empty
    table gives an empty one; other columns are not read. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            if model is None or not texts:
                score = np.full(len(texts), 0.5)
            else:
                score = model.score(np.array([statistics(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    scored = documents(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`score_quality` with what :func:`fit_quality` learns; repeated rows get equal scores."""
    return score_quality(docs, fit_quality(docs, labels))


def keep_quality(docs: DataFrame, model: Discriminant | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of good quality, with all columns.

    A null text is scored as an empty one; without a model all rows stay; repeated rows share their
    fate; an empty table gives an empty one; columns keep their names, whatever these are.
    """
    if model is None:
        return docs
    at = docs.columns.index("text")
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                score = model.score(np.array([statistics(t or "") for t in batch.column(at).to_pylist()]))
                batch = batch.filter(pa.array(score >= threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)
