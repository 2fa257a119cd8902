"""Vectors as arrays of doubles, by built-in array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(doubles(a), F.lit(1), n), F.slice(doubles(b), F.lit(1), n), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def hashed(text: Column, size: int = 768) -> Column:
    """A reproducible unit vector for a text: bytes of seeded 64-bit hashes."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(F.xxhash64(text, i), F.lit(256)) / 255.0)
    return normalised(raw)


def text_vector(text: Column, size: int = 256) -> Column:
    """Four plain statistics of a text, filled with zeros; all zeros for an empty text."""
    n = F.length(text)
    letters = F.regexp_count(text, F.lit(r"\p{L}")) / F.greatest(n, F.lit(1))
    digits = F.regexp_count(text, F.lit("[0-9]")) / F.greatest(n, F.lit(1))
    spaces = F.regexp_count(text, F.lit(r"\s")) / F.greatest(n, F.lit(1))
    return F.concat(F.array((n / 1000).cast("double"), letters, digits, spaces), F.array_repeat(F.lit(0.0), size - 4))


def first_components(v: Column, k: int) -> Column:
    return F.slice(doubles(v), 1, k)


def sparse(v: Column, k: int) -> Column:
    """The k components of greatest size, zeros elsewhere; of equal sizes the earlier ones stay."""
    ranked = F.array_sort(F.transform(doubles(v), lambda x, i: F.struct((-F.abs(x)).alias("s"), i.alias("i"))))
    keep = F.transform(F.slice(ranked, 1, k), lambda r: r["i"])
    return F.transform(doubles(v), lambda x, i: F.when(F.array_contains(keep, i), x).otherwise(F.lit(0.0)))


def quantised(v: Column, levels: int = 255, constant: bool = True) -> Column:
    """A round trip through 8 bits between least and greatest component.

    A constant vector stays; without ``constant`` its components are not numbers, as a division by its width of zero says.
    """
    low, high = F.array_min(doubles(v)), F.array_max(doubles(v))
    step = (high - low) / levels
    return F.when(high > low, F.transform(doubles(v), lambda x: F.floor((x - low) / step) * step + low)).otherwise(doubles(v) if constant else F.transform(doubles(v), lambda x: F.when(x.isNotNull(), F.lit(float("nan")))))


def compressed(v: Column, method: str, k: int) -> Column:
    if method == "quantize":
        return quantised(v)
    return sparse(v, k) if method == "sparse" else first_components(v, k)
