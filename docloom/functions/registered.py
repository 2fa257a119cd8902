"""Functions for SQL text: temporary functions whose bodies are SQL, so that plans stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

_WORDS = "filter(split(lower(coalesce({0}, '')), '\\\\s+'), w -> w != '')"
#: name -> (parameters, result, body).
FUNCTIONS = {
    "docloom_tokens": ("t STRING", "BIGINT", "CAST(floor(length(coalesce(t, '')) / 4) AS BIGINT)"),
    "docloom_truncate": ("t STRING, n INT", "STRING", "CASE WHEN length(t) <= n THEN t ELSE concat(substring(t, 1, n - 3), '...') END"),
    "docloom_word_jaccard": (
        "a STRING, b STRING",
        "DOUBLE",
        f"CASE WHEN size({_WORDS.format('a')}) = 0 OR size({_WORDS.format('b')}) = 0 THEN 0D ELSE size(array_intersect({_WORDS.format('a')}, {_WORDS.format('b')})) / size(array_union({_WORDS.format('a')}, {_WORDS.format('b')})) END",
    ),
    "docloom_cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>",
        "DOUBLE",
        "CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) > 0 AND aggregate(b, 0D, (s, x) -> s + x * x) > 0 THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x)) ELSE 0D END",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
