"""Figures about indexing, embeddings, recognition and retrieval runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import words
from docloom.functions.vectors import norm

#: FIXED VALUE: tokens that a page is estimated to have had before.
PAGE_TOKENS = 2500


def indexing_statistics(regions: DataFrame) -> DataFrame:
    """Per document: pages, regions, tokens, the estimate for the pages, its ratio and what is saved."""
    pages, tokens = F.count_distinct("page_num"), F.sum("token_count")
    return regions.groupBy("doc_id").agg(pages.alias("pages"), F.count("*").alias("regions"), tokens.alias("tokens"), (pages * PAGE_TOKENS).alias("estimated"), F.when(tokens > 0, pages * PAGE_TOKENS / tokens).otherwise(0.0).alias("ratio"), (pages * PAGE_TOKENS - tokens).alias("saved"))


def compression_statistics(pages: DataFrame) -> DataFrame:
    """Words of the raw text against tokens kept (raw_text, tokens), as a percentage."""
    raw, kept = F.sum(F.size(words("raw_text"))), F.sum("tokens")
    return pages.agg(raw.alias("raw"), kept.alias("kept"), F.format_string("%.1f%%", F.when(raw > 0, (1 - kept / raw) * 100).otherwise(0.0)).alias("compression"))


def embedding_statistics(vectors: DataFrame) -> DataFrame:
    """Number, size, norms, share of zeros and kilobytes of vectors."""
    n, size = norm(F.col("vector")), F.size("vector")
    zeros = F.size(F.filter("vector", lambda x: F.abs(x) < 1e-6))
    return vectors.agg(F.count("*").alias("count"), F.max(size).alias("size"), F.avg(n).alias("mean_norm"), F.stddev_pop(n).alias("std_norm"), (F.sum(zeros) / F.sum(size)).alias("sparsity"), (F.sum(size) * 4 / 1024).alias("kilobytes"))


def recognition_statistics(regions: DataFrame) -> DataFrame:
    """Regions a page, tokens a region, mean confidence and how many are sure."""
    pages = F.count_distinct("doc_id", "page_num")
    return regions.agg((F.count("*") / pages).alias("regions_per_page"), F.avg("token_count").alias("tokens_per_region"), F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") > 0.7).alias("sure"))


def index_statistics(regions: DataFrame) -> DataFrame:
    return regions.groupBy("block_type").agg(F.count("*").alias("n"), F.count_distinct("doc_id", "page_num").alias("pages"), F.min("page_num").alias("first_page"), F.max("page_num").alias("last_page"))


def retrieval_statistics(log: DataFrame) -> DataFrame:
    """Counts and shares of the strategies of a query log (query_id, strategy)."""
    counted = log.groupBy("strategy").agg(F.count("*").alias("n"))
    return counted.crossJoin(log.agg(F.count("*").alias("all"))).select("strategy", "n", (F.col("n") / F.col("all") * 100).alias("percent"))


def processing_summary(mentions: DataFrame) -> DataFrame:
    """A line of text for each document on what was extracted."""
    return mentions.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("entity_type").alias("types"), F.avg("confidence").alias("c")).select("doc_id", F.format_string("%d entities of %d types, mean confidence %.2f", "n", "types", "c").alias("summary"))


def throughput(df: DataFrame, text: str = "text") -> dict[str, float]:
    """Texts and characters a second of an action over ``df``."""
    import time

    began = time.perf_counter()
    row = df.agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("c")).first()
    took = max(1e-9, time.perf_counter() - began)
    return {"texts_per_second": row["n"] / took, "characters_per_second": (row["c"] or 0) / took, "seconds": took}


def running_statistics(log: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals and mean seconds of a log of runs (regions, entities, seconds): partial sums, no order needed."""
    return log.groupBy(*keys).agg(F.count("*").alias("documents"), F.sum("regions").alias("regions"), F.sum("entities").alias("entities"), F.avg("seconds").alias("mean_seconds"))


def top_hits(ranked: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` hits of each question (query_id, rank), for a summary."""
    return ranked.where(F.col("rank") <= n)
