"""Exact deduplication by content-defined chunk recipes.

Each text is cut where a rolling hash of its last 32 bytes says so, which makes equal passages fall into
equal chunks. A chunk is known by a 64-bit identifier and checked by 64 bits of its SHA-256 and its
length: identifiers under which two different chunks meet are replaced by ones that hold the check
too. A document is then the ordered list of its chunks' identifiers, its recipe, and two texts are
equal where their recipes are. Texts are read once and never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import documents, keep_marked, materialise, release, text_key

#: Bytes of a chunk: at least, on average beyond that, at most.
LEAST, MEAN_BITS, MOST = 256, 10, 8192
#: One random 32-bit number for each byte value.
_GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)


def normalise(text: bytes) -> bytes:
    """Each run of white space as one space, also at the ends."""
    parts = text.split()
    if not parts:
        return b" " if text else b""
    lead, trail = text[:1].isspace(), text[-1:].isspace()
    return b" " * lead + b" ".join(parts) + b" " * trail


def cuts(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end. A cut depends on the 32 bytes before it and on the last cut."""
    size = len(data)
    if size <= LEAST:
        return [size]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    places = (np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist()
    ends, last = [], 0
    for place in [*places, size]:
        while place - last > MOST:
            last += MOST
            ends.append(last)
        if place - last >= LEAST or place == size and place > last:
            last = place
            ends.append(last)
    return ends


def _signed(data: bytes) -> int:
    return int.from_bytes(data[:8], "little", signed=True)


def recipes(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, text_sha256 and the chunks' identifiers, checks and lengths, in text order."""
    types = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("text_sha256", pa.string()), *((c, pa.list_(pa.int64())) for c in ("ids", "checks", "lengths"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                data, last = normalise(text.encode()), 0
                ids, checks, lengths = [], [], []
                for end in cuts(data):
                    chunk = data[last:end]
                    ids.append(_signed(xxhash.xxh3_64_digest(chunk)))
                    checks.append(_signed(hashlib.sha256(chunk).digest()))
                    lengths.append(end - last)
                    last = end
                for column, value in zip(columns, (hashlib.sha256(data).hexdigest(), ids, checks, lengths), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t.type) for c, t in zip(columns, list(types)[2:], strict=True))], schema=types)

    found = documents(docs).withColumn("text_hash", text_key(F.col("text"))).mapInArrow(run, "doc_id long, text_hash long, text_sha256 string, ids array<long>, checks array<long>, lengths array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def chunk_table(found: DataFrame) -> DataFrame:
    """Each identifier once: chunk_id, uses, length, and whether only one chunk has it (verified)."""
    each = found.select(F.explode(F.arrays_zip("ids", "checks", "lengths")).alias("c")).select("c.*")
    counted = each.groupBy(F.col("ids").alias("chunk_id")).agg(
        F.count("*").alias("uses"), F.max("lengths").alias("length"), *(f(c).alias(f"{n}_{c}") for c in ("checks", "lengths") for n, f in (("least", F.min), ("most", F.max)))
    )
    verified = (F.col("least_checks") == F.col("most_checks")) & (F.col("least_lengths") == F.col("most_lengths"))
    return counted.select("chunk_id", "uses", "length", verified.alias("verified"))


def _verified(found: DataFrame) -> DataFrame:
    """The recipes with identifiers under which only one chunk is known."""
    doubtful = materialise(chunk_table(found).where(~F.col("verified")).select("chunk_id"), "doubtful-chunks")
    if doubtful.isEmpty():
        release(doubtful)
        return found.withColumn("recipe", F.col("ids")).drop("ids", "checks", "lengths")
    each = found.select("row", F.posexplode(F.arrays_zip("ids", "checks", "lengths")).alias("pos", "c")).select("row", "pos", "c.*")
    marked = each.join(doubtful.withColumn("doubt", F.lit(True)), each.ids == doubtful.chunk_id, "left")
    known = F.when(F.col("doubt"), F.xxhash64("ids", "checks", "lengths")).otherwise(F.col("ids"))
    lists = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", known.alias("id")))).alias("l")).select("row", F.col("l.id").alias("recipe"))
    return found.drop("ids", "checks", "lengths").join(lists, "row")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of texts that are equal once each run of white space is one space.

    Returns one row per row of ``docs``: doc_id, keep_id (smallest id of the group), group_size, kept,
    text_sha256 (of the normalised text) and text_hash (of the text as it is). A null text counts as empty, and all empty texts are one
    group; a null doc_id stands behind all others; of rows that repeat an id and its text one is kept;
    texts of any length are read whole; an empty table gives an empty one; other columns are not read.

    Only ids, checks and recipes are shuffled. Groups are counted with partial aggregation; only those
    of two rows or more are joined back, and a large one is then the skewed side of a sort-merge join,
    which adaptive execution splits.
    """
    found = materialise(_verified(materialise(recipes(docs), "recipes")), "verified-recipes")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row")))
    groups = found.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups.select("recipe", F.col("first.id").alias("keep"), F.col("first.row").alias("keep_row"), "n"), "recipe-groups")
    joined = found.join(groups, "recipe", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "text_hash",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_groups` keeps, with all columns."""
    return keep_marked(docs, exact_groups(docs).select("doc_id", "text_hash", F.col("kept").alias("stays")))
