"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.sources.store import materialise, new_path, release, shared_dir, sweep

__all__ = ["materialise", "new_path", "release", "shared_dir", "sweep"]

#: White space that separates words, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]+"
#: A word: a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"

def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id's text leaves no remainder. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


#: Rows and bytes of the batches in which texts go to Python, where the session doesn't set its own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Texts are long: batches of ten thousand would take most of what executors have outside the heap."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def documents(df: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text (null: empty), and the named columns where they exist, under their own names."""
    bound_batches(df.sparkSession)
    extra = [F.col(c) for c in keep if c in df.columns]
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def text_key(text: Column) -> Column:
    """A 64-bit hash of a text, null as empty, that tells apart rows which share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``marked`` (doc_id, text_hash, stays; a row per row) lets stay, with all columns.

    Columns of ``docs`` may have any names but those that begin with ``_docloom``. Ids and texts of rows
    that go are what is joined with the documents, so that where few go the join is small. Rows that
    repeat an id and its text stay as often as they are marked to.
    """
    counted = marked.groupBy(F.col("doc_id").alias("_docloom_id"), F.col("text_hash").alias("_docloom_h")).agg(F.count("*").alias("_docloom_n"), F.count_if("stays").alias("_docloom_stay")).where("_docloom_stay < _docloom_n")
    counted = materialise(counted, "going")
    if counted.isEmpty():
        return docs
    key = text_key(F.col("text"))
    left = docs.withColumn("_docloom_key", key)
    same = lambda other: left["doc_id"].cast("long").eqNullSafe(other["_docloom_id"]) & (left["_docloom_key"] == other["_docloom_h"])
    out = left.join(counted, same(counted), "left_anti")
    partly = counted.where("_docloom_stay > 0")
    if not partly.isEmpty():
        repeated = left.join(partly, same(partly)).withColumn("_docloom_place", F.row_number().over(Window.partitionBy("_docloom_id", "_docloom_h").orderBy(F.lit(0))))
        out = out.unionByName(repeated.where("_docloom_place <= _docloom_stay").drop("_docloom_id", "_docloom_h", "_docloom_n", "_docloom_stay", "_docloom_place"))
    return out.drop("_docloom_key")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows, so that Python holds few texts as objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
