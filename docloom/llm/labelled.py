"""Bounded samples of labelled documents, for the operators that learn from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import documents, held_out, materialise, text_key

#: Labelled rows of each class from which a model learns.
SAMPLE = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most ``sample`` labelled documents of each class, and all labels' counts.

    Held-out rows, null labels and labels other than 0 and 1 take no part. Of an id that is labelled
    several times the greatest label counts, and of documents that repeat an id the one whose text has
    the least hash, so that a class has at most ``sample`` rows. Which ids a class gets follows from
    their hash, so it is the same in every run. The ids are at most twice ``sample`` rows, which bounds
    the broadcast; the documents are filtered by them before any text is worked on.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null AND y in (0, 1)").where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [usable.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    rows = documents(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).groupBy("_id", "y").agg(F.min_by("text", text_key(F.col("text"))).alias("text")).select("y", "text")
    return materialise(rows, f"labelled-{label}"), counts
