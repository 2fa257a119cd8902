"""Incremental indexing with Structured Streaming.

Documents arrive in files; each micro-batch becomes region and mention rows, written under the batch's
number, so that a batch that is run again replaces what it wrote. Mentions are the source of truth:
entities over all documents are aggregated from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.entities import merge_entities
from docloom.operators.mentions import extract_mentions
from docloom.operators.regions import admitted
from docloom.sources.regions import regions_from_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def document_stream(spark: SparkSession, path: str, schema: str = SCHEMA, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _write_batch(folder: str):
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        regions = admitted(regions_from_lines(batch))
        for name, df in (("regions", regions), ("mentions", extract_mentions(regions))):
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return write


def index_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Index all that is there, in batches, then stop; a later run goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(_write_batch(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def indexed_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of the last batch in which each document came."""
    m = spark.read.parquet(f"{folder}/mentions")
    last = m.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return m.join(last, ["doc_id", "batch"]).drop("batch")


def indexed_entities(spark: SparkSession, folder: str) -> DataFrame:
    return merge_entities(indexed_mentions(spark, folder))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type in tumbling windows, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
