"""Files in and out: PDF and image scans through plug-in backends, and saved graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A backend turns (path, bytes, first page, page after the last) into rows of (page_num, text, image).
PageBackend = Callable[[str, bytes, int, int | None], Iterator[tuple[int, str | None, bytes | None]]]
InfoBackend = Callable[[bytes], dict]
_pages: dict[str, PageBackend] = {}
_infos: dict[str, InfoBackend] = {}

PAGE_SCHEMA = "path string, page_num int, text string, image binary, error string"
INFO_SCHEMA = "path string, num_pages int, title string, author string, creation_date string, file_size long"


def register_backend(kind: str, pages: PageBackend, info: InfoBackend | None = None) -> None:
    """Make a document format readable under a name."""
    _pages[kind] = pages
    if info:
        _infos[kind] = info


def _text_pages(path: str, data: bytes, start: int, end: int | None) -> Iterator[tuple[int, str | None, bytes | None]]:
    for number, text in enumerate(data.decode("utf-8", "replace").split("\f")[start:end], start):
        yield number, text, None


register_backend("text", _text_pages, lambda data: {"num_pages": data.count(b"\f") + 1})


def scan_documents(spark: SparkSession, path: str, kind: str = "text", start: int = 0, end: int | None = None, glob: str | None = None) -> DataFrame:
    """Pages of all files under ``path``: path, page_num, text, image and error.

    Pages ``start`` to before ``end``. A file that can't be read, or whose range is empty, gives one
    row with the error and no page. Reading is spread over files; a task holds one file at a time.
    """
    if end is not None and start >= end:
        raise ValueError("the page range is empty")
    backend = _pages[kind]
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(name, number, text, image, None) for number, text, image in backend(name, bytes(data), start, end)]
                    rows = rows or [(name, None, None, None, "no page in the range")]
                except Exception as e:  # a bad file is a row, not a failed job
                    rows = [(name, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "page_num", "text", "image", "error"]).astype({"page_num": "Int32"})

    return files.select("path", "content").mapInPandas(run, PAGE_SCHEMA)


def document_info(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """What files say about themselves; a file that can't be read has 0 pages and unknown fields."""
    backend = _infos.get(kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data, size in zip(batch["path"], batch["content"], batch["length"], strict=True):
                try:
                    info = backend(bytes(data)) if backend else {}
                except Exception:  # documented: unknown fields
                    info = {}
                rows.append((name, info.get("num_pages", 0), info.get("title", "Unknown"), info.get("author", "Unknown"), info.get("creation_date", "Unknown"), size))
            yield pd.DataFrame(rows, columns=["path", "num_pages", "title", "author", "creation_date", "file_size"])

    return spark.read.format("binaryFile").load(path).select("path", "content", "length").mapInPandas(run, INFO_SCHEMA)


def scan_images(spark: SparkSession, path: str, formats: tuple[str, ...] = ("png", "jpg", "jpeg"), least_bytes: int = 0, most_bytes: int | None = None) -> DataFrame:
    """Image files of the given formats and sizes; the size filter reaches the file listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(formats) + "}").load(path).where(F.col("length") >= least_bytes)
    return files if most_bytes is None else files.where(F.col("length") <= most_bytes)


GRAPH_TABLES = ("regions", "nodes", "spatial_edges", "mentions", "entities", "relationships", "entity_region", "figure_caption", "image_entity")


def save_tables(tables: dict[str, DataFrame], folder: str, buckets: int | None = None) -> None:
    """Write tables as Parquet under one folder; tables with a doc_id in buckets of it if asked for."""
    for name, df in tables.items():
        if buckets and "doc_id" in df.columns:
            df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("doc_bucket").parquet(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = GRAPH_TABLES) -> dict[str, DataFrame]:
    """The tables of a folder that are there; reading one document is a filter that reaches the scan."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = lambda name: (p := jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")).getFileSystem(conf).exists(p)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names if there(name)}


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines for other tools."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
