"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset in a local session, as in
    tests, a temporary folder is made and kept for the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    A lost executor costs nothing that was written, and what is read back is split evenly.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**{"compression": codec} if codec else {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def compressed(df: DataFrame, name: str) -> DataFrame:
    """As :func:`materialise`, in fewer bytes: for tables of texts that stay as long as an index."""
    return materialise(df, name, "zstd")


def at_once(*makers: Callable[[], T]) -> list[T]:
    """What each maker returns; their jobs run side by side, so that one's last tasks leave no cores idle."""
    with ThreadPoolExecutor(len(makers)) as threads:
        return [f.result() for f in [threads.submit(m) for m in makers]]


def release(*frames: DataFrame) -> None:
    """Delete the files of materialised tables that no plan needs any more."""
    for df in frames:
        path = getattr(df, "_docloom_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    for entry in list(_written):
        if entry[1] == path:
            _written.remove(entry)


@atexit.register
def _clean_up() -> None:
    for spark, path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: its folder is the cluster's to clear
            return


def sweep(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan needs any more.

    Spark removes them once the driver's garbage collector has found their owners; between the phases
    of a long operator that is worth asking for.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
