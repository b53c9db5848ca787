"""What the operators of this subpackage share: tables, the shared work folder, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = "1m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a Python task handles at once; bounds its working memory whatever the batch holds.
CHUNK_BYTES = 1 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes, so long texts don't fill a worker's memory."""
    df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and it survives lost executors.

    Once it is written nothing reads its shuffles again, so their files go.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    release()  # what the driver's Python held for this table, such as a model that was broadcast
    return spark.read.schema(df.schema).parquet(path)


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a batch whose texts have about ``limit`` characters together; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start = i
            size = 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def release() -> None:
    """Hand free memory of this Python process back to the system; workers outlive their tasks, and the driver its tables."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of ``mapInArrow`` that releases memory when its task's rows have ended."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one record batch (its columns as a dict of Arrow arrays) that yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for out in function(columns):
                yield pa.RecordBatch.from_arrays(
                    [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow],
                    names=arrow.names,
                )

    return small_batches(df).mapInArrow(run, schema)
