"""Written intermediate tables and numbering by order, for the plans of this library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, tag: str = "table") -> str:
    """A path of its own in the folder of ``spark.checkpoint.dir`` (one of our own where it is unset)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the folder of ``spark.checkpoint.dir`` and read it back."""
    spark = df.sparkSession
    path = new_path(spark)
    # Once the table is written nothing reads its shuffles again, so their files go.
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Inputs of fewer bytes for each core than this are dealt to all cores; larger ones come in enough splits.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt to all cores, if it is so small that a file may be one split; else as it is.

    Patterns cost far more than moving the texts of a small input once. Large inputs aren't shuffled.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size <= cores * SPREAD_BYTES else df


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A number that follows the order of the input, fixed by writing the table."""
    return df if name in df.columns else materialise(df.withColumn(name, F.monotonically_increasing_id()))


def numbered(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "n") -> DataFrame:
    """``df`` with the number of each row in ``order``, from 1 for each value of ``by``.

    Rows are dealt by range and counted in each range; the counts of earlier ranges are added. No task
    holds more than one range, and the counts are one row for each range and value of ``by``.
    """
    by = by or []
    dealt = materialise(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range", *by).agg(F.count("*").alias("_count"))
    before = F.sum("_count").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_range", *by, F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    return dealt.withColumn("_within", within).join(counts, ["_range", *by]).withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_range", "_within", "_before")


