"""The vault of a stream: runs of entries in buckets, merged as they grow in number, and the last number of each type.

Batch ``n`` adds a run of its own new entries. Every ``FAN`` runs of one level are merged into one of the next, so
after n batches there are at most ``FAN`` - 1 runs on each of log(n) levels. A run of level 1 and above is dealt to
buckets by the hash of type and key. A batch looks up its own keys alone: it reads the buckets that these fall into
and joins them with the keys; no batch reads, shuffles or writes all entries, and the numbers go on from one small
table. All folders are named by batch numbers, so a batch that runs again replaces its own output and sees the
entries that it saw before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 16
BUCKETS = 256
ENTRY = "type string, key string, n long, prefix string, token string, value string"


def runs(batches: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, first batch) of the runs that hold the entries of the first ``batches`` batches."""
    out, start = [], 0
    while start < batches:
        level = 0
        while start % fan ** (level + 1) == 0 and start + fan ** (level + 1) <= batches:
            level += 1
        out.append((level, start))
        start += fan**level
    return out


def buckets(level: int) -> int:
    return 1 if not level else min(BUCKETS, 16**level)


def _bucket(number: int):
    return F.pmod(F.xxhash64("type", "key"), F.lit(number)).cast("int")


@dataclass(frozen=True)
class Ledger:
    """The entries of the batches before ``batch`` under the folder ``out``."""

    spark: SparkSession
    out: str
    batch: int
    fan: int = FAN

    def _path(self, level: int, start: int) -> str:
        return f"{self.out}/vault/level={level}/start={start}"

    def _run(self, level: int, start: int) -> DataFrame:
        return self.spark.read.schema(f"{ENTRY}, bucket int").parquet(self._path(level, start))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The entries of ``keys`` (type, key; distinct)."""
        found = runs(self.batch, self.fan)
        if not found:
            return self.spark.createDataFrame([], ENTRY)
        used = {r.b for r in keys.select(_bucket(BUCKETS).alias("b")).distinct().collect()}
        parts = []
        for level, start in found:
            number = buckets(level)
            parts.append(self._run(level, start).where(F.col("bucket").isin(sorted({b % number for b in used}))).drop("bucket"))
        return reduce(DataFrame.unionByName, parts).join(keys.select("type", "key"), ["type", "key"], "left_semi")

    def last(self) -> DataFrame:
        """type and last: the largest number that each type has so far."""
        if not self.batch:
            return self.spark.createDataFrame([], "type string, last long")
        return self.spark.read.parquet(f"{self.out}/counters/batch={self.batch - 1}")

    def add(self, new: DataFrame) -> None:
        """Write the new entries and the last numbers of this batch, and merge the runs that are full."""
        columns = [c.split()[0] for c in ENTRY.split(", ")]
        new.select(*columns, F.lit(0).alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(self._path(0, self.batch))
        written = self._run(0, self.batch)
        grown = self.last().unionByName(written.groupBy("type").agg(F.max("n").alias("last"))).groupBy("type").agg(F.max("last").alias("last"))
        grown.coalesce(1).write.mode("overwrite").parquet(f"{self.out}/counters/batch={self.batch}")
        done, level = self.batch + 1, 1
        while done % self.fan**level == 0:
            step, first = self.fan ** (level - 1), done - self.fan**level
            parts = [self._run(level - 1, first + i * step).drop("bucket") for i in range(self.fan)]
            merged = reduce(DataFrame.unionByName, parts).withColumn("bucket", _bucket(buckets(level)))
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._path(level, first))
            level += 1

    def entries(self) -> DataFrame:
        """All entries of the batches before ``batch``."""
        parts = [self._run(level, start).drop("bucket") for level, start in runs(self.batch, self.fan)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ENTRY)
