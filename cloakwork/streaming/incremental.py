"""Incremental runs: new files become protected records, with one vault for all of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.detect import Options
from ..plans.engine import run, score_texts
from ..plans.mapping import Mapping
from .ledger import Ledger


def protect_stream(source: DataFrame, mapping: Mapping, out: str, checkpoint: str, mode: str = "pseudo", **options):
    """Start a query that protects a stream of records into ``out``/records and keeps its vault in ``out``/vault.

    Each batch looks up its own keys among the entries of the batches before it and adds what is new (see ``ledger``). Records
    and entries of a batch go to folders named by its number, so a batch that runs again replaces its own output.
    """
    spark = source.sparkSession
    if options.get("scope"):
        raise ValueError("a stream has one vault; scopes would number anew in each batch")

    def one(batch: DataFrame, number: int) -> None:
        ledger = Ledger(spark, out, number) if mode == "pseudo" else None
        result = run(batch, replace(mapping), mode, known=ledger, **options)
        if ledger is not None:
            new = result.vault.join(ledger.last(), "type", "left").where("n > coalesce(last, 0)")
            ledger.add(new)
        result.records.drop("_rid").write.mode("overwrite").parquet(f"{out}/records/batch={number}")

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vault_of(spark: SparkSession, out: str, batches: int) -> DataFrame:
    """The vault of a stream after its first ``batches`` batches."""
    return Ledger(spark, out, batches).entries()


def score_stream(source: DataFrame, column: str, options: Options = Options()) -> DataFrame:
    """A stream of records with their risk counts, score and level: each row by itself, no state."""
    return score_texts(source, column, options)
