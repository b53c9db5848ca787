"""Single texts in, single results out: the engine and the vault for callers that hold one text."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import vault
from ..operators.detect import Options
from .engine import protect_texts, score_texts


def _frame(spark: SparkSession, text: str):
    return spark.createDataFrame([(0, text)], "_rid long, text string")


def protect_text(spark: SparkSession, text: str, options: Options = Options(), mode: str = "pseudo") -> dict:
    """The protected ``text``, its ``vault`` (token -> value; empty in anon mode) and its ``score`` and ``level``."""
    done = protect_texts(_frame(spark, text), "text", options, mode)
    score = done.scores.first()
    entries = {} if done.vault is None else {r.token: r.value for r in done.vault.collect()}
    return {"text": done.records.first().text, "vault": entries, "score": score.score, "level": score.level}


def score_text(spark: SparkSession, text: str, options: Options = Options()) -> dict:
    """Risk counts, ``score`` and ``level`` of a text."""
    return score_texts(_frame(spark, text), "text", options).drop("_rid", "text").first().asDict()


def restore_text(spark: SparkSession, text: str, entries: dict[str, str]) -> str:
    """A text with each token of ``entries`` replaced by its value."""
    known = spark.createDataFrame([("", token, value) for token, value in entries.items()], "type string, jeton string, valeur_originale string")
    return vault.restore(_frame(spark, text), ["text"], known, "_rid").select(F.col("text")).first().text
