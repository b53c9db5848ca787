"""Risk scores, levels, counts, samples and reports of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordlists import Dictionaries

#: Points of each risk, and the levels with their upper bounds.
POINTS = {"finance": 5, "direct": 3, "tech": 2, "indirect": 1}
LEVELS = ((1, "NUL"), (10, "FAIBLE"), (50, "MODÉRÉ"), (100, "ÉLEVÉ"))
HIGHEST = "CRITIQUE"


def level(score: Column) -> Column:
    out = F.lit(HIGHEST)
    for bound, name in reversed(LEVELS):
        out = F.when(score < bound, name).otherwise(out)
    return out


def risk_counts(found: Column) -> dict[str, Column]:
    """Detections of each risk in an array of detections."""
    return {r: F.aggregate(found, F.lit(0).cast("long"), _adder(r)) for r in POINTS}


def _adder(risk: str):
    return lambda n, d: n + F.when(d["risk"] == risk, 1).otherwise(0)


def score(found: Column) -> Column:
    return sum((n * POINTS[r] for r, n in risk_counts(found).items()), F.lit(0).cast("long"))


def scored(df: DataFrame, found: str = "found") -> DataFrame:
    """``df`` with direct, finance, tech, indirect, score and level of its detections."""
    counts = risk_counts(F.col(found))
    return df.withColumns(counts).withColumn("score", sum((F.col(r) * p for r, p in POINTS.items()), F.lit(0).cast("long"))).withColumn("level", level(F.col("score")))


def replacements(detections: DataFrame) -> DataFrame:
    """stat and n of a table of detections, and their sum as stat ``total``."""
    return detections.rollup("stat").agg(F.count("*").alias("n")).select(F.coalesce("stat", F.lit("total")).alias("stat"), "n")


def samples(detections: DataFrame, order: list[str], k: int = 5, chars: int = 60) -> DataFrame:
    """The first ``k`` detections of each stat: stat, rank, original (cut to ``chars``), token. ``order`` must be total."""
    rank = F.row_number().over(Window.partitionBy("stat").orderBy(*order))
    return detections.withColumn("rank", rank).where(F.col("rank") <= k).select("stat", F.col("rank").cast("long").alias("rank"), F.substring("value", 1, chars).alias("original"), "token")


def top_words(detections: DataFrame, k: int = 20, dictionaries: Dictionaries = Dictionaries()) -> DataFrame:
    """The words found most by dictionaries: word, n, stopword; ties by word."""
    hits = detections.where("hit").groupBy(F.upper("value").alias("word")).agg(F.count("*").alias("n"))
    stop = F.col("word").isin(dictionaries.stopwords) | F.lower("word").isin(dictionaries.lower_stopwords)
    return hits.withColumn("stopword", stop).orderBy(F.desc("n"), "word").limit(k)


def report(scores: DataFrame) -> DataFrame:
    """One row over scored records: n, score, mean (one decimal), max, the level of the sum and that of the mean."""
    row = scores.agg(F.count("*").alias("n"), F.coalesce(F.sum("score"), F.lit(0)).alias("score"), F.round(F.avg("score"), 1).alias("mean"), F.bround(F.avg("score")).cast("long").alias("rounded"), F.max("score").alias("max"))
    return row.withColumns({"level": level(F.col("score")), "mean_level": F.translate(level(F.coalesce("rounded", F.lit(0))), "ÉÈ", "EE")})
