"""Word lists from a folder of JSON files, each an array of strings, or text files of one word a line."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wordlists import Dictionaries

#: The file that each list is read from, without its extension.
FILES = {
    "given_names": "prenoms",
    "surnames": "noms",
    "lower_stopwords": "stopwords-minuscules",
    "stopwords": "stopwords-capitalises",
    "kept_capitals": "majuscules-garder",
    "cities": "villes-france",
    "organisations": "mots-organisations",
    "institutions": "contexte-institution",
}
#: Names can be many and stay tables; the other lists stand in patterns.
NAMES = ("given_names", "surnames")


def _words(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The distinct words of a list; None if the folder lacks it."""
    every = spark.read.text(folder, wholetext=True, pathGlobFilter=f"{name}.{{json,txt}}").select("value", F.col("_metadata.file_name").alias("file"))
    words = F.when(F.col("file").endswith(".json"), F.from_json("value", "array<string>")).otherwise(F.split("value", r"\R"))
    found = every.select(F.explode(words).alias("word")).where(F.trim("word") != "").distinct()
    return None if every.isEmpty() else found


def load(spark: SparkSession, folder: str) -> Dictionaries:
    """The lists that ``folder`` holds, the built-in ones in place of the others."""
    found = {field: words for field, name in FILES.items() if (words := _words(spark, folder, name)) is not None}
    return replace(Dictionaries(), **{field: words if field in NAMES else sorted(r.word for r in words.collect()) for field, words in found.items()})


def stats(spark: SparkSession, dictionaries: Dictionaries) -> DataFrame:
    """dictionary and n: how many distinct words each list has."""
    lists = {f.name: getattr(dictionaries, f.name) for f in fields(dictionaries)}
    rows = [(name, len(set(words))) for name, words in lists.items() if not isinstance(words, DataFrame)]
    out = spark.createDataFrame(rows, "dictionary string, n long")
    for name, words in lists.items():
        if isinstance(words, DataFrame):
            out = out.union(words.distinct().agg(F.lit(name).alias("dictionary"), F.count("*").alias("n")))
    return out
