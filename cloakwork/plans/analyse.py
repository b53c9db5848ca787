"""Analysis of records without changing them, and before-and-after previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scoring
from ..operators.detect import Options
from .engine import json_schema, score_texts

#: Levels of objects and lists that are looked into where no schema is given.
LEVELS = 4


def leaf_texts(schema: T.DataType, base: Column) -> list[Column]:
    """All string leaves of a value as columns; keys that begin with ``_`` are passed over, lists are joined."""
    if isinstance(schema, T.StringType):
        return [base]
    if isinstance(schema, T.StructType):
        return [x for f in schema.fields if not f.name.startswith("_") for x in leaf_texts(f.dataType, base[f.name])]
    if isinstance(schema, T.ArrayType) and leaf_texts(schema.elementType, F.lit(None)):
        return [F.array_join(F.transform(base, lambda x: F.concat_ws("\n", *leaf_texts(schema.elementType, x))), "\n")]
    return []


def wrapped_texts(text: Column, levels: int = LEVELS) -> Column:
    """The string leaves of a JSON object in a text, a line each, whatever its shape; the text itself if it holds no object.

    Keys that begin with ``_`` are passed over, and what lies deeper than ``levels`` is taken as its JSON.
    """

    def leaves(v: Column, left: int) -> Column:
        kind = F.schema_of_variant(v)
        if not left:
            return F.when(kind.isin("STRING", "VOID") | ~kind.rlike("^(?:OBJECT|ARRAY)"), F.array(F.when(kind == "STRING", v.cast("string")))).otherwise(F.array(F.to_json(v)))
        entries = F.map_entries(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.startswith("_")))
        items = F.try_variant_get(v, "$", "array<variant>")
        none = F.array().cast("array<string>")
        return (
            F.when(kind == "STRING", F.array(v.cast("string")))
            .when(kind.startswith("OBJECT"), F.flatten(F.transform(entries, lambda e: leaves(e["value"], left - 1))))
            .when(kind.startswith("ARRAY"), F.flatten(F.transform(items, lambda x: leaves(x, left - 1))))
            .otherwise(none)
        )

    found = F.try_parse_json(text)
    looks = (F.length(text) > 10) & F.ltrim(text).startswith("{")
    return F.when(looks & found.isNotNull(), F.array_join(leaves(found, levels), "\n")).otherwise(text)


def analyse(df: DataFrame, limit: int | None = 20, options: Options = Options(), unwrap: tuple[str, ...] | None = None) -> DataFrame:
    """Each record with risk counts, score and level of all its texts. ``limit`` None takes all records.

    ``unwrap`` names columns of JSON texts, which are then read with one schema; without it every text that is a JSON object is
    unwrapped by itself, so records may have shapes of their own.
    """
    rows = df if limit is None else df.limit(limit)
    parts: list[Column] = []
    for f in df.schema.fields:
        if f.name.startswith("_"):
            continue
        if unwrap and f.name in unwrap:
            schema = json_schema(df, f.name)
            parts += leaf_texts(schema, F.from_json(F.col(f"`{f.name}`"), schema))
        elif unwrap is None and isinstance(f.dataType, T.StringType):
            parts.append(wrapped_texts(F.col(f"`{f.name}`")))
        else:
            parts += leaf_texts(f.dataType, F.col(f"`{f.name}`"))
    return score_texts(rows.withColumn("_all", F.concat_ws("\n", *parts) if parts else F.lit("")), "_all", options).drop("_all")


def summary(analysed: DataFrame) -> DataFrame:
    """n, mean (rounded half to even), max and the level of the mean, unaccented."""
    row = analysed.agg(F.count("*").alias("n"), F.coalesce(F.bround(F.avg("score")), F.lit(0)).cast("long").alias("mean"), F.coalesce(F.max("score"), F.lit(0)).alias("max"))
    return row.withColumn("level", F.translate(scoring.level(F.col("mean")), "ÉÈ", "EE"))


def preview(before: DataFrame, after: DataFrame, columns: list[str], row: str = "_rid", k: int = 10, chars: int = 150) -> DataFrame:
    """The first ``k`` rows' fields before and after: row, field, before, after (cut to ``chars``) and changed."""
    first = before.orderBy(row).limit(k)
    joined = first.select(row, *(F.col(f"`{c}`").cast("string").alias(f"b{i}") for i, c in enumerate(columns))).join(
        after.select(row, *(F.col(f"`{c}`").cast("string").alias(f"a{i}") for i, c in enumerate(columns))), row
    )
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after")) for i, c in enumerate(columns))))
    shown = joined.select(row, each.alias("x")).select(row, "x.*")
    return shown.select(row, "field", F.substring("before", 1, chars).alias("before"), F.substring("after", 1, chars).alias("after"), (~F.col("before").eqNullSafe(F.col("after"))).alias("changed"))


def preview_by_field(previewed: DataFrame, k: int = 3, row: str = "_rid") -> DataFrame:
    """Up to ``k`` changed examples of each field."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("field").orderBy(row))
    return previewed.where("changed").withColumn("rank", rank).where(F.col("rank") <= k)
