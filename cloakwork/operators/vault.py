"""The vault: which token stands for which value, numbered by first appearance within each type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn
from ..plans.tables import materialise, numbered

PROVISIONAL = r"\[[^\[\]]+_9\d{17}\]"


def build(occurrences: DataFrame, known=None) -> DataFrame:
    """type, key, n, prefix, token and value of ``occurrences`` (type, key, value, prefix, pos).

    ``known`` is an earlier vault: its values keep their tokens and new ones are numbered after them. It is a table, all
    of which is in the result, or something with ``lookup`` and ``last`` (``streaming.ledger``), of which the result has what occurs.
    """
    firsts = occurrences.groupBy("type", "key").agg(F.min("pos").alias("pos"), F.min_by("value", "pos").alias("value"), F.min_by("prefix", "pos").alias("prefix"))
    before = last = None
    if isinstance(known, DataFrame):
        before, last = known, known.groupBy("type").agg(F.max("n").alias("last"))
    elif known is not None:
        firsts = materialise(firsts)
        before, last = materialise(known.lookup(firsts)), known.last()
    if before is not None:
        firsts = firsts.join(before.select("type", "key"), ["type", "key"], "left_anti")
    rows = numbered(firsts, ["pos"], ["type"])
    if last is not None:
        rows = rows.join(last, "type", "left").withColumn("n", F.col("n") + F.coalesce("last", F.lit(0)))
    rows = rows.select("type", "key", "n", "prefix", F.concat(F.lit("["), F.col("prefix"), F.lit("_"), F.col("n").cast("string"), F.lit("]")).alias("token"), "value")
    return rows if before is None else before.select(*rows.columns).unionByName(rows)


def exported(vault: DataFrame) -> DataFrame:
    """type, jeton, valeur_originale in the order of type and token as texts."""
    return vault.select("type", F.col("token").alias("jeton"), F.col("value").alias("valeur_originale")).orderBy("type", "jeton")


def search(vault: DataFrame, text: str) -> DataFrame:
    """Entries of an exported vault that hold ``text`` in any column, whatever the case."""
    return vault.where(F.lower(F.concat_ws("\n", "type", "jeton", "valeur_originale")).contains(text.lower()))


def page(vault: DataFrame, number: int, size: int = 20) -> DataFrame:
    """One page of an exported vault; numbers beyond the ends give the nearest page."""
    last = max(1, -(-vault.count() // size))
    return vault.orderBy("type", "jeton", "valeur_originale").offset((min(max(1, number), last) - 1) * size).limit(size)


#: Buckets of a saved vault; a key is hot if it stands in more than one in so many rows of the data that meets it.
BUCKETS, HOT = 64, 256


def save(vault: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Keep a vault (type, key, token, value) as a table of the warehouse, bucketed and sorted by key."""
    vault.select("type", "key", "token", "value").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").format("parquet").saveAsTable(name)


def with_tokens(df: DataFrame, column: str, type_: str, table: str, out: str = "token", hot: int = HOT) -> DataFrame:
    """``df`` with the token of a saved vault for each value of ``column``; null where the vault lacks it.

    The vault isn't shuffled: the distinct keys of ``df``, counted before the shuffle, come to its buckets. Keys that stand in more
    than one of ``hot`` rows, of which there can't be as many as ``hot``, are broadcast to the rows; the others are joined by shuffle, so
    no task gets a hot key's rows.
    """
    keyed = df.withColumn("_vault_key", fn.typed_key(F.col(f"`{column}`").cast("string")))
    counts = keyed.where(F.coalesce("_vault_key", F.lit("")) != "").groupBy(F.col("_vault_key").alias("key")).agg(F.count("*").alias("_n"))
    counts = materialise(counts)
    met = materialise(meeting(counts, type_, table).select(F.col("key").alias("_vault_key"), "_n", F.col("token").alias(out)))
    rows = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    common = F.col("_n") * hot > rows
    first = keyed.join(F.broadcast(met.where(common).select("_vault_key", F.col(out).alias("_hot_token"))), "_vault_key", "left")
    rest = first.where("_hot_token is null").drop("_hot_token").join(met.where(~common).drop("_n"), "_vault_key", "left")
    done = first.where("_hot_token is not null").withColumnRenamed("_hot_token", out).unionByName(rest)
    return done.select(*df.columns, out)


def meeting(counts: DataFrame, type_: str, table: str) -> DataFrame:
    """``counts`` (key, ...) with the entries of a saved vault: keys are dealt to the vault's buckets, which stay where they are."""
    known = counts.sparkSession.table(table).where(F.col("type") == type_).select("key", "token")
    return counts.repartition(_buckets(counts.sparkSession, table), "key").hint("merge").join(known.hint("merge"), "key")


def _buckets(spark: SparkSession, table: str) -> int:
    found = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    return int(found["Num Buckets"])


def final_text(text: Column, tokens: Column) -> Column:
    """``text`` with provisional tokens replaced through the map ``tokens``."""
    found = F.regexp_extract_all(text, F.lit(PROVISIONAL), F.lit(0))
    woven = F.zip_with(F.split(text, PROVISIONAL, -1), found, lambda a, m: F.concat(a, F.coalesce(F.try_element_at(tokens, m), m, F.lit(""))))
    return F.when(F.rlike(text, F.lit(PROVISIONAL)), F.array_join(woven, "")).otherwise(text)


#: A token of any prefix; what isn't in the vault stays as it is.
TOKEN = r"\[[^\[\]]+_\d+\]"


def _strings(kind: T.DataType, value: Column) -> Column | None:
    """An array of all strings in a value of any type; None if it can hold none."""
    if isinstance(kind, T.StringType):
        return F.array(value)
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _strings(f.dataType, value[f.name])) is not None]
        return F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts)) if parts else None
    if isinstance(kind, T.MapType):
        return _strings(T.ArrayType(kind.valueType), F.map_values(value))
    if isinstance(kind, T.ArrayType) and _strings(kind.elementType, F.lit(None)) is not None:
        return F.flatten(F.transform(value, lambda x: F.coalesce(_strings(kind.elementType, x), F.array().cast("array<string>"))))
    return None


def rewritten(kind: T.DataType, value: Column, one: Callable[[Column], Column]) -> Column:
    """A value of any type with ``one`` applied to each string in it, at any depth; keys of maps stay."""
    if isinstance(kind, T.StringType):
        return one(value)
    if _strings(kind, F.lit(None)) is None:
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(rewritten(f.dataType, value[f.name], one).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: rewritten(kind.valueType, v, one))
    return F.transform(value, lambda x: rewritten(kind.elementType, x, one))


def restore(df: DataFrame, columns: list[str] | None, vault: DataFrame, row: str) -> DataFrame:
    """``columns`` of ``df`` (None: all) with each token of the exported ``vault`` replaced by its value, at any depth.

    Strings in structs, lists and values of maps are restored too; in a string that is a JSON object or list the value is
    written as JSON writes it, so wrapped records stay sound. Of a token that stands for several values the last in
    the order of type and value counts. Tokens that the vault lacks, and those of empty values, stay. ``row`` tells
    the rows of ``df`` apart.
    """
    columns = [c for c in df.columns if c != row] if columns is None else columns
    kinds = {c: df.schema[c].dataType for c in columns}
    found = {c: s for c in columns if (s := _strings(kinds[c], F.col(f"`{c}`"))) is not None}
    if not found:
        return df
    values = vault.where(F.coalesce("valeur_originale", F.lit("")) != "").groupBy("jeton").agg(F.max_by("valeur_originale", F.struct("type", "valeur_originale")).alias("_value"))
    texts = F.concat(*(F.coalesce(s, F.array().cast("array<string>")) for s in found.values()))
    every = F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(TOKEN), F.lit(0)))))
    met = df.select(F.col(row).alias("_row"), F.explode(every).alias("jeton")).join(values, "jeton")
    maps = met.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("jeton", "_value"))).alias("_values"))

    def restored(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
        # Only texts that begin like JSON are tried as JSON.
        wrapped = F.ltrim(text).rlike(r"^[{\[]\s*[\"{\[]") & F.try_parse_json(text).isNotNull()

        def known(m: Column) -> Column:
            value = F.try_element_at("_values", m)
            quoted = F.to_json(F.struct(value.alias("v")))
            return F.coalesce(F.when(wrapped, F.substring(quoted, F.lit(7), F.length(quoted) - 8)).otherwise(value), m, F.lit(""))

        woven = F.zip_with(F.split(text, TOKEN, -1), tokens, lambda a, m: F.concat(a, F.when(m.isNull(), F.lit("")).otherwise(known(m))))
        return F.when(F.rlike(text, F.lit(TOKEN)), F.array_join(woven, "")).otherwise(text)

    joined = df.join(maps, F.col(row) == F.col("_row"), "left")
    return joined.withColumns({c: rewritten(kinds[c], F.col(f"`{c}`"), restored) for c in found}).drop("_row", "_values")
