"""The engine: records in, protected records, vault, detections and scores out."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as fn
from ..functions.wordlists import Dictionaries
from ..operators import scoring, vault
from ..operators.detect import HIDDEN, PERSON, REMOVED, Options, detect, provisional
from .mapping import Field, Mapping
from .tables import materialise, numbered, spread, with_row_id

#: What each type of field becomes in irreversible output.
CONSTANTS = {"prenom": "***", "nom": "***", "email": "anonyme@example.com", "tel": "00 00 00 00 00", "cp": "00000", "genre": "Non renseigné"}
OTHER = "***"
POSITION = ["_rid", "phase", "field", "elem", "stage", "place"]


@dataclass(frozen=True)
class Result:
    """``records`` as they came, protected; ``vault`` (null in anon mode); ``detections`` one row each; ``scores`` one row
    for each record; ``errors`` the ``_rid`` of each record whose wrapped JSON is broken."""

    records: DataFrame
    vault: DataFrame | None
    detections: DataFrame
    scores: DataFrame
    errors: DataFrame

    def stats(self) -> DataFrame:
        return scoring.replacements(self.detections)

    def samples(self, k: int = 5) -> DataFrame:
        return scoring.samples(self.detections, POSITION, k)

    def report(self) -> DataFrame:
        return scoring.report(self.scores)


def json_schema(df: DataFrame, column: str) -> T.StructType:
    """The schema of all JSON objects in a string column, found in one aggregate."""
    found = df.select(F.schema_of_variant_agg(F.expr(f"try_parse_json(`{column}`)"))).first()[0] or "VOID"
    # Values of several kinds under one key are read as texts.
    ddl = re.sub(r"\b(?:VOID|VARIANT)\b", "STRING", found.replace("OBJECT<", "STRUCT<"))
    kind = T._parse_datatype_string(ddl) if ddl.startswith("STRUCT<") else T.StructType()
    return kind


def _kind(schema: T.DataType, path: str) -> T.DataType | None:
    """The type at a dotted path; ``a[]`` steps into an array. None if there is nothing."""
    for part in path.split("."):
        name, in_list = part.removesuffix("[]"), part.endswith("[]")
        if not isinstance(schema, T.StructType) or name not in schema.names:
            return None
        schema = schema[name].dataType
        if in_list:
            if not isinstance(schema, T.ArrayType):
                return None
            schema = schema.elementType
    return schema


class _Paths:
    """Where the paths of a mapping lead: into the unwrapped object, if their first part is a key there, else into the record."""

    def __init__(self, record: T.StructType, unwrap: str, inner: T.StructType | None):
        self.record, self.unwrap, self.inner = record, unwrap, inner

    def resolve(self, path: str) -> tuple[str, str, T.DataType] | None:
        """(column, path in it, type)."""
        if self.inner is not None:
            inside = path.removeprefix(f"{self.unwrap}.")
            if (inside != path or "." in path) and (kind := _kind(self.inner, inside)) is not None:
                return "_un", inside, kind
        kind = _kind(self.record, path)
        head, _, rest = path.partition(".")
        return None if kind is None else (head.removesuffix("[]"), rest if not head.endswith("[]") else f"[].{rest}".removesuffix("."), kind)

    def get(self, path: str) -> Column | None:
        found = self.resolve(path)
        if found is None:
            return None
        column, rest, _ = found
        out = F.col(f"`{column}`")
        for part in rest.split(".") if rest else []:
            out = out[part]
        return out


def _put(df: DataFrame, column: str, rest: str, value) -> DataFrame:
    """``value(old)`` or, in a list, ``value(old, i)`` at a path of a column."""
    whole = F.col(f"`{column}`")
    if "[]" not in rest:
        if not rest:
            return df.withColumn(column, value(whole))
        old = whole
        for part in rest.split("."):
            old = old[part]
        return df.withColumn(column, F.when(whole.isNotNull(), whole.withField(rest, value(old))))
    head, _, tail = rest.partition("[]")
    tail = tail.removeprefix(".")
    items = whole
    for part in head.split(".") if head else []:
        items = items[part]

    def one(x: Column, i: Column) -> Column:
        old = x
        for part in tail.split(".") if tail else []:
            old = old[part]
        return F.when(x.isNotNull(), x.withField(tail, value(old, i))) if tail else value(old, i)

    changed = F.transform(items, one)
    return df.withColumn(column, changed if not head else F.when(whole.isNotNull(), whole.withField(head, changed)))


def _texts(paths: _Paths, path: str, index: int) -> Column | None:
    """An array of struct<field, elem, text> of the texts at a path."""
    found = paths.resolve(path)
    if found is None or not isinstance(found[2], T.StringType):
        return None
    column, rest, _ = found
    whole = F.col(f"`{column}`")

    def at(base: Column, steps: str) -> Column:
        for part in steps.split(".") if steps else []:
            base = base[part]
        return base

    def item(text: Column, i: Column) -> Column:
        return F.struct(F.lit(index).alias("field"), i.cast("int").alias("elem"), text.alias("text"))

    if "[]" not in rest:
        return F.array(item(at(whole, rest), F.lit(0)))
    head, _, tail = rest.partition("[]")
    return F.transform(at(whole, head), lambda x, i: item(at(x, tail.removeprefix(".")), i))


def run(
    df: DataFrame, mapping: Mapping, mode: str = "pseudo", strong: bool = False, tech: bool = False, dictionaries: Dictionaries = Dictionaries(),
    known=None, on_error: str = "keep", scope: str | None = None, limit: int | None = None, entities: str | None = None,
    extra: tuple = (),
) -> Result:
    """Protect ``df``. ``mode`` is pseudo (reversible tokens) or anon; ``known`` an earlier vault to go on from
    (a table, or a ledger, of which the result has the entries that occur).

    ``on_error`` says what becomes of records whose wrapped JSON is broken: keep them as they are or
    drop them. ``extra`` are stages of one's own (``detect.register_stage``); ``entities`` is a list column of person names that a model has found. ``limit`` takes the first records only (a dry run). With ``scope``, a column, each of
    its values has numbering and vault of its own.
    """
    if mode not in ("pseudo", "anon"):
        raise ValueError(f"unknown mode {mode}")
    anon = mode == "anon"
    columns = [c for c in df.columns if c != "_rid"]
    base = with_row_id(df)
    if limit is not None:
        base = materialise(base.orderBy("_rid").limit(limit))
    inner = json_schema(base, mapping.unwrap) if mapping.unwrap else None
    errors = base.select("_rid").limit(0)
    if inner is not None:
        # A broken text would give an object of nulls; it gives none.
        sound = F.expr(f"try_parse_json(`{mapping.unwrap}`)").isNotNull()
        base = base.withColumn("_un", F.when(sound, F.from_json(mapping.unwrap, inner)))
        fine = F.col("_un").isNotNull() | (F.trim(F.coalesce(mapping.unwrap, F.lit(""))) == "")
        errors = base.where(~fine).select("_rid")
        if on_error == "drop":
            base = base.where(fine)
    paths = _Paths(base.select(*columns).schema, mapping.unwrap, inner)

    # Fields: what each becomes, and its occurrence.
    fields: list[tuple[Field, Column, Column]] = []
    for f in mapping.fields:
        if (value := paths.get(f.path)) is not None:
            shown = value.cast("string")
            fields.append((f, shown, value.isNotNull() & (fn.trim(shown) != "")))
    items = [
        F.when(
            there,
            F.struct(
                F.lit(1).alias("phase"), F.lit(i).alias("field"), F.lit(0).alias("elem"), F.lit(0).alias("stage"), F.lit(0).alias("place"), F.lit(f.type).alias("type"), F.lit(f.prefix).alias("prefix"),
                fn.typed_key(v).alias("key"), fn.trim(v).alias("value"), F.lit(f.type).alias("stat"), F.lit(None).cast("string").alias("risk"), F.lit(False).alias("hit"), provisional(F.lit(f.type), fn.typed_key(v), F.lit(f.prefix)).alias("token"),
            ),
        )
        for i, (f, v, there) in enumerate(fields)
    ]
    scoped = [F.col(scope).alias("_scope")] if scope else []
    keys = ["_scope"] if scope else []
    of_fields = base.select("_rid", *scoped, F.explode(F.array_compact(F.array(*items))).alias("d")).select("_rid", *keys, "d.*") if items else None

    # Texts: one row each, all through one chain of stages.
    arrays = [a for i, p in enumerate(mapping.texts) if (a := _texts(paths, p, i)) is not None]
    found = texts = None
    if arrays:
        named = [F.col(f"`{entities}`").alias("_entities")] if entities else []
        rows = spread(base).select("_rid", *scoped, *named, *_names(paths, mapping), F.explode(F.flatten(F.array(*(F.coalesce(a, F.array()) for a in arrays)))).alias("t"))
        rows = rows.select("_rid", *keys, *(["_entities"] if entities else []), "_given", "_surname_", "t.*").where("text is not null").withColumn("_key", F.concat_ws("/", "_rid", "field", "elem"))
        options = Options(strong, tech, mapping.whitelist, mapping.blacklist, dictionaries, entities="_entities" if entities else None, extra=extra)
        rows = detect(rows, "text", options, out="shown", row="_key", lookup=(F.col("_given"), F.col("_surname_")) if mapping.lookup_given else None, hide=anon)
        if anon:
            rows = rows.withColumn("shown", F.regexp_replace("shown", rf"\[{PERSON}_\d+\]", REMOVED))
        texts = materialise(rows.select("_rid", *keys, "field", "elem", "shown", "found"))
        found = texts.select("_rid", *keys, F.lit(2).alias("phase"), "field", "elem", F.explode("found").alias("d"))
        found = found.select("_rid", *keys, "phase", "field", "elem", "d.stage", "d.place", "d.type", "d.prefix", "d.key", "d.value", "d.stat", "d.risk", "d.hit", "d.token")
    parts = [p for p in (of_fields, found) if p is not None]
    if not parts:
        raise ValueError("none of the mapping's paths is in the records")
    detections = reduce(DataFrame.unionByName, parts)

    # In the vault the scope is a part of the type, so each scope numbers by itself.
    head = F.when(F.col("_scope").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("_scope").cast("string"))) if scope else None
    kind = F.concat(head, F.lit("\x1f"), F.col("type")) if scope else F.col("type")
    occurrences = detections.where((F.col("type") != HIDDEN) & (F.col("key") != "")).select(kind.alias("type"), "key", "value", "prefix", F.struct(*POSITION).alias("pos"))
    table = materialise(vault.build(occurrences, known))
    finals = detections.withColumns({"_kind": kind, "_provisional": F.col("token")}).join(table.select(F.col("type").alias("_kind"), "key", F.col("token").alias("final")), ["_kind", "key"], "left").drop("_kind")
    detections = materialise(finals.withColumn("token", F.coalesce("final", "token")).drop("final"))
    maps = detections.groupBy("_rid").agg(F.map_from_entries(F.collect_set(F.struct("_provisional", "token"))).alias("_tokens"))
    records = base.join(maps, "_rid", "left")
    no_tokens = F.create_map().cast("map<string,string>")
    records = records.withColumn("_tokens", F.coalesce("_tokens", no_tokens))
    if texts is not None:
        shown = texts.groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "field", "elem").alias("k"), F.col("shown").alias("v")))).alias("_shown"))
        records = records.join(shown, "_rid", "left").withColumn("_shown", F.coalesce("_shown", no_tokens))
        for index, path in enumerate(mapping.texts):
            if _texts(paths, path, index) is None:
                continue
            column, rest, _ = paths.resolve(path)

            def text(old: Column, i: Column | None = None, index: int = index) -> Column:
                key = F.concat(F.lit(f"{index}/"), F.coalesce(i, F.lit(0)).cast("string") if i is not None else F.lit("0"))
                new = F.try_element_at("_shown", key)
                return F.when(old.isNotNull(), vault.final_text(new, F.col("_tokens")))

            records = _put(records, column, rest, _of_two(text) if "[]" in rest else text)
    if anon and any(f.type == "id" for f, _, _ in fields):
        # Ids are counted through: record by record, and within a record in the order of the fields.
        order = numbered(of_fields.where(F.col("type") == "id").select("_rid", "field"), ["_rid", "field"], name="_n")
        order = order.groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("field", "_n"))).alias("_numbers"))
        records = records.join(order, "_rid", "left")
    for i, (f, value, there) in enumerate(fields):
        column, rest, kind_ = paths.resolve(f.path)
        if not anon:
            new = F.try_element_at("_tokens", provisional(F.lit(f.type), fn.typed_key(value), F.lit(f.prefix)))
        elif f.type == "id":
            new = F.try_element_at("_numbers", F.lit(i)).cast("string")
        elif f.type == "uuid":
            new = F.uuid()
        else:
            new = F.lit(CONSTANTS.get(f.type, OTHER))
        records = _put(records, column, rest, lambda old, new=new, there=there: F.when(_there(old), new).otherwise(old.cast("string")))
    if inner is not None:
        records = records.withColumn(mapping.unwrap, F.when(F.col("_un").isNotNull(), F.to_json("_un", {"ignoreNullFields": "false"})).otherwise(F.col(mapping.unwrap)))
    per_risk = [F.sum(F.when(F.col("risk") == r, 1).otherwise(0)).cast("long").alias(r) for r in scoring.POINTS]
    scores = base.select("_rid").join(detections.groupBy("_rid").agg(*per_risk), "_rid", "left").na.fill(0, list(scoring.POINTS))
    scores = scores.withColumn("score", sum((F.col(r) * p for r, p in scoring.POINTS.items()), F.lit(0).cast("long"))).withColumn("level", scoring.level(F.col("score")))
    if scope:
        of = F.substring_index("type", "\x1f", -1)
        own = F.substring("type", F.lit(2), F.length("type") - F.length(of) - 2)
        table = table.withColumns({"_scope": F.when(F.left("type", F.lit(1)) == "+", own), "type": of})
    return Result(records.select("_rid", *columns), None if anon else table, detections.drop("_provisional"), scores, errors)


def _there(old: Column) -> Column:
    return old.isNotNull() & (fn.trim(old.cast("string")) != "")


def _of_two(text):
    return lambda old, i: text(old, i)


def _names(paths: _Paths, mapping: Mapping) -> list[Column]:
    """The columns _given and _surname_ of the person each record is about."""

    def at(path: str) -> Column:
        value = paths.get(path) if path else None
        return F.lit(None).cast("string") if value is None else value.cast("string")

    return [at(mapping.lookup_given).alias("_given"), at(mapping.lookup_surname).alias("_surname_")]


def protect_texts(df: DataFrame, column: str, options: Options = Options(), mode: str = "pseudo") -> Result:
    """The same for a frame with one free-text column and no fields."""
    mapping = Mapping(texts=(column,), whitelist=options.whitelist, blacklist=options.blacklist)
    return run(df, mapping, mode, options.strong, options.tech, options.dictionaries, extra=options.extra)


def score_texts(df: DataFrame, column: str, options: Options = Options()) -> DataFrame:
    """``df`` with risk counts, score and level of a text column: no vault, no shuffle."""
    return scoring.scored(detect(spread(df), column, options, out="_shown", found="_found"), "_found").drop("_shown", "_found")
