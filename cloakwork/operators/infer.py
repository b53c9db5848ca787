"""A mapping inferred from records: what each column seems to hold."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fold, trim
from ..functions.wordlists import Dictionaries
from ..plans.engine import json_schema
from ..plans.mapping import Field, Mapping

#: What a field's name says, in order of precedence. ``text`` is free text.
BY_NAME = (
    ("prenom", ("firstname", "prenom", "first_name", "given")),
    ("nom", ("lastname", "nom", "last_name", "family", "patronyme")),
    ("siret", ("siret",)),
    ("siren", ("siren",)),
    ("uuid", ("guid", "uuid")),
    ("email", ("mail", "email", "courriel")),
    ("tel", ("phone", "mobile", "fax", "consumerphone")),
    ("cp", ("postal", "cp", "zipcode", "zip_code", "code_postal", "postalcode")),
    ("genre", ("gender", "genre", "sexe")),
    ("text", ("comment", "note", "description", "texte", "question", "message", "detail", "contenu", "objet")),
)
#: Names of numbers that are ids, and values that tell a gender.
ID_NAMES = ("id", "ident", "numero")
GENDERS = ("male", "female", "homme", "femme", "m", "f")
PREFIXES = {"prenom": "PRENOM", "nom": "NOM", "siret": "SIRET", "siren": "SIREN", "uuid": "UUID", "email": "EMAIL", "tel": "TEL", "cp": "CP", "genre": "GENRE", "id": "ID"}
LONG_TEXT = 80
_HEX = "[0-9a-f]"
_UUID = re.compile("-".join(f"{_HEX}{{{n}}}" for n in (8, 4, 4, 4, 12)), re.I)


def kind_of(path: str, value: str, given: bool = False, surname: bool = False) -> str | None:
    """The type of a text field by its name, else by a value of it; ``given`` and ``surname`` are what dictionaries say."""
    name = path.lower().rsplit(".", 1)[-1]
    for kind, parts in BY_NAME:
        if any(p in name for p in parts):
            return kind
    if "@" in value and "." in value:
        return "email"
    if _UUID.fullmatch(value):
        return "uuid"
    if value.isdecimal() and (found := {14: "siret", 9: "siren", 5: "cp"}.get(len(value))):
        return found
    if value.lower() in GENDERS:
        return "genre"
    if re.fullmatch(r"[\d\s+.-]{8,}", value) and not re.fullmatch(r"\d{9,14}", value):
        return "tel"
    return "prenom" if given else "nom" if surname else "text" if len(value) > LONG_TEXT else None


def _leaves(kind: T.DataType, path: str = ""):
    """(path, type) of the text and number leaves, ``[]`` after the path of a list."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaves(f.dataType, f"{path}.{f.name}" if path else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from _leaves(kind.elementType, f"{path}[]")
    elif path.count("[]") < 2:
        yield path, kind


def _first(column: str, path: str):
    out = F.col(column)
    for part in path.split("."):
        out = out[part.removesuffix("[]")] if part.removesuffix("[]") else out
        if part.endswith("[]"):
            out = F.get(out, 0)
    return out


def infer_mapping(df: DataFrame, sample: int = 5, dictionaries: Dictionaries = Dictionaries()) -> Mapping:
    """From the first value that isn't null of each field in the first ``sample`` records; one small row reaches the driver."""
    rows = df.limit(sample)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    first = rows.agg(*(F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in df.columns)).first()
    wrapped = next((c for c in names if first[c] and len(first[c]) > 10 and first[c].strip()[:1] in "{[" and json_schema(rows, c).fields), "")
    values: dict[str, tuple[T.DataType, object]] = {c: (df.schema[c].dataType, first[c]) for c in sorted(df.columns) if c != wrapped and first[c] is not None and not c.startswith("_")}
    if wrapped:
        schema = json_schema(rows, wrapped)
        leaves = list(_leaves(schema))
        inner = rows.select(F.from_json(wrapped, schema).alias("u")).agg(*(F.first(_first("u", p), ignorenulls=True).alias(f"c{i}") for i, (p, _) in enumerate(leaves))).first()
        values |= {p: (k, inner[f"c{i}"]) for i, (p, k) in enumerate(leaves) if inner[f"c{i}"] is not None}
    texts = [str(v) for k, v in values.values() if isinstance(k, T.StringType)]
    known = {w: _in_dictionary(df, texts, d) for w, d in (("given", dictionaries.given_names), ("surname", dictionaries.surnames))}
    fields, free = [], []
    for path, (kind, value) in values.items():
        if isinstance(kind, T.StringType):
            found = kind_of(path, value, value in known["given"], value in known["surname"])
        elif isinstance(kind, T.NumericType):
            found = "id" if any(p in path.lower() for p in ID_NAMES) else None
        else:
            found = None
        if found == "text":
            free.append(path)
        elif found and "[]" not in path:
            fields.append(Field(path, found, PREFIXES[found]))
    lookup = {t: next((f.path for f in fields if f.type == t), "") for t in ("prenom", "nom")}
    return Mapping(tuple(fields), tuple(free), lookup["prenom"], lookup["nom"], unwrap=wrapped)


def _in_dictionary(df: DataFrame, values: list[str], dictionary) -> set[str]:
    if not isinstance(dictionary, DataFrame):
        words = {w.strip().upper() for w in dictionary}
        return {v for v in values if v.strip().upper() in words}
    tried = df.sparkSession.createDataFrame([(v,) for v in values] or [("",)], "v string")
    word = F.upper(trim(F.col(dictionary.columns[0])))
    hits = tried.join(dictionary.select(word.alias("w")), (F.upper(trim(F.col("v"))) == F.col("w")) | (fold(trim(F.col("v"))) == F.col("w")), "left_semi")
    return {r.v for r in hits.collect()}


def as_rows(df: DataFrame, mapping: Mapping) -> DataFrame:
    """A mapping as a table: path, type, prefix; free texts have the type ``text``."""
    rows = [(f.path, f.type, f.prefix) for f in mapping.fields] + [(t, "text", None) for t in mapping.texts]
    return df.sparkSession.createDataFrame(rows, "path string, type string, prefix string")
