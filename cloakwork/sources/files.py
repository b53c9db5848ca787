"""Reading and writing records by file format: one reader and one writer for each extension."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.vault import exported
from ..plans.mapping import Mapping
from ..plans.tables import materialise, with_row_id
from . import json_records, office

#: Suffixes of the files that the library writes.
SUFFIXES = {"pseudo": "_PSEUDO", "anon": "_ANON", "restore": "_RESTAURE"}
TABLES, DOCUMENTS, TEXTS = {".xlsx": office.read_xlsx, ".ods": office.read_ods}, {".docx": office.read_docx, ".odt": office.read_odt}, (".txt", ".md")
READABLE = (".json", ".csv", ".tsv", *TABLES, *DOCUMENTS, *TEXTS, ".pdf")


def extension(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


@dataclass(frozen=True)
class Loaded:
    """``records`` that could be read; ``errors``, one row for each that could not: _source and reason, never its text;
    ``files``, one row for each file that was looked at: _source."""

    records: DataFrame
    errors: DataFrame
    files: DataFrame


def load(spark: SparkSession, path: str, mapping: Mapping = Mapping(), kinds: tuple[str, ...] | None = None, pdf=None) -> Loaded:
    """A file, glob, or folder of one format; with ``kinds`` all files of a folder of these formats, but those the library wrote itself.

    A record or file that is broken is left out of the records and counted. Each format is one scan, however many files it has.
    ``pdf`` is a function of a PDF's bytes that gives the text of its pages; there is none built in.
    """
    found = _list(spark, path, kinds) if kinds else None
    by_kind: dict[str, list[str]] = {}
    for f in found if kinds else []:
        by_kind.setdefault(extension(f), []).append(f)
    if kinds and not by_kind:
        raise ValueError(f"no files of {', '.join(kinds)} in {path}")
    parts = [_load(spark, own, kind, mapping, pdf) for kind, own in by_kind.items()] if kinds else [_load(spark, [path], extension(path), mapping, pdf)]
    records = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_numbered(r, i, len(parts)) for i, (r, _) in enumerate(parts)])
    errors = reduce(DataFrame.unionByName, [e for _, e in parts])
    names = [PurePosixPath(f).name for f in found] if kinds else [PurePosixPath(path).name]
    return Loaded(records, errors, spark.createDataFrame([(n,) for n in names], "_source string"))


def _numbered(records: DataFrame, part: int, parts: int) -> DataFrame:
    """Numbers of rows that stay apart where formats meet; each format keeps its order."""
    return records if parts == 1 else with_row_id(records).withColumn("_rid", F.col("_rid") + (part << 57))


def read(spark: SparkSession, path: str, mapping: Mapping = Mapping(), pdf=None) -> DataFrame:
    """The records that ``load`` finds in a file, glob, or folder of one format; ``_source`` names the file of a document."""
    records = load(spark, path, mapping, pdf=pdf).records
    return records if extension(path) in (*DOCUMENTS, *TEXTS, ".pdf") else records.drop("_source")


def read_folder(spark: SparkSession, path: str, mapping: Mapping = Mapping(), kinds: tuple[str, ...] = (".json",)) -> DataFrame:
    """The records of all files of a folder with the given extensions; ``_source`` tells the file.

    Use ``scope="_source"`` in ``run`` to give each file a numbering of its own.
    """
    return load(spark, path, mapping, kinds).records


def _load(spark: SparkSession, paths: list[str], kind: str, mapping: Mapping, pdf) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of files of one format."""
    none = spark.createDataFrame([], "_source string, reason string")
    options = mapping.options
    named = json_records.name_of("_metadata.file_path").alias("_source")
    if kind == ".json" and options.get("encoding", "utf-8").lower().replace("-", "") == "utf8":
        sound, broken = json_records.read(spark, paths)
        return sound, broken.select("_source", F.lit("JSON").alias("reason"))
    if kind == ".json":
        # Other encodings can't be cut at bytes; a task reads a file whole.
        whole = materialise(spark.read.json(paths, multiLine=True, encoding=options["encoding"], columnNameOfCorruptRecord=json_records.BROKEN).withColumn("_source", json_records.name_of("_metadata.file_path")))
        if json_records.BROKEN not in whole.columns:
            return whole, none
        bad = F.col(json_records.BROKEN).isNotNull()
        return whole.where(~bad).drop(json_records.BROKEN), whole.where(bad).select("_source", F.lit("JSON").alias("reason"))
    if kind in (".csv", ".tsv"):
        header = options.get("header", True)
        df = spark.read.csv(paths, sep="\t" if kind == ".tsv" else options.get("delimiter", ","), encoding=options.get("encoding", "utf-8"), header=header, multiLine=True, escape='"')
        fields = df.columns
        df = df.select(*(F.coalesce(f"`{c}`", F.lit("")).alias(c if header else f"col_{i}") for i, c in enumerate(fields)), *([] if "_source" in fields else [named]))
        return df, none
    if kind in TEXTS:
        return spark.read.text(paths, wholetext=True).select(F.col("value").alias("texte"), named), none
    if kind in DOCUMENTS or kind == ".pdf":
        if kind == ".pdf" and pdf is None:
            raise ValueError("reading PDF needs a function that gives the text of its pages")
        parse = DOCUMENTS.get(kind) or (lambda data: "\n\n".join(x for x in pdf(data) if x))
        found = materialise(_each(spark, paths, lambda data: [parse(data)], "string"))
        return found.where("reason is null").select(F.col("r").alias("texte"), "_source"), found.where("reason is not null").select("_source", "reason")
    if kind in TABLES:
        found = materialise(_each(spark, paths, TABLES[kind], "map<string,string>"))
        keys = found.select("_source", F.posexplode(F.map_keys("r")).alias("i", "k")).groupBy("k").agg(F.min(F.struct("_source", "i")).alias("at"))
        names = [r.k for r in keys.orderBy("at").collect()]
        # A cell that is empty is "", a column that the file lacks is null.
        cells = [F.when(F.map_contains_key("r", F.lit(n)), F.coalesce(F.try_element_at("r", F.lit(n)), F.lit(""))).alias(n) for n in names]
        return found.where("reason is null").select(*cells, *([] if "_source" in names else ["_source"])), found.where("reason is not null").select("_source", "reason")
    raise ValueError(f"unknown format: {kind or paths[0]}")


def _each(spark: SparkSession, paths: list[str], parse, kind: str) -> DataFrame:
    """r, _source and reason: what ``parse`` makes of the bytes of each file; a file that it can't read has one row with the reason."""
    from pyspark.sql.pandas.types import to_arrow_type

    r = to_arrow_type(T._parse_datatype_string(kind))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, source in zip(batch.column("content"), batch.column("_source").to_pylist(), strict=True):
                try:
                    found, reason = list(parse(data.as_py())), None
                except Exception as e:  # whatever a broken file makes a parser raise
                    found, reason = [None], type(e).__name__
                if found and isinstance(found[0], dict):
                    found = [list(x.items()) for x in found]
                yield pa.RecordBatch.from_arrays([pa.array(found, r), pa.array([source] * len(found), pa.string()), pa.array([reason] * len(found), pa.string())], names=["r", "_source", "reason"])

    return _binary(spark, paths).mapInArrow(rows, f"r {kind}, _source string, reason string")


def _binary(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("content", F.element_at(F.split("path", "/"), -1).alias("_source"))


def status(loaded: Loaded, detections: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """One row for each file that was looked at, and one for all (``_source`` null): n_records, n_errors, n_replacements and status.

    ``detections`` and ``records`` are those of a run over ``loaded.records``. A file of which nothing could be read is an ``error``.
    """
    counts = loaded.records.groupBy("_source").agg(F.count("*").alias("n_records"))
    broken = loaded.errors.groupBy("_source").agg(F.count("*").alias("n_errors"))
    rows = loaded.files.join(counts, "_source", "left").join(broken, "_source", "left")
    if detections is not None:
        of = detections.join((loaded.records if records is None else records).select("_rid", "_source"), "_rid")
        rows = rows.join(of.groupBy("_source").agg(F.count("*").alias("n_replacements")), "_source", "left")
    else:
        rows = rows.withColumn("n_replacements", F.lit(0).cast("long"))
    rows = rows.na.fill(0, ["n_records", "n_errors", "n_replacements"])
    rows = rows.withColumn("status", F.when((F.col("n_errors") > 0) & (F.col("n_records") == 0), "error").otherwise("ok"))
    failed = F.sum(F.when(F.col("status") == "error", 1).otherwise(0))
    sums = [F.sum(c).alias(c) for c in ("n_records", "n_errors", "n_replacements")]
    every = rows.agg(*sums, F.concat((F.count("*") - failed).cast("string"), F.lit(" ok, "), failed.cast("string"), F.lit(" error")).alias("status"))
    return rows.unionByName(every.select(F.lit(None).cast("string").alias("_source"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_records", "n_errors", "n_replacements")), "status"))


def _list(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> list[str]:
    """Files of a folder; Spark lists them, so any store will do, and reads none."""
    names = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    return sorted(n for n in names if extension(n) in kinds and not any(f"{s}." in n for s in SUFFIXES.values()))


def _store(path: str):
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{PurePosixPath(path)}")


def output_path(path: str, what: str) -> str:
    p = PurePosixPath(path)
    kind = ".txt" if p.suffix.lower() == ".pdf" else p.suffix
    return str(p.with_name(p.stem + SUFFIXES[what] + kind))


def write(df: DataFrame, path: str) -> None:
    """Write records by the extension of ``path``.

    JSON lines, CSV, TSV, text and Parquet are folders that Spark writes in parallel. Office files and
    a ``.json`` array are single files, streamed through the driver one partition at a time: they are
    meant for results that a person opens.
    """
    kind = extension(path)
    df = df.drop("_rid")
    if kind in (".csv", ".tsv"):
        df.write.mode("overwrite").csv(path, sep="\t" if kind == ".tsv" else ",", header=True, escape='"')
    elif kind in (".txt", ".md"):
        df.select(F.col("texte").cast(T.StringType())).write.mode("overwrite").text(path)
    elif kind == ".parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind in (".xlsx", ".ods"):
        rows = [r.asDict() for r in df.toLocalIterator()]
        _put(path, office.write_xlsx(rows) if kind == ".xlsx" else office.write_ods(rows))
    elif kind in (".docx", ".odt"):
        text = "\n".join(r.texte or "" for r in df.select("texte").toLocalIterator())
        _put(path, office.write_docx(text) if kind == ".docx" else office.write_odt(text))
    elif kind == ".json":
        store, name = _store(path)
        with store.open_output_stream(name) as out:
            out.write(b"[")
            for i, r in enumerate(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()):
                out.write((", " * (i > 0) + r.j).encode())
            out.write(b"]")
    else:
        df.write.mode("overwrite").json(path)


def _put(path: str, data: bytes) -> None:
    store, name = _store(path)
    with store.open_output_stream(name) as out:
        out.write(data)


def write_vault(vault: DataFrame, path: str) -> None:
    """The vault as ``;``-separated text in the order of type and token: one folder of as many files as the order has ranges."""
    exported(vault).write.mode("overwrite").csv(path, sep=";", header=True, escape='"')


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """type, jeton, valeur_originale of a written vault; further columns are left out."""
    df = spark.read.csv(path, sep=";", header=True, multiLine=True, escape='"')
    return df.toDF("type", "jeton", "valeur_originale", *df.columns[3:]).select("type", "jeton", "valeur_originale")


def bundle(target: str, files: list[str]) -> None:
    """A zip archive of local files."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in files:
            z.write(f, PurePosixPath(f).name)
