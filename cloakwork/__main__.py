"""Command line: ``python -m cloakwork INPUT (--pseudo | --anon | --dry-run | --score-only | --mapping-generate | --restore VAULT)``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.wordlists import Dictionaries
from .operators import infer, vault
from .operators.detect import Options
from .plans.analyse import analyse, preview, summary
from .plans.engine import run
from .plans.mapping import Mapping
from .plans.tables import with_row_id
from .sources import dictionaries, files

DRY_RUN = 100
KINDS = (".json", ".csv", ".tsv", ".xlsx", ".ods", ".docx", ".odt")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cloakwork", description=__doc__)
    p.add_argument("input", help="a file or, with --input-dir, a folder")
    what = p.add_mutually_exclusive_group(required=True)
    for flag in ("--pseudo", "--anon", "--dry-run", "--score-only", "--mapping-generate"):
        what.add_argument(flag, action="store_true")
    what.add_argument("--restore", metavar="VAULT")
    p.add_argument("--mapping")
    p.add_argument("--fort", action="store_true", help="also detect names by context and dictionaries")
    p.add_argument("--tech", action="store_true", help="also detect technical secrets and addresses")
    p.add_argument("--input-dir", action="store_true", help="all files of a folder, each with a vault of its own")
    p.add_argument("--dictionaries", metavar="FOLDER", help="word lists that take the place of the built-in ones, names among them")
    p.add_argument("--nlp", metavar="COLUMN", help="a list column of the records with the names of persons that a model has found")
    p.add_argument("--chunk-size", type=int, default=0, metavar="N", help="write a folder of JSON lines, N records a file at most, in place of one array")
    p.add_argument("--output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("cloakwork").getOrCreate()
    mapping = Mapping.from_json(Path(a.mapping).read_text()) if a.mapping else Mapping()
    loaded = files.load(spark, a.input, mapping, KINDS if a.input_dir else None)
    df = loaded.records
    words = dictionaries.load(spark, a.dictionaries) if a.dictionaries else Dictionaries()
    if a.mapping_generate:
        print(infer.infer_mapping(df).to_json())
        return 0
    if a.score_only:
        summary(analyse(df, None, Options(a.fort, a.tech, dictionaries=words))).show(truncate=False)
        return 0
    if a.restore:
        rows = with_row_id(df)
        _write(vault.restore(rows, None, files.read_vault(spark, a.restore), "_rid").orderBy("_rid"), a.output or files.output_path(a.input, "restore"), a.chunk_size)
        return 0
    if not a.mapping:
        p.error("--mapping is needed")
    if files.extension(a.input) in (*files.DOCUMENTS, *files.TEXTS, ".pdf") and mapping.texts == ("*",):
        mapping = Mapping(mapping.fields, ("texte",), whitelist=mapping.whitelist, blacklist=mapping.blacklist)
    mode = "anon" if a.anon else "pseudo"
    df = with_row_id(df)
    result = run(df, mapping, mode, a.fort, a.tech, words, scope="_source" if a.input_dir else None, limit=DRY_RUN if a.dry_run else None, on_error="drop", entities=a.nlp)
    result.stats().orderBy("stat").show(100, truncate=False)
    result.report().show(truncate=False)
    # A record of broken wrapped JSON is left out like one that can't be read: nobody has looked for personal data in it.
    inner = result.errors.join(df.select("_rid", *(["_source"] if "_source" in df.columns else [])), "_rid")
    print(f"errors: {loaded.errors.count() + inner.count()}")
    if "_source" in df.columns:
        errors = loaded.errors.unionByName(inner.select("_source", F.lit("unwrap").alias("reason")))
        files.status(files.Loaded(result.records, errors, loaded.files), result.detections).orderBy(F.col("_source").asc_nulls_last()).show(1000, truncate=False)
    if a.dry_run:
        fields = [f.path for f in mapping.fields] + [t for t in mapping.texts if "[]" not in t]
        plain = [f for f in fields if f in df.columns]
        preview(df, result.records, plain).show(1000, truncate=False)
        return 0
    out = a.output or files.output_path(a.input, mode)
    _write(result.records.orderBy("_rid"), out, a.chunk_size)
    if result.vault is not None:
        files.write_vault(result.vault, str(Path(out).with_name("correspondances.csv")))
    return 0


def _write(df: DataFrame, out: str, chunk: int) -> None:
    df = df.drop("_source") if files.extension(out) == ".json" else df
    if chunk and files.extension(out) == ".json":
        df.drop("_rid").write.mode("overwrite").option("maxRecordsPerFile", chunk).option("ignoreNullFields", "false").json(out)
    else:
        files.write(df, out)


if __name__ == "__main__":
    raise SystemExit(main())
