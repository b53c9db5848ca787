"""Cases where a result once went wrong, or a path was missing."""

import json

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import detect as D
from cloakwork.operators import vault
from cloakwork.plans import queries, texts
from cloakwork.plans.engine import run
from cloakwork.plans.mapping import Mapping
from cloakwork.sources import dictionaries, files, office
from cloakwork.streaming.incremental import protect_stream

IDS = Mapping.from_json({"champs_sensibles": {"i": {"type": "id", "jeton": "ID"}, "j": {"type": "id", "jeton": "CODE-X"}, "n": {"type": "nom", "jeton": "Client"}}})


def test_json_lines_arrays_and_objects(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "[y]"}, {"a": 3, "b": None}]
    shapes = {"lines": "\n".join(map(json.dumps, rows)), "array": json.dumps(rows), "pretty": json.dumps(rows, indent=1)}
    for name, text in shapes.items():
        (tmp_path / f"{name}.json").write_text(text)
        assert sorted((r.a, r.b) for r in files.read(spark, str(tmp_path / f"{name}.json")).collect()) == [(1, "x"), (2, "[y]"), (3, None)]
    (tmp_path / "one.json").write_text(json.dumps(rows[0], indent=2))
    assert files.read(spark, str(tmp_path / "one.json")).count() == 1
    got = files.read_folder(spark, str(tmp_path)).groupBy("_source").count().collect()
    assert {r._source: r["count"] for r in got} == {"lines.json": 3, "array.json": 3, "pretty.json": 3, "one.json": 1}


def test_two_id_fields_are_counted_through(spark):
    df = spark.createDataFrame([(1, "a", "b", "x"), (2, "", "c", "x"), (3, "d", None, "x")], "_rid long, i string, j string, n string")
    assert sorted((r.i, r.j, r.n) for r in run(df, IDS, "anon").records.collect()) == [("", "3", "***"), ("1", "2", "***"), ("4", None, "***")]


def test_prefixes_of_any_form_are_restored(spark):
    df = spark.createDataFrame([(1, "a", "b", "Eve"), (2, "a", "c", "Bob")], "_rid long, i string, j string, n string")
    done = run(df, IDS)
    assert sorted((r.i, r.j, r.n) for r in done.records.collect()) == [("[ID_1]", "[CODE-X_2]", "[Client_1]"), ("[ID_1]", "[CODE-X_3]", "[Client_2]")]
    back = vault.restore(done.records, ["i", "j", "n"], vault.exported(done.vault), "_rid")
    assert sorted((r.i, r.j, r.n) for r in back.collect()) == [("a", "b", "Eve"), ("a", "c", "Bob")]


def test_null_scope(spark):
    df = spark.createDataFrame([(1, "a", "b", "Eve", None), (2, "a", "c", "Bob", ""), (3, "a", "c", "Zoe", "s")], "_rid long, i string, j string, n string, s string")
    table = run(df, IDS, scope="s").vault
    assert sorted(((r._scope or str(r._scope)), r.token) for r in table.where("type = 'nom'").collect()) == [("", "[Client_1]"), ("None", "[Client_1]"), ("s", "[Client_1]")]


@pytest.mark.parametrize("mode", ["anon", "pseudo"])
def test_stream_of_several_batches(spark, tmp_path, mode):
    for k in range(3):
        (tmp_path / f"in{k}.json").write_text(json.dumps({"n": f"Name {k % 2}"}))
    source = spark.readStream.schema("n string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*.json")
    mapping = Mapping.from_json({"champs_sensibles": {"n": {"type": "nom", "jeton": "NOM"}}})
    protect_stream(source, mapping, f"{tmp_path}/out", f"{tmp_path}/check", mode).awaitTermination(300)
    got = sorted(r.n for r in spark.read.parquet(f"{tmp_path}/out/records").collect())
    assert got == ["***"] * 3 if mode == "anon" else len(got) == 3 and len(set(got)) == 2


def test_errors_are_counted(spark):
    df = spark.createDataFrame([(1, '{"k": 1}'), (2, "{broken"), (3, ""), (4, None)], "_rid long, p string")
    mapping = Mapping.from_json({"champs_sensibles": {"p.k": {"type": "k", "jeton": "K"}}, "structure": {"unwrap": {"field": "p"}}})
    for how, kept in (("keep", 4), ("drop", 3)):
        done = run(df, mapping, on_error=how)
        assert [r._rid for r in done.errors.collect()] == [2] and done.records.count() == kept


def test_dictionaries_from_a_folder(spark, tmp_path):
    (tmp_path / "prenoms.json").write_text(json.dumps(["marie", "Éva"]))
    (tmp_path / "noms.txt").write_text("\n".join(f"nom{i}" for i in range(700)) + "\nzola\n\n")
    (tmp_path / "villes-france.json").write_text(json.dumps(["PARIS"]))
    d = dictionaries.load(spark, str(tmp_path))
    counts = {r.dictionary: r.n for r in dictionaries.stats(spark, d).collect()}
    assert (counts["given_names"], counts["surnames"], counts["cities"], counts["stopwords"]) == (2, 701, 1, 242)
    df = spark.createDataFrame([("Marie est absente",), ("vu ZOLA hier et NOMX",), ("rien",), (None,)], "t string")
    want = [[], [], ["maj_patronyme"], ["prenom_isole"]]
    for words in (d, D.Dictionaries(["marie"], [f"nom{i}" for i in range(700)] + ["zola"])):
        got = D.detect(df, "t", D.Options(strong=True, dictionaries=words, names=("prenom_isole", "capitals"))).collect()
        assert sorted([x.stat for x in r.found] for r in got) == want


def test_single_texts(spark):
    options = D.Options()
    done = texts.protect_text(spark, "Ecrire a marie@test.com ou marie@test.com.", options)
    assert done["text"].startswith("Ecrire a [EMAIL_1] ou [EMAIL_")
    assert done["score"] == texts.score_text(spark, "Ecrire a marie@test.com ou marie@test.com.", options)["score"] == 6
    assert texts.restore_text(spark, done["text"], done["vault"]) == "Ecrire a marie@test.com ou marie@test.com."


def test_repeated_rows_of_ods():
    data = office.write_ods([{"a": "x", "b": "y"}])
    assert office.read_ods(data) == [{"a": "x", "b": "y"}]


def test_analysis_by_all_detectors(spark, tmp_path):
    spark.createDataFrame([("ip 10.0.0.1",), ("a@b.fr et 4111 1111 1111 1111",), ("rien",)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = queries.analyse_all(spark, str(tmp_path)).first()
    assert (row.n, row["max"]) == (3, 8)


def test_made_sentences_hold_what_is_found_and_what_is_not(spark, tmp_path):
    spark.range(1, 121).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    for name in queries.SENTENCES:
        n = queries.made(name)(spark, str(tmp_path)).select("c_custkey").distinct().count()
        assert 0 < n < 120, name
