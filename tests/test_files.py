"""Round trips of the formats, folders, streams and the command line."""

import json

import pytest

from cloakwork.__main__ import main
from cloakwork.operators.infer import infer_mapping, kind_of
from cloakwork.plans.mapping import Mapping
from cloakwork.sources import files, office
from cloakwork.streaming.incremental import protect_stream

ROWS = [{"nom": "Dupont", "prenom": "Marie", "email": "m@x.fr"}, {"nom": "Léa & <Co>", "prenom": "", "email": "a;b,\"c\""}]
MAIL = Mapping.from_json({"champs_sensibles": {"email": {"type": "email", "jeton": "EMAIL"}}})


@pytest.mark.parametrize("kind", ["xlsx", "ods"])
def test_spreadsheets(spark, tmp_path, kind):
    path = f"{tmp_path}/t.{kind}"
    files.write(spark.createDataFrame([tuple(r.values()) for r in ROWS], "nom string, prenom string, email string").coalesce(1), path)
    df = files.read(spark, path)
    assert df.columns == ["nom", "prenom", "email"] and sorted(r.asDict()["nom"] for r in df.collect()) == ["Dupont", "Léa & <Co>"]
    assert {r.email for r in df.collect()} == {"m@x.fr", "a;b,\"c\""}


@pytest.mark.parametrize("kind", ["docx", "odt"])
def test_documents(spark, tmp_path, kind):
    (tmp_path / f"d.{kind}").write_bytes((office.write_docx if kind == "docx" else office.write_odt)("Un\n\n deux & <trois>\n"))
    row = files.read(spark, f"{tmp_path}/d.{kind}").first()
    assert (row.texte, row._source) == ("Un\n deux & <trois>", f"d.{kind}")


def test_csv_tsv_text_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('nom,note\n"D, E","deux\nlignes"\n')
    assert files.read(spark, f"{tmp_path}/a.csv").first() == ("D, E", "deux\nlignes")
    (tmp_path / "b.csv").write_text("x;1\ny;2\n")
    assert files.read(spark, f"{tmp_path}/b.csv", Mapping(options={"delimiter": ";", "header": False})).columns == ["col_0", "col_1"]
    (tmp_path / "c.tsv").write_text("nom\tv\nA\t1\n")
    assert files.read(spark, f"{tmp_path}/c.tsv").first() == ("A", "1")
    (tmp_path / "d.md").write_text("# Titre\nligne")
    assert files.read(spark, f"{tmp_path}/d.md").first().texte == "# Titre\nligne"
    df = spark.createDataFrame([(1, "é"), (2, None)], "i long, t string").coalesce(1)
    files.write(df, f"{tmp_path}/e.json")
    assert json.loads((tmp_path / "e.json").read_text()) == [{"i": 1, "t": "é"}, {"i": 2, "t": None}]
    assert files.read(spark, f"{tmp_path}/e.json").count() == 2
    with pytest.raises(ValueError, match="unknown format"):
        files.read(spark, f"{tmp_path}/x.bin")


def test_folder_and_names(spark, tmp_path):
    for name in ("b.json", "a.json", "a_PSEUDO.json"):
        (tmp_path / name).write_text(json.dumps([{"email": "x@y.fr"}]))
    df = files.read_folder(spark, str(tmp_path))
    assert sorted(r._source for r in df.collect()) == ["a.json", "b.json"]
    assert files.output_path("/x/a.pdf", "anon") == "/x/a_ANON.txt" and files.output_path("/x/a.json", "pseudo") == "/x/a_PSEUDO.json"


def test_stream_keeps_one_vault(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, mails in enumerate((["a@x.fr", "b@x.fr"], ["b@x.fr", "c@x.fr"])):
        spark.createDataFrame([(m,) for m in mails], "email string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("email string").parquet(f"{tmp_path}/in")
        query = protect_stream(source, MAIL, f"{tmp_path}/out", f"{tmp_path}/check")
        query.awaitTermination()
        assert query.exception() is None
        assert len({r.key: r.token for r in spark.read.parquet(f"{tmp_path}/out/vault").collect()}) == i + 2
    vault = {r.key: r.token for r in spark.read.parquet(f"{tmp_path}/out/vault").collect()}
    assert vault == {"a@x.fr": "[EMAIL_1]", "b@x.fr": "[EMAIL_2]", "c@x.fr": "[EMAIL_3]"}
    assert sorted(r.email for r in spark.read.parquet(f"{tmp_path}/out/records").collect()) == ["[EMAIL_1]", "[EMAIL_2]", "[EMAIL_2]", "[EMAIL_3]"]


def test_inference(spark):
    assert [kind_of(*x) for x in (("client.prenom", ""), ("nom", ""), ("x", "a@b.fr"), ("x", "75001"), ("x", "123456789"), ("x", "06 12 34 56 78"), ("x", "F"), ("x", "y" * 81), ("x", "y"))] == [
        "prenom", "nom", "email", "cp", "siren", "tel", "genre", "text", None,
    ]
    wrapped = json.dumps({"R": {"Firstname": "Lea", "Details": [{"Value": "x" * 90}], "Phone": "0612345678"}})
    df = spark.createDataFrame([(1, "Dupont", True, wrapped)], "ident long, nom string, is_id boolean, w string")
    m = infer_mapping(df)
    assert {(f.path, f.type) for f in m.fields} == {("ident", "id"), ("nom", "nom"), ("R.Firstname", "prenom"), ("R.Phone", "tel")}
    assert (m.texts, m.unwrap, m.lookup_given, m.lookup_surname) == (("R.Details[].Value",), "w", "R.Firstname", "nom")
    assert Mapping.from_json(m.to_json()) == m


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "r.json").write_text(json.dumps([{"email": "m@x.fr"}, {"email": "n@x.fr"}]))
    (tmp_path / "m.json").write_text(MAIL.to_json())
    assert main([f"{tmp_path}/r.json", "--pseudo", "--mapping", f"{tmp_path}/m.json"]) == 0
    assert [r["email"] for r in json.loads((tmp_path / "r_PSEUDO.json").read_text())] == ["[EMAIL_1]", "[EMAIL_2]"]
    assert main([f"{tmp_path}/r_PSEUDO.json", "--restore", f"{tmp_path}/correspondances.csv", "--output", f"{tmp_path}/back.json"]) == 0
    assert [r["email"] for r in json.loads((tmp_path / "back.json").read_text())] == ["m@x.fr", "n@x.fr"]
    assert main([f"{tmp_path}/r.json", "--mapping-generate"]) == 0
    assert '"email"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([f"{tmp_path}/r.json"])
