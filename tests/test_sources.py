"""Arrays cut at any byte, broken records and files, restoring at any depth."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cloakwork.__main__ import main
from cloakwork.operators import vault
from cloakwork.plans.engine import run
from cloakwork.plans.mapping import Mapping
from cloakwork.sources import files, json_records, office

SECRET = "Secret Martin"
MAPPING = {"champs_sensibles": {"nom": {"type": "nom", "jeton": "NOM"}}}


def written(folder):
    """All that stands in the files of a folder, but for the inputs that hold the secret."""
    return "\n".join(f.read_text(errors="replace") for f in folder.rglob("*") if f.is_file() and not f.name.startswith("in") and not f.name.endswith(".crc"))


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that they begin within strings, escapes and nested values."""
    names = {"spark.sql.files.maxPartitionBytes": "701b", "spark.sql.files.openCostInBytes": "1b"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_arrays_cut_at_any_byte_equal_the_whole(small_ranges, tmp_path):
    spark, rng = small_ranges, random.Random(1)
    bits = ['"', "\\", "{", "}", "[", "]", ",", "\n", "é", "x", "日", '\\"', '}\\"{', "\\\\"]
    rows = [{"i": i, "t": "".join(rng.choice(bits) for _ in range(rng.randrange(60))), "o": {"a": [{"z": "]}"}, None], "b": [[i]]}} for i in range(400)]
    rows[100]["t"] = "}{" * 2000  # a record over several ranges
    shapes = {"in a+b%.json": json.dumps(rows, ensure_ascii=False, indent=1), "in b.json": json.dumps(rows), "one.json": json.dumps(rows[3], indent=2) + "\n", "none.json": "[]", "blank.json": " \n", "lines.json": "\n".join(map(json.dumps, rows))}
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
    assert spark.read.text(f"{tmp_path}/in b.json", lineSep="}").select(F.spark_partition_id()).distinct().count() > 20
    loaded = files.load(spark, str(tmp_path), kinds=(".json",))
    assert loaded.errors.count() == 0
    got: dict = {}
    for r in loaded.records.orderBy("_source", "_rid").collect():
        got.setdefault(r._source, []).append({"i": r.i, "t": r.t, "o": {"a": [x and x.asDict() for x in r.o.a], "b": r.o.b}})
    assert got == {"in a+b%.json": rows, "in b.json": rows, "lines.json": rows, "one.json": [rows[3]]}


def test_cutter_by_every_split():
    text = '[{"a":"\\\\\\"}"},{"b":{"c":[1,{"d":"]"}]}} , {"e":"{\\u007d"}]'
    want = [(i, json.dumps(x)) for i, x in enumerate(json.loads(text))]
    marks = [i + 1 for i, c in enumerate(text) if c == "}"]
    for cut in marks:
        found, carry = [], b""
        first, second = text[:cut].encode(), text[cut:].encode()
        cutter = json_records.Cutter(json_records.State(), 1)
        found += [x.decode() for _, x in cutter.feed(first)]
        carry = b"".join(cutter.open or [])
        at, step, odd, quotes = json_records.brackets(first)
        state = json_records.State(bool(quotes % 2), int(step[~odd].sum()))
        for number, x in json_records.Cutter(state, 1).feed(second):
            found.append((carry + x).decode() if number is None else x.decode())
        assert [json.loads(x) for x in found] == [json.loads(x) for _, x in want]


@pytest.mark.parametrize("shape", ["lines", "array", "first"])
def test_broken_records_leave_nothing_behind(spark, tmp_path, capsys, shape):
    good, bad = [json.dumps({"nom": "Anna Un"}), json.dumps({"nom": "Bob Deux"})], '{"nom":"%s", broken' % SECRET
    text = {"lines": "\n".join([good[0], bad, good[1]]), "first": "\n".join([bad, *good]), "array": f"[{good[0]}, {bad}}}, {good[1]}]"}[shape]
    (tmp_path / "in.json").write_text(text)
    (tmp_path / "m.json").write_text(json.dumps(MAPPING))
    assert main([f"{tmp_path}/in.json", "--pseudo", "--mapping", f"{tmp_path}/m.json", "--output", f"{tmp_path}/out.json"]) == 0
    shown = capsys.readouterr().out
    assert "errors: 1" in shown and SECRET not in shown
    assert json.loads((tmp_path / "out.json").read_text()) == [{"nom": "[NOM_1]"}, {"nom": "[NOM_2]"}]
    assert SECRET not in written(tmp_path)


def test_folder_with_broken_files(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "in1.json").write_text(json.dumps([{"nom": "Anna"}, {"nom": "Bob"}]))
    (folder / "in2.json").write_text('{"nom":"%s", broken' % SECRET)
    (folder / "in3.csv").write_text("nom\nCara\n")
    (folder / "in4.xlsx").write_bytes(office.write_xlsx([{"nom": "Dora", "x": ""}]))
    (folder / "in5.xlsx").write_bytes(SECRET.encode())
    loaded = files.load(spark, str(folder), Mapping.from_json(MAPPING), (".json", ".csv", ".xlsx"))
    result = run(loaded.records, Mapping.from_json(MAPPING), scope="_source")
    got = {r._source: (r.n_records, r.n_errors, r.n_replacements, r.status) for r in files.status(loaded, result.detections).collect()}
    assert got == {
        "in1.json": (2, 0, 2, "ok"), "in2.json": (0, 1, 0, "error"), "in3.csv": (1, 0, 1, "ok"), "in4.xlsx": (1, 0, 1, "ok"), "in5.xlsx": (0, 1, 0, "error"), None: (4, 2, 4, "3 ok, 2 error"),
    }
    (tmp_path / "m.json").write_text(json.dumps(MAPPING))
    assert main([str(folder), "--input-dir", "--anon", "--mapping", f"{tmp_path}/m.json", "--output", f"{tmp_path}/out"]) == 0
    shown = capsys.readouterr().out
    assert "errors: 2" in shown and "3 ok, 2 error" in shown and SECRET not in shown + written(tmp_path / "out")


def test_broken_wrapped_records_are_left_out_by_the_command_line(spark, tmp_path, capsys):
    mapping = {"structure": {"unwrap": {"field": "w"}}, "champs_sensibles": {"w.nom": {"type": "nom", "jeton": "NOM"}}}
    (tmp_path / "in.json").write_text(json.dumps([{"w": '{"nom": "Anna"}'}, {"w": '{"nom": "%s", broken' % SECRET}, {"w": None}]))
    (tmp_path / "m.json").write_text(json.dumps(mapping))
    assert main([f"{tmp_path}/in.json", "--pseudo", "--mapping", f"{tmp_path}/m.json", "--output", f"{tmp_path}/out.json"]) == 0
    assert "errors: 1" in capsys.readouterr().out
    assert json.loads((tmp_path / "out.json").read_text()) == [{"w": '{"nom":"[NOM_1]"}'}, {"w": None}] and SECRET not in written(tmp_path)


def test_restore_at_any_depth(spark, tmp_path):
    record = {"person": {"name": "[NOM_1]", "notes": ["see [NOM_1]!", "[NOM_2]", None], "deep": [{"m": [["[EMAIL_1]"]]}]}, "w": json.dumps({"k": "[NOM_1]", "l": ["[NOM_2]"]}), "n": 5, "plain": "[no json [NOM_2] [NOM_9]", "gone": None}
    back = {"person": {"name": 'Zo"é\\', "notes": ['see Zo"é\\!', "Bob", None], "deep": [{"m": [["a@b.c"]]}]}, "w": {"k": 'Zo"é\\', "l": ["Bob"]}, "n": 5, "plain": "[no json Bob [NOM_9]", "gone": None}
    (tmp_path / "r.json").write_text(json.dumps([record]))
    (tmp_path / "v.csv").write_text('type;jeton;valeur_originale\nnom;[NOM_1];"Zo""é\\"\nnom;[NOM_2];Bob\nemail;[EMAIL_1];a@b.c\nnom;[NOM_3];\n')
    assert main([f"{tmp_path}/r.json", "--restore", f"{tmp_path}/v.csv", "--output", f"{tmp_path}/back.json"]) == 0
    (got,) = json.loads((tmp_path / "back.json").read_text())
    got["w"] = json.loads(got["w"])
    assert got == back
    maps = spark.createDataFrame([(1, {"a": "[NOM_2]", "[NOM_2]": None})], "_rid long, m map<string,string>")
    known = spark.createDataFrame([("nom", "[NOM_2]", "Bob")], "type string, jeton string, valeur_originale string")
    assert vault.restore(maps, None, known, "_rid").first().m == {"a": "Bob", "[NOM_2]": None}


def test_dry_run_previews_and_chunks_are_written(spark, tmp_path, capsys):
    (tmp_path / "in.json").write_text(json.dumps([{"nom": f"Name {i}"} for i in range(25)]))
    (tmp_path / "m.json").write_text(json.dumps(MAPPING))
    args = [f"{tmp_path}/in.json", "--mapping", f"{tmp_path}/m.json", "--output", f"{tmp_path}/out.json"]
    assert main([*args, "--dry-run"]) == 0 and "[NOM_3]" in capsys.readouterr().out and not (tmp_path / "out.json").exists()
    assert main([*args, "--pseudo", "--chunk-size", "10"]) == 0
    parts = [p.read_text().splitlines() for p in (tmp_path / "out.json").glob("part-*")]
    assert max(map(len, parts)) <= 10 and sorted(json.loads(x)["nom"] for p in parts for x in p) == sorted(f"[NOM_{i}]" for i in range(1, 26))
