"""Whole runs over small records, with the outcomes that are published for them."""

import json

import pytest

from cloakwork.functions.wordlists import Dictionaries
from cloakwork.operators import vault
from cloakwork.plans.engine import protect_texts, run
from cloakwork.plans.mapping import Mapping

#: Records, and outcomes below (texts, counts, scores), that are published for them.
FLAT = [
    (1, "Marie", "Dupont", "marie.dupont@example.fr", "06 12 34 56 78", "75015", "Bonjour Marie, votre commande chez ORANGE est en cours. Contactez-nous au 01 23 45 67 89."),
    (2, "Pierre", "Martin", "pierre.martin@example.fr", "0698765432", "69001", "M. Martin a signale un probleme avec la Societe Generale SA. Son IBAN FR76 1234 5678 9012 3456 7890 123 a ete debite a tort."),
    (3, "Lea", "Petit", "lea.petit@example.fr", "+33 6 11 22 33 44", "33000", "Lea Petit habite au 12 rue Victor Hugo a Bordeaux. Elle est nee le 15/03/1990. Numero de secu : 2 90 03 75 123 456 78."),
    (4, "Ali", "Ben Ahmed", "ali.benahmed@example.fr", "07 99 88 77 66", "13001", "Ali Ben Ahmed a contacte l'ecole Victor Hugo pour inscrire son fils. Son email est ali [at] example [dot] com."),
    (5, "Eva", "Blanc", "eva.blanc@example.fr", "", "59000", "Eva Blanc a achete une pierre decorative chez AMAZON pour 25 euros. Reference commande n 12345. La Direction regionale a ete informee."),
]
COLUMNS = "id long, prenom string, nom string, email string, telephone string, code_postal string, commentaire string"
MAPPING = Mapping.from_json(
    {
        "champs_sensibles": {k: {"type": t, "jeton": p} for k, t, p in [("nom", "nom", "NOM"), ("prenom", "prenom", "PRENOM"), ("email", "email", "EMAIL"), ("telephone", "tel", "TEL"), ("code_postal", "cp", "CP"), ("id", "id", "ID")]},
        "texte_libre": ["commentaire"],
        "lookup_noms": {"prenom": "prenom", "nom": "nom"},
        "whitelist": ["ORANGE", "SFR", "FREE", "AMAZON"],
    }
)


@pytest.fixture(scope="module")
def flat(spark):
    return spark.createDataFrame(FLAT, COLUMNS).coalesce(1)


def comments(result):
    return [r.commentaire for r in result.records.orderBy("_rid").collect()]


def test_flat_pseudo(flat):
    result = run(flat, MAPPING)
    assert comments(result) == [
        "Bonjour [PERSONNE_1], votre commande chez ORANGE est en cours. Contactez-nous au [TEL_1].",
        "M. [PERSONNE_2] a signale un probleme avec la [ORGANISATION_1]. Son IBAN [IBAN_1] a ete debite a tort.",
        "[PERSONNE_3] habite au [VOIE_1][VILLE_1]. Elle est nee le 15/03/1990. Numero de secu : [NIR_1].",
        "[PERSONNE_4] a contacte l'ecole Victor Hugo pour inscrire son fils. Son email est ali [at] example [dot] com.",
        "[PERSONNE_5] a achete une pierre decorative chez AMAZON pour 25 euros. Reference commande n 12345. La Direction regionale a ete informee.",
    ]
    rows = [tuple(r)[1:7] for r in result.records.orderBy("_rid").collect()]
    assert rows == [tuple(f"[{p}_{n}]" if n < 5 or p != "TEL" else "" for p in ("ID", "PRENOM", "NOM", "EMAIL", "TEL", "CP")) for n in range(1, 6)]
    stats = {r.stat: r.n for r in result.stats().collect()}
    assert stats == {
        "nom": 5, "prenom": 5, "email": 5, "tel": 4, "cp": 5, "id": 5, "lookup_prenom": 1, "lookup_nom": 4, "tel_txt": 1, "iban_txt": 1, "orga_txt": 1,
        "nir_txt": 1, "ville_txt": 1, "voie_txt": 1, "total": 40,
    }
    report = result.report().first()
    assert (report.score, report.level) == (16, "MODÉRÉ")
    rows = [tuple(r) for r in vault.exported(result.vault).collect()]
    assert rows == sorted(rows, key=lambda r: r[:2]) and len(rows) == 40
    assert ("iban_txt", "[IBAN_1]", "FR76 1234 5678 9012 3456 7890 123") in rows and ("voie_txt", "[VOIE_1]", "12 rue Victor Hugo a") in rows
    assert ("personne", "[PERSONNE_4]", "Ali Ben Ahmed") in rows


def test_flat_anon(flat):
    result = run(flat, MAPPING, "anon")
    assert result.vault is None
    first = result.records.orderBy("_rid").first()
    assert tuple(first)[1:7] == ("1", "***", "***", "anonyme@example.com", "00 00 00 00 00", "00000")
    assert comments(result)[0] == "Bonjour [SUPPRIMÉ], votre commande chez ORANGE est en cours. Contactez-nous au [TEL_1]."
    assert {r.stat: r.n for r in result.stats().collect()}["total"] == 40
    assert result.report().first().score == 16


def test_flat_strong(flat):
    result = run(flat, MAPPING, strong=True, dictionaries=Dictionaries(given_names=["ali"]))
    stats = {r.stat: r.n for r in result.stats().collect()}
    assert (stats["total"], stats["prenom_nom"], stats["prenom_isole_min"], stats["cp_txt"]) == (43, 1, 1, 1)
    report = result.report().first()
    assert report.score == 22
    texts = comments(result)
    assert texts[3] == "[PERSONNE_4] a contacte l'ecole [PERSONNE_5] pour inscrire son fils. Son email est [PERSONNE_6] [at] example [dot] com."
    assert "commande n [CP_1]" in texts[4]
    listed = flat.sparkSession.createDataFrame([("ali",)], "name string")
    again = run(flat, MAPPING, strong=True, dictionaries=Dictionaries(given_names=listed))
    assert comments(again) == texts


def test_text(spark):
    df = spark.createDataFrame([("Bonjour Marie, votre email est marie@test.com et votre numero 06 12 34 56 78. IBAN FR76 3000 6000 0112 3456 7890 189.",)], "texte string")
    result = protect_texts(df, "texte")
    assert result.records.first().texte == "Bonjour [PERSONNE_1], votre email est [EMAIL_1] et votre numero [TEL_1]. IBAN [IBAN_1]."
    assert result.report().first().score == 14 and result.stats().where("stat = 'total'").first().n == 4


def test_nested(spark):
    reports = [
        {"Report": {"Id": "a-1", "Firstname": "Marie", "Email": "m@x.fr", "Phone": None, "Details": [{"Label": "l", "Value": "Appeler Marie au 0612345678"}, {"Label": "k", "Value": "rien"}], "Question": "Marie attend"}},
        {"Report": {"Id": "a-2", "Firstname": "Paul", "Email": "m@x.fr", "Phone": "0102030405", "Details": [], "Question": ""}},
    ]
    rows = [(7, json.dumps(r)) for r in reports] + [(8, None), (9, "{broken")]
    mapping = Mapping.from_json(
        {
            "structure": {"unwrap": {"field": "wrapped"}},
            "champs_sensibles": {"ident": {"type": "id", "jeton": "ID"}, "Report.Id": {"type": "uuid", "jeton": "UUID"}, "Report.Email": {"type": "email", "jeton": "EMAIL"}, "Report.Phone": {"type": "tel", "jeton": "TEL"}},
            "texte_libre": ["Report.Question", "Report.Details[].Value"],
            "lookup_noms": {"prenom": "Report.Firstname"},
        }
    )
    df = spark.createDataFrame(rows, "ident long, wrapped string").coalesce(1)
    result = run(df, mapping)
    got = [(r.ident, r.wrapped) for r in result.records.orderBy("_rid").collect()]
    assert [g[0] for g in got] == ["[ID_1]", "[ID_1]", "[ID_2]", "[ID_3]"]
    first, second = json.loads(got[0][1])["Report"], json.loads(got[1][1])["Report"]
    assert first["Question"] == "[PERSONNE_1] attend" and first["Details"][0]["Value"] == "Appeler [PERSONNE_1] au [TEL_1]" and first["Details"][1]["Value"] == "rien"
    assert (first["Email"], second["Email"], second["Phone"], second["Id"]) == ("[EMAIL_1]", "[EMAIL_1]", "[TEL_1]", "[UUID_2]")
    assert got[2][1] is None and got[3][1] == "{broken"
    assert run(df, mapping, on_error="drop").records.count() == 3


def test_restore(flat):
    result = run(flat, MAPPING)
    back = vault.restore(result.records, ["nom", "email", "commentaire"], vault.exported(result.vault), "_rid").orderBy("_rid").collect()
    assert [r.email for r in back] == [r[3] for r in FLAT]
    assert back[3].commentaire == FLAT[3][6]


def test_scopes_and_known(spark):
    df = spark.createDataFrame([("a", "x@y.fr"), ("b", "z@y.fr"), ("a", "z@y.fr"), ("b", "z@y.fr")], "file string, mail string").coalesce(1)
    mapping = Mapping.from_json({"champs_sensibles": {"mail": {"type": "email", "jeton": "EMAIL"}}})
    assert [r.mail for r in run(df, mapping, scope="file").records.orderBy("_rid").collect()] == ["[EMAIL_1]", "[EMAIL_1]", "[EMAIL_2]", "[EMAIL_1]"]
    first = run(df.limit(1), mapping)
    second = run(df, mapping, known=first.vault)
    assert [r.mail for r in second.records.orderBy("_rid").collect()] == ["[EMAIL_1]", "[EMAIL_2]", "[EMAIL_2]", "[EMAIL_2]"]
