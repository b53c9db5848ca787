"""Each detector with texts it finds and texts it leaves, and the scalar functions."""

import pytest
from pyspark.sql import functions as F

from cloakwork.functions import text as T
from cloakwork.functions.wordlists import Dictionaries
from cloakwork.operators import scoring
from cloakwork.operators.detect import Options, detect

#: text, names of what is found (in the order of the stages)
TECH = [
    ("Voir https://www.mabanque.fr/mon-compte", ["url_txt"]),
    ("Num 1234567890123 ok", ["fiscal_txt"]),
    ("commande 1234567890123", []),
    ("1234567890123 kg", []),
    ("Numero secu : 1 85 05 78 006 084 20", ["nir_txt"]),
    ("Numero 1 85 13 78 006 084 20", []),
    ("IBAN FR76 3000 6000 0112 3456 7890 189", ["iban_txt"]),
    ("carte 4111 1111 1111 1111 fin", ["cb_txt"]),
    ("carte 4111 1111 1111 1112 fin", []),
    ("cvv: 123", ["cvv_txt"]),
    ("siret 732 829 320 00074", ["siret_txt"]),
    ("siren 732 829 320", ["siren_txt"]),
    ("siren 732 829 321", []),
    ("mailto:a@b.fr", ["email_txt"]),
    ("ali (at) example (dot) com", ["email_txt"]),
    ("ali [at] example [dot] com", []),
    ("Email: test@example.fr, tel 06 12 34 56 78", ["email_txt", "tel_txt"]),
    ("eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4", ["jwt_txt"]),
    ("eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.abc", []),
    ("cle sk_abcdefghij0123456789XY", ["apikey_txt"]),
    ("cle sk_court", []),
    ("ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334 la", ["ipv6_txt"]),
    ("Interface reseau AA:BB:CC:DD:EE:FF active", ["mac_txt"]),
    ("Serveur sur 192.168.1.100 port 443", ["ipv4_txt"]),
    ("Version 999.168.1", []),
    ("GPS 48.8566, 2.3522", ["gps_txt"]),
    ("plaque AB-123-CD", ["plaque_txt"]),
    ("appelez 0033 6 12 34 56 78", ["tel_txt"]),
    ("TEL : 12 34", ["tel_txt"]),
    ("la Societe Generale SA gagne", ["orga_txt"]),
    ("la Clinique ferme", ["orga_txt"]),
    ("la clinique ferme", []),
    ("je vais a nîmes demain", ["ville_txt"]),
    ("nee le 15/03/1990", []),
    ("au 12 rue Victor Hugo", ["voie_txt"]),
    ("Bonjour Marie Curie et merci", ["salutation"]),
    ("Bonjour Merci", []),
    ("avec Mme Durand hier", ["titre"]),
    ("", []),
    (None, []),
    ("Elle a 12345 points", []),
]
STRONG = [
    ("née le 15/03/1990 ici", ["date_naiss_txt"]),
    ("rue Victor Hugo", ["voie_txt"]),
    ("lot 75001 ici", ["cp_txt"]),
    ("vu Jean DUPONT hier", ["prenom_nom_maj"]),
    ("vu Jean Dupont hier", ["prenom_nom"]),
    ("école Jean Dupont hier", []),
    ("Jean Dupont maternelle", []),
    ("Merci Dupont hier", []),
    ("Marie est absente", ["prenom_isole"]),
    ("avec zoé demain", ["prenom_isole_min"]),
    ("avec rose demain", []),
    ("vu BEN Ahmed hier", ["patronyme_prefixe"]),
    ("Le dossier DUPONT est classe", ["maj_long"]),
    ("Le dossier PETI est classe", ["maj_patronyme"]),
    ("Le dossier ABCD est classe", []),
    ("NOMS\tABCDE\n", []),
    ("la FRANCE gagne", []),
]


def stats(df, options):
    got = detect(df, "t", options, out="shown").select("i", "t", "shown", F.col("found.stat").alias("s")).orderBy("i").collect()
    return [r.s for r in got], [r.shown for r in got]


def test_standard_and_technical(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TECH)], "i int, t string").coalesce(2)
    found, shown = stats(df, Options(tech=True))
    assert list(zip([t for t, _ in TECH], found, strict=True)) == TECH
    assert all(s == t for (t, f), s in zip(TECH, shown, strict=True) if not f)


def test_strong(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STRONG)], "i int, t string").coalesce(2)
    words = Dictionaries(given_names=["Marie", "ZOE", "rose"], surnames=["PETI"])
    found, _ = stats(df, Options(strong=True, dictionaries=words))
    assert list(zip([t for t, _ in STRONG], found, strict=True)) == STRONG


def test_lists_and_neighbours(spark):
    df = spark.createDataFrame([(1, "Bonjour ORANGE et DUPONT"), (2, "Contacter Victor Hugo pour info"), (3, "avec M. DURAND MARTINEZ et Jean DUPONT Lerouge,DURAND")], "i int, t string")
    found, shown = stats(df, Options(strong=True, whitelist=("orange",), blacklist=("victor hugo",)))
    assert "orange" in shown[0] and found[0] == ["maj_long"] and found[1] == ["blacklist"]
    assert "] ," not in shown[2] and "DURAND" not in shown[2].split("]")[0]


def test_names_of_a_model(spark):
    rows = [(1, "vu Marie hier avec Jean Valjean et Paul", ["Marie", "Jean Valjean", "Jean", "Paul"]), (2, "école Jean Valjean", ["Jean Valjean"]), (3, "rien", []), (4, "rien", None)]
    df = spark.createDataFrame(rows, "i int, t string, people array<string>")
    found, shown = stats(df, Options(entities="people", dictionaries=Dictionaries(given_names=["Marie"])))
    assert found == [["nlp", "nlp"], [], [], []] and shown[0].endswith(" et Paul") and shown[1:] == [r[1] for r in rows[1:]]


def test_functions(spark):
    df = spark.createDataFrame([("Mme  Dupont Marie",), ("marie DUPONT",), ("M. Petit",), ("[PERSONNE_3] Zoé",), ("d'Arc Jeanne",), ("42",)], "v string")
    assert [r.k for r in df.select(T.person_key(F.col("v")).alias("k")).collect()] == ["dupont marie", "dupont marie", "m petit", "zoé", "d'arc jeanne", ""]
    row = df.limit(1).select(T.luhn(F.lit("4111111111111111")).alias("a"), T.luhn(F.lit("4111111111111112")).alias("b"), T.fold(F.lit("Zoé")).alias("c")).first()
    assert tuple(row) == (True, False, "ZOE")


@pytest.mark.parametrize(("score", "level"), [(0, "NUL"), (9, "FAIBLE"), (10, "MODÉRÉ"), (49, "MODÉRÉ"), (50, "ÉLEVÉ"), (99, "ÉLEVÉ"), (100, "CRITIQUE")])
def test_levels(spark, score, level):
    assert spark.range(1).select(scoring.level(F.lit(score))).first()[0] == level
