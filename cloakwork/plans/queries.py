"""Queries over the given tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import infer, scoring, vault
from .analyse import analyse, preview, summary
from .engine import protect_texts, run, score_texts
from .mapping import Mapping
from .tables import new_path, spread

EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
CARD = r"\b(?:\d[\s-]*?){13,19}\b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def found(spark: SparkSession, sf_dir: str, *names: str, tech: bool = True) -> DataFrame:
    """Detections of single detectors over all documents, one row each."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    detected = D.detect(docs, "text", D.Options(tech=tech, names=names), out="shown")
    return detected.select("doc_id", "lang", "source", F.explode("found").alias("d")).select("doc_id", "lang", "source", "d.*")


def per_document(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return found(spark, sf_dir, name).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("value").alias("first_value"))

    return query


def per_document_sql(pattern: str, valid: str = "true") -> str:
    return f"SELECT doc_id, count(*) AS n, min(trim(v, E' \\t\\n\\r')) AS first_value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS v FROM documents) WHERE {valid} GROUP BY doc_id"


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
LUHN = (
    f"length({_DIGITS}) NOT IN (9, 14) AND list_sum([CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) ELSE 2 * CAST(substr(reverse({_DIGITS}), i, 1) AS INT) "
    f"- CASE WHEN CAST(substr(reverse({_DIGITS}), i, 1) AS INT) > 4 THEN 9 ELSE 0 END END FOR i IN range(1, length({_DIGITS}) + 1)]) % 10 = 0"
)


def det_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    detected = D.detect(pages, "url", D.Options(names=("url_txt",)), out="shown")
    return detected.select("page_id", F.size("found").cast("long").alias("n"), F.col("found")[0]["value"].alias("value"))


def _isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of three detectors over each text as it was given, in one scan."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    names = ("email_txt", "cb_txt", "ipv4_txt")
    for name in names:
        docs = D.detect(docs, "text", D.Options(tech=True, names=(name,)), out="shown", found=name).drop("shown")
    return docs.select("doc_id", "lang", "source", F.concat(*names).alias("found"))


def doc_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(_isolated(spark, sf_dir)).select("doc_id", "direct", "finance", "tech", "score", "level")


_RISK = f"""
SELECT doc_id, lang, source, CAST(direct AS BIGINT) AS direct, CAST(finance AS BIGINT) AS finance, CAST(tech AS BIGINT) AS tech, CAST(5 * finance + 3 * direct + 2 * tech AS BIGINT) AS score FROM (
  SELECT doc_id, lang, source, len(regexp_extract_all(text, '{EMAIL}')) AS direct, len(regexp_extract_all(text, '{IPV4}')) AS tech,
    len(list_filter(regexp_extract_all(text, '{CARD}'), lambda v: {LUHN})) AS finance FROM documents)
"""
_LEVEL = "CASE WHEN {0} < 1 THEN 'NUL' WHEN {0} < 10 THEN 'FAIBLE' WHEN {0} < 50 THEN 'MODÉRÉ' WHEN {0} < 100 THEN 'ÉLEVÉ' ELSE 'CRITIQUE' END"


def risk_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch totals: each source and all of them."""
    rows = scoring.scored(_isolated(spark, sf_dir))
    return rows.rollup("source").agg(F.count("*").alias("records"), F.sum(F.size("found")).cast("long").alias("replacements"), F.sum("score").alias("score")).withColumn("source", F.coalesce("source", F.lit("(all)")))


def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.replacements(_isolated(spark, sf_dir).select(F.explode("found").alias("d")).select("d.stat"))


def samples_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.samples(found(spark, sf_dir, "ipv4_txt"), ["doc_id", "place"]).select("stat", "rank", "original")


def email_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", D._replaced(F.col("text"), f"(?U){EMAIL}", lambda m: F.lit("<EMAIL>")).alias("text"))


def has_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, "ville_txt").select("doc_id").distinct()


def upper_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words in capitals found most in documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    detected = D.detect(docs, "text", D.Options(strong=True, names=("capitals",)), out="shown")
    return scoring.top_words(detected.select(F.explode("found").alias("d")).select("d.*"))


CUSTOMER = Mapping.from_json({"champs_sensibles": {"c_name": {"type": "nom", "jeton": "NOM"}, "c_custkey": {"type": "id", "jeton": "ID"}, "c_mktsegment": {"type": "segment", "jeton": "SEG"}}})


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("_rid", F.col("c_custkey"))


def tok_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(_customer(spark, sf_dir), CUSTOMER).records.select(F.col("_rid").alias("row"), "c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal")


_VAULT = """
WITH f AS (
  SELECT 'nom' AS type, lower(trim(c_name)) AS key, c_name AS v, c_custkey AS rid, 'NOM' AS p FROM customer UNION ALL
  SELECT 'id', CAST(c_custkey AS VARCHAR), CAST(c_custkey AS VARCHAR), c_custkey, 'ID' FROM customer UNION ALL
  SELECT 'segment', lower(trim(c_mktsegment)), c_mktsegment, c_custkey, 'SEG' FROM customer
), g AS (SELECT type, key, min(rid) AS rid, arg_min(trim(v), rid) AS v, min(p) AS p FROM f WHERE key <> '' GROUP BY type, key),
vault AS (SELECT type, key, '[' || p || '_' || row_number() OVER (PARTITION BY type ORDER BY rid) || ']' AS jeton, v AS valeur_originale FROM g)
"""


def anon_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(_customer(spark, sf_dir), CUSTOMER, "anon").records.select(F.col("_rid").alias("row"), "c_custkey", "c_name", "c_mktsegment", "c_nationkey")


def _vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.exported(run(_customer(spark, sf_dir), CUSTOMER).vault)


def vault_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vault(spark, sf_dir)


def vault_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.search(_vault(spark, sf_dir), "UIL")


def vault_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.page(_vault(spark, sf_dir), 2)


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = run(_customer(spark, sf_dir), CUSTOMER)
    back = vault.restore(done.records, ["c_custkey", "c_name", "c_mktsegment"], vault.exported(done.vault), "_rid")
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


EVENTS = Mapping.from_json({"champs_sensibles": {"props.k": {"type": "k", "jeton": "K"}}, "structure": {"unwrap": {"field": "props"}}})


def unwrap_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .engine import json_schema

    events = table(spark, sf_dir, "events")
    inner = F.from_json("props", json_schema(events, "props"))
    return events.select("event_id", inner["k"].cast("long").alias("k"))


def rewrap_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values inside wrapped JSON become tokens; read back from the JSON that is written."""
    events = table(spark, sf_dir, "events").withColumn("_rid", F.col("event_id"))
    return run(events, EVENTS).records.select(F.col("_rid").alias("event_id"), F.get_json_object("props", "$.k").alias("k"))


def preview_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _customer(spark, sf_dir)
    return preview(before, run(before, CUSTOMER, limit=10).records, ["c_name", "c_nationkey"])


def infer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").orderBy("doc_id")
    return infer.as_rows(docs, infer.infer_mapping(docs))


def analyse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return summary(analyse(docs, None, D.Options(names=("email_txt",))))


def protect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All standard and technical stages over all documents, with numbered tokens."""
    docs = table(spark, sf_dir, "documents").withColumn("_rid", F.col("doc_id")).select("_rid", "text")
    done = protect_texts(docs, "text", D.Options(tech=True))
    return done.records.join(done.scores.select("_rid", "score", "level"), "_rid").select(F.col("_rid").alias("doc_id"), "text", "score", "level")


def score_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "conversations"), "text", D.Options(tech=True)).select("conv_id", "turn", "direct", "finance", "tech", "indirect", "score", "level")


#: Sentences made of each customer's key, as SQL that Spark and the oracle both read.
_TWO, _THREE, _FOUR = (lambda x, n=n: f"lpad(({x}) || '', {n}, '0')" for n in (2, 3, 4))
_K = "c_custkey"
SENTENCES = {
    "tel_txt": f"'appelez le 0' || ({_K} % 10) || ' ' || {_TWO(f'{_K} % 97')} || ' 45.67 ' || {_TWO(f'{_K} % 89')} || ' fin'",
    "nir_txt": f"'secu ' || (1 + {_K} % 2) || ' ' || {_TWO(f'{_K} % 100')} || ' ' || {_TWO(f'{_K} % 16')} || ' 78 ' || {_THREE(f'{_K} % 1000')} || ' ' || {_THREE(f'{_K} % 997')} || ' fin'",
    "iban_txt": f"'compte FR' || {_TWO(f'{_K} % 97')} || CASE WHEN {_K} % 7 = 0 THEN ' 30-0 6000 ' ELSE ' 3000 6000 ' END || {_FOUR(f'{_K} % 9999')} || ' 3456 7890 189 fin'",
    "siret_txt": f"'siret ' || lpad((({_K} * 104729) % 1000000000) || '', 9, '0') || lpad(({_K} % 99991) || '', 5, '0') || ' ou ' || lpad((({_K} * 7919) % 1000000000) || '', 9, '0') || ' fin'",
    "cvv_txt": f"CASE {_K} % 5 WHEN 0 THEN 'cvv: ' WHEN 1 THEN 'CVC ' WHEN 2 THEN 'Cryptogramme - ' WHEN 3 THEN 'cv2=' ELSE 'cv3 ' END || {_THREE(f'{_K} % 1000')} || ' fin'",
    "mac_txt": f"'carte ' || {_TWO(f'{_K} % 100')} || CASE WHEN {_K} % 3 = 0 THEN '-' ELSE ':' END || 'aB:0' || ({_K} % 10) || ':CC:DD' || CASE WHEN {_K} % 4 = 0 THEN '' ELSE ':e1' END || ' fin'",
    "plaque_txt": f"'auto ' || CASE {_K} % 3 WHEN 0 THEN 'AB-' || {_THREE(f'{_K} % 1000')} || '-CD' WHEN 1 THEN ({_K} % 10000) || ' XYZ ' || {_TWO(f'{_K} % 96')} ELSE 'ab-' || {_THREE(f'{_K} % 1000')} || '-cd' END || ' fin'",
    "gps_txt": f"'en ' || ({_K} % 100) || '.5' || ({_K} % 10) || ', ' || (({_K} * 7) % 200) || '.25 fin'",
    "apikey_txt": f"'cle ' || CASE {_K} % 3 WHEN 0 THEN 'sk_' WHEN 1 THEN 'api_' ELSE 'ak_' END || substr('abcdefghijklmnopqrstuvwxyz', 1, CAST(8 + {_K} % 12 AS INT)) || lpad({_K} || '', 6, '0') || ' fin'",
}


def made(name: str):
    """One detector over a sentence for each customer."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(SENTENCES[name]).alias("text"))
        detected = D.detect(rows, "text", D.Options(tech=True, names=(name,)), out="shown")
        return detected.select("c_custkey", F.explode("found").alias("d")).select("c_custkey", F.col("d.type").alias("type"), F.col("d.value").alias("value"), F.col("d.risk").alias("risk"))

    return query


def made_sql(name: str, pattern: str, risk: str, valid: str = "true", kind: str | None = None) -> str:
    found = f"SELECT c_custkey, unnest(regexp_extract_all({SENTENCES[name]}, '{pattern}')) AS v FROM customer"
    return f"SELECT c_custkey, {kind or f"'{name}'"} AS type, trim(v) AS value, '{risk}' AS risk FROM ({found}) WHERE {valid}"


def analyse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of all documents by all standard and technical detectors."""
    return summary(analyse(table(spark, sf_dir, "documents").select("text"), None, D.Options(tech=True)))


NESTED = Mapping.from_json({"champs_sensibles": {"person.name": {"type": "nom", "jeton": "NOM"}}, "texte_libre": ["person.notes[].said", "wrapped"]})


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a record with lists and wrapped JSON, that holds its name and an address."""
    mail = F.concat(F.lit("client"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    notes = F.array(F.struct(F.concat(F.lit("mail "), mail).alias("said")), F.struct(F.lit(None).cast("string").alias("said")), F.struct(F.lower("c_mktsegment").alias("said")))
    wrapped = F.to_json(F.struct(mail.alias("to"), F.array(F.concat(F.lit("cc "), mail)).alias("cc")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_rid"), F.struct(F.col("c_name").alias("name"), notes.alias("notes")).alias("person"), wrapped.alias("wrapped"))


def nested_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in structs, lists and wrapped JSON."""
    done = run(_nested(spark, sf_dir), NESTED).records
    return done.select(F.col("_rid").alias("row"), F.col("person.name").alias("name"), F.col("person.notes")[0]["said"].alias("said"), F.get_json_object("wrapped", "$.cc[0]").alias("cc"))


def nested_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records whole again, from their protected form and the vault."""
    done = run(_nested(spark, sf_dir), NESTED)
    back = vault.restore(done.records, None, vault.exported(done.vault), "_rid")
    return back.select(F.col("_rid").alias("row"), F.col("person.name").alias("name"), F.array_join(F.col("person.notes")["said"], "|", "-").alias("said"), F.get_json_object("wrapped", "$.to").alias("to"), F.get_json_object("wrapped", "$.cc[0]").alias("cc"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions, called from SQL."""
    from ..functions import sql

    sql.register(spark)
    table(spark, sf_dir, "customer").createOrReplaceTempView("cloak_customer")
    number = "lpad(c_custkey * 104729 || '', 9 + 7 * (c_custkey % 2), '4')"
    return spark.sql(
        f"SELECT c_custkey, cloak_key('  ' || c_name || ' ') AS key, cloak_fold('é' || c_mktsegment || 'ç') AS folded, cloak_digits(c_name) AS digits, cloak_luhn({number}) AS luhn, "
        f"cloak_is_card({number}) AS card, cloak_is_company('n° ' || {number}) AS company, cloak_person('Mme ' || c_mktsegment || ' 12') AS person FROM cloak_customer"
    )


#: Numbers of suppliers in the form of the caller's own stage.
SUPPLIER = D.Stage("supplier_txt", r"Supplier#\d{9}", "supplier_txt", "FOURNISSEUR", "direct")


def own_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage of the caller's own between two built-in ones: links are tokens when it looks, numbers of companies not yet."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_rid"), F.concat(F.lit("voir https://example.com/"), "s_name", F.lit(" de "), "s_name").alias("text"))
    done = protect_texts(rows, "text", D.register_stage(D.Options(), SUPPLIER, "url_txt"))
    return done.records.select(F.col("_rid").alias("row"), "text")


def vault_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the tokens of their customers, from a vault that is kept in buckets; one customer stands in a third of the rows."""
    from uuid import uuid4

    done = run(_customer(spark, sf_dir).select("_rid", "c_name"), Mapping(CUSTOMER.fields[:1]))
    name = f"vault_{uuid4().hex}"
    vault.save(done.vault, name, 16)
    customer = F.when(F.col("o_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" CUSTOMER#"), F.lpad(customer.cast("string"), 9, "0")).alias("name"))
    met = vault.with_tokens(orders, "name", "nom", name).select("o_orderkey", "token")
    spark.sql(f"DROP TABLE {name}")
    return met


#: What is added to the text of each document, in turn: things that detectors find, and things that only look alike.
ADDED = (
    "'tel 0' || (doc_id % 10) || ' ' || lpad((doc_id * 7919 % 100000000) || '', 8, '0') || '.'", "'TEL : ' || doc_id", "'0033 6 12.34-56_78 ' || lpad((doc_id % 100) || '', 2, '0')", "'IBAN fr' || lpad((doc_id % 100) || '', 2, '0') || ' 3000 6000 0112 3456 7890 189'",
    "'FR76 3000 600é 0112 3456'", "'CVV: ' || (doc_id % 2000)", "'cryptogramme ' || (100 + doc_id % 900) || 'x'", "'eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.SflKxwRJSMeKKF2QT4' || doc_id", "'api_' || repeat('k1', CAST(6 + doc_id % 9 AS INT))", "'fe80:0:0:0:200:f8ff:fe21:' || (doc_id % 10000)",
    "'00:1b-44:11:3a:' || lpad((doc_id % 100) || '', 2, '0')", "'48.8' || doc_id || ', 2.35'", "'148.85, 200.1'", "'AB-' || lpad((doc_id % 1000) || '', 3, '0') || '-CD'", "(doc_id % 10000) || ' ABC 75é'", "'12 rue Victor Hugo'", "'avenue du ' || doc_id", "'75' || lpad((doc_id % 10000) || '', 3, '0')",
    "'née le 0' || (doc_id % 10) || '/12/19' || (60 + doc_id % 40)", "'Mme Durand-' || doc_id", "'madame durand'", "'M. LEGRAND Paul'", "'www.example.org/' || doc_id", "'un texte sans rien'",
)
FLAGS = ("url_txt", "iban_txt", "cvv_txt", "jwt_txt", "apikey_txt", "ipv6_txt", "mac_txt", "gps_txt", "plaque_txt", "tel_txt", "date_naiss_txt", "voie_txt", "cp_txt", "titre")
_ADD = "CASE doc_id % {n} {whens} END".format(n=len(ADDED), whens=" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(ADDED)))


def detector_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which detectors find something in each document, each over the text as it was given; strong and technical ones too."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", F.expr(f"coalesce(text, '') || ' ' || {_ADD}").alias("text")))
    for name in FLAGS:
        rows = D.detect(rows, "text", D.Options(strong=True, tech=True, names=(name,)), out="shown", found=name).drop("shown")
    return rows.select("doc_id", *((F.size(name) > 0).alias(name) for name in FLAGS))


def flags_sql() -> str:
    """The same patterns with the edges of words spelt out, as DuckDB's know only ASCII words."""
    from ..functions.text import LETTER, LOWER, UPPER

    a, z = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
    streets = "rue|avenue|boulevard|chemin|impasse|allée|route"
    patterns = {
        "url_txt": rf"{a}(?:https?://|www\.)\S+",
        "iban_txt": rf"(?i){a}[A-Z]{{2}}\d{{2}}(?:[\s-]?[0-9A-Z]{{4}}){{4}}[\s-]?[0-9A-Z]{{0,4}}[\s-]?[0-9A-Z]{{0,3}}{z}",
        "cvv_txt": rf"(?i){a}(?:cvv|cvc|cryptogramme|cv2)[^\pL\pN_]+\d{{3,4}}{z}",
        "jwt_txt": rf"{a}(?:eyJ[a-zA-Z0-9_-]{{10,}}\.){{2}}[a-zA-Z0-9_-]{{9,}}[a-zA-Z0-9_]{z}",
        "apikey_txt": rf"{a}(?:sk|pk|api)_[a-zA-Z0-9]{{20,}}{z}",
        "ipv6_txt": r"(?:[a-fA-F0-9]{1,4}:){7}[a-fA-F0-9]{1,4}|(?:[a-fA-F0-9]{1,4}:){1,7}:|::(?:[a-fA-F0-9]{1,4}:){0,5}[a-fA-F0-9]{1,4}",
        "mac_txt": rf"{a}(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}{z}",
        "gps_txt": rf"{a}(?:[1-8]?\d\.\d+|90\.0+)[,\s]+-?(?:1[0-7]\d|[1-9]?\d)\.\d+{z}",
        "plaque_txt": rf"{a}(?:[A-Z]{{2}}[-\s]?\d{{3}}[-\s]?[A-Z]{{2}}|\d{{1,4}}[-\s]?[A-Z]{{2,3}}[-\s]?\d{{2}}){z}",
        "tel_txt": r"(?:^|[^0-9])(?:(?:\+|00)33|0)\s*[1-9](?:[\s._-]*\d){8}(?:$|[^0-9])|(?i:TEL)\s*:\s*[\d\s.-]+",
        "date_naiss_txt": rf"(?i){a}(?:né|née|naissance)(?:e|s)?\s+(?:le|du|au)?\s*:?\s*\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}{z}",
        "voie_txt": rf"(?i){a}(?:\d+\s+(?:{streets}|bis|ter)|(?:{streets}))\s+[{LETTER}''\s-]{{3,}}",
        "cp_txt": rf"{a}\d{{5}}{z}",
        "titre": rf"(?i){a}(?:M\.|Mme\.?|Mlle\.?|monsieur|madame|mademoiselle)\s*[{UPPER}](?:[{LOWER}]+|[{UPPER}]+)",
    }
    flags = ", ".join(f"regexp_matches(t, '{patterns[n]}') AS {n}" for n in FLAGS)
    return f"SELECT doc_id, {flags} FROM (SELECT doc_id, coalesce(text, '') || ' ' || {_ADD} AS t FROM documents)"


#: Records in an array of the files that ``json_arrays`` makes.
ARRAY = 2_000


def _arrays(spark: SparkSession, sf_dir: str) -> str:
    """A folder of files, each one array of events; braces, quotes and escapes stand in their texts."""
    odd = F.concat(F.lit('}{"'), F.col("event_type"), F.lit('\\"[ '), F.col("props"))
    record = F.to_json(F.struct("event_id", "user_id", odd.alias("odd"), F.array(F.struct("event_type")).alias("list")))
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / ARRAY).alias("of"), record.alias("j"))
    path = new_path(spark, "arrays")
    arrays = rows.groupBy("of").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), " ,\n"), F.lit("]")).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON arrays and read back by byte ranges."""
    from ..sources import json_records

    records, _ = json_records.read(spark, [_arrays(spark, sf_dir)])
    return records.select("event_id", "user_id", "odd", F.col("list")[0]["event_type"].alias("event_type"))


def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, each tenth cut short: what is read, and what is counted as broken."""
    from ..sources import json_records
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    path = new_path(spark, "lines")
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 7, F.left(line, F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    records, broken = json_records.read(spark, [path])
    kept = records.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))
    return kept.unionByName(broken.agg(F.lit("(broken)").alias("event_type"), F.count("*").alias("n"), F.lit(0).cast("long").alias("users")))


def analyse_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of documents wrapped in JSON of two shapes, which the analysis finds by itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    flat, deep = F.to_json(F.struct("text", "lang")), F.to_json(F.struct(F.struct(F.array(F.struct("text", F.lit(1).alias("n"))).alias("parts"), F.col("lang").alias("_hidden")).alias("body")))
    wrapped = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, flat).otherwise(deep).alias("w"))
    return analyse(wrapped, None, D.Options(names=("email_txt",))).select("doc_id", "direct", "score", "level")


QUERIES = {
    "det_email": per_document("email_txt"),
    "det_ipv4": per_document("ipv4_txt"),
    "det_card": per_document("cb_txt"),
} | {
    f.__name__: f
    for f in (
        det_url, doc_risk, risk_by_source, counts_by_type, samples_top5, email_rewrite, has_city, upper_words, tok_customer, anon_customer, vault_export, vault_search, vault_page,
        restore_roundtrip, unwrap_props, rewrap_props, preview_diff, infer_documents, analyse_documents, analyse_all, protect_documents, score_conversations,
        nested_tokens, nested_roundtrip, json_arrays, json_errors, analyse_wrapped, detector_flags, vault_tokens, sql_functions, own_stage,
    )
} | {f"made_{name}": made(name) for name in SENTENCES}


def _city_sql() -> str:
    from ..functions.text import alternation
    from ..functions.wordlists import Dictionaries

    words = alternation(Dictionaries().cities).replace("'", "''")
    return f"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(?:{words})([^\\pL\\pN_]|$)')"


def _upper_sql() -> str:
    """Words in capitals of five letters and more, not alone on a line and in no list. Marks between words are doubled, so each word has its own."""
    from ..functions.text import UPPER
    from ..functions.wordlists import CAPITALISED_STOPWORDS, INSTITUTIONS, KEPT_CAPITALS, LOWER_STOPWORDS, RESERVED

    def listed(words) -> str:
        return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"

    pattern = rf"(^|[^\pL\pN_])((?:[Ll]''|[Dd]'')?[{UPPER}]{{2,}}(?:-[{UPPER}]{{2,}})*)($|[^\pL\pN_])"
    edge = "('', chr(9), chr(10), chr(13))"
    return rf"""
WITH t AS (SELECT regexp_replace(text, '([^\pL\pN_''-])', '\1\1', 'g') AS t FROM documents),
m AS (SELECT unnest(regexp_extract_all(t, '{pattern}')) AS m FROM t),
w AS (SELECT regexp_extract(m, '{pattern}', 1) AS l, regexp_extract(m, '{pattern}', 2) AS v, regexp_extract(m, '{pattern}', 3) AS r FROM m)
SELECT upper(v) AS word, count(*) AS n, upper(v) IN {listed(CAPITALISED_STOPWORDS)} OR lower(upper(v)) IN {listed(LOWER_STOPWORDS)} AS stopword FROM w
WHERE length(v) >= 5 AND NOT (l IN {edge} AND r IN {edge}) AND v NOT IN {listed([*RESERVED, *KEPT_CAPITALS, *CAPITALISED_STOPWORDS])} AND lower(v) NOT IN {listed(INSTITUTIONS)}
GROUP BY upper(v) ORDER BY n DESC, word LIMIT 20
"""


def _functions_sql() -> str:
    number = "lpad(CAST(c_custkey * 104729 AS VARCHAR), CAST(9 + 7 * (c_custkey % 2) AS INT), '4')"
    luhn = LUHN.replace(f"length({_DIGITS}) NOT IN (9, 14) AND ", "")
    return (
        f"SELECT c_custkey, lower(c_name) AS key, 'E' || upper(c_mktsegment) || 'C' AS folded, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, {luhn} AS luhn, {luhn} AND length(v) <> 9 AS card, {luhn} AND length(v) = 9 AS company, "
        f"lower(c_mktsegment) AS person FROM (SELECT *, {number} AS v FROM customer)"
    )


ORACLES = {
    "det_email": per_document_sql(EMAIL),
    "det_ipv4": per_document_sql(IPV4),
    "det_card": per_document_sql(CARD, LUHN),
    "det_url": "SELECT page_id, CAST(len(regexp_extract_all(url, '\\b(?:https?://|www\\.)\\S+')) AS BIGINT) AS n, url AS value FROM pages",
    "doc_risk": f"SELECT doc_id, direct, finance, tech, score, {_LEVEL.format('score')} AS level FROM ({_RISK})",
    "risk_by_source": f"SELECT coalesce(source, '(all)') AS source, count(*) AS records, CAST(sum(direct + finance + tech) AS BIGINT) AS replacements, CAST(sum(score) AS BIGINT) AS score FROM ({_RISK}) GROUP BY ROLLUP (source)",
    "counts_by_type": f"SELECT stat, CAST(n AS BIGINT) AS n FROM (SELECT 'email_txt' AS stat, sum(direct) AS n FROM ({_RISK}) UNION ALL SELECT 'cb_txt', sum(finance) FROM ({_RISK}) UNION ALL SELECT 'ipv4_txt', sum(tech) FROM ({_RISK}) UNION ALL SELECT 'total', sum(direct + finance + tech) FROM ({_RISK})) WHERE n > 0",
    "samples_top5": f"SELECT 'ipv4_txt' AS stat, rank, v AS original FROM (SELECT v, row_number() OVER (ORDER BY doc_id, i) AS rank FROM (SELECT doc_id, unnest(list_zip(l, range(len(l))), recursive := true) FROM (SELECT doc_id, regexp_extract_all(text, '{IPV4}') AS l FROM documents)) AS t(doc_id, v, i)) WHERE rank <= 5",
    "email_rewrite": f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '<EMAIL>', 'g') AS text FROM documents",
    "has_city": _city_sql(),
    "tok_customer": _VAULT + "SELECT c_custkey AS row, i.jeton AS c_custkey, n.jeton AS c_name, s.jeton AS c_mktsegment, c_nationkey, c_acctbal FROM customer JOIN vault i ON i.type = 'id' AND i.key = CAST(c_custkey AS VARCHAR) JOIN vault n ON n.type = 'nom' AND n.key = lower(trim(c_name)) JOIN vault s ON s.type = 'segment' AND s.key = lower(trim(c_mktsegment))",
    "anon_customer": "SELECT c_custkey AS row, CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR) AS c_custkey, '***' AS c_name, '***' AS c_mktsegment, c_nationkey FROM customer",
    "vault_export": _VAULT + "SELECT type, jeton, valeur_originale FROM vault",
    "vault_search": _VAULT + "SELECT type, jeton, valeur_originale FROM vault WHERE lower(type) LIKE '%uil%' OR lower(jeton) LIKE '%uil%' OR lower(valeur_originale) LIKE '%uil%'",
    "vault_page": _VAULT + "SELECT type, jeton, valeur_originale FROM vault ORDER BY type, jeton, valeur_originale LIMIT 20 OFFSET 20",
    "restore_roundtrip": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "unwrap_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "rewrap_props": "WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events), v AS (SELECT k, '[K_' || row_number() OVER (ORDER BY min(event_id)) || ']' AS t FROM e WHERE k IS NOT NULL GROUP BY k) SELECT event_id, t AS k FROM e LEFT JOIN v USING (k)",
    "preview_diff": _VAULT + "SELECT _rid, field, before, after, before IS DISTINCT FROM after AS changed FROM (SELECT c_custkey AS _rid, 'c_name' AS field, c_name AS before, '[NOM_' || row_number() OVER (ORDER BY c_custkey) || ']' AS after FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR), CAST(c_nationkey AS VARCHAR) FROM customer) WHERE _rid IN (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 10)",
    "infer_documents": "SELECT 'doc_id' AS path, 'id' AS type, 'ID' AS prefix UNION ALL SELECT 'text', 'text', NULL WHERE (SELECT length(text) FROM documents ORDER BY doc_id LIMIT 1) > 80",
    "analyse_documents": f"SELECT count(*) AS n, CAST(round_even(avg(s), 0) AS BIGINT) AS mean, CAST(max(s) AS BIGINT) AS max, CASE WHEN round_even(avg(s), 0) < 1 THEN 'NUL' WHEN round_even(avg(s), 0) < 10 THEN 'FAIBLE' ELSE 'MODERE' END AS level FROM (SELECT 3 * len(regexp_extract_all(text, '{EMAIL}')) AS s FROM documents)",
}
_CLIENT = "'client' || c_custkey || '@example.com'"
ORACLES |= {
    "detector_flags": flags_sql(),
    "upper_words": _upper_sql(),
    "sql_functions": _functions_sql(),
    "own_stage": "WITH n AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) SELECT s_suppkey AS row, 'voir [URL_' || i || '] de [FOURNISSEUR_' || i || ']' AS text FROM n",
    "vault_tokens": _VAULT + "SELECT o_orderkey, jeton AS token FROM (SELECT o_orderkey, 'customer#' || lpad(CAST(CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS VARCHAR), 9, '0') AS k FROM orders) o LEFT JOIN vault v ON v.type = 'nom' AND v.key = o.k",
    "nested_tokens": "SELECT c_custkey AS row, '[NOM_' || row_number() OVER (ORDER BY c_custkey) || ']' AS name, 'mail [EMAIL_' || row_number() OVER (ORDER BY c_custkey) || ']' AS said, 'cc [EMAIL_' || row_number() OVER (ORDER BY c_custkey) || ']' AS cc FROM customer",
    "nested_roundtrip": f"SELECT c_custkey AS row, c_name AS name, 'mail ' || {_CLIENT} || '|-|' || lower(c_mktsegment) AS said, {_CLIENT} AS to, 'cc ' || {_CLIENT} AS cc FROM customer",
    "json_arrays": "SELECT event_id, user_id, '}{\"' || event_type || '\\\"[ ' || props AS odd, event_type FROM events",
    "json_errors": "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events WHERE event_id % 10 <> 7 GROUP BY event_type UNION ALL SELECT '(broken)', count(*), CAST(0 AS BIGINT) FROM events WHERE event_id % 10 = 7",
    "analyse_wrapped": f"SELECT doc_id, n AS direct, 3 * n AS score, {_LEVEL.format('3 * n')} AS level FROM (SELECT doc_id, len(regexp_extract_all(text, '{EMAIL}')) AS n FROM documents)",
}
#: Luhn over all digits of ``v``, for the 9 or 14 digits of a company number.
_COMPANY = LUHN.replace("NOT IN (9, 14)", "IN (9, 14)")
ORACLES |= {
    "made_tel_txt": made_sql("tel_txt", r"\b0[1-9](?:[\s._-]*\d){8}", "direct"),
    "made_nir_txt": made_sql("nir_txt", r"[12] \d{2} \d{2} \d{2} \d{3} \d{3}", "finance", "CAST(substr(v, 6, 2) AS INT) BETWEEN 1 AND 12"),
    "made_iban_txt": made_sql("iban_txt", r"FR\d{2}(?: \d{4}){4}(?: \d{1,4})?(?: \d{1,3})?", "finance"),
    "made_siret_txt": made_sql("siret_txt", r"\b\d{9}(?:\d{5})?\b", "finance", _COMPANY, "CASE WHEN length(v) = 14 THEN 'siret_txt' ELSE 'siren_txt' END"),
    "made_cvv_txt": made_sql("cvv_txt", r"(?i)(?:cvv|cvc|cryptogramme|cv2)[ :=-]+\d{3}", "finance"),
    "made_mac_txt": made_sql("mac_txt", r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}", "tech"),
    "made_plaque_txt": made_sql("plaque_txt", r"AB-\d{3}-CD|\b\d{1,4} XYZ \d{2}\b", "tech"),
    "made_gps_txt": made_sql("gps_txt", r"\b[1-8]?\d\.\d+, (?:1[0-7]\d|[1-9]?\d)\.\d+", "tech"),
    "made_apikey_txt": made_sql("apikey_txt", r"\b(?:sk|api)_[a-z0-9]{20,}", "tech"),
}
