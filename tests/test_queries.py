"""Registered queries over nested and written records, against what they are made of."""

import json

import pytest
from pyspark.sql import functions as F

from cloakwork.plans import queries
from cloakwork.plans.analyse import analyse, wrapped_texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.range(1, 41).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), "id").alias("c_name"), F.lit("AUTO").alias("c_mktsegment")).write.parquet(f"{path}/customer.parquet")
    spark.range(5000).select(F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.lit("click").alias("event_type"), F.lit('{"k": 1}').alias("props")).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_nested_round_trip(spark, folder):
    rows = queries.nested_roundtrip(spark, folder).collect()
    assert sorted((r.row, r.name, r.said, r.to, r.cc) for r in rows) == [(i, f"Customer#{i}", f"mail client{i}@example.com|-|auto", f"client{i}@example.com", f"cc client{i}@example.com") for i in range(1, 41)]
    assert {r.name for r in queries.nested_tokens(spark, folder).collect()} == {f"[NOM_{i}]" for i in range(1, 41)}


def test_arrays_and_broken_lines(spark, folder):
    rows = queries.json_arrays(spark, folder).collect()
    assert len(rows) == 5000 and {r.odd for r in rows} == {'}{"click\\"[ {"k": 1}'}
    assert {r.event_type: r.n for r in queries.json_errors(spark, folder).collect()} == {"click": 4500, "(broken)": 500}


def test_wrapped_texts_of_any_shape(spark):
    shapes = [
        ({"a": {"b": "x@y.fr", "c": ["p@q.fr", {"d": "r@s.fr", "n": 5}], "_e": "no@no.fr"}}, "x@y.fr\np@q.fr\nr@s.fr"),
        ({"t": "a \"quoted\" é\n@", "z": None, "f": 1.5}, 'a "quoted" é\n@'),
        ({"k": {"l": {"m": {"n": {"o": "deep"}}}}}, '{"o":"deep"}'),
        ({"numbers": [1, 2, 3]}, ""),
    ]
    texts = [json.dumps(x) for x, _ in shapes] + ["{broken and long enough", "plain text of a record", None, "", "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.w for r in df.select("i", wrapped_texts(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [w for _, w in shapes] + texts[4:]


def test_analysis_finds_wrapped_records_by_itself(spark):
    rows = [json.dumps({"a": {"b": "x@y.fr"}, "c": ["p@q.fr"]}), json.dumps({"a": {"b": "r@s.fr", "d": {"e": "4111 1111 1111 1111"}}}), json.dumps({"a": {"b": "none"}})]
    df = spark.createDataFrame([(w,) for w in rows], "w string")
    one = sorted((r.direct, r.finance, r.score, r.level) for r in analyse(df, None).collect())
    assert one == sorted((r.direct, r.finance, r.score, r.level) for r in analyse(df, None, unwrap=("w",)).collect()) == [(0, 0, 0, "NUL"), (1, 1, 8, "FAIBLE"), (2, 0, 6, "FAIBLE")]
    mixed = spark.createDataFrame([(rows[0],), ("mail z@y.fr",), (None,), (json.dumps({"a": "q@y.fr, t@y.fr"}),)], "w string")
    assert sorted(r.direct for r in analyse(mixed, None).collect()) == [0, 1, 2, 2]


def test_detectors_flag_what_is_added_and_nothing_else(spark, tmp_path):
    n = len(queries.ADDED)
    spark.range(n * 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Un texte, sans (rien) de 12 mots.").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: {k for k in queries.FLAGS if r[k]} for r in queries.detector_flags(spark, str(tmp_path)).collect()}
    assert rows[0] == set() and rows[1] == {"tel_txt"}  # no number begins with 00 or lacks digits
    assert [rows[i] for i in (3, 4, 7, 9, 11, 12, 13, 14, n - 1)] == [{"iban_txt", "tel_txt"}, set(), {"jwt_txt"}, {"ipv6_txt"}, {"gps_txt"}, set(), {"plaque_txt"}, set(), set()]
    assert set().union(*rows.values()) == set(queries.FLAGS)


def test_small_inputs_are_spread_and_large_ones_are_not(spark):
    from cloakwork.plans import tables

    df = spark.range(10).coalesce(1)
    assert tables.spread(df).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    before, tables.SPREAD_BYTES = tables.SPREAD_BYTES, 1
    try:
        assert tables.spread(df) is df
    finally:
        tables.SPREAD_BYTES = before


def test_tokens_from_a_bucketed_vault(spark):
    from cloakwork.operators import vault

    known = spark.range(500).select(F.lit("nom").alias("type"), F.concat(F.lit("k"), "id").alias("key"), F.concat(F.lit("[NOM_"), "id", F.lit("]")).alias("token"), F.col("id").cast("string").alias("value"))
    known = known.unionByName(spark.createDataFrame([("tel", "k3", "[TEL_1]", "x")], known.schema))
    vault.save(known, "vault_of_tests", 8)
    # One key in nine of ten rows, keys that the vault lacks, nulls and blanks.
    rows = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, " K3 ").when(F.col("id") % 100 == 0, None).when(F.col("id") % 100 == 50, " ").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("v"))
    got = {r.id: r.token for r in vault.with_tokens(rows, "v", "nom", "vault_of_tests").collect()}
    want = {i: "[NOM_3]" if i % 10 else None if i % 100 in (0, 50) or i >= 500 else f"[NOM_{i}]" for i in range(5000)}
    assert got == want
    plan = vault.meeting(rows.select(F.col("v").alias("key")), "nom", "vault_of_tests")._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("FileScan") - 400 : plan.index("FileScan")]
    assert "SelectedBucketsCount: 8 out of 8" in plan and "Exchange" not in side[side.rindex("Sort [") :]
    spark.sql("DROP TABLE vault_of_tests")


def test_own_stages_stand_where_they_are_put(spark):
    from cloakwork.operators import detect as D

    own = D.Stage("code", r"\bX-\d{4}\b", "code", "CODE", "direct")
    late = D.Stage("late", r"\bX-\d{2}\b|\[CODE_\d+\]", "late", "LATE", None, guard=False)
    options = D.register_stage(D.register_stage(D.register_stage(D.Options(), own, "url_txt"), late, "url_txt"), D.Stage("first", "www", "first", "FIRST"))
    names = [s.name for s in D.stages(options)]
    assert names[:4] == ["first", "url_txt", "code", "late"] and names.index("late") < names.index("nir_txt")
    df = spark.createDataFrame([("voir www.x.fr X-1234 et X-12, tel 06 12 34 56 78",), (None,)], "t string")
    row = D.detect(df, "t", options, out="shown").where("t is not null").first()
    assert [d.type for d in row.found] == ["first", "code", "late", "late", "tel_txt"]
    with pytest.raises(ValueError, match="no stage nothing"):
        D.stages(D.register_stage(D.Options(), own, "nothing"))


def test_sql_functions_equal_the_columns(spark):
    from cloakwork.functions import sql, text

    sql.register(spark)
    values = ["4111 1111 1111 1111", "4111-1111-1111-1112", "732829320", "  Zoé ÇA ", "", None, "Mme Anne DUPONT, 12", "2 90 03 75 123 456 78", "2 90 13 75 123 456 78", "abc"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    pairs = {"cloak_key": text.typed_key, "cloak_fold": text.fold, "cloak_digits": text.digits, "cloak_is_card": text.card_number, "cloak_is_company": text.company_number}
    got = df.select(*(F.expr(f"{name}(v)").alias(f"s{i}") for i, name in enumerate(pairs)), *(f(F.col("v")).alias(f"c{i}") for i, f in enumerate(pairs.values()))).collect()
    for r in got:
        assert [r[f"s{i}"] for i in range(len(pairs))] == [r[f"c{i}"] for i in range(len(pairs))]
    assert [r.x for r in df.selectExpr("cloak_is_social(v) AS x").collect()][7:9] == [True, False]
    assert [r.x for r in df.selectExpr("cloak_person(v) AS x").collect()][6] == "anne dupont"
