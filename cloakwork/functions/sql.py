"""The scalar functions as temporary SQL functions, for queries in SQL: no Python runs in them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import LETTER

#: name -> (parameters, type, body). Bodies may call the functions above them.
FUNCTIONS = {
    "cloak_trim": ("v STRING", "STRING", r"regexp_replace(v, r'(?U)^\s+|\s+$', '')"),
    "cloak_key": ("v STRING", "STRING", "lower(cloak_trim(v))"),
    "cloak_fold": ("v STRING", "STRING", "translate(upper(v), 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ', 'AAAAAACEEEEIIIINOOOOOUUUUYY')"),
    "cloak_digits": ("v STRING", "STRING", "regexp_replace(v, '[^0-9]', '')"),
    "cloak_luhn": (
        "v STRING", "BOOLEAN",
        "CASE WHEN v RLIKE '^[0-9]+$' THEN aggregate(sequence(1, length(v)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr(reverse(v), i, 1)) ELSE 2 * int(substr(reverse(v), i, 1)) - CASE WHEN int(substr(reverse(v), i, 1)) > 4 THEN 9 ELSE 0 END END) % 10 = 0 WHEN v IS NOT NULL THEN false END",
    ),
    "cloak_is_card": ("v STRING", "BOOLEAN", "length(cloak_digits(v)) >= 9 AND length(cloak_digits(v)) NOT IN (9, 14) AND cloak_luhn(cloak_digits(v))"),
    "cloak_is_company": ("v STRING", "BOOLEAN", "length(cloak_digits(v)) IN (9, 14) AND cloak_luhn(cloak_digits(v))"),
    "cloak_is_social": ("v STRING", "BOOLEAN", r"length(regexp_replace(v, r'(?U)[\s.\-]', '')) IN (13, 15) AND try_cast(substr(regexp_replace(v, r'(?U)[\s.\-]', ''), 4, 2) AS INT) BETWEEN 1 AND 12"),
    "cloak_person": (
        "v STRING", "STRING",
        rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(cloak_trim(v), r'(?iU)\[PERSONNE_\d+\]|\b(?:m\.|mme\.?|mlle\.?|monsieur|madame)\b', ''), r'[^{LETTER}'' -]+', ' '), r'\s+', ' ')))".replace("r'[^" + LETTER + "'' -]+'", "\"[^" + LETTER + "' -]+\""),
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, under their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
