"""The vault of a stream: runs, merges, look-ups and batches that run again."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import vault
from cloakwork.plans.mapping import Mapping
from cloakwork.streaming.incremental import protect_stream
from cloakwork.streaming.ledger import Ledger, runs


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_runs_cover_all_batches_and_are_few(fan):
    for n in range(300):
        found = runs(n, fan)
        covered = [b for level, start in found for b in range(start, start + fan**level)]
        assert covered == list(range(n))
        assert all(sum(level == k for level, _ in found) < fan for k in range(10))
    assert len(runs(100)) == 6 + 4


def test_batches_go_on_numbering_and_look_up_their_own_keys(spark, tmp_path):
    rng, out = random.Random(1), str(tmp_path / "out")
    want: dict[tuple, int] = {}
    counts = {"a": 0, "b": 0}
    for number in range(9):
        rows = [(kind, f"k{rng.randrange(40)}", i) for i, kind in enumerate(rng.choices("ab", k=8))] if number != 4 else []
        occurrences = spark.createDataFrame(rows, "type string, key string, place long").select("type", "key", F.upper("key").alias("value"), F.upper("type").alias("prefix"), F.struct("place").alias("pos"))
        for kind, key, _ in rows:
            if (kind, key) not in want:
                counts[kind] += 1
                want[kind, key] = counts[kind]
        for again in range(2 if number == 5 else 1):
            ledger = Ledger(spark, out, number, fan=3)
            table = vault.build(occurrences, ledger)
            got = {(r.type, r.key): (r.n, r.token, r.value) for r in table.collect()}
            assert got == {(t, k): (want[t, k], f"[{t.upper()}_{want[t, k]}]", k.upper()) for t, k, _ in rows}, again
            ledger.add(table.join(ledger.last(), "type", "left").where("n > coalesce(last, 0)"))
    every = Ledger(spark, out, 9, fan=3)
    assert {(r.type, r.key): r.n for r in every.entries().collect()} == want and runs(9, 3) == [(2, 0)]
    # A look-up of one key reads its bucket only.
    one = every.lookup(spark.createDataFrame([next(iter(want))], "type string, key string"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and re.search(r"PartitionFilters: \[[^\]]*bucket#\d+", plan)


def test_streams_refuse_scopes(spark, tmp_path):
    source = spark.readStream.schema("n string").json(str(tmp_path))
    with pytest.raises(ValueError, match="one vault"):
        protect_stream(source, Mapping(), f"{tmp_path}/out", f"{tmp_path}/check", scope="n")
