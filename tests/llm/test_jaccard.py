"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from cloakwork.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed, n=260):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rnd.choices(words, k=60))
    texts = [None, "", " \t ", "One", "one ", "one two three four", "ONE two  three\nfour", "one two three four five", "é " * 9, "x" * 9000]
    base = " ".join(rnd.choices(words, k=150))
    while len(texts) < n:
        kind = rnd.random()
        if kind < 0.25:  # a group of near copies
            text = base.split()
            for _ in range(rnd.randint(0, 4)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            texts.append(" ".join(text))
        elif kind < 0.5:  # a passage that many texts share
            texts.append(" ".join([*rnd.choices(words, k=rnd.randint(0, 40)), passage, *rnd.choices(words, k=rnd.randint(0, 30))]))
        elif kind < 0.8:  # a copy of an earlier text with a few edits
            text = (rnd.choice(texts) or "").split()
            for _ in range(rnd.randint(0, 1 + len(text) // 40)):
                if text:
                    text[rnd.randrange(len(text))] = rnd.choice(words)
            texts.append(" ".join(text))
        else:
            texts.append(" ".join(rnd.choices(words, k=rnd.choice([3, 6, 9, 30, 200, 900]))))
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "few"), [(1, (12, 24)), (2, (2, 2)), (3, (1, 3)), (4, (3, 1))])
def test_near_duplicates(spark, monkeypatch, seed, few):
    monkeypatch.setattr(jaccard, "FEW", few[0])
    monkeypatch.setattr(jaccard, "FEW_SECOND", few[1])
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, cls string, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_nothing_and_no_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    assert jaccard.near_duplicates(df.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.near_duplicates(df).collect()) == [(0, 0), (1, 1), (1, 1)]


def test_pigeonhole_bounds():
    """Any two sets similar enough share a segment of the first index, or all but one element of one of the second."""
    rng = np.random.default_rng(5)
    schemes = jaccard.Schemes()
    for size in [*range(1, 60), 100, 333, 1000]:
        for _ in range(20):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            drop = rng.integers(0, size // 5 + 1)
            add = rng.integers(0, size // 5 + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both):
                continue
            first = [{x for _, s, _ in jaccard.first_index(v, schemes) for x in s.tolist()} for v in (a, b)]
            spare = [min(m for _, _, m in jaccard.first_index(v, schemes)) for v in (a, b)]
            assert first[0] & first[1] or max(spare) < 0
            (wa, da), (wb, db) = ([{x for p in jaccard.second_index(v, schemes) for x in p[k].tolist()} for k in (0, 1)] for v in (a, b))
            assert wa & wb or wa & db or da & wb


def test_runs_in_any_batches():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 500))
    members = rng.integers(0, 60, 500) * 2
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    for few in (2, 8, 1000):
        want = {(int(a), int(b)) for k in np.unique(keys) for run in [np.unique(members[keys == k])] if len(run) <= few for a in run for b in run if a < b}
        for step in (7, 64, 500):
            runs = jaccard._Runs(few, False)
            out = [runs.take(keys[i : i + step], members[i : i + step]) for i in range(0, 500, step)]
            out.append(runs.take(keys[:0], members[:0], last=True))
            got = {(r["a"], r["b"]) for b in out for r in b.to_pylist() if r["kind"] == 0}
            assert got == want
            costly = {(r["a"], r["b"]) for b in out for r in b.to_pylist() if r["kind"] == 1}
            assert costly == {(int(m), int(k)) for k in np.unique(keys) for run in [np.unique(members[keys == k])] if len(run) > few for m in run}


def test_texts_are_dealt_once_for_the_exact_comparison(spark, monkeypatch):
    plans = []
    taken = jaccard.arrow_map

    def arrow_map(df, function, schema):
        if df.columns == ["a", "b", "x", "y"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return taken(df, function, schema)

    monkeypatch.setattr(jaccard, "arrow_map", arrow_map)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = " ".join(f"w{k}" for k in range(60))
        rows = [(3, text), (1, text + " more"), (2, "other words of a text")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        facts = [(r.doc_id, v) for r in docs.collect() for v in jaccard.shingle_sets([r.text])]
        made = [(jaccard._class_id(len(v), v)[2], i, len(v), np.minimum(np.diff(jaccard._parts(v, 64)), 65_535).astype("<u2").tobytes()) for i, v in facts]
        classes = spark.createDataFrame(made, "cls long, rep long, n long, buckets binary")
        of = {i: c for c, i, _, _ in made}
        pairs = spark.createDataFrame([(of[3], of[1]), (of[2], of[1])], "a long, b long")
        assert [tuple(r) for r in jaccard._similar(pairs, classes, docs).collect()] == [(of[3], of[1])]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [p.count("SortMergeJoin") for p in plans] == [1]


def test_parities_tell_a_least_difference():
    """Never more than the sets differ in; and enough to rule out large sets that share half, which 64 counts can't."""
    for size, drop, add in [(1, 0, 0), (1, 1, 1), (5, 2, 3), (63, 0, 4), (64, 1, 0), (65, 9, 2), (1000, 30, 160), (3000, 400, 0)]:
        a, b = (np.sort(jaccard.mix(np.arange(*x, dtype=np.uint64))) for x in ((0, size), (drop, size + add)))
        assert jaccard.least_difference(jaccard.parities(a), jaccard.parities(b)) <= len(np.setxor1d(a, b))
    a, b = (np.sort(jaccard.mix(np.arange(*x, dtype=np.uint64))) for x in ((0, 3000), (1000, 4000)))
    most = 6000 * 20 // 180
    counts = [np.diff(jaccard._parts(x, 64)) for x in (a, b)]
    assert np.abs(counts[0] - counts[1]).sum() <= most < jaccard.least_difference(jaccard.parities(a), jaccard.parities(b))


def test_texts_of_pairs_that_parities_rule_out_are_not_dealt(spark, monkeypatch):
    dealt = []
    sides = jaccard._sides
    monkeypatch.setattr(jaccard, "_sides", lambda pairs, *more: sides(dealt.append(pairs.count()) or pairs, *more))
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join([*base[:2000], *(f"x{rnd.random()}" for _ in range(1000))])) for k in range(4)]
    rows.append((9, rows[0][1] + " more"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert sum(dealt) == 1


def test_few_pairs_are_not_dealt_for_their_bounds(spark, monkeypatch):
    plans, taken = [], jaccard.arrow_map

    def arrow_map(df, function, schema):
        if "p" in df.columns:
            plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return taken(df, function, schema)

    monkeypatch.setattr(jaccard, "arrow_map", arrow_map)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus(5, 60)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        expected = brute(rows)
        for few in (20_000, 0):
            monkeypatch.setattr(jaccard, "BROADCAST_PAIRS", few)
            monkeypatch.setattr(jaccard, "BROADCAST_IDS", few)
            plans.clear()
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
            assert got == expected
            joins = {len(columns): plan.count("SortMergeJoin") for columns, plan in plans}
            assert joins == ({6: 0, 5: 1} if few else {6: 2, 5: 4})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_without_links_groups_stay_as_they_are(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    assert jaccard._merged(groups, spark.createDataFrame([], "a long, b long")) is groups


def test_few_signatures_a_set():
    """With bands twice as wide as similar sets can differ, a set has half a signature an element."""
    schemes = jaccard.Schemes()
    sizes = [int(40 * 1.1**k) for k in range(40)]
    made = sum(len(s) / n for n in sizes for _, s, _ in jaccard.first_index(np.sort(jaccard.mix(np.arange(n, dtype=np.uint64))), schemes))
    assert made < 0.55 * len(sizes)
