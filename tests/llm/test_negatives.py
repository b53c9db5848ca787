"""Hard negatives against a comparison of every anchor with every row."""

import math

import numpy as np
from pyspark.sql import functions as F

from cloakwork.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, tree string"


def brute(rows, k=5, m=3, low=50, high=95):
    known = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in q) < 2**62:
            known.append((vec_id, q, label))
    out = []
    for i, (a, q, label) in enumerate(known):
        if a % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(q, r, strict=True)), vec_id, other == label) for j, (vec_id, r, other) in enumerate(known) if j != i and len(r) == len(q)]
        for s, p, own in [x for x in sorted(scores) if x[2]][:k]:
            fit = [x for x in sorted(scores) if not x[2] and low * -s <= 100 * -x[0] <= high * -s][:m]
            out += [(a, p, rank, x[1], -s, -x[0]) for rank, x in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.expr("vec_id % 50 = 0"), **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def test_equals_brute_force_with_hot_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 12))
    rows = []
    for i in range(900):
        v = centres[i % 6] + 0.6 * rng.standard_normal(12)
        rows.append((i, v.tolist(), int(rng.integers(4)) if i % 3 else 0, "x", "y"))  # label 0 holds more than a third
    rows += [(2000 + i, rows[50][1], i % 2, None, None) for i in range(300)]  # copies of an anchor, of two labels
    rows += [(100, rows[100][1], 0, "x", "y"), (7, None, 1, "x", "y"), (8, [math.nan] * 12, 1, "x", "y"), (9, [None] * 12, 1, "x", "y"), (10, [math.inf] * 12, 1, "x", "y"),
             (11, rows[3][1], None, "x", "y"), (None, rows[4][1], 1, "x", "y"), (12, [3e30] * 12, 1, "x", "y"), (5000, [1.0, 2.0], 1, "x", "y"), (5001, [1.0, 2.5], 1, "x", "y"),
             (5002, [1.0, 1.5], 2, "x", "y"), (5050, [0.0] * 12, 1, "x", "y"), (5100, [], 1, "x", "y"), (5101, [], 1, "x", "y"), (5102, [], 2, "x", "y")]
    expected = brute(rows)
    assert len(expected) > 100
    assert mined(spark, rows, tree=64, cell=1500, asked=5) == expected
    assert mined(spark, rows) == expected


def test_large_components_stay_exact(spark):
    rows = [(50 * i, [1e6 + i, -2e6 + 3 * i, 1e5 * i], i % 2, "x", "y") for i in range(40)]
    assert mined(spark, rows) == brute(rows) != []


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_descents_pass_over_what_the_radii_rule_out():
    """Well separated groups: the radii keep a descent from most points, and what it finds is the best."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    x = np.floor(256 * (np.repeat(rng.standard_normal((20, 16)) * 4, 100, axis=0) + 0.05 * rng.standard_normal((2000, 16)))).astype(np.int64)
    order, parent, level, reach = negatives.cover(x)
    f = x[order].astype(float)
    extra = np.sqrt((f**2).sum(axis=1).max() - (f**2).sum(axis=1))
    f = np.concatenate([f, extra[:, None]], axis=1)
    for i in range(1, len(order)):
        assert level[parent[i]] > level[i] or level[i] == negatives._BOTTOM
        d = np.linalg.norm(f[i] - f[parent[i]])
        assert d <= reach[i] + 1e-6 and (level[i] == negatives._BOTTOM or d <= 2.0 ** (int(level[i]) + 1) + 1e-6)
    table = pa.table({"label": ["a"] * 2000, "rid": order, "vec_id": order, "q": [v.tobytes() for v in x[order]], "place": np.arange(2000), "parent": parent, "level": level, "reach": reach})
    tree = negatives.Tree(table, 16)
    verified = 0
    for a in range(0, 2000, 100):
        best = negatives.Best([(negatives._LEAST, negatives._MOST)], 5)
        verified += negatives.descend(tree, a, x[a], best)
        scores = x @ x[a]
        assert best.held[0] == sorted((-int(s), i) for i, s in enumerate(scores) if i != a)[:5]
    assert verified < 20 * 2000 / 3
