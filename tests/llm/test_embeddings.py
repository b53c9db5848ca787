"""Embedding near-duplicates against brute force, and components against union-find."""

import numpy as np
import pytest

from cloakwork.llm import embeddings
from cloakwork.llm.components import connected_components


def brute(rows, threshold=0.98):
    parent = {i: i for i, *_ in rows}
    links = {i: 0 for i, *_ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    units = {}
    for i, v, label in rows:
        if v is not None and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            v = np.array(v, float) / np.abs(v).max()
            units[i] = v / np.linalg.norm(v), label
    for i, (a, x) in units.items():
        for j, (b, y) in units.items():
            if j < i and x == y and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (links[i], root(i), root(i) == i) for i in parent}


def corpus(seed, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.standard_normal((6, 32))
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            v = centres[rng.integers(0, 6)] + rng.standard_normal(32) * 0.13
        elif kind < 0.7 and rows:
            v = np.array(rows[rng.integers(0, len(rows))][1]) * rng.choice([1.0, 2.5])
        else:
            v = rng.standard_normal(32)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    odd = [None, [], [0.0] * 32, [None, *rows[0][1][1:]], [float("nan"), *rows[0][1][1:]], [float("inf")] * 32, rows[0][1][:31], [1e-30 * x for x in rows[0][1]], [1e30 * x for x in rows[0][1]]]
    rows += [(n + k, v, rows[0][2]) for k, v in enumerate(odd)]
    rows += [(n + 50 + k, rows[0][1], None) for k in range(2)]
    return rows


@pytest.mark.parametrize(("seed", "block", "neighbours"), [(1, 512, 10), (2, 7, 3)])
def test_near_duplicates(spark, monkeypatch, seed, block, neighbours):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, unit string").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, neighbours=neighbours).collect()}
    assert got == brute(rows)


def test_stars_and_a_hot_label(spark):
    """Members near their original but not near each other, in a label of most rows: windows alone miss many."""
    rng = np.random.default_rng(5)
    rows = []
    for size in (600, 150):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        rows.append(centre)
        for _ in range(size):
            off = rng.standard_normal(64)
            off -= off @ centre * centre
            rows.append(0.985 * centre + np.sqrt(1 - 0.985**2) * off / np.linalg.norm(off))
    rows += list(rng.standard_normal((250, 64)))
    rows = [(i, v.tolist(), int(i % 7 == 0 and i > 760)) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert got[0][0] == 600 and got[601][0] == 150


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(df).count() == 0


def test_connected_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(-400, 400, (350, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "x long, y long").repartition(3)
    assert {r.id: r.component for r in connected_components(df).collect()} == {x: root(x) for x in linked}
    assert connected_components(df.limit(0)).count() == 0
