"""Benchmark decontamination against edit distances of all windows and regions."""

import random
import re

import numpy as np

from cloakwork.llm import decontaminate as D


def distance(pattern, text):
    """The least edits that turn some region of the text into the pattern."""
    before = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[j - 1] + 1))
        before = now
    return min(before)


def edited(rnd, text, most):
    out = list(text)
    for _ in range(rnd.randint(0, most)):
        k, kind = rnd.randrange(len(out)), rnd.random()
        if kind < 0.4:
            out[k] = rnd.choice("abcdeth ")
        elif kind < 0.7:
            del out[k]
        else:
            out.insert(k, rnd.choice("xyz th"))
    return "".join(out)


def D_letters(text):
    return [c for c in text.lower() if c.isalnum()]


def words(rnd, n):
    return " ".join("".join(rnd.choices("abcdefghilmnoprstu", k=rnd.randint(2, 8))) for _ in range(n))


def test_against_all_regions():
    rnd = random.Random(4)
    items = [(i, words(rnd, rnd.choice([3, 6, 12, 30])) + ".") for i in range(30)]
    index = D.Index(items, 40, 0.1, 5, 12)
    texts, held = [None, "", "é" * 30, " ".join(t for _, t in items[:2])], 0
    texts += [words(rnd, rnd.randint(0, 20)) + " " + edited(rnd, rnd.choice(items)[1], 9).upper() + " " + words(rnd, rnd.randint(0, 20)) for _ in range(60)]
    for text, found in zip(texts, D.find(index, texts), strict=True):
        own = D.normal(text or "")[0].tolist()
        want = {index.item[w] for w in range(len(index.length)) if distance(index.codes[w][: index.length[w]].tolist(), own) <= index.budget[w]}
        short = {i for i, t in items if 0 < len(D.normal(t)[0]) < 12 and re.search(rf"(?<![^\W_]){r'[\W_]*'.join(map(re.escape, D_letters(t)))}(?![^\W_])", (text or "").lower())}
        assert found.keys() == want | short
        held += len(want)
        for windows, edits, start, end in found.values():
            assert windows and edits >= 0 and 0 <= start < end <= len(text)
    assert held > 30


def test_short_items():
    index = D.Index([(1, "Is it 42?"), (2, "天地玄黄"), (3, "!"), (4, "is it"), (5, "IS-IT 42"), (6, None)], 80, 0.1, 8, 24)
    texts = ["so is it, 42. Is it 42", "this it 42", "is it 421", "宇宙天地玄黄洪荒", "is", None, "x is\nit"]
    got = [{k: (len(w), e, a, b) for k, (w, e, a, b) in x.items()} for x in D.find(index, texts)]
    assert got == [{1: (1, 0, 3, 22), 4: (1, 0, 3, 19), 5: (1, 0, 3, 22)}, {}, {4: (1, 0, 0, 5)}, {2: (1, 0, 2, 6)}, {}, {}, {4: (1, 0, 2, 7)}]


def test_slices_do_not_matter(monkeypatch):
    rnd = random.Random(5)
    items = [(i, words(rnd, 20)) for i in range(5)]
    texts = [" ".join(words(rnd, 40) if k % 3 else items[k % 5][1] for k in range(12)) for _ in range(6)]
    index = D.Index(items, 80, 0.1, 8, 24)
    want = D.find(index, texts)
    monkeypatch.setattr(D, "_SLICE", 300)
    assert D.find(index, texts) == want


def test_hashes_tell_grams_apart():
    codes = np.random.default_rng(1).integers(97, 100, 3000).astype(np.uint32)
    for q in (1, 2, 5, 8):
        grams = [tuple(codes[i : i + q]) for i in range(len(codes) - q + 1)]
        hashes = D.gram_hashes(codes, q).tolist()
        assert len(set(grams)) == len(set(hashes)) == len(set(zip(grams, hashes, strict=True)))


def test_rows(spark):
    rnd = random.Random(6)
    items = [(i, words(rnd, 25)) for i in range(6)] + [(7, None), (8, ""), (9, "short one")]
    docs = [(1, words(rnd, 80)), (2, words(rnd, 9) + " " + items[0][1] + ". " + items[3][1].upper()), (3, None), (None, items[1][1]), (4, ""), (4, items[2][1]), (4, items[2][1]), (5, "short one")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, start int").repartition(3)
    benchmark = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    for block_chars in (100, 10**6):
        got = sorted((r.doc_id or 0, r.item_id) for r in D.matches(df, benchmark, block_chars=block_chars).collect())
        assert got == [(0, 1), (2, 0), (2, 3), (4, 2), (4, 2), (5, 9)]
        kept = D.clean(df, benchmark, block_chars=block_chars)
        assert kept.columns == df.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted((d, t or "") for d, t in (docs[0], docs[2], docs[4]))
    assert D.matches(df, benchmark.limit(0)).count() == 0 and D.clean(df, benchmark.limit(0)).count() == len(docs)
    assert D.matches(df.limit(0), benchmark).count() == 0


def test_repetitive_texts_need_bounded_memory():
    """A long text of one letter, two or a phrase, against items of the same: what is held doesn't grow with the text."""
    import tracemalloc

    items = [(1, "a" * 100), (2, "ab" * 60), (3, "the same words " * 12)]
    index = D.Index(items, D.WINDOW, D.RATE, D.Q, D.LEAST)
    for item, text in ((1, "a" * 300_000), (2, "ab" * 40_000), (3, "the same words " * 5_000)):
        tracemalloc.start()
        found = D.find(index, [text, "nothing of this kind"])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert item in found[0] and not found[1] and found[0][item][1] == 0
        assert found[0][item][2] == 0 and found[0][item][3] >= len(text) - 20
        assert peak < 400_000_000


def test_small_runs_of_pairs_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    items = [(i, "".join(rng.choice(list("abc "), 130))) for i in range(12)] + [(90, "x" * 90), (91, "xy" * 50)]
    index = D.Index(items, D.WINDOW, D.RATE, D.Q, D.LEAST)
    texts = ["".join(rng.choice(list("abc "), 300)) + items[i % 14][1] + "".join(rng.choice(list("abc "), 200)) for i in range(30)] + ["x" * 3000, "xy" * 900]
    want = D.find(index, texts)
    for size in (50, 777, 1 << 14):
        monkeypatch.setattr(D, "_ENTRIES", size)
        assert D.find(index, texts) == want
    assert all(items[i % 14][0] in found for i, found in enumerate(want[:30]))


def test_a_batch_of_texts_needs_bounded_memory():
    """What a worker holds grows with what it searches at once, not with the batch: all workers of an executor search at a time."""
    import tracemalloc

    rnd = random.Random(7)
    items = [(i, words(rnd, 30)) for i in range(40)] + [(90, "the short one")]
    index = D.Index(items, D.WINDOW, D.RATE, D.Q, D.LEAST)
    some = [words(rnd, 60) for _ in range(300)]
    texts = [" ".join(rnd.choices(some, k=5)) + " " + items[i % 41][1] for i in range(600)]
    assert sum(map(len, texts)) > 1_000_000
    D.fold_table()
    tracemalloc.start()
    found = D.find(index, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(items[i % 41][0] in x for i, x in enumerate(found))
    assert peak < 40_000_000


def test_short_items_are_found_across_slices(monkeypatch):
    index = D.Index([(1, "is it 42"), (2, "no")], D.WINDOW, D.RATE, D.Q, D.LEAST)
    texts = ["so is it 42 and is it 42, no, " * 9, "", "no"]
    want = D.find(index, texts)
    assert [sorted(x) for x in want] == [[1, 2], [], [2]] and want[0][1][2:] == (3, 264)
    for size in (1, 3, 7, 50):
        monkeypatch.setattr(D, "_SLICE", size)
        assert D.find(index, texts) == want
