"""Personal data: patterns against plain expressions, the field against all paths, held-out sentences, whole tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from cloakwork.llm import pii


def plain(text):
    """The four patterns by expressions over the whole text."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            if low <= len(digits) <= high and (kind == "phone" or sum(doubled) % 10 == 0):
                out.append((kind, *m.span()))
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return pii.field()


def test_patterns_equal_plain_expressions():
    rng = random.Random(4)
    texts = ["", "a@b.c_d@e.f", "a@b@c.d", "@x.y", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.255", "+1 (234) 555-0199)", "4111 1111 1111 1111 4111-1111-1111-1111", "é4111111111111111é", "a@b..c x@y.z.", "++12 345 678 9 +1", "1" * 4000 + ".1.1.1"]
    texts += ["".join(rng.choice("0123456789...  @@--++()abZ_%\né") for _ in range(rng.randrange(1, 80))) for _ in range(6000)]
    texts += ["".join(rng.choice(["4111111111111111", "5500 0000 0000 0004", "1.2.3.4", "+49 170 1234567", "a.b@c.de", " ", ".", "-", "@", "7", "x"]) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    for text in texts:
        assert sorted(pii.patterns(text)) == plain(text), text


def test_long_odd_texts_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "a@" * 150_000, "+1(" * 100_000, "+" + "1 " * 150_000, "a@b." * 80_000):
        pii.patterns(text)


def test_viterbi_equals_the_best_of_all_paths(field):
    decoder = pii.Decoder(field)
    for line in ("token = \"5d190bd7c06284de91015a36974748794293dd8a\"", "call (017) 555-7713", "x y z", "4111.1111 1111.1111", "jo (at) mail"):
        words = line.split()
        ids = [decoder.number(pii.shape(w, field.lexicon)) for w in words]
        rows = [field.row(None)] + [field.row(pii.shape(w, field.lexicon)) for w in words] + [field.row(None)]
        score = [rows[i][0] + rows[i - 1][1] + rows[i + 1][2] for i in range(1, len(words) + 1)]

        def total(path, score=score):
            return field.first[path[0]] + sum(s[x] for s, x in zip(score, path, strict=True)) + sum(field.steps[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product(range(len(pii.LABELS)), repeat=len(words)), key=total)
        assert decoder.lines([words], every=True).get(0, [0] * len(words)) == list(best), (line, ids)


def test_lines_passed_over_are_all_o(field):
    texts = [t for t, _ in pii.examples(700, seed=5)] + ["", "   ", "word " * 3000 + "(017) 555-7713"]
    lines = [t.split() for t in texts]
    assert pii.Decoder(field).lines(lines) == pii.Decoder(field).lines(lines, every=True)


def test_held_out_sentences(field):
    decoder = pii.Decoder(field)
    right = wrong = missed = 0
    for text, spans in pii.examples(800, seed=99):
        got = decoder.lines([text.split()]).get(0, [0] * len(text.split()))
        want = pii.labels_of(text, spans)
        right += sum(a == b != 0 for a, b in zip(got, want, strict=True))
        wrong += sum(a != b and a != 0 for a, b in zip(got, want, strict=True))
        missed += sum(a != b and b != 0 for a, b in zip(got, want, strict=True))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_table(spark, field):
    secret = "5d190bd7c06284de91015a36974748794293dd8a"
    rows = [
        (1, "mail a.b@c.de, ip 1.2.3.4, card 4111111111111111, call +1 (234) 555-0199.", "x", "y"),
        (2, f'héé token = "{secret}" and\ncall (234) 555-0199 .', "x", "y"),
        (3, "Plain words of a clean text, with 12 numbers and 2024.", None, None),
        (4, None, "x", "y"), (5, "", "x", "y"), (None, "a@b.c", "x", "y"), (1, "a@b.c", "x", "y"), (6, "lorem " * 200_000 + "z@y.xx", "x", "y"),
    ]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email string"), field)
    found = {(r.doc_id, r.n_email): r for r in got.collect()}
    assert got.count() == len(rows)
    assert found[1, 1].spans in ("email:5:13,ip:18:25,card:32:48,phone:55:72", "email:0:5")
    assert found[2, 0].spans == f"phone:{rows[1][1].index('(')}:{rows[1][1].index(' .', 60)},secret:13:53"
    assert [found[k, n].spans for k, n in ((3, 0), (4, 0), (5, 0))] == ["", "", ""]
    for r in got.collect():
        texts = [t or "" for i, t, *_ in rows if i == r.doc_id]
        bases = [plain(t) for t in texts]
        assert r.base_sha256 in [hashlib.sha256(pii.written(b).encode()).hexdigest() for b in bases]
    assert pii.find(spark.createDataFrame([], "doc_id long, text string"), field).collect() == []


def test_decoder_forgets_within_bounds(field, monkeypatch):
    monkeypatch.setattr(pii, "_WORDS", 50)
    decoder = pii.Decoder(field)
    texts = [t for t, _ in pii.examples(200, seed=6)]
    small = [pii.scan([t], decoder) for t in texts]
    monkeypatch.undo()
    assert small == [pii.scan([t], pii.Decoder(field)) for t in texts[:1]] + [pii.scan([t], decoder) for t in texts[1:]]
    assert np.isfinite(field.weights).all()
