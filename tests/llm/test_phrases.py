"""Phrase collocations against plain counting."""

import re
from collections import Counter, defaultdict

import pytest

from cloakwork.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def brute(rows, least=30, per_lang=2000, longest=4):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for at in range(len(p) - size + 1):
                    inside[p[at : at + size]] = max(inside[p[at : at + size]], a)
        scored = []
        for p, a in candidates.items():
            score, cut = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if 100 * inside[p] < 80 * a:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:per_lang], 1)]
    return sorted(out)


ROWS = (
    [(i, "The quick Brown fox, jumps over\tthe  lazy dog. The quick brown fox", "en", "x", 1) for i in range(40)]
    + [(i, "the quick red fox\nthe quick\x0bred hen; the the the the the", None, "x", 1) for i in range(31)]
    + [(i, "à la carte à la maison É à la", "fr" if i % 2 else "und", "x", 1) for i in range(70)]
    + [(1, None, "en", "x", 1), (2, "", "en", "x", 1), (3, " .,;! \n", None, None, None), (None, "one two " * 3000, "en", "x", 1), (4, "z" * 50000, "de", "x", 1)]
)


@pytest.mark.parametrize("held", [(500_000, 4_000_000), (1, 1), (500_000, 1)])
def test_equals_plain_counting_on_every_path(spark, held):
    got = phrases.collocations(spark.createDataFrame(ROWS, SCHEMA), held_words=held[0], held_phrases=held[1])
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(ROWS) != []


def test_first_of_each_language_and_ties(spark):
    got = phrases.collocations(spark.createDataFrame(ROWS * 2, SCHEMA), per_lang=2)
    assert sorted(map(tuple, got.collect())) == brute(ROWS * 2, per_lang=2)


def test_nothing_is_frequent_or_there_is_nothing(spark):
    assert phrases.collocations(spark.createDataFrame(ROWS[:5], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
