"""Language identification: its scoring against a plain one, odd texts, held-out accuracy."""

import math
import pickle
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cloakwork.llm import langid

EN = "the quick brown fox jumps over the lazy dog and then the dog sleeps in the warm sun of the garden".split()
DE = "der schnelle braune fuchs springt über den faulen hund und dann schläft der hund in der warmen sonne".split()


def corpus(n=120):
    rows = []
    for i in range(n):
        words = (EN, DE)[i % 2]
        rows.append((i, " ".join(words[(i * k) % len(words)] for k in range(1, 12)), ("en", "de")[i % 2]))
    odd = [None, "", " 12 .", "½ ²", "日本語", "zzzqqq", "DER Hund", "the", "x" * 5000]
    return rows + [(n + k, t, "en" if k % 3 else None) for k, t in enumerate(odd)]


def test_held_out_accuracy_and_odd_texts(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0.5, "src") for r in rows], "doc_id long, text string, lang string, score double, source string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if i < 120:
            assert got[i].lang_pred == lang
        assert 0 <= got[i].score <= 1
    assert [(got[120 + k].lang_pred, got[120 + k].score) for k in range(4)] == [("und", 0.0)] * 4
    assert got[124].lang_pred in ("en", "de") and got[126].lang_pred == "de" and got[127].lang_pred == "en"


def test_a_small_head_changes_no_result(spark):
    rows = [*corpus(), (900, "quickly sleeper hundert banana fuchsbau", None), (901, "gardengarden der", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = {r.doc_id: r for r in langid.identify(df).collect()}
    got = langid.identify(df, cells=12).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.held_out, r.lang_pred) == (want[r.doc_id].held_out, want[r.doc_id].lang_pred) and abs(r.score - want[r.doc_id].score) < 1e-9


def test_n_grams_fit_where_words_do_not(spark):
    """Many words of few letters: n-grams are sent, words joined."""
    rows = [*corpus(), *((1000 + i, "".join(w), "en" if i % 2 else "de") for i, w in enumerate(product("ab", repeat=11)))]
    df = spark.createDataFrame([*rows, (900, "quickly sleeper hundert banana fuchsbau", None)], "doc_id long, text string, lang string").repartition(3)
    training = df.where("lang is not null")
    words = langid.word_counts(training)
    grams = langid.gram_counts(words).count()
    assert grams < words.count()
    want = {r.doc_id: r for r in langid.predict(df, langid.learn(training)).collect()}
    model = langid.learn(training, grams)
    assert model.full and model.full[1] is None
    for r in langid.predict(df, model).collect():
        assert r.lang_pred == want[r.doc_id].lang_pred and abs(r.score - want[r.doc_id].score) < 1e-9


def test_hashes_are_those_of_spark(spark):
    keys = ["", "a", "über", "日本", "x" * 100, "<ab>"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64("k")).collect()]
    assert langid.hashes(keys).view(np.int64).tolist() == got


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(df).collect()} == {("und", 0.0)}
    assert langid.identify(df.limit(0)).count() == 0


def test_lang_is_no_input_of_a_prediction(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    swapped = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("fr")).otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.identify(df).collect())) == sorted(map(tuple, langid.identify(swapped).collect()))


def test_model_against_plain_scoring():
    words = {("the", "en"): 9, ("der", "de"): 7, ("in", "en"): 3, ("in", "de"): 2}
    counts = Counter()
    for (w, lang), n in words.items():
        for k in range(1, 6):
            for g in langid.grams(w, k):
                counts[g, lang] += n
    languages = ["de", "en"]
    totals = [[sum(n for (_, x), n in words.items() if x == lang) for lang in languages]]
    totals += [[sum(n for (g, x), n in counts.items() if x == lang and len(g) == k) for lang in languages] for k in range(1, 6)]
    table = lambda d, key: pa.table({key: [k for k, _ in d], "lang": [x for _, x in d], "n": list(d.values())})
    model = pickle.loads(pickle.dumps(langid.Model(languages, totals, table(words, "word"), table(counts, "gram"), 1)))

    def log(d, key, lang, total):
        return math.log((d.get((key, lang), 0) + 0.5) / (total + 0.5 * len({k for k, _ in d if d is words or len(k) == len(key)}) + 1))

    def plain(text):
        score, n = np.zeros(2), 0
        for w in text.split():
            if any(k == w for k, _ in words):
                score += [log(words, w, x, totals[0][i]) for i, x in enumerate(languages)]
                n += 1
                continue
            for k in range(min(5, len(w) + 2), 0, -1):
                known = [g for g in langid.grams(w, k) if any(g == h for h, _ in counts)]
                if known:
                    score += np.mean([[log(counts, g, x, totals[k][i]) for i, x in enumerate(languages)] for g in known], axis=0)
                    n += 1
                    break
        best = int(score.argmax())
        return languages[best], 1 / np.exp((score - score[best]) / np.sqrt(n)).sum()

    for text in ("the", "der in", "then derin", "hte", "in in the", "xxinxx er th"):
        lang, score = model.predict(text)
        assert lang == plain(text)[0] and abs(score - plain(text)[1]) < 1e-9
    assert model.predict("qq") == ("en", 0.5)
