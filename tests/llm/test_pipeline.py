"""The corpus pipeline against its stages by brute force, on a small folder of tables."""

import random

import corpus_pipeline
from tokenizers import Tokenizer

from cloakwork.llm import common
from cloakwork.llm.bytebpe import vocabulary_path
from tests.llm.test_jaccard import brute
from tests.llm.test_langid import DE, EN


def corpus():
    rnd = random.Random(8)
    leak = "The answer of the hidden question is that the garden of the fox has seven yellow doors and one window."
    docs = [(i, " ".join(rnd.choices((EN, DE)[i % 2], k=rnd.randint(8, 60))), ("en", "de")[i % 2], f"src{i % 3}", 5) for i in range(80)]
    docs += [(100 + i, " ".join([docs[i][1], *(["extra"] * (i % 2))]), docs[i][2], "src0", 5) for i in range(20)]
    docs += [(200, f"{docs[3][1]} {leak}", "en", "s", 1), (201, leak.upper().replace("YELLOW", "YELOW"), None, "s", 1), (202, None, "en", "s", 1), (203, "", "en", "s", 1), (204, "12 34 ..", "en", "s", 1)]
    docs += [docs[5], docs[5]]
    return docs, [(1, leak), (2, "short"), (3, None)]


def test_stages(spark, tmp_path):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    sf, at = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name in list(stages)[:-1]:
        at = stages[name](spark, at, sf)
        assert at.columns == df.columns
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    assert kept["language_id"].keys() == {d[0] for d in docs} - {202, 203, 204}
    groups = brute(sorted({(i, t) for i, t in kept["language_id"].items()}))
    assert kept["ngram_jaccard"].keys() == {i for i, (_, c) in groups.items() if i == c}
    assert spark.read.parquet(f"{tmp_path}/ngram_jaccard").count() == len(kept["ngram_jaccard"])
    assert kept["decontamination"].keys() == kept["ngram_jaccard"].keys() - {200, 201}
    rows = corpus_pipeline.run(spark, sf).collect()
    library = Tokenizer.from_file(vocabulary_path())
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept["decontamination"].items()}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_of_one_id_are_judged_by_themselves(spark):
    a, b, c = ("the fox went over the hill to see what it could see", "seven men sat around a fire and told each other long stories", "seven men sat around a fire and told each other long stories")
    rows = [(0, b, "en", "s", 1), (1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, c, "en", "s", 1), (2, a, "en", "s", 1), (None, a, "en", "s", 1), (None, a, "en", "s", 1), (3, None, "en", "s", 1), (3, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.ngram_jaccard(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in kept.collect()) == [((False, 0), b), ((False, 1), a), ((False, 3), ""), ((False, 3), ""), ((True, 0), a), ((True, 0), a)]


def test_drivers_python_gives_memory_back_after_each_table(spark, monkeypatch):
    given = []
    monkeypatch.setattr(common, "release", lambda: given.append(1))
    assert common.materialise(spark.range(3), "given-back").count() == 3
    assert given == [1]
