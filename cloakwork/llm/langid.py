"""Language identification: words first, then ever shorter character n-grams for words not known.

Learning counts every word of every training text on Spark. A known word scores by its log frequency
in each language; of another word, the longest n-grams that are known score in its place, by their
mean. Counts are sent to the tasks as arrays, by 64-bit hashes of words and n-grams. Beyond ``MODEL_CELLS``
(word, language) counts these are the words seen most only, and all other words of the texts meet the full
counts in joins, as do n-grams where they are more than that; so the bound changes no result.

A text that is null or has no letter is ``und`` with score 0. With nothing learned every text is
``und``. A text of which no word or n-gram is known gets the language seen in most documents, at its
share of one over the number of languages. Ties go to the first language by name. Repeated rows and rows
without doc_id are predicted each (the latter are never learned from); an empty table gives no rows; texts of
any length count whole; other columns are no input, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from xxhash import xxh64_intdigest

from .common import chunks, materialise, small_batches, tidy

#: At most so many counts of words are sent to the tasks, and as many of n-grams if all of these fit; the others are joined.
MODEL_CELLS = 4_000_000
#: Numbers in the table of the words that are sent: with many languages these are fewer words.
MODEL_SIZE = 1 << 24
#: Scores of so many words are kept by a task.
UNSEEN = 100_000
LONGEST = 5
UND = "und"
_WORD = re.compile(r"[^\W\d_]+")
_FLUSH = 200_000


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept out of training: crc32 of its id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between its edge marks; single letters come without the marks."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(df: DataFrame, keys_of, key: str) -> DataFrame:
    """Counts by language over all batches of ``keys_of(batch)``, which gives (lang, keys, n): each key n times."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counter in seen.items():
                n = len(counter)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], names=["lang", key, "n"])
            seen.clear()

        for batch in batches:
            for i, (lang, keys, n) in enumerate(keys_of(batch)):
                counter = seen.get(lang)
                if counter is None:
                    counter = seen[lang] = Counter()
                if n == 1:
                    counter.update(keys)
                else:
                    for k in keys:
                        counter[k] += n
                if i % 64 == 0 and sum(map(len, seen.values())) > _FLUSH:
                    yield from flush()
        yield from flush()

    return small_batches(df).mapInArrow(run, f"lang string, {key} string, n long").groupBy("lang", key).agg(F.sum("n").alias("n"))


def word_counts(training: DataFrame) -> DataFrame:
    """lang, word and n over all texts of ``training`` (text, lang)."""

    def words(batch):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            yield lang, _WORD.findall((text.as_py() or "").lower()), 1

    return _counted(training.select("lang", "text"), words, "word")


def gram_counts(counts: DataFrame) -> DataFrame:
    """lang, gram and n of the n-grams of all words, each as often as its word."""

    def of_words(batch):
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield lang, [g for k in range(1, LONGEST + 1) for g in grams(word, k)], n

    return _counted(counts.select("lang", "word", "n"), of_words, "gram")


def _most(counts: DataFrame, key: str, languages: list[str], cells: int | None) -> pa.Table | None:
    """The counts (hash, lang, n and the key's length) of the keys seen most, all languages of a key together, within ``cells`` counts; None: all."""
    if cells is not None:
        totals = counts.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("cells"))
        level = F.floor(F.log2("total") * 8).cast("int")
        held, cut = 0, None
        for k, n in sorted(map(tuple, totals.groupBy(level).agg(F.sum("cells")).collect()), reverse=True):
            if held + n > cells:
                break
            held, cut = held + n, k
        if cut is None:
            return None
        counts = counts.join(totals.where(level >= cut).select(key), key)
    number = (F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1).cast("short")
    return counts.select(F.xxhash64(key).alias("hash"), number.alias("lang"), "n", F.least(F.length(key), F.lit(100)).cast("byte").alias("size")).toArrow()


def hashes(keys: Collection[str]) -> np.ndarray:
    """The 64-bit hash of each key, as Spark's ``xxhash64`` gives it."""
    return np.fromiter((xxh64_intdigest(k.encode(), 42) for k in keys), np.uint64, len(keys))


class Logs:
    """Log frequencies by language of keys: one row of counts for each key, in the order of their hashes."""

    def __init__(self, counts: pa.Table | None, languages: list[str], totals: np.ndarray, distinct: int | None = None):
        if counts is None:
            keys, langs, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        elif counts.schema[0].type == pa.int64():
            keys, langs, n = counts.column(0).to_numpy().view(np.uint64), counts.column(1).to_numpy(), counts.column(2).to_numpy()
        else:
            number = {x: i for i, x in enumerate(languages)}
            keys, langs, n = counts.column(0).to_pylist(), [number[x] for x in counts.column(1).to_pylist()], counts.column(2).to_numpy()
            keys = hashes(keys)
        self.hash, row = np.unique(keys, return_inverse=True)
        # Whole numbers, exact at any size; logarithms are taken of the rows that are looked up.
        self.counts = np.zeros((len(self.hash), len(languages)), np.uint32 if n.max(initial=0) < 1 << 32 else np.uint64)
        self.counts[row, langs] = n
        self.size = np.log(totals + 0.5 * (len(self.hash) if distinct is None else distinct) + 1)
        #: Of a key that no language has. One seen n times in a language has log(2 n + 1) more there.
        self.base = np.log(0.5) - self.size

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if not len(self.hash):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.hash, keys), len(self.hash) - 1)
        return np.where(self.hash[at] == keys, at, -1)

    def of(self, rows: np.ndarray) -> np.ndarray:
        return np.log(self.counts[rows].astype(np.float64) + 0.5) - self.size


class Model:
    """Log frequencies by language of the known words and n-grams."""

    def __init__(self, languages: list[str], totals: list[list[int]], words: pa.Table | None, ngrams: pa.Table | list | None, prior: int, distinct: list[int] | None = None):
        self.languages, self.prior = languages, prior
        distinct = distinct or [None] * (LONGEST + 1)
        #: The full counts of words, if tasks have only a part of them, and of n-grams, if tasks have none.
        self.full: tuple[DataFrame, DataFrame | None] | None = None
        self.words = Logs(words, languages, np.array(totals[0], float), distinct[0])
        # The n-grams of each length share the counts of their own length.
        self.grams = [Logs(None, languages, np.ones(len(languages)))]
        for n in range(1, LONGEST + 1):
            length = pc.utf8_length(ngrams["gram"]) if ngrams is not None and "gram" in ngrams.column_names else None if ngrams is None else ngrams["size"]
            own = None if ngrams is None else ngrams.filter(pc.equal(length, n))
            self.grams.append(Logs(own, languages, np.maximum(1.0, np.array(totals[n], float)), distinct[n]))
        self._forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "scores", "full")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self, room: int = 0):
        """Words met lately: word -> row of ``scores``, -1 for words of which nothing is known."""
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((max(UNSEEN, room), len(self.languages)))

    def backoff(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word the mean of the longest n-grams that are known, and their length; 0 if not even a letter is."""
        score, level = np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)
        rest = np.arange(len(words))
        for n in range(LONGEST, 0, -1):
            if not len(rest):
                break
            of = [grams(words[i], n) for i in rest.tolist()]
            owner = np.repeat(np.arange(len(rest)), list(map(len, of)))
            at = self.grams[n].find(hashes(list(chain.from_iterable(of))))
            owner, at = owner[at >= 0], at[at >= 0]
            logs, often = self.grams[n].of(at), np.bincount(owner, minlength=len(rest))
            met = often > 0
            for k in range(len(self.languages)):
                score[rest[met], k] = np.bincount(owner, logs[:, k], len(rest))[met] / often[met]
            level[rest[met]] = n
            rest = rest[~met]
        return score, level

    def _meet(self, counters: list[Counter]) -> None:
        """Keep the scores of all words of some texts."""
        every = set().union(*counters)
        new = every.difference(self.rows)
        if len(self.rows) + len(new) > len(self.scores):
            self._forget(len(every))
            new = every
        new = list(new)
        found = self.words.find(hashes(new))
        known = np.flatnonzero(found >= 0)
        other = np.flatnonzero(found < 0)
        score, level = self.backoff([new[i] for i in other.tolist()])
        first = len(self.rows)
        rows = first + np.arange(len(new))
        self.scores[rows[known]] = self.words.of(found[known])
        self.scores[rows[other]] = score
        rows[other[level == 0]] = -1
        self.rows.update(zip(new, rows.tolist(), strict=True))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counters = [Counter(_WORD.findall((text or "").lower())) for text in texts]
        if not self.languages:
            return [(UND, 0.0)] * len(texts)
        self._meet(counters)
        get, out = self.rows.__getitem__, []
        for counts in counters:
            if not any(map(str.isalpha, counts)):
                out.append((UND, 0.0))
                continue
            rows, times = np.fromiter(map(get, counts), np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
            if rows.min() < 0:
                rows, times = rows[rows >= 0], times[rows >= 0]
            out.append(self.decided(times @ self.scores[rows], int(times.sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def decided(self, score: np.ndarray, n: int) -> tuple[str, float]:
        """The language and score of a text by the summed scores of its ``n`` words."""
        if not n:
            return self.languages[self.prior], 1 / len(self.languages)
        best = int(score.argmax())
        # Words of a text depend on each other, so their evidence counts as its root.
        return self.languages[best], float(1 / np.exp((score - score[best]) / np.sqrt(n)).sum())


def learn(training: DataFrame, cells: int = MODEL_CELLS) -> Model:
    """A model of ``training`` (text, lang), all of its texts."""
    training = training.where("lang is not null and text is not null")
    found = training.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not found:
        return Model([], [[]] * (LONGEST + 1), None, None, 0)
    languages = sorted(r.lang for r in found)
    words = materialise(word_counts(training), "language-words")
    ngrams = materialise(gram_counts(words), "language-grams")
    sums = {(r.lang, 0): r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    sums |= {(r.lang, r.k): r.n for r in ngrams.groupBy("lang", F.length("gram").alias("k")).agg(F.sum("n").alias("n")).collect()}
    totals = [[sums.get((lang, k), 0) for lang in languages] for k in range(LONGEST + 1)]
    prior = languages.index(found[0].lang)
    cells = min(cells, max(1, MODEL_SIZE // len(languages)))
    all_words, all_grams = words.count() <= cells, ngrams.count() <= cells
    sent = _most(ngrams, "gram", languages, None) if all_grams else None
    if all_words and all_grams:
        return Model(languages, totals, _most(words, "word", languages, None), sent, prior)
    each = {r.k: r.n for r in ngrams.select("gram").distinct().groupBy(F.length("gram").alias("k")).agg(F.count("*").alias("n")).collect()}
    distinct = [words.select("word").distinct().count(), *(each.get(k, 0) for k in range(1, LONGEST + 1))]
    model = Model(languages, totals, _most(words, "word", languages, cells), sent, prior, distinct)
    model.full = words, None if all_grams else ngrams
    return model


def _looked_up(wanted: DataFrame, model: Model) -> DataFrame:
    """word, level (0: a known word, else the length of its longest known n-grams) and more: by language, what its score has above the level's base."""
    words, ngrams = model.full
    above = F.collect_list(F.struct("lang", F.log(2 * F.col("n") + 1).alias("d")))
    met = materialise(wanted.join(words.groupBy("word").agg(above.alias("more")), "word", "left"), "language-known")
    found = met.where("more is not null").select("word", F.lit(0).alias("level"), "more")
    rest = met.where("more is null").select("word")
    if ngrams is None:
        shared, level = wanted.sparkSession.sparkContext.broadcast(model), "word string, level int, more array<struct<lang string, d double>>"

        @tidy
        def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            base = np.array([x.base for x in m.grams])
            for batch in batches:
                words = batch.column("word").to_pylist()
                score, levels = m.backoff(words)
                more = [[{"lang": x, "d": y} for x, y in zip(m.languages, row, strict=True)] for row in (score - base[levels]).tolist()]
                kept = pa.array(levels > 0)
                kind = pa.list_(pa.struct([("lang", pa.string()), ("d", pa.float64())]))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(levels, pa.int32()), pa.array(more, kind)], names=["word", "level", "more"]).filter(kept)

        return found.union(small_batches(rest).mapInArrow(unseen, level))

    def cut(k: int):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # A word that holds an n-gram twice counts it twice.
                every = [(w, g, n) for w in batch.column("word").to_pylist() for g, n in Counter(grams(w, k)).items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in every], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "gram", "times"])

        return run

    for k in range(LONGEST, 0, -1):
        of_gram = ngrams.where(F.length("gram") == k).groupBy("gram").agg(above.alias("own"))
        often = F.transform("own", lambda x: F.struct(x["lang"].alias("lang"), (x["d"] * F.col("times")).alias("d")))
        held = small_batches(rest).mapInArrow(cut(k), "word string, gram string, times long").join(of_gram, "gram").select("word", "times", often.alias("own"))
        lists = held.groupBy("word").agg(F.sum("times").alias("all"), F.flatten(F.collect_list("own")).alias("own"))
        mean = F.transform("own", lambda x: F.struct(x["lang"].alias("lang"), (x["d"] / F.col("all")).alias("d")))
        told = materialise(lists.select("word", F.lit(k).alias("level"), mean.alias("more")), "language-unseen")
        found = found.union(told)
        rest = materialise(rest.join(told, "word", "left_anti"), "language-rest")
    return found


def _predict_joined(kept: DataFrame, model: Model, schema: StructType, hidden: list[str]) -> DataFrame:
    """``predict`` with a model whose tasks have only the words seen most: all other words meet the full counts."""
    shared = kept.sparkSession.sparkContext.broadcast(model)
    shown = [f for f in schema.fields if f.name not in ("lang_pred", "score", *hidden)]
    parts = "_row long, _letters boolean, _score array<double>, _n long, _words array<string>, _times array<long>"
    part_schema = StructType([*shown, *StructType.fromDDL(parts).fields])

    @tidy
    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value.words
        for batch in batches:
            letters, score, n, others, times = [], [], [], [], []
            for text in batch.column("text"):
                counts = Counter(_WORD.findall((text.as_py() or "").lower()))
                words, often = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                at = logs.find(hashes(words))
                known = at >= 0
                letters.append(any(map(str.isalpha, counts)))
                score.append((often[known] @ logs.of(at[known])).tolist())
                n.append(int(often[known].sum()))
                others.append([w for w, k in zip(words, known.tolist(), strict=True) if not k])
                times.append(often[~known].tolist())
            columns = [batch.column(f.name) for f in shown] + [batch.column("_row"), pa.array(letters, pa.bool_()), pa.array(score, pa.list_(pa.float64())), pa.array(n, pa.int64()), pa.array(others, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=part_schema.names)

    read = small_batches(kept.withColumn("_row", F.monotonically_increasing_id())).mapInArrow(head, part_schema)
    read = materialise(read, "language-read")
    said = read.select("_row", F.explode(F.arrays_zip("_words", "_times")).alias("x")).select("_row", F.col("x._words").alias("word"), F.col("x._times").alias("times"))
    found = _looked_up(said.select("word").distinct(), model)
    tails = said.join(found, "word").groupBy("_row").agg(F.collect_list(F.struct("times", "level", F.col("more.lang").alias("langs"), F.col("more.d").alias("ds"))).alias("_tail"))

    @tidy
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = {x: i for i, x in enumerate(m.languages)}
        base = [m.words.base, *(x.base for x in m.grams[1:])]
        for batch in batches:
            out = []
            for letters, score, n, tail in zip(*(batch.column(c).to_pylist() for c in ("_letters", "_score", "_n", "_tail")), strict=True):
                if not letters:
                    out.append((UND, 0.0))
                    continue
                score, levels = np.array(score), [0] * (LONGEST + 1)
                for x in tail or []:
                    levels[x["level"]] += x["times"]
                    for lang, d in zip(x["langs"], x["ds"], strict=True):
                        score[number[lang]] += x["times"] * d
                for k, times in enumerate(levels):
                    score += times * base[k]
                out.append(m.decided(score, n + sum(levels)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in shown), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=[*(f.name for f in shown), "lang_pred", "score"])

    joined = read.drop("_words", "_times").join(tails, "_row", "left").drop("_row")
    return small_batches(joined).mapInArrow(whole, StructType([*shown, *schema.fields[-2:]]))


def predict(docs: DataFrame, model: Model, hidden: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, without the columns ``hidden``; of its columns only ``text`` is looked at."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.select(*names)
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    if model.full is not None:
        return _predict_joined(kept, model, schema, hidden or [])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.predict_all
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [x for a, b in chunks(texts) for x in of(texts[a:b])]
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    return small_batches(kept).mapInArrow(run, schema).drop(*(hidden or []))


def identify(docs: DataFrame, folds: int = 5, cells: int = MODEL_CELLS) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that aren't held out and predict all rows."""
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds)), cells)
    found = predict(docs.select("doc_id", "text"), model, ["text"])
    return found.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "lang_pred", "score")
