"""Phrase collocations by sorted occurrence relations, extended word by word.

The relation of length k holds, for every document, the positions at which a frequent phrase of k words
begins, the number of that phrase and of the frequent word that follows it, in the order of pieces and
positions; pieces are a gap apart. It is written, and the relation of length k + 1 comes from it: each
occurrence meets the one at the next position of its piece (all is sorted, so one pass joins them), the pairs
of phrase and following word are counted over the corpus, and only occurrences of pairs that are frequent
enough stay. All parts of a frequent phrase are
as frequent, so the tables of counts hold every number that scores and containment need; these are joins of
the tables alone.

Numbers of frequent words and phrases reach the tasks as sorted arrays as long as there are at most ``held``
of them; beyond it occurrences meet the table in a join. Both ways give the same relation. Tasks count
occurrences before the shuffle, so a very common pair is a few rows of it.

Per language, a null one is ``und``. Null and empty texts hold no words; repeated rows count each; texts of any length count
whole. Ties in rank go by occurrences and phrase, ties of cuts to the first. An empty table gives no rows;
columns besides text and lang are ignored, whatever their names. Counts are exact (longs; scores in decimals).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, small_batches, tidy

LONGEST, LEAST, PER_LANG, CONTAINED = 4, 30, 2000, 80
UND = "und"
#: Up to so many words (or phrases of one length) are sent to the tasks; beyond it they are joined.
HELD_WORDS, HELD_PHRASES = 500_000, 4_000_000
#: Distinct words, and occurrences, that a task counts before it hands them on.
_WORDS, _OCCURRENCES = 200_000, 4_000_000
#: Positions in one Arrow batch of a relation.
_VALUES = 200_000
#: A language's candidates are ranked in so many parts first.
_PARTS = 64
_GAP = b"\xff"  # no UTF-8 text holds this byte
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _GAP * 10)


def words(text: str | None) -> list[bytes]:
    """The words of a text in order, a gap between pieces."""
    return (text or "").encode().translate(_TABLE).replace(_GAP, b" \xff ").split()


def _counted(docs: DataFrame, least: int) -> DataFrame:
    """lang, word and n of the words that occur ``least`` times in a language; the null word has the number of all words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        totals: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, counts in seen.items() for w, n in counts.items()] + [(lang, None, n) for lang, n in totals.items()]
            seen.clear()
            totals.clear()
            lang, word, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                own = seen[lang]
                found = words(text.as_py())
                own.update(found)
                gaps = own.pop(_GAP, 0)
                totals[lang] += len(found) - gaps
                if len(own) > _WORDS:
                    yield flush()
        yield flush()

    found = small_batches(docs).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return found.where(f"n >= {least} or word is null").select("lang", F.col("word").cast("string").alias("word"), "n")


def _numbered(df: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``df`` written in ``order`` with an ``id`` from 1 that follows it."""
    dealt = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), tag)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))
    return dealt.join(F.broadcast(starts), "part").withColumn("id", F.col("start") + F.col("row").bitwiseAND((1 << 33) - 1) + 1).drop("part", "row", "start")


def _arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column without copies."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def _batches(rows: Iterator[tuple[np.ndarray, ...]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of arrays, many to a batch."""
    kept: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        columns = []
        for i, field in enumerate(schema):
            offsets = np.cumsum([0, *(len(r[i]) for r in kept)]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[i] for r in kept]), field.type.value_type)))
        kept.clear()
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    for row in rows:
        kept.append(row)
        size += len(row[0])
        if size > _VALUES:
            yield flush()
            size = 0
    if kept:
        yield flush()


_LONGS = pa.list_(pa.int64())
_FIRST, _LATER = pa.schema([("w", _LONGS)]), pa.schema([("at", pa.list_(pa.int32())), ("phrase", _LONGS), ("following", _LONGS)])


def _first_relation(docs: DataFrame, vocabulary: DataFrame, held: int) -> DataFrame:
    """One row a document: ``w``, the number of the frequent word at each position, 0 for other words and gaps."""
    spark = docs.sparkSession
    if vocabulary.count() <= held:
        table: dict[str, dict[bytes, int]] = defaultdict(dict)
        for lang, word, number in zip(*vocabulary.select("lang", "word", "id").toArrow().to_pydict().values(), strict=True):
            table[lang][word.encode()] = number
        known = spark.sparkContext.broadcast(dict(table))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray]]:
            for batch in batches:
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                    get = known.value.get(lang, {}).get
                    yield (np.array(list(map(get, words(text.as_py()), repeat(0))), np.int64),)

        @tidy
        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(found(batches), _FIRST)

        return materialise(small_batches(docs).mapInArrow(look_up, "w array<long>"), "phrase-words")

    @tidy
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of a document with their positions."""
        from pyspark import TaskContext

        doc = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                at: dict[bytes, list[int]] = defaultdict(list)
                own = words(text.as_py())
                for i, w in enumerate(own):
                    if w != _GAP:
                        at[w].append(i)
                n = len(at)
                columns = [pa.array([doc] * n, pa.int64()), pa.array([len(own)] * n, pa.int32()), pa.array([lang] * n, pa.string()), pa.array(list(at), pa.binary()).cast(pa.string()), pa.array(list(at.values()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "size", "lang", "word", "at"])
                doc += 1

    spelt = small_batches(docs).mapInArrow(spell, "doc long, size int, lang string, word string, at array<int>")
    met = spelt.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("doc", "size").agg(F.collect_list(F.struct("id", "at")).alias("of"))

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray]]:
        for batch in batches:
            for size, of in zip(batch.column("size").to_pylist(), batch.column("of"), strict=True):
                row = np.zeros(size, np.int64)
                for x in of.as_py():
                    row[x["at"]] = x["id"]
                yield (row,)

    @tidy
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(laid(batches), _FIRST)

    return materialise(met.mapInArrow(lay, "w array<long>"), "phrase-words")


def _joined(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each document the occurrences that a frequent word follows: position, phrase, that word and the word after it.

    The word after it stands beside the occurrence at the next position: the end of a frequent phrase is frequent too.
    """
    names = batch.schema.names
    if names == ["w"]:
        for w in _arrays(batch.column(0)):
            at = np.flatnonzero(w)
            more = np.append(w, [0, 0])
            at = at[more[at + 1] > 0]
            yield at, w[at], more[at + 1], more[at + 2]
        return
    for at, phrase, following in zip(*(_arrays(batch.column(names.index(c))) for c in _LATER.names), strict=True):
        here = np.flatnonzero(following)
        beside = np.minimum(np.searchsorted(at, at[here] + 1), len(at) - 1)
        yield at[here], phrase[here], following[here], np.where(at[beside] == at[here] + 1, following[beside], 0)


def _frequent(relation: DataFrame, base: int, least: int) -> DataFrame:
    """key (phrase * base + following word) and n of the phrases one word longer that occur ``least`` times."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(kept or [np.zeros(0, np.int64)]), return_counts=True)
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["key", "n"])

        for batch in batches:
            for at, phrase, following, _ in _joined(batch):
                kept.append(phrase * base + following)
                size += len(at)
                if size > _OCCURRENCES:
                    yield flush()
                    size = 0
        yield flush()

    return small_batches(relation).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(f"n >= {least}")


def _next_relation(relation: DataFrame, phrases: DataFrame, k: int, base: int, held: int) -> DataFrame:
    """The relation of k words: ``at``, ``phrase`` and the ``following`` word (0: none that is frequent), only of frequent phrases."""
    schema = "at array<int>, phrase array<long>, following array<long>"
    if phrases.count() <= held:
        # Numbers follow the order of the keys.
        known = relation.sparkSession.sparkContext.broadcast(np.sort(phrases.select("key").toArrow()["key"].to_numpy()))

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            keys = known.value
            for batch in batches if len(keys) else ():
                for at, phrase, following, after in _joined(batch):
                    key = phrase * base + following
                    place = np.searchsorted(keys, key)
                    hit = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == key)
                    if len(hit):
                        yield at[hit], place[hit] + 1, after[hit]

        @tidy
        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _batches(found(batches), _LATER)

        return materialise(small_batches(relation).mapInArrow(look_up, schema), f"phrase-relation-{k}")

    @tidy
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct keys of a document with their positions."""
        from pyspark import TaskContext

        doc = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at, phrase, following, after in _joined(batch):
                key = phrase * base + following
                order = np.argsort(key, kind="stable")
                distinct, starts = np.unique(key[order], return_index=True)
                lists = [pa.array(np.split(x[order], starts[1:]) if len(distinct) else [], kind) for x, kind in ((at, _LATER.field("at").type), (after, _LONGS))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), doc)), pa.array(distinct), *lists], names=["doc", "key", "at", "after"])
                doc += 1

    spread = small_batches(relation).mapInArrow(keyed, "doc long, key long, at array<int>, after array<long>")
    met = spread.join(phrases.select("key", "id"), "key").groupBy("doc").agg(F.collect_list(F.struct("id", "at", "after")).alias("of")).select("of")

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for of in batch.column("of"):
                of = of.as_py()
                at = np.concatenate([x["at"] for x in of])
                phrase = np.repeat([x["id"] for x in of], [len(x["at"]) for x in of])
                order = np.argsort(at, kind="stable")
                yield at[order], phrase[order], np.concatenate([x["after"] for x in of])[order]

    @tidy
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(laid(batches), _LATER)

    return materialise(met.mapInArrow(lay, schema), f"phrase-relation-{k}")


def frequent_phrases(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, held_words: int = HELD_WORDS, held_phrases: int = HELD_PHRASES
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to ``longest`` words that occur ``least`` times, and (lang, n), all words."""
    given = docs.select(F.coalesce("lang", F.lit(UND)).alias("lang"), "text").where("text is not null")
    counted = materialise(_counted(given, least), "phrase-counts")
    vocabulary = materialise(_numbered(counted.where("word is not null"), ["lang", "word"], "phrase-order"), "phrase-vocabulary")
    base = (vocabulary.agg(F.max("id")).first()[0] or 0) + 1
    relation = _first_relation(given, vocabulary, held_words)
    shorter = vocabulary.select("id", "lang", F.col("word").alias("phrase"), F.col("n").alias("f"))
    tables = [shorter.withColumn("k", F.lit(1))]
    for k in range(2, longest + 1):
        if (shorter.agg(F.max("id")).first()[0] or 0) > ((1 << 63) - 1) // base:
            raise OverflowError("too many frequent phrases to number their pairs by a long")
        phrases = materialise(_numbered(_frequent(relation, base, least), ["key"], "phrase-order"), f"phrase-keys-{k}")
        if k < longest:
            relation = _next_relation(relation, phrases, k, base, held_phrases)
        pairs = phrases.select("id", F.expr(f"key div {base}").alias("head"), (F.col("key") % base).alias("tail"), F.col("n").alias("f"))
        last = vocabulary.select(F.col("id").alias("tail"), "word")
        named = pairs.join(shorter.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("start")), "head").join(last, "tail")
        shorter = materialise(named.select("id", "lang", F.concat_ws(" ", "start", "word").alias("phrase"), "f"), f"phrases-{k}")
        tables.append(shorter.withColumn("k", F.lit(k)))
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.select("lang", "phrase", "k", "f"), counted.where("word is null").select("lang", "n")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, per_lang: int = PER_LANG, contained: int = CONTAINED,
    held_words: int = HELD_WORDS, held_phrases: int = HELD_PHRASES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of each language of ``docs`` (text, lang)."""
    known, totals = frequent_phrases(docs, longest, least, held_words, held_phrases)
    split = known.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    cuts = split.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr("2000000 * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    # Every phrase inside a longer one, with the most frequent of those.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " "))))
    inside = split.where("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {contained} * cast(a as decimal(20, 0))")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= per_lang)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= per_lang)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _oracle() -> str:
    """The same by windows over all words."""
    pieces = ", ".join(f"CASE WHEN {' AND '.join(f'lead(p, {i}) OVER o = p' for i in range(1, k)) or 'true'} THEN {' || chr(32) || '.join(f'lead(w, {i}) OVER o' if i else 'w' for i in range(k))} END AS p{k}" for k in range(1, LONGEST + 1))
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UND}') AS lang, row_number() OVER () AS p, piece FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), words AS (
  SELECT lang, p, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM (SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces)
), grams AS MATERIALIZED (SELECT lang, {pieces} FROM words WINDOW o AS (ORDER BY p, i)),
f AS MATERIALIZED (
  {' UNION ALL '.join(f'SELECT lang, p{k} AS phrase, {k} AS k, count(*) AS f FROM grams WHERE p{k} IS NOT NULL GROUP BY ALL' for k in range(1, LONGEST + 1))}
), c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
parts AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
known AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, cut, (2000000 * CAST(c.a AS HUGEINT)) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM parts c JOIN known x ON x.lang = c.lang AND x.phrase = c.head JOIN known y ON y.lang = c.lang AND y.phrase = c.tail
), s AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS least FROM cuts),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[begin_:begin_ + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - size + 2)) AS begin_ FROM (SELECT *, unnest(range(2, k)) AS size FROM c WHERE k > 2))) GROUP BY ALL
), kept AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, CAST(s.score AS BIGINT) AS score FROM s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE least = 1 AND (i.longer IS NULL OR 100 * CAST(i.longer AS HUGEINT) < {CONTAINED} * CAST(s.a AS HUGEINT))
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN (SELECT lang, count(*) AS n FROM words GROUP BY lang) t ON t.lang = r.lang WHERE rank <= {PER_LANG}
"""


ORACLE_SQL = _oracle()
