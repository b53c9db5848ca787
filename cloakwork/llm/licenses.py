"""License scan: an exact set-similarity join of text blocks with license templates, and phrase places.

Native DataFrame operations only. A block is a sentence; it goes on over single line ends, as license texts are
wrapped, and ends at an empty line. A template is found in a block when
the block holds at least ``threshold`` of the template's distinct words. The join orders words by
their document frequency in the corpus, rarest first, and lets a block and a template meet only if
they share a word of both prefixes (prefix filter), the block has enough words (length filter) and
the places of the shared words leave room for enough overlap (positional filter); overlaps are then
counted exactly. Only words of templates can overlap, so blocks are cut to these first, in the one pass that reads the texts;
texts that as a whole have too few words of every template have no blocks to look at. Of templates that are nearly
the same set (Jaccard ``RIVALS`` or more: the notices of the GPL, LGPL and AGPL) only those that a block holds best
count, the largest of them where they are held equally well.

Null and empty texts have 0 words and no labels; every row counts, repeated ones too. Texts are
lower-cased for A-Z only. An empty table gives no rows; texts of any length count whole; templates that are found equally
well all give their labels; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Fixed values of the query's contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}

#: Sentences of public license notices by label; the words of each are a set.
TEMPLATES = {
    "agpl-3.0": "gnu affero general public license version 3",
    "agpl-notice": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": "you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-3-clause": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-clause": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsl-1.0": "distributed under the boost software license version 1 0",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-notice": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit": "released under the mit license",
    "mit-distributed": "distributed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-licensed": "licensed under the mit license",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD, RIVALS = 0.9, 0.8
#: Blocks end at empty lines and after the marks that end a sentence; the point of "v. 2.0" ends none.
BLOCK_END = r"\n[ \t\r]*\n|[.!?]+[ \t\r\n]+"
VERSION = r"\bv\.[ \t\r\n]+([0-9])"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _text(column: str = "text") -> Column:
    """A text with A-Z lower-cased. ``lower`` changes further letters, but makes an ASCII letter of the Kelvin sign alone
    (and i with a mark of the dotted capital I), so it gives the same words of templates and the same number of words."""
    text = F.coalesce(column, F.lit(""))
    return F.when(text.contains("\u212a"), F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def _needed(words: list[str], threshold: float) -> int:
    return ceil(round(threshold * len(set(words)), 9))


def frequencies(told: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each word of the templates stands: a row for each of these words. ``told`` has each text's distinct words as ``known``."""
    found = told.select(F.explode("known").alias("word")).groupBy("word").count().collect()
    counted = {r.word: r["count"] for r in found}
    return {w: counted.get(w, 0) for w in vocabulary}


def _prefix(words: list[str], rank: dict[str, int], threshold: float) -> tuple[list[str], int]:
    """A template's words in the global order, and how many of them come first: one of these is in any block that holds it."""
    words = sorted(set(words), key=rank.get)
    return words, len(words) - _needed(words, threshold) + 1


def rivals(templates: dict[str, str]) -> dict[str, list[str]]:
    """For each label those of templates that are nearly the same set of words."""
    sets = {label: set(text.split()) for label, text in templates.items()}
    return {a: [b for b, y in sets.items() if b != a and len(x & y) >= RIVALS * len(x | y)] for a, x in sets.items()}


def template_matches(blocks: DataFrame, order: list[str], templates: dict[str, str], threshold: float) -> DataFrame:
    """``blocks`` (key columns, words) joined with the templates they hold: key columns, label, containment.

    ``words`` are the distinct template words of a block; ``order`` is the global order, rarest first.
    """
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, text in templates.items():
        words, first = _prefix(text.split(), rank, threshold)
        index += [(w, i, label, words, len(words) - first + 1) for i, w in enumerate(words[:first])]
    spark = blocks.sparkSession
    # As many rows as the templates have prefix words, a constant of this module or the caller's argument.
    index = F.broadcast(spark.createDataFrame(index, "word string, t_at int, label string, template array<string>, need int"))
    keys = [c for c in blocks.columns if c != "words"]
    ordered = blocks.withColumn("words", F.array_intersect(F.array(*map(F.lit, order)), F.col("words")))
    probed = ordered.select(*keys, "words", F.posexplode("words").alias("b_at", "word")).join(index, "word")
    size = F.size("words")
    room = 1 + F.least(F.size("template") - F.col("t_at") - 1, size - F.col("b_at") - 1)
    candidates = probed.where((size >= F.col("need")) & (F.col("b_at") <= size - F.col("need")) & (room >= F.col("need")))
    # A pair may meet at several words of its prefixes: the first one in the global order stands for it.
    first = F.element_at(F.array_intersect("words", "template"), 1) == F.col("word")
    overlap = F.size(F.array_intersect("words", "template"))
    return candidates.where(first & (overlap >= F.col("need"))).select(*keys, "label", (overlap / F.size("template")).alias("containment"))


def _told(docs: DataFrame, vocabulary: list[str], templates: dict[str, str], threshold: float) -> DataFrame:
    """What one pass over the texts tells of each row: doc_id, key, n_words, n_base, first_word, last_word, base, known and blocks.

    ``known`` are the distinct words of templates and phrases; ``blocks`` the distinct template words of each block, null
    where the whole text has too few words of every template, so that no block of it can hold one.
    """
    all_words = F.regexp_extract_all("low", F.lit(WORD), F.lit(0))
    every_known = F.array(*map(F.lit, sorted({*vocabulary, *(w for p in PHRASES.values() for w in p)})))
    read = docs.select("doc_id", _text().alias("low")).withColumn("key", F.xxhash64("doc_id", "low")).withColumn("words", all_words)
    read = read.withColumn("known", F.array_intersect("words", every_known))

    def held(words: list[str]) -> Column:
        return F.size(F.array_intersect("known", F.array(*map(F.lit, words))))

    # The places of phrases, looked for only in texts that have all of the phrase's words and in which they follow each other somehow.
    def starts(phrase: tuple[str, ...]) -> Column:
        def here(i: Column) -> Column:
            found = F.get("words", i) == phrase[0]
            for k in range(1, len(phrase)):
                found = found & (F.get("words", i + k) == phrase[k])
            return F.coalesce(found, F.lit(False))

        every = F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
        return F.when((held(list(phrase)) == len(set(phrase))) & F.col("low").rlike(GAP.join(phrase)), every).otherwise(F.array().cast("array<int>"))

    least = min(_needed(t.split(), threshold) for t in templates.values())
    enough = reduce(or_, (held(sorted(set(t.split()))) >= _needed(t.split(), threshold) for t in templates.values()))
    lines = F.split(F.regexp_replace("low", VERSION, "v $1"), BLOCK_END)
    known = F.array(*map(F.lit, vocabulary))
    cut = F.filter(F.transform(lines, lambda x: F.array_intersect(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)), known)), lambda x: F.size(x) >= least)
    places = [starts(phrase) for phrase in PHRASES.values()]
    return (
        read.withColumns({f"p{k}": p for k, p in enumerate(places)} | {"blocks": F.when(enough, cut)})
        .withColumn("places", F.flatten(F.array(*(F.col(f"p{k}") for k in range(len(places))))))
        .select(
            "doc_id",
            "key",
            F.size("words").cast("long").alias("n_words"),
            F.size("places").cast("long").alias("n_base"),
            F.array_min("places").cast("long").alias("first_word"),
            F.array_max("places").cast("long").alias("last_word"),
            F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(x)) for k, x in enumerate(PHRASES)))).alias("base"),
            "known",
            "blocks",
        )
    )


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """License labels and phrase places of each row of ``docs`` (doc_id, text).

    doc_id, n_words, n_base (all places of the phrases), first_word, last_word, base_labels, labels
    and score: 1 where a phrase stands, else the largest containment of a template found, else 0.
    """
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    told = materialise(_told(docs, vocabulary, templates, threshold), "licenses-told")
    counted = frequencies(told, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counted[w], w))
    base = told.drop("known", "blocks")
    blocks = told.where("blocks is not null").select("doc_id", "key", F.posexplode("blocks").alias("block", "words"))
    matches = template_matches(blocks, order, templates, threshold)
    against = {a: others for a, others in rivals(templates).items() if others}
    if against:
        sizes = F.create_map(*(F.lit(x) for label, text in templates.items() for x in (label, len(set(text.split())))))
        near = F.create_map(*(x for a, others in against.items() for x in (F.lit(a), F.array(*map(F.lit, others)))))
        # At most one row of a block for each template.
        held = matches.groupBy("doc_id", "key", "block").agg(F.collect_list(F.struct("containment", F.element_at(sizes, F.col("label")).alias("size"), "label")).alias("held"))

        def beaten(x: Column) -> Column:
            others = F.coalesce(F.try_element_at(near, x["label"]), F.array().cast("array<string>"))
            return F.exists("held", lambda y: F.array_contains(others, y["label"]) & ((y["containment"] > x["containment"]) | ((y["containment"] == x["containment"]) & (y["size"] > x["size"]))))

        matches = held.select("doc_id", "key", F.explode(F.filter("held", lambda x: ~beaten(x))).alias("m")).select("doc_id", "key", "m.label", "m.containment")
    found = matches.groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    joined = base.alias("b").join(found.alias("f"), F.col("b.key").eqNullSafe(F.col("f.key")) & F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return joined.select(
        "b.doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    templates = ", ".join(f"('{label}', list_distinct(string_split('{text}', ' ')), {_needed(text.split(), THRESHOLD)})" for label, text in TEMPLATES.items())
    place = {
        x: f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(p))})" for x, p in PHRASES.items()
    }
    places = ", ".join(f'{sql} AS "{x}"' for x, sql in place.items())
    names = ", ".join(f"CASE WHEN len(\"{x}\") > 0 THEN '{x}' END" for x in PHRASES)
    every = ", ".join(f'"{x}"' for x in PHRASES)
    near = ", ".join(f"('{a}', '{b}')" for a, others in rivals(TEMPLATES).items() for b in others)
    return f"""
WITH t(label, template, need) AS (VALUES {templates}),
d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS low FROM documents),
w AS (SELECT doc_id, r, regexp_extract_all(low, '{WORD}') AS w FROM d),
p AS (SELECT doc_id, r, len(w) AS n_words, {places} FROM w),
b AS (SELECT *, flatten([{every}]) AS places, list_filter([{names}], lambda x: x IS NOT NULL) AS base FROM p),
s AS (SELECT r, row_number() OVER () AS block, list_distinct(regexp_extract_all(line, '{WORD}')) AS words FROM (SELECT r, unnest(regexp_split_to_array(regexp_replace(low, '{VERSION}', 'v \1', 'g'), '{BLOCK_END}')) AS line FROM d)),
h AS (SELECT r, block, label, len(template) AS size, n / len(template) AS c FROM (SELECT r, block, label, template, need, len(list_intersect(words, template)) AS n FROM s, t) WHERE n >= need),
near(x, y) AS (VALUES {near}),
beaten AS (SELECT a.block, a.label FROM h a JOIN near ON near.x = a.label JOIN h b ON b.block = a.block AND b.label = near.y WHERE b.c > a.c OR b.c = a.c AND b.size > a.size),
m AS (SELECT r, list(DISTINCT label) AS more, max(c) AS best FROM h ANTI JOIN beaten USING (block, label) GROUP BY r)
SELECT doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END :: DOUBLE AS score
FROM b LEFT JOIN m ON b.r = m.r
"""


ORACLE_SQL = _oracle()
