"""Token counts of whole texts for a sentencepiece BPE file, without token ids.

No piece of such a vocabulary holds a character of ``left`` (the space mark and others, found in the
vocabulary) after a different character, so no merge crosses from another character to one of these:
a text may be cut there into pre-tokens whose pieces add up. Each distinct pre-token of the corpus
is given to the library once. Frequent short ones (at most ``head`` of them) are broadcast; the rest
meets the per-document frequencies in a join, in which those of many documents are salted.

Null and empty texts count 0 tokens and 0 bytes; repeated rows and rows without doc_id are counted each. An
empty table gives no rows, texts of any length count whole, no ties arise that change a count, and columns
besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks, materialise, small_batches, tidy

SPACE = "▁"
#: The broadcast table has at most so many pre-tokens, each of at most so many characters.
HEAD, HEAD_CHARS = 1 << 17, 48
#: A pre-token outside the broadcast table that occurs more often than once in so many documents is dealt to so many tasks.
HOT, SALTS = 256, 64
_FLUSH = 200_000


class Splitter:
    """The pre-tokens of a text, by a pattern that the vocabulary gives."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or model.trainer_spec.model_type != 2:
            raise ValueError("only BPE models that leave the text as it is can be counted by pre-tokens")
        spec.add_dummy_prefix = False
        self.processor = SentencePieceProcessor(model_proto=model.SerializeToString())
        pieces = [p.piece for p in model.pieces if p.type in (1, 4)]
        inner = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if a != b}
        left = {c for p in pieces for c in p} - inner
        if SPACE in inner or any(p.type == 4 for p in model.pieces):
            raise ValueError("pieces of this vocabulary cross spaces")
        left = "".join(sorted(re.escape(c) for c in left if ord(c) < 128 or c == SPACE))
        self.pattern = re.compile(f"[{left}]+[^{left}]*|[^{left}]+")

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def count(self, pieces: list[str]) -> list[int]:
        return [len(x) for x in self.processor.encode(pieces, num_threads=1)]


_splitters: dict[str, Splitter] = {}


def splitter(path: str) -> Splitter:
    if path not in _splitters:
        _splitters[path] = Splitter(path)
    return _splitters[path]


def vocabulary_counts(docs: DataFrame, path: str) -> DataFrame:
    """Each distinct pre-token of the corpus once: piece, n (its occurrences), n_tokens."""

    @tidy
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path).split
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(split(text.as_py() or ""))
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    def count(columns):
        yield {"piece": columns["piece"], "n": columns["n"], "n_tokens": splitter(path).count(columns["piece"].to_pylist())}

    found = small_batches(docs).select("text").mapInArrow(distinct, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return arrow_map(found, count, "piece string, n long, n_tokens long")


def frequent(vocabulary: DataFrame, limit: int = HEAD) -> dict[str, int]:
    """n_tokens of at most ``limit`` of the most frequent short pre-tokens."""
    short = vocabulary.where(F.length("piece") <= HEAD_CHARS)
    level = F.floor(F.log2("n") * 8).cast("int")
    held, cut = 0, None
    for k, n in sorted(map(tuple, short.groupBy(level).count().collect()), reverse=True):
        if held + n > limit:
            break
        held, cut = held + n, k
    if cut is None:
        return {}
    return {r.piece: r.n_tokens for r in short.where(level >= cut).select("piece", "n_tokens").collect()}


def _hot(vocabulary: DataFrame, docs: DataFrame, held: dict[str, int]) -> list[int]:
    """Hashes of the pre-tokens that aren't broadcast and occur in so many documents (or so often) that one task would get too many.

    All that are found are told: a document has a bounded number of long pre-tokens, and short ones as frequent are broadcast first.
    """
    least = docs.count() // HOT
    if least < SALTS:
        return []
    short = F.length("piece") <= HEAD_CHARS
    rows = vocabulary.where(F.col("n") > least).select(F.xxhash64("piece").alias("hash"), F.when(short, F.col("piece")).alias("short"))
    return [r.hash for r in rows.collect() if r.short is None or r.short not in held]


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs`` (doc_id, text)."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = materialise(vocabulary_counts(docs, path), "token-vocabulary")
    held = frequent(vocabulary, head)
    known = docs.sparkSession.sparkContext.broadcast(held)
    hot = _hot(vocabulary, docs, held)
    names = ["own", "piece", "row", "doc_id", "n_bytes", "n"]
    kinds = [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    @tidy
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document a row of its own, with the tokens of broadcast pre-tokens, and one for each other pre-token."""
        from pyspark import TaskContext

        split, get = splitter(path).split, known.value.get
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks(texts):
                rows = []
                for doc_id, text in zip(doc_ids[a:b], texts[a:b], strict=True):
                    text = text or ""
                    pieces = split(text)
                    counts = list(map(get, pieces))
                    rest = Counter([p for p, n in zip(pieces, counts, strict=True) if n is None])
                    rows.append((True, None, row, doc_id, len(text.encode()), sum(filter(None, counts))))
                    rows += [(False, p, row, None, None, n) for p, n in rest.items()]
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "own boolean, piece string, row long, doc_id long, n_bytes long, n long"
    found = docs.select("doc_id", "text").mapInArrow(frequencies, schema)
    key = F.coalesce("piece", F.col("row").cast("string"))
    given = vocabulary.select(F.lit(False).alias("own"), F.col("piece").alias("key"), "n_tokens")
    rows, on = found.withColumn("key", key), ["own", "key"]
    if hot:
        # Rows of hot pre-tokens by their salt, which all their entries have; equal hashes of others do no harm.
        salted = F.xxhash64("key").isin(hot)
        rows = rows.withColumn("salt", F.when(salted, F.pmod("row", F.lit(SALTS))).otherwise(0).cast("long"))
        given = given.withColumn("salt", F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")))
        on = [*on, "salt"]
    joined = rows.join(given, on, "left")
    return (
        joined.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(F.col("n") * F.col("n_tokens"))).alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
