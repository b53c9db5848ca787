"""Token ids in Simple-8b words: 4 selector bits and 60 payload bits in each 64-bit word.

A shard file holds documents in ascending doc_id order:

    magic "CWS8B\\x02\\0\\0", then little-endian int64: documents, ids, blocks, ids of the partition before the shard,
      documents without doc_id (they come first, with 0 in its place)
    int64 doc_id of each document, int64 ids of each document
    int64 first word of each block, one more for the end
    uint64 words

A block holds ``BLOCK`` ids (the last one fewer), so a reader can start at any block. Ids of more
than 30 bits are escaped: each takes a word of its own. Null and empty texts hold the end id alone;
repeated rows are stored once each, in the order of their texts. An empty table gives no files and no rows;
texts of any length count whole; columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import encoder, vocabulary_path
from .common import arrow_map, chunks, materialise, new_path, small_batches, tidy

MAGIC = b"CWS8B\x02\0\0"
BLOCK = 4096
SHARD_IDS = 1 << 20
#: Units in a generation of the encoder's cache, which a worker keeps from task to task.
UNITS = 600_000
#: How many ids of how many bits each selector of Simple-8b packs.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS = np.array([n for n, _ in SELECTORS])
#: Bits of the ids below 2 ** 16.
_WIDTH = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of unsigned 32-bit ids, and the first word of each block with one more for the end."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(1, "<i8")
    width = _WIDTH[ids] if int(ids.max()) < len(_WIDTH) else np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    # Ids left in the block, as far as a selector can reach.
    room = np.full(n, 240, np.uint8)
    for end in [*range(BLOCK, n, BLOCK), n]:
        tail = min(240, end - (end - 1) // BLOCK * BLOCK)
        room[end - tail : end] = np.arange(tail, 0, -1)
    widest = {1: width}
    for p in (2, 4, 8, 16, 32, 64, 128):
        widest[p] = _widest(widest[p // 2], p // 2)
    selector = np.full(n, 15, np.uint8)
    for s in range(14, -1, -1):
        count, bits = SELECTORS[s]
        power = 1 << (count.bit_length() - 1)
        if int(widest[power].min()) > bits:
            continue
        reach = widest[power] if count == power else _widest(widest[power], count - power)
        np.copyto(selector, np.uint8(s), where=(reach <= bits) & (room >= count))
    starts = np.zeros(n, bool)
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        starts[at] = True
        at = at + _COUNTS[selector[at]]
        more = at < ends
        at, ends = at[more], ends[more]
    first = np.flatnonzero(starts)
    used = selector[first]
    words, wide = used.astype(np.uint64) << np.uint64(60), ids.astype(np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        of = np.flatnonzero(used == s)
        if bits and len(of):
            at, word = first[of], words[of]
            for k in range(count):
                word |= wide[at] << np.uint64(k * bits)
                at += 1
            words[of] = word
    blocks = np.searchsorted(first, np.arange(0, n, BLOCK))
    return words.astype("<u8"), np.append(blocks, len(words)).astype("<i8")


def _widest(width: np.ndarray, shift: int) -> np.ndarray:
    out = width.copy()
    np.maximum(out[:-shift], width[shift:], out=out[:-shift])
    return out


def decode_ids(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks of words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(_COUNTS[selector])
    first = ends - _COUNTS[selector]
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, "<u4")
    for s, (count, bits) in enumerate(SELECTORS):
        of = np.flatnonzero(selector == s)
        if bits and len(of):
            mask, word, at = np.uint64((1 << bits) - 1), words[of], first[of]
            for k in range(count):
                ids[at] = (word >> np.uint64(k * bits)) & mask
                at += 1
    return ids


def shard_bytes(doc_ids: list, lengths: list[int], ids: bytes, before: int) -> bytes:
    words, blocks = encode_ids(np.frombuffer(ids, "<u4"))
    without = doc_ids.count(None)
    head = np.array([len(doc_ids), len(ids) // 4, len(blocks) - 1, before, without], "<i8")
    return b"".join([MAGIC, head.tobytes(), np.array([0] * without + doc_ids[without:], "<i8").tobytes(), np.array(lengths, "<i8").tobytes(), blocks.tobytes(), words.tobytes()])


class Shard:
    """A shard file's content; ``read(a, b)`` decodes ids a to b from the blocks that hold them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a Simple-8b shard")
        docs, self.n_ids, n_blocks, self.before, self.without = np.frombuffer(data, "<i8", 5, 8).tolist()
        at = 48
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<i8", docs, at + 8 * docs)
        at += 16 * docs
        self.blocks = np.frombuffer(data, "<i8", n_blocks + 1, at)
        self.words = np.frombuffer(data, "<u8", -1, at + 8 * (n_blocks + 1))

    def read(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, "<u4")
        a, b = start // BLOCK, -(-end // BLOCK)
        return decode_ids(self.words[self.blocks[a] : self.blocks[b]])[start - a * BLOCK : end - a * BLOCK]


def write_ids(docs: DataFrame, path: str, end_id: int = 0, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shard files under ``path``, a URI that all executors share.

    Returns the manifest (partition, shard, path, n_docs, n_ids). Names depend on partition and
    shard only and files appear by a rename, so a task that runs again replaces its own files.
    """
    vocabulary = vocabulary or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units = encoder(vocabulary)
        units.limit = UNITS
        encode = units.encode
        store, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        partition = task.partitionId()
        doc_ids: list = []
        lengths: list[int] = []
        parts: list[bytes] = []
        before = shard = held = 0
        manifest = []

        def flush() -> None:
            nonlocal before, shard, held
            name = f"{root}/{partition:07d}-{shard:06d}.s8b"
            draft = f"{root}/.{partition:07d}-{shard:06d}-{task.taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                out.write(shard_bytes(doc_ids, lengths, b"".join(parts), before))
            store.move(draft, name)
            manifest.append((partition, shard, name, len(doc_ids), held))
            before, shard, held = before + held, shard + 1, 0
            for x in (doc_ids, lengths, parts):
                x.clear()

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks(texts):
                for doc_id, code in zip(ids[a:b], encode([t or "" for t in texts[a:b]]), strict=True):
                    doc_ids.append(doc_id)
                    parts.append(code + end)
                    lengths.append(len(code) // 4 + 1)
                    held += lengths[-1]
                    if held >= shard_ids:
                        flush()
        if doc_ids:
            flush()
        columns = list(zip(*manifest, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["partition", "shard", "path", "n_docs", "n_ids"])

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    ordered = small_batches(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "partition int, shard int, path string, n_docs long, n_ids long")


def read_ids(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Per document of the shard files: doc_id, start, n_tokens and ids_crc32, from the decoded ids.

    ``start`` needs the ids of earlier partitions: one number for each partition goes through the driver.
    """
    totals = sorted(map(tuple, manifest.groupBy("partition").agg(F.sum("n_ids")).collect()))
    base, before = {}, 0
    for partition, n in totals:
        base[partition] = before
        before += n

    def decode(columns):
        for name, content in zip(columns["path"].to_pylist(), columns["content"], strict=True):
            shard = Shard(content.as_py())
            first = base[int(name.rsplit("/", 1)[1].split("-")[0])] + shard.before
            data = shard.read(0, shard.n_ids).tobytes()
            ends = np.cumsum(shard.lengths)
            starts = ends - shard.lengths
            yield {
                "doc_id": pa.array(shard.doc_ids, mask=np.arange(len(shard.doc_ids)) < shard.without),
                "start": starts + first,
                "n_tokens": shard.lengths,
                "ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)],
            }

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(path).select("path", "content")
    return arrow_map(files, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to shard files in the shared folder and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "simple8b")
    manifest = materialise(write_ids(docs, path, **options), "simple8b-manifest")
    return read_ids(spark, path, manifest)
