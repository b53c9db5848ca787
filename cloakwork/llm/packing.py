"""Packing of documents into fixed token windows by the sum-of-squares rule.

Each task packs the documents of its partition as they come. A level array counts the open windows
by fill; a document's last piece goes to the level that makes the sum of the squared counts of
partially filled windows smallest. Longer documents first give off whole windows. When a task ends
(or holds ``open_limit`` open windows) the open windows are joined: the emptiest are cut up to fill
the fullest, so that each time at most one window stays short.

No shuffle: work and result depend on the input partition alone, so a lost task is simply run again.
Null and empty texts give one piece that holds the end id; repeated rows and rows without doc_id are
packed once each. An empty table gives no rows. A text of any length is cut into whole windows and a rest. Of
levels with equal sums the emptiest is taken. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytebpe import encoder, vocabulary_path
from .common import chunks, small_batches, tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
#: Units in a generation of a worker's cache. The open windows stand beside it, so it is smaller than the encoder's own.
UNITS = 300_000


class Packer:
    """Sum-of-squares packing of one stream of documents; ``rows`` holds the pieces of closed windows."""

    def __init__(self, window: int, first_sequence: int = 0, open_limit: int = 4096):
        self.window, self.open_limit = window, open_limit
        self.count = np.zeros(window + 1, np.int64)  # level -> open windows; a full window counts as none
        self.open: list[list[list]] = [[] for _ in range(window)]  # level -> windows, each a list of pieces
        self.n_open = 0
        self.sequence = first_sequence
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        tokens, window = len(ids) // 4, self.window
        whole = tokens - tokens % window
        for start in range(0, whole, window):
            self._close([(doc_id, start, ids[4 * start : 4 * (start + window)], tokens)])
        if whole < tokens:
            self._place((doc_id, whole, ids[4 * whole :], tokens))
            if self.n_open >= self.open_limit:
                self.finish()

    def _place(self, piece: tuple) -> None:
        size, window, count = len(piece[2]) // 4, self.window, self.count
        # Moving a window from level h to h + size changes the sum of squares by 2 (N[h + size] - N[h]) + 2,
        # opening one (h = 0) by 2 N[size] + 1.
        change = 2 * (count[size:] - count[: window + 1 - size]) + 2
        change[0] = 2 * count[size] + 1
        change[window - size] = -2 * count[window - size] + 1 if size < window else 0
        change[1:][count[1 : window + 1 - size] == 0] = np.iinfo(np.int64).max
        level = int(change.argmin())
        if level:
            pieces = self.open[level].pop()
            count[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == window:
            self._close(pieces)
        else:
            self.open[level + size].append(pieces)
            count[level + size] += 1
            self.n_open += 1

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, tokens in pieces:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, zlib.crc32(ids), tokens, self.sequence, offset))
            offset += length
        self.sequence += 1

    def finish(self) -> None:
        """Fill the fullest open windows with cuts of the emptiest; at most the last one closed is short."""
        left = [(level, w) for level in range(self.window - 1, 0, -1) for w in self.open[level]]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        self.n_open = 0
        first, last = 0, len(left) - 1
        while first <= last:
            level, pieces = left[first]
            while level < self.window and last > first:
                small, donor = left[last]
                doc_id, start, ids, tokens = donor.pop()
                take = min(self.window - level, len(ids) // 4)
                keep = len(ids) // 4 - take
                pieces.append((doc_id, start + keep, ids[4 * keep :], tokens))
                if keep:
                    donor.append((doc_id, start, ids[: 4 * keep], tokens))
                level += take
                left[last] = (small - take, donor)
                if not donor:
                    last -= 1
            self._close(pieces)
            first += 1


def pack(docs: DataFrame, window: int = 1024, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into windows of ``window`` ids; one row for each piece.

    sequence_id is unique over all tasks (the task's number in its upper bits) and follows the
    input's partitions; offset runs without gaps in each sequence.
    """
    path = vocabulary or vocabulary_path()
    end = np.array([end_id], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = (units := encoder(path, UNITS)).encode
        packer = Packer(window, TaskContext.get().partitionId() << 33)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * len(_FIELDS)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(_FIELDS))

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in chunks(texts.to_pylist()):
                part = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                for doc_id, ids in zip(doc_ids[a:b], encode(part), strict=True):
                    packer.add(doc_id, ids + end)
                if len(packer.rows) > 20_000:
                    yield flush()
        packer.finish()
        units.shrink()
        yield flush()

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
