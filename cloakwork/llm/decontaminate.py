"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment.

Texts are compared by their letters and digits, lower-cased; white space and marks don't count. Each
benchmark item is cut into overlapping windows of ``window`` characters (a shorter item is one
window). A text holds a window if some region of it is within ``rate`` edits a character. Such a
region shares at least L + 1 - q - k q of the window's L + 1 - q q-grams, all on diagonals at most k
apart, so they fall into one of the overlapping bands of 2 (k + 1) diagonals. Bands with enough
shared q-grams are aligned; what stays within k edits is a match.

The benchmark is sent to the tasks in blocks of at most ``BLOCK_CHARS`` characters; a larger one
takes more passes over the texts. Of items with fewer than ``least`` letters and digits no edits are
allowed, and they must begin and end at the ends of words (scripts without blanks between words have
no such ends). Null and empty texts and items match nothing; repeated rows match each; no ties arise,
as every item found is reported. Texts and items of any length count whole, empty tables give no
matches, and further columns are passed through or ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, tidy

WINDOW, RATE, Q, LEAST = 80, 0.1, 8, 24
BLOCK_CHARS = 4_000_000
#: Characters of texts that are searched at once: a worker holds about 150 bytes for each, whatever the batch.
_SLICE = 1 << 17
#: Pairs of a place and a window's q-gram that are counted at once.
_ENTRIES = 1 << 17
_NONE = np.uint32(0xFFFFFFFF)
#: From here on code points are mostly of scripts that set no blanks between words.
_NO_BLANKS = 0x2E80
_MIX = np.uint64(0x9E3779B97F4A7C15)
_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point of the basic plane the lower-case letter or digit it counts as, or 0."""
    global _fold
    if _fold is None:
        table = np.zeros(0x10000, np.uint32)
        for c in range(0x10000):
            if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalnum():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold = table
    return _fold


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The letters and digits of a text as folded code points, and where each one stands."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.where(codes < 0x10000, fold_table()[np.minimum(codes, 0xFFFF)], codes)
    at = np.flatnonzero(folded)
    return folded[at], at


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of every q-gram."""
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        # Sums over 1, 2, 4, ... characters, each half moved on by a power of the base.
        base = np.uint64(0xBF58476D1CE4E5B9)
        sums, power, have, out, done = mixed, base, 1, None, 0
        while have <= q:
            if q & have:
                part = sums[done : done + len(codes) - q + 1]
                out = part.copy() if out is None else out * power + part
                done += have
            sums = sums[:-have] * power + sums[have:]
            power = power * power
            have *= 2
        return (out ^ (out >> np.uint64(32))) * _MIX


class Index:
    """The q-grams of the windows of some benchmark items."""

    def __init__(self, items: list[tuple], window: int, rate: float, q: int, least: int):
        self.q = q
        codes, self.item, hashes, owners, offsets, short = [], [], [], [], [], []
        for item_id, text in items:
            own = normal(text or "")[0]
            if len(own) < max(least, q):
                if len(own):
                    short.append((item_id, own))
                continue
            starts = range(0, max(1, len(own) - window + 1), max(1, window // 2))
            for s in sorted({*starts, max(0, len(own) - window)}):
                part = own[s : s + window]
                found = gram_hashes(part, q)
                hashes.append(found)
                owners.append(np.full(len(found), len(codes)))
                offsets.append(np.arange(len(found)))
                codes.append(part)
                self.item.append(item_id)
        self.length = np.array([len(c) for c in codes], np.int64)
        # At least one q-gram must be shared, so the edit budget of short windows is cut to that.
        self.budget = np.minimum((self.length * rate + 1e-9).astype(np.int64), (self.length - q) // q) if codes else np.zeros(0, np.int64)
        self.need = self.length + 1 - q - self.budget * q
        self.longest = int(self.length.max(initial=0))
        self.codes = np.full((len(codes), self.longest), _NONE, np.uint32)
        for i, c in enumerate(codes):
            self.codes[i, : len(c)] = c
        if codes:
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            self.hash, self.first = np.unique(flat[order], return_index=True)
            self.last = np.append(self.first[1:], len(flat))
            self.owner, self.offset = np.concatenate(owners)[order], np.concatenate(offsets)[order]
            self.bits = max(16, int(np.ceil(np.log2(len(self.hash)))) + 5)
            self.seen = np.zeros(1 << self.bits, bool)
            self.seen[self._slot(self.hash)] = True
        #: Short items by length: their hashes, ascending, and the numbers that follow the windows' numbers.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in sorted({len(own) for _, own in short}):
            of = [(int(gram_hashes(own, size)[0]), item_id) for item_id, own in short if len(own) == size]
            of.sort(key=lambda x: x[0])
            self.short[size] = np.array([h for h, _ in of], np.uint64), np.arange(len(self.item), len(self.item) + len(of))
            self.item += [item_id for _, item_id in of]

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, codes: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(window, edits, first, last character) of each match in ``codes``, texts laid end to end.

        ``limits`` are the first characters of the texts and the end; a match lies within one text.
        """
        if not self.longest:
            return
        overlap = 2 * self.longest
        for start in range(0, max(1, len(codes)), _SLICE):
            yield from self._search(codes, limits, start, min(len(codes), start + _SLICE + overlap))

    def _search(self, codes, limits, start, end):
        if end - start < self.q:
            return
        hashes = gram_hashes(codes[start:end], self.q)
        hit = self.seen[self._slot(hashes)]
        # A region holds its q-grams within this reach: places without enough of them around are passed over.
        reach = self.longest + 2 * int(self.budget.max())
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32)])
        span = min(reach, len(hit))
        dense = np.concatenate([[0], np.cumsum(total[span:] - total[:-span] >= self.need.min(), dtype=np.int32)])
        at = np.flatnonzero(hit)
        near = dense[np.minimum(at + 1, len(dense) - 1)] > dense[np.clip(at + 1 - span, 0, len(dense) - 1)]
        at = at[near]
        k = np.minimum(np.searchsorted(self.hash, hashes[at]), len(self.hash) - 1)
        exact = self.hash[k] == hashes[at]
        at, k = at[exact], k[exact]
        if not len(at):
            return
        for owner, band in self._bands(at, k, start):
            for i in range(0, len(owner), 2048):
                yield from self._align(codes, limits, owner[i : i + 2048], band[i : i + 2048])

    def _bands(self, at: np.ndarray, k: np.ndarray, start: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and bands that share enough q-grams, from q-gram ``k`` at each place of ``at``.

        A q-gram may stand in many windows, and often in each, so places are taken in runs of about ``_ENTRIES`` pairs;
        counts are kept only of bands that later places can still reach.
        """
        ends = np.cumsum(self.last[k] - self.first[k])
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = 0
        while i < len(at):
            done = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + _ENTRIES, side="right")))
            first = self.first[k[i:j]]
            times = self.last[k[i:j]] - first
            entry = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
            owner = self.owner[entry]
            band = (np.repeat(at[i:j], times) + start - self.offset[entry]) // (self.budget[owner] + 1)
            packed, count = self._tally(owner, band)
            held, place = np.unique(np.concatenate([held, packed]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, count]), len(held)).astype(np.int64)
            owner, band = held >> 42, (held & ((1 << 42) - 1)) - (1 << 40)
            # A band holds two steps of its window's width; no place behind reaches further back than the longest window.
            over = (band + 2) * (self.budget[owner] + 1) <= at[j] + start - self.longest if j < len(at) else np.ones(len(held), bool)
            enough = over & (counts >= self.need[owner])
            yield owner[enough], band[enough]
            held, counts = held[~over], counts[~over]
            i = j

    def _tally(self, owner: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many pairs fall into each (window, band), packed as one number; each counts for its band and the one below."""
        low = int(band.min()) - 1
        span = int(band.max()) - low + 1
        owners = np.flatnonzero(np.bincount(owner, minlength=len(self.length)))
        if len(owners) * span <= 8 * _ENTRIES:
            place = np.zeros(len(self.length), np.int64)
            place[owners] = np.arange(len(owners))
            key = place[owner] * span + (band - low)
            count = np.bincount(key, minlength=len(owners) * span)
            count[:-1] += count[1:].copy() if len(count) > 1 else 0
            full = np.flatnonzero(count)
            return owners[full // span] * (1 << 42) + (full % span + low) + (1 << 40), count[full]
        return np.unique(np.concatenate([owner, owner]) * (1 << 42) + np.concatenate([band, band - 1]) + (1 << 40), return_counts=True)

    def _align(self, codes, limits, owner, band):
        """Edit distance of each window to the region around its band, free at both ends of the region."""
        if not len(owner):
            return
        budget = self.budget[owner]
        most = int(budget.max())
        origin = band * (budget + 1) - budget  # the lowest diagonal
        columns = 4 * most + 3
        # The text that the band's middle lies in; characters of other texts match nothing.
        middle = np.clip(band * (budget + 1) + budget + 1 + self.length[owner] // 2, 0, len(codes) - 1)
        text = np.searchsorted(limits, middle, side="right") - 1
        place = origin[:, None] + np.arange(columns + self.longest)
        inside = (place >= limits[text][:, None]) & (place < limits[text + 1][:, None])
        region = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], _NONE - np.uint32(1))
        pattern = self.codes[owner]
        step = np.int64(1) << 20  # an edit; the lower bits hold the column where the alignment began
        column = np.arange(columns)
        cost = np.tile(column.astype(np.int64), (len(owner), 1))
        final = cost.copy()
        for i in range(self.longest):
            diagonal = cost + step * (pattern[:, i : i + 1] != region[:, i : i + columns])
            skipped = np.concatenate([cost[:, 1:] + step, np.full((len(owner), 1), 1 << 60)], axis=1)
            cost = np.minimum(diagonal, skipped)
            cost = np.minimum.accumulate(cost - column * step, axis=1) + column * step
            ends = self.length[owner] == i + 1
            final[ends] = cost[ends]
        best = final.argmin(axis=1)
        value = final[np.arange(len(owner)), best]
        edits, began = value >> 20, value & (step - 1)
        for j in np.flatnonzero(edits <= budget):
            first = int(origin[j] + began[j])
            last = int(origin[j] + best[j] + self.length[owner[j]] - 1)
            yield int(owner[j]), int(edits[j]), max(first, int(limits[text[j]])), min(last, int(limits[text[j] + 1]) - 1)


    def exact(self, codes: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(number, first, last character) of each place of a short item within one text, by its 64-bit hash."""
        for size, (hashes, numbers) in self.short.items():
            for start in range(0, len(codes) - size + 1, _SLICE):
                own = gram_hashes(codes[start : start + _SLICE + size - 1], size)
                hit = np.flatnonzero(np.isin(own, hashes))
                hit = hit[limits[np.searchsorted(limits, hit + start, side="right")] >= hit + start + size]
                low, high = (np.searchsorted(hashes, own[hit], side=side) for side in ("left", "right"))
                for first, a, b in zip((hit + start).tolist(), low.tolist(), high.tolist(), strict=True):
                    for number in numbers[a:b].tolist():
                        yield number, first, first + size - 1


def _stands_alone(codes: np.ndarray, at: np.ndarray, first: int, last: int) -> bool:
    """Whether characters ``first`` to ``last`` of a text's letters and digits begin and end where words do."""
    left = first and at[first] - at[first - 1] == 1 and codes[first] < _NO_BLANKS and codes[first - 1] < _NO_BLANKS
    right = last + 1 < len(at) and at[last + 1] - at[last] == 1 and codes[last] < _NO_BLANKS and codes[last + 1] < _NO_BLANKS
    return not left and not right


def find(index: Index, texts: list[str | None]) -> list[dict]:
    """For each text the items it holds: item -> (windows found, fewest edits, start, end in the text)."""
    return [found for a, b in chunks(texts, _SLICE) for found in _find(index, texts[a:b])]


def _find(index: Index, texts: list[str | None]) -> list[dict]:
    parts = [normal(t or "") for t in texts]
    limits = np.cumsum([0, *(len(c) for c, _ in parts)])
    found: list[dict] = [{} for _ in texts]
    if limits[-1]:
        every = np.concatenate([c for c, _ in parts])
        for window, edits, first, last in index.search(every, limits):
            text = int(np.searchsorted(limits, first, side="right")) - 1
            at = parts[text][1]
            span = int(at[first - limits[text]]), int(at[last - limits[text]]) + 1
            windows, fewest, start, end = found[text].get(index.item[window], (set(), edits, *span))
            found[text][index.item[window]] = windows | {window}, min(fewest, edits), min(start, span[0]), max(end, span[1])
        for number, first, last in index.exact(every, limits):
            text = int(np.searchsorted(limits, first, side="right")) - 1
            codes, at = parts[text]
            first, last = first - int(limits[text]), last - int(limits[text])
            if _stands_alone(codes, at, first, last):
                _, _, start, end = found[text].get(index.item[number], (None, 0, int(at[first]), 0))
                found[text][index.item[number]] = {number}, 0, start, max(end, int(at[last]) + 1)
    return found


def _indexes(benchmark: DataFrame, window: int, rate: float, q: int, least: int, block_chars: int):
    """Broadcast indexes of the benchmark, one block of it at a time."""
    total = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_chars))
    rows = benchmark.select("item_id", "text")
    for i in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i) if blocks > 1 else rows
        index = Index([tuple(r) for r in own.collect()], window, rate, q, least)
        yield benchmark.sparkSession.sparkContext.broadcast(index)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rate: float = RATE, q: int = Q, least: int = LEAST, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, item_id, n_windows, edits, start and end (code points) of each item found in a row of ``docs`` (doc_id, text)."""
    names = ["doc_id", "item_id", "n_windows", "edits", "start", "end"]

    def searched(shared):
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                rows = []
                for doc_id, items in zip(ids, find(shared.value, texts), strict=True):
                    rows += [(doc_id, item, len(w), *rest) for item, (w, *rest) in items.items()]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        return small_batches(docs).select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))

    return reduce(DataFrame.union, map(searched, _indexes(benchmark, window, rate, q, least, block_chars)))


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rate: float = RATE, q: int = Q, least: int = LEAST, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""

    def without(left: DataFrame, shared) -> DataFrame:
        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column("text").to_pylist()
                keep = [not items for items in find(shared.value, texts)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return small_batches(left).mapInArrow(run, left.schema)

    return reduce(without, _indexes(benchmark, window, rate, q, least, block_chars), docs)
