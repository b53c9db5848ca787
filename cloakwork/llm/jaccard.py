"""Near-duplicates by exact Jaccard similarity of word shingles: universe partitions and the pigeonhole principle.

A document's set holds the hashes of its runs of five words. Documents with equal sets are one
class. Sizes fall into bands; in the scheme of a band (for pairs whose larger set lies in it) two
sets that are similar enough differ in at most H shingles. The shingle universe is cut into
m > H segments by hash, so at least m - H segments of such a pair are equal.

* First index: a signature for the subset of each segment that isn't empty. A signature that few
  classes share gives all pairs of them; one that many share is costly. Its hub is the class among
  them that has most costly signatures.
* Each class is compared with the hub that it shares most costly signatures with, and what is
  similar becomes one group. From then on only pairs of different groups are compared, since links
  inside a group change no component: the pairs of signatures that few share, and each class with
  all hubs. A costly signature whose classes are all of one group by then has told all it can.
* A class may leave out as many other segments (empty, or costly and of several groups) as m - H - 1.
  Classes that left out more meet in a second index: (H + 1) / 2 larger segments, each with
  its one-deletion neighbourhood, of which a similar pair must share one within one shingle. Costly
  signatures are treated as in the first index, and the pairs of different groups that are left
  are found by what they and their hub differ in.

Candidates pass the size bound, a bound on the counts of 64 hash buckets and one on the parities of as many
buckets as the sets have elements; what passes all is compared exactly, by sets made from the whole texts
(as 64-bit hashes of shingles). Components are found on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, arrow_map, chunks, materialise, small_batches, tidy
from .components import connected_components

SHINGLE = 5
#: Similarity of 80 in 100: 100 * |intersection| >= 80 * |union|.
PERCENT = 80
#: Classes with one signature of which all pairs are compared; in the second index.
FEW, FEW_SECOND = 12, 24
#: Written tables of ids with up to so many rows are broadcast; beyond it they are joined by shuffle.
BROADCAST_IDS = 200_000
#: Up to so many pairs of classes are broadcast with the counts of their buckets; beyond it they are joined by shuffle.
BROADCAST_PAIRS = 20_000
_SLICE = 1 << 18
_BASE = 0xD1B54A32D192ED03
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A class id has its lowest bit free for the scheme it is used in.
_ID = np.int64(-2)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    forth, back = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
    forth[0] = back[0] = 1
    return np.cumprod(forth, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word (a run of bytes that aren't blanks, A-Z lower-cased), and the byte where it starts."""
    every = np.frombuffer(data, np.uint8)
    hashes, starts = [], []
    at = 0
    while at < len(every):
        end = min(len(every), at + _SLICE)
        if end < len(every):  # cut at a blank; a word longer than a slice is taken whole
            blank = np.flatnonzero(_BLANK[every[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:
                more = np.flatnonzero(_BLANK[every[end:]])
                end = end + int(more[0]) + 1 if len(more) else len(every)
        part = _LOWER[every[at:end]]
        inside = np.concatenate([[False], ~_BLANK[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        forth, back = _powers(1 << max(18, (len(part) - 1).bit_length()))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * forth[: len(part)], out=total[1:])
        hashes.append(mix((total[last] - total[first]) * back[first]))
        starts.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's set of shingle hashes, ascending."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    limits = np.cumsum([0, *(len(d) + 1 for d in data)])
    words, at = word_hashes(b" ".join(data))
    ends = np.searchsorted(at, limits).tolist()
    runs = words
    for k in range(1, SHINGLE):
        runs = mix(runs[:-1] * np.uint64(3) + words[k:], k) if len(runs) > 1 else runs[:0]
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            whole = words[a : a + 1]
            for k in range(a + 1, b):
                whole = mix(whole * np.uint64(3) + words[k : k + 1], 100 + k - a)
            out.append(mix(whole, 99))
        else:
            out.append(words[:0])
    return out


class Schemes:
    """Bands of set sizes, and for each band the segments of its scheme."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.low, self.high = [0], [0]

    def band(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            # Twice as wide as similar sets can differ, so that many sets have no part in the scheme of the next band.
            self.high.append(max(self.low[-1], self.low[-1] * 10_000 // self.percent**2))
        return int(np.searchsorted(self.high, size))

    def differ(self, total: int) -> int:
        """The most shingles in which similar sets of ``total`` elements together can differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, size: int) -> Iterator[tuple[int, int, int, int]]:
        """(flag, band, H of the whole scheme, H of this size) for a set's own band and, as the smaller set, the next."""
        own = self.band(size)
        self.band(self.high[own] + 1)
        for flag, band in ((0, own), (1, own + 1)):
            most = min(self.high[band], size * 100 // self.percent)
            if most >= self.low[band]:
                yield flag, band, self.differ(2 * self.high[band]), self.differ(size + most)

    def segments(self, band: int) -> int:
        """Of the first index: more than H, and large enough that few are empty."""
        h = self.differ(2 * self.high[band])
        return 1 if not h else max(h + 2, -(-self.high[band] // 4))


def _parts(values: np.ndarray, segments: int) -> np.ndarray:
    """The first element of each segment in an ascending set, and the end."""
    with np.errstate(over="ignore"):
        at = ((values >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    return np.searchsorted(at, np.arange(segments + 1, dtype=np.uint64))


def _sums(values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values, 7), out=total[1:])
    return total


def first_index(values: np.ndarray, schemes: Schemes) -> Iterator[tuple[int, np.ndarray, int]]:
    """(flag, signatures, how many more segments may be left out) for each scheme of a set."""
    total = _sums(values)
    for flag, band, _, own in schemes.of(len(values)):
        m = schemes.segments(band)
        ends = _parts(values, m)
        filled = np.flatnonzero(ends[1:] > ends[:-1])
        sums = total[ends[filled + 1]] - total[ends[filled]]
        yield flag, mix(sums + mix(filled.astype(np.uint64), 1000 + band), 1), len(filled) - own - 1


def second_index(values: np.ndarray, schemes: Schemes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures of whole segments, signatures of segments without one element) for each scheme of a set."""
    total, each = _sums(values), mix(values, 7)
    for _, band, h, _ in schemes.of(len(values)):
        m = h // 2 + 1
        ends = _parts(values, m)
        salt = mix(np.arange(m, dtype=np.uint64), 2000 + band)
        sums = total[ends[1:]] - total[ends[:-1]]
        owner = np.repeat(np.arange(m), np.diff(ends))
        yield mix(sums + salt, 2), mix(sums[owner] - each + salt[owner], 2) if h else np.zeros(0, np.uint64)


def parities(values: np.ndarray) -> bytes:
    """For each of 2^k buckets (64 at least, and one for each element) whether it has an odd number of elements, as bits."""
    m = max(64, 1 << (len(values) - 1).bit_length())
    return np.packbits(np.bincount((values & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A number of elements in which two sets of these parities differ at least."""
    p, q = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _class_id(size: int, values: np.ndarray) -> tuple[int, int, int]:
    """Two fingerprints of a set and the class id made of them."""
    a, b = int(mix(values, 11).sum(dtype=np.uint64)), int(mix(values, 12).sum(dtype=np.uint64))
    own = int(mix(np.array([a ^ (b << 1 & 0xFFFFFFFFFFFFFFFF) ^ size], np.uint64), 13)[0])
    return tuple(int(np.uint64(x).astype(np.int64)) for x in (a, b, own & 0xFFFFFFFFFFFFFFFE))


def summaries(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, f1, f2 (fingerprints), cls, spare0 and spare1 (segments its schemes may leave out), buckets, own, parities and keys.

    ``keys`` holds the signatures of the first index, the first ``own`` of them for pairs whose larger set is in the set's own
    band. Documents of one class in one task give them, and their parities, once, rows without doc_id never.
    """
    names = ("doc_id", "n", "f1", "f2", "cls", "spare0", "spare1", "buckets", "own", "parities", "keys")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, seen = Schemes(), set()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks(texts):
                rows, keys, ends = [], [], [0]
                for doc_id, values in zip(ids[a:b], shingle_sets(texts[a:b]), strict=True):
                    if not len(values):
                        rows.append((doc_id, 0, *[None] * 8))
                        ends.append(ends[-1])
                        continue
                    of_class = _class_id(len(values), values)
                    found = {flag: (keyed, more) for flag, keyed, more in first_index(values, schemes)}
                    own, next_ = found.get(0, (values[:0], None)), found.get(1, (values[:0], None))
                    odd = None
                    if doc_id is not None and of_class[2] not in seen:
                        odd = parities(values)
                        keys += own[0], next_[0]
                        ends.append(ends[-1] + len(own[0]) + len(next_[0]))
                        seen.add(of_class[2])
                    else:
                        ends.append(ends[-1])
                    buckets = np.minimum(np.diff(_parts(values, 64)), 65_535).astype("<u2").tobytes()
                    rows.append((doc_id, len(values), *of_class, own[1], next_[1], buckets, len(own[0]), odd))
                keys = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))], names=names)

    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary(), pa.int32(), pa.binary()]
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, cls long, spare0 int, spare1 int, buckets binary, own int, parities binary, keys array<long>")


def _first_signatures(table: DataFrame) -> DataFrame:
    """key and member of the first index; the member's lowest bit is the scheme's flag."""
    each = table.select("cls", "own", F.posexplode("keys").alias("at", "key"))
    return each.select("key", F.when(F.col("at") < F.col("own"), F.col("cls")).otherwise(F.col("cls") + 1).alias("member"))


def _second_signatures(docs: DataFrame) -> DataFrame:
    """key and member of the second index. The member's lowest bit tells whether an element was left out.

    Documents of one class in one task give its signatures once.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, seen = Schemes(), set()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, CHUNK_BYTES // 8):
                keys, members = [], []
                for values in shingle_sets(texts[a:b]):
                    own = _class_id(len(values), values)[2] if len(values) else None
                    if own is None or own in seen:
                        continue
                    seen.add(own)
                    for pair in second_index(values, schemes):
                        for flag, signatures in enumerate(pair):
                            keys.append(signatures)
                            members.append(np.full(len(signatures), own | flag, np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(members))], names=["key", "member"])

    return small_batches(docs).select("text").mapInArrow(run, "key long, member long")


class _Runs:
    """Candidate pairs, and costly signatures, of ascending (key, member) rows that come in batches."""

    def __init__(self, few: int, second: bool):
        self.few, self.second = few, second
        self.keys = self.members = np.zeros(0, np.int64)
        self.hub: tuple[int, int] | None = None  # key and first member of a run that is passing by

    def take(self, keys: np.ndarray, members: np.ndarray, last: bool = False):
        """kind 0: a pair of classes a, b. kind 1: a member a of the costly signature b."""
        keys, members = np.concatenate([self.keys, keys]), np.concatenate([self.members, members])
        if len(keys):
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])])
            keys, members = keys[new], members[new]
        cut = len(keys) if last else int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        done = keys[:cut], members[:cut]
        self.keys, self.members = keys[cut:], members[cut:]
        if len(self.keys) > 50_000:  # a run this long is costly in any case
            done = keys, members
            self.keys, self.members = self.keys[-1:], self.members[-1:]
            if self.hub is None or self.hub[0] != self.keys[0]:
                self.hub = int(keys[cut]), int(members[cut])
        return self._pairs(*done)

    def _pairs(self, keys, members):
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(keys)))
        a, b = [], []
        for n in np.unique(size[(size > 1) & (size <= self.few)]).tolist():
            rows = first[size == n][:, None]
            i, j = np.triu_indices(n, 1)
            x, y = members[rows + i].ravel(), members[rows + j].ravel()
            if self.second:  # two sets that both lack an element needn't be close
                close = (x & y & 1) == 0
                x, y = x[close], y[close]
            a.append(x)
            b.append(y)
        costly = [np.zeros(0, np.int64)] * 2
        long, hubs = size > self.few, members[first].copy()
        if self.hub is not None and len(first) and keys[first[0]] == self.hub[0]:
            long[0], hubs[0] = True, self.hub[1]
        if self.second:  # whole segments come first: a run that begins otherwise has none, so no candidates
            long &= (hubs & 1) == 0
        if long.any():
            at = np.flatnonzero(np.repeat(long, size))
            costly = [members[at], keys[at]]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        a, b = a & _ID, b & _ID
        low, high = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        if len(low):
            order = np.lexsort((high, low))
            low, high = low[order], high[order]
            new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            low, high = low[new], high[new]
        kind = np.repeat(np.array([0, 1], np.int8), [len(low), len(costly[0])])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([low, costly[0]])), pa.array(np.concatenate([high, costly[1]]))], names=["kind", "a", "b"])


def _few(written: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast where it is small: a join with it then deals nothing."""
    return F.broadcast(written) if written.count() <= BROADCAST_IDS else written


def _hubs(costly: DataFrame) -> DataFrame:
    """key, fame and hub: of each costly signature the class that has most of them. ``costly`` has key, cls and whole.

    Copies of one text share more signatures with it than with each other, so it links most of them.
    Only classes with the whole segment can be hubs.
    """
    wholes = costly.where("whole")
    fame = wholes.groupBy("cls").agg(F.count("*").alias("fame"))
    return wholes.join(fame, "cls").groupBy("key").agg(F.max(F.struct("fame", "cls")).alias("best")).select("key", "best.fame", F.col("best.cls").alias("hub"))


def _nearest(costly: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each class (a) with the hub (b) of most of its costly signatures."""
    met = costly.join(hubs, "key").where("cls <> hub").select("cls", "hub", "fame").repartition("cls")
    votes = met.groupBy("cls", "hub").agg(F.count("*").alias("n"), F.first("fame").alias("fame"))
    return votes.groupBy("cls").agg(F.max(F.struct("n", "fame", "hub"))["hub"].alias("b")).select(F.col("cls").alias("a"), "b")


def _stars(costly: DataFrame, hubs: DataFrame) -> DataFrame:
    """Each class of a costly signature (a) with its hub (b)."""
    return costly.join(hubs.select("key", "hub"), "key").where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes in different groups."""
    of = [groups.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")) for x in ("a", "b")]
    met = pairs.join(of[0], "a", "left").join(of[1], "b", "left")
    return met.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")


def _mixed(costly: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of costly signatures (key, cls, ...) that are shared by classes of several groups, with ``component``."""
    own = costly.join(groups.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    several = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return materialise(own.join(several, "key"), "jaccard-mixed")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (id, component) after further links (a, b), which are taken between groups; without any, ``groups`` itself."""
    if links.isEmpty():
        return groups
    ends = links
    for x in ("a", "b"):
        of = groups.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
        ends = ends.join(of, x, "left").withColumn(f"of_{x}", F.coalesce(f"of_{x}", x))
    edges = ends.select("of_a", "of_b").union(ends.select("a", "of_a")).union(ends.select("b", "of_b")).union(groups.select("id", "component"))
    return _few(materialise(connected_components(edges), "jaccard-groups"))


def _collisions(signatures: DataFrame, few: int, second: bool) -> DataFrame:
    """kind, a, b as ``_Runs`` gives them, as a written table."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(few, second)
        for batch in batches:
            yield runs.take(batch.column("key").to_numpy(), batch.column("member").to_numpy())
        yield runs.take(np.zeros(0, np.int64), np.zeros(0, np.int64), last=True)

    order = ["key", F.col("member").bitwiseAND(F.lit(1)), "member"] if second else ["key", "member"]
    ordered = signatures.repartition("key").sortWithinPartitions(*order)
    return materialise(ordered.mapInArrow(run, "kind byte, a long, b long"), "jaccard-collisions")


def _costly(met: DataFrame) -> DataFrame:
    """key, cls, flag and whole of the rows of costly signatures."""
    flag = F.col("a").bitwiseAND(F.lit(1))
    return met.where("kind = 1").select(F.col("b").alias("key"), (F.col("a") - flag).alias("cls"), flag.alias("flag"), (flag == 0).alias("whole"))


def _texts(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cls and text of the classes in ``wanted``; a class whose document's id is repeated has other texts besides. A written table."""
    rows = materialise(wanted.distinct().join(classes.select("cls", F.col("rep").alias("doc_id")), "cls"), "jaccard-wanted")
    few = rows.count() <= BROADCAST_IDS
    return materialise(docs.select("doc_id", "text").join(F.broadcast(rows) if few else rows, "doc_id").select("cls", "text"), "jaccard-texts")


def _sides(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b and text: a's text for each pair of ``pairs`` (a, b), and once b's own text, where a is null. A written table.

    Texts get their pairs where they are read, so they are dealt only once, by b.
    """
    of = classes.select("cls", F.col("rep").alias("doc_id"))
    first = pairs.join(of.withColumnRenamed("cls", "a"), "a").select("doc_id", "a", "b")
    second = pairs.select("b").distinct().join(of.withColumnRenamed("cls", "b"), "b").select("doc_id", F.lit(None).cast("long").alias("a"), "b")
    rows = materialise(first.union(second), "jaccard-wanted")
    few = rows.count() <= BROADCAST_IDS
    return materialise(docs.select("doc_id", "text").join(F.broadcast(rows) if few else rows, "doc_id").select("a", "b", "text"), "jaccard-texts")


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cls and shingles (a set's hashes, ascending) of the classes in ``wanted``. A written table."""

    def sets(columns):
        texts = columns["text"].to_pylist()
        for a, b in chunks(texts):
            found = [v for v in shingle_sets(texts[a:b]) if len(v)]
            yield {"cls": [_class_id(len(v), v)[2] for v in found], "shingles": [v.tobytes() for v in found]}

    read = arrow_map(_texts(wanted, classes, docs).select("text"), sets, "cls long, shingles binary")
    return materialise(read.join(wanted.distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "jaccard-sets")


def _pivots(hot: DataFrame, hubs: DataFrame) -> DataFrame:
    """key, hub: for each costly signature one of few hubs, the one that leads most of its members."""
    led = hot.join(hubs, "key").groupBy("cls", "hub").agg(F.count("*").alias("n"))
    cover = led.groupBy("hub").agg(F.sum("n").alias("cover"))
    first = led.join(cover, "hub").groupBy("cls").agg(F.max(F.struct("cover", "hub"))["hub"].alias("hub"))
    votes = hot.join(first, "cls").groupBy("key", "hub").agg(F.count("*").alias("n"))
    return votes.groupBy("key").agg(F.max(F.struct("n", "hub"))["hub"].alias("hub"))


def _across(hot: DataFrame, hubs: DataFrame, classes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b) among members of costly signatures in different groups, and links of members with their hubs.

    ``hot`` has key, cls and component. D(x) is what set x and its hub h differ in. Two members u and x differ in |D(u)| + |D(x)| - 2 o
    shingles, o of them common to D(u) and D(x), so similar ones need a certain o. Members similar to h
    are linked by it; in other pairs one, u, isn't similar to h, and |D(u)| > (|h| + |u|) / 9 gives
    o > (|D(x)| + (|h| - |x|) / 9) / 2. With the elements of every D in one order, rarest first, sets
    that have o elements in common share one of the first |D| - o + 1.
    """
    members = materialise(hot.join(_pivots(hot, hubs), "key").select("hub", "cls", "component").distinct(), "jaccard-members")
    sets = _sets(members.select("cls").union(members.select(F.col("hub").alias("cls"))), classes, docs)

    def differ(columns):
        rows = []
        for x, h in zip(columns["x"], columns["h"], strict=True):
            x, h = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(h.as_py(), np.uint64)
            d = np.setxor1d(x, h, assume_unique=True)
            rows.append((len(x), len(h), d.view(np.int64), len(d) * (100 + PERCENT) <= (len(x) + len(h)) * (100 - PERCENT)))
        n, m, d, near = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
        yield {"hub": columns["hub"], "cls": columns["cls"], "component": columns["component"], "n": n, "m": m, "d": d, "near": near}

    full = members.join(sets.select("cls", F.col("shingles").alias("x")), "cls").join(sets.select(F.col("cls").alias("hub"), F.col("shingles").alias("h")), "hub")
    kind = "hub long, cls long, component long, n long, m long, d array<long>, near boolean"
    found = materialise(arrow_map(full.select("hub", "cls", "component", "x", "h"), differ, kind), "jaccard-differences")
    each = found.select("hub", "cls", "component", "n", "m", "near", F.size("d").alias("size"), F.explode("d").alias("e"))
    common = each.groupBy("hub", "e").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("hub", "cls").orderBy("times", "e"))
    # The least o with a partner that isn't similar to the hub, and with any partner.
    inv = (100 + PERCENT) / (100 - PERCENT)
    half = F.greatest(F.lit(1), F.floor((F.col("size") + (F.col("m") - F.col("n")) / inv) / 2 - 1e-6) + 1)
    any_ = F.greatest(F.lit(1), F.ceil((F.col("size") - (F.col("m") + F.col("n")) / inv) / 2 - 1e-6))
    ranked = each.join(common, ["hub", "e"]).withColumn("place", place)
    ranked = ranked.withColumns({"half": F.col("place") <= F.col("size") - half + 1, "long": F.col("place") <= F.col("size") - any_ + 1})
    ranked = materialise(ranked.where("half or (long and not near)").select("hub", "e", "cls", "component", "n", "size", "place", "near", "half", "long"), "jaccard-prefixes")

    def met(x: DataFrame, y: DataFrame, more: str) -> DataFrame:
        pair = x.alias("x").join(y.alias("y"), ["hub", "e"])
        need = (F.col("x.size") + F.col("y.size") - (F.col("x.n") + F.col("y.n")) / inv) / 2 - 1e-6
        # What can still be common from here on; at the first common element that is all of it.
        rest = 1 + F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
        fits = (rest >= need) & (100 * F.least("x.n", "y.n") >= PERCENT * F.greatest("x.n", "y.n")) & (F.least("x.size", "y.size") >= need)
        return pair.where(fits & F.expr("x.component <> y.component") & F.expr(more)).select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))

    near, far = ranked.where("near and half"), ranked.where("not near")
    pairs = met(near, far.where("long"), "true").union(met(far.where("half"), far.where("half"), "x.cls < y.cls")).distinct()
    return pairs, found.where("near and cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b"))


def _close(near: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of ``near`` (a, b, most) whose classes differ in at most ``most`` elements as far as their parities tell. A written table."""

    def bound(columns):
        each = zip(columns["p"], columns["q"], columns["most"].to_pylist(), strict=True)
        keep = pa.array([least_difference(x.as_py(), y.as_py()) <= most for x, y, most in each], pa.bool_())
        yield {c: columns[c].filter(keep) for c in ("a", "b")}

    wanted, few = near.select(F.col("a").alias("cls")).union(near.select("b")), near.count() <= BROADCAST_IDS
    wanted = F.broadcast(wanted) if few else wanted.distinct()
    # Only the parities of these classes are dealt, each once.
    own = sketches.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("parities").alias("parities"))
    full = own.select(F.col("cls").alias("a"), F.col("parities").alias("p")).join(F.broadcast(near) if few else near, "a")
    full = full.join(own.select(F.col("cls").alias("b"), F.col("parities").alias("q")), "b")
    return materialise(arrow_map(full.select("a", "b", "most", "p", "q"), bound, "a long, b long"), "jaccard-close")


def _similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, sketches: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar: first by bounds, then exactly. A written table.

    Many pairs best have their common class as b: its set is then made once a batch. ``sketches`` has cls and parities
    of every class, repeated rows included.
    """
    facts = classes.select("cls", "n", "buckets")

    def bound(columns):
        x, y = columns["n"].to_numpy(), columns["m"].to_numpy()
        most = (x + y) * (100 - PERCENT) // (100 + PERCENT)
        ok = 100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)
        if len(x):
            # In Arrow, binaries of one length lie end to end.
            p, q = (np.frombuffer(b"".join(columns[c].to_pylist()), "<u2").reshape(-1, 64).astype(np.int64) for c in ("p", "q"))
            ok &= np.abs(p - q).sum(axis=1) <= most
        keep = pa.array(ok)
        yield {"a": columns["a"].filter(keep), "b": columns["b"].filter(keep), "most": pa.array(most).filter(keep)}

    pairs = materialise(pairs.distinct(), "jaccard-pairs")
    firsts = facts.select(F.col("cls").alias("a"), "n", F.col("buckets").alias("p"))
    seconds = facts.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("buckets").alias("q"))
    if pairs.count() <= BROADCAST_PAIRS:
        pairs, seconds = F.broadcast(pairs), F.broadcast(seconds.join(F.broadcast(pairs.select("b")), "b", "left_semi"))
    near = firsts.join(pairs, "a").join(seconds, "b")
    near = near.where(f"100 * least(n, m) >= {PERCENT} * greatest(n, m)")
    near = materialise(arrow_map(near.select("a", "b", "n", "m", "p", "q"), bound, "a long, b long, most long"), "jaccard-near")
    if sketches is not None and not near.isEmpty():
        near = _close(near, sketches)
    if near.isEmpty():
        return near.select("a", "b")
    texts = _sides(near, classes, docs)
    held: dict[tuple[int, str], np.ndarray] = {}

    def exact(columns):
        a, b = columns["a"].to_pylist(), columns["b"].to_pylist()
        sides = list(zip(a, columns["x"].to_pylist(), strict=True)), list(zip(b, columns["y"].to_pylist(), strict=True))
        every = list(dict.fromkeys([*sides[0], *sides[1]]))
        new = [k for k in every if k not in held]
        texts = [t for _, t in new]
        for i, j in chunks(texts):
            held.update(zip(new[i:j], shingle_sets(texts[i:j]), strict=True))
        kept = []
        for k, m in zip(*sides, strict=True):
            x, y = held[k], held[m]
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * both >= PERCENT * (len(x) + len(y) - both) and all(_class_id(len(v), v)[2] == c for c, v in ((k[0], x), (m[0], y))))
        for k in held.keys() - set(sides[1][-1:]):
            del held[k]
        keep = pa.array(kept, pa.bool_())
        yield {"a": columns["a"].filter(keep), "b": columns["b"].filter(keep)}

    full = texts.where("a is not null").select("a", "b", F.col("text").alias("x")).join(texts.where("a is null").select("b", F.col("text").alias("y")), "b")
    return materialise(arrow_map(full.select("a", "b", "x", "y"), exact, "a long, b long"), "jaccard-links")


def _met(costly: DataFrame, pairs: DataFrame, groups: DataFrame | None, classes: DataFrame, docs: DataFrame, sketches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups after an index: its costly signatures' classes with their nearest hubs, then all else that is apart.

    Gives the groups, the rows of costly signatures of several groups, and the hubs.
    """
    hubs = _few(materialise(_hubs(costly), "jaccard-hubs"))
    first = _nearest(costly, hubs)
    links = _similar(first if groups is None else _apart(first, groups), classes, docs, sketches)
    groups = _few(materialise(connected_components(links), "jaccard-groups")) if groups is None else _merged(groups, links)
    mixed = _mixed(costly, groups)
    links = _similar(_apart(pairs.union(_stars(mixed, hubs)), groups), classes, docs, sketches)
    merged = _merged(groups, links)
    return merged, mixed if merged is groups else _mixed(mixed.drop("component"), merged), hubs


def _rest(docs: DataFrame, classes: DataFrame, sketches: DataFrame, mixed: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with the links that the first index may have missed: between classes that left out too many segments."""
    left = mixed.groupBy("cls", "flag").agg(F.countDistinct("key").alias("left"))
    wide = left.groupBy("cls").agg(F.max(F.when(F.col("flag") == 0, F.col("left"))).alias("left0"), F.max(F.when(F.col("flag") == 1, F.col("left"))).alias("left1"))
    short = (F.coalesce("spare0", F.lit(0)) < F.coalesce("left0", F.lit(0))) | (F.coalesce("spare1", F.lit(0)) < F.coalesce("left1", F.lit(0)))
    again = materialise(classes.join(wide, "cls", "left").where(short).select("cls"), "jaccard-again")
    if again.isEmpty():
        return groups
    met = _collisions(_second_signatures(_texts(again, classes, docs)), FEW_SECOND, second=True)
    groups, mixed, hubs = _met(materialise(_costly(met), "jaccard-costly"), met.where("kind = 0").select("a", "b"), groups, classes, docs, sketches)
    if mixed.isEmpty():
        return groups
    pairs, direct = _across(mixed.select("key", "cls", "component"), hubs.select("key", "hub"), classes, docs)
    return _merged(groups, direct.union(_similar(pairs, classes, docs, sketches)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and are their own component; a text of fewer than five
    words has one shingle. Repeated rows each get a row; rows without doc_id aren't linked and have no component.
    An empty table gives no rows, texts of any length count whole, ties need no rule (a component's id is its
    smallest doc_id), and further columns of ``docs`` are ignored, whatever their names.
    """
    table = materialise(summaries(docs), "jaccard-summaries")
    docs = docs.where("doc_id is not null")
    told = table.where("n > 0 and doc_id is not null")
    classes = told.groupBy("n", "f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.first("cls").alias("cls"), F.first("spare0").alias("spare0"), F.first("spare1").alias("spare1"), F.first("buckets").alias("buckets")
    )
    classes = materialise(classes, "jaccard-classes")
    sketches = table.where("parities is not null").select("cls", "parities")
    met = _collisions(_first_signatures(table), FEW, second=False)
    costly = materialise(_costly(met), "jaccard-costly")
    groups, mixed, _ = _met(costly, met.where("kind = 0").select("a", "b"), None, classes, docs, sketches)
    groups = _rest(docs, classes, sketches, mixed, groups)
    named = groups.join(classes.select(F.col("cls").alias("id"), "rep"), "id")
    names = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = named.join(names, "component").select(F.col("id").alias("cls"), "component_id")
    of_class = classes.join(linked, "cls", "left").select("f1", "f2", "n", F.coalesce("component_id", "rep").alias("component_id"))
    return table.select("doc_id", "n", "f1", "f2").join(of_class, ["n", "f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
