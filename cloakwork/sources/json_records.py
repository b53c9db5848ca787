"""JSON records by many tasks: lines, single objects and arrays of any size.

An array in one file is cut by the byte ranges in which Spark reads it. Read with ``}`` as the end of a line,
every range begins and ends at such a mark, so no escape crosses a border; what a range lacks is whether it
begins inside a string, and how deep. Each range therefore tells what it does to either beginning (one small
row), the rows are composed in the order of the ranges, and a second pass cuts each range into records, beginning at
the right state. A record over a border is put together from its parts. No task reads a file whole, and the
driver holds one row for each range. Files are read by Spark's readers alone, from any store.

Records that aren't sound JSON objects never come out: they are counted by file, without their text. Elements of an
array that are neither objects nor lists, and blank lines, are passed over.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.engine import json_schema
from ..plans.tables import materialise

#: The column of a broken record's text while it is told from sound ones; it is dropped at once.
BROKEN = "__broken__"
#: Pieces at the beginning of a file that tell its layout.
HEAD = 50
_FILE, _START = "_metadata.file_path", "_metadata.file_block_start"


def brackets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Positions of all brackets, +1 or -1 for each, whether an odd number of quotes stands before it, and the number of quotes."""
    a = np.frombuffer(data, np.uint8)
    quote, back = np.flatnonzero(a == ord('"')), np.flatnonzero(a == ord("\\"))
    if len(back):
        first = back[np.diff(back, prepend=-2) > 1]
        last = back[np.diff(back, append=len(a) + 1) > 1]
        # After an odd number of backslashes a quote is a part of its string.
        quote = np.setdiff1d(quote, last[(last - first) % 2 == 0] + 1, assume_unique=True)
    at = np.flatnonzero((a == ord("{")) | (a == ord("[")) | (a == ord("}")) | (a == ord("]")))
    step = np.where((a[at] == ord("{")) | (a[at] == ord("[")), 1, -1)
    return at, step, np.searchsorted(quote, at) % 2 == 1, len(quote)


@dataclass
class State:
    """Where a range stands: inside a string or not, and the depth of brackets."""

    quoted: bool = False
    depth: int = 0


class Cutter:
    """Cuts a range that begins at ``state`` into records; ``base`` is the depth around a record."""

    def __init__(self, state: State, base: int):
        self.quoted, self.depth, self.base = state.quoted, state.depth, base
        #: Parts of the record that is open, and its number here; None if it began in an earlier range.
        self.open: list[bytes] | None = [] if state.depth > base else None
        self.number: int | None = None
        self.count = 0

    def feed(self, data: bytes) -> Iterator[tuple[int | None, bytes]]:
        """Numbers and texts of the records that end in ``data``."""
        at, step, odd, quotes = brackets(data)
        outside = odd == self.quoted
        at, step = at[outside], step[outside]
        depth = self.depth + np.cumsum(step)
        event = np.flatnonzero(((step > 0) & (depth == self.base + 1)) | ((step < 0) & (depth == self.base)))
        begin = 0
        for place, way in zip(at[event].tolist(), step[event].tolist(), strict=True):
            if way > 0:
                begin, self.open, self.number = place, [], self.count
                self.count += 1
            elif self.open is not None:
                self.open.append(data[begin : place + 1])
                yield self.number, b"".join(self.open)
                self.open = None
        if self.open is not None:
            self.open.append(data[begin:])
        self.quoted ^= bool(quotes % 2)
        if len(depth):
            self.depth = int(depth[-1])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start of the range, data) of the pieces in order; the mark that ended each piece stands again."""
    for batch in batches:
        texts, files, starts = batch.column("value").to_pylist(), batch.column("file").to_pylist(), batch.column("start").to_pylist()
        begin = 0
        for i in range(1, len(texts) + 1):
            if i == len(texts) or (files[i], starts[i]) != (files[begin], starts[begin]):
                yield files[begin], starts[begin], "".join([t + "}" for t in texts[begin:i]]).encode()
                begin = i


def name_of(path: str) -> Column:
    """The name of a file from its path, which Spark tells as a URL."""
    return F.element_at(F.split(F.try_url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B"))), "/"), -1)


def _pieces(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.text(files, lineSep="}").select("value", F.col(_FILE).alias("file"), F.col(_START).alias("start"))


def layout(head: str) -> str:
    """``lines``, ``array`` or ``object``, from the beginning of a file."""
    head = head.lstrip("﻿ \t\r\n")
    if head.startswith("["):
        return "array"
    for line in head.splitlines()[:20]:
        try:
            if isinstance(json.loads(line), dict):
                return "lines"
        except ValueError:
            pass
    return "object"


def layouts(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The layout of each file, from one job over all of them; files without text have none."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[str]] = {}
        for batch in batches:
            for value, file in zip(batch.column("value"), batch.column("file").to_pylist(), strict=True):
                if len(own := seen.setdefault(file, [])) < HEAD:
                    own.append(value.as_py() + "}")
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([layout("".join(x)) for x in seen.values()], pa.string())], names=["file", "layout"])

    first = _pieces(spark, files).where(F.col("start") == 0)
    return {r.file: r.layout for r in first.mapInArrow(heads, "file string, layout string").collect()}


def _states(pieces: DataFrame, base: dict[str, int]) -> dict[tuple[str, int], tuple[int, State]]:
    """For each range its number in the order of files and ranges, and the state in which it begins."""

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a range that begins outside (0) or inside (1) a string: the depth it adds, and whether it ends inside one.
        seen: dict[tuple[str, int], list] = {}
        for file, start, data in _runs(batches):
            own = seen.setdefault((file, start), [0, 0, False])
            _, step, odd, quotes = brackets(data)
            even_steps, odd_steps = int(step[~odd].sum()), int(step[odd].sum())
            own[0] += odd_steps if own[2] else even_steps
            own[1] += even_steps if own[2] else odd_steps
            own[2] ^= bool(quotes % 2)
        rows = [(f, s, *e) for (f, s), e in seen.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "plain", "quoted", "turns"])

    out: dict[tuple[str, int], tuple[int, State]] = {}
    now, last = State(), None
    for number, r in enumerate(sorted(pieces.mapInArrow(effects, "file string, start long, plain long, quoted long, turns boolean").collect(), key=lambda r: (r.file, r.start))):
        now = State() if r.file != last else now
        out[r.file, r.start] = number, now
        now, last = State(now.quoted ^ r.turns, now.depth + (r.quoted if now.quoted else r.plain)), r.file
    return out


def _cut(spark: SparkSession, files: list[str], base: dict[str, int]) -> DataFrame:
    """value, file and _rid (in the order of files and records) of the records of arrays and single objects."""
    pieces = _pieces(spark, files)
    known = spark.sparkContext.broadcast((_states(pieces, base), base))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, bases = known.value
        rows: list[tuple] = []
        size = 0
        cutter, of = None, None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["file", "range", "kind", "number", "value"])

        def end() -> None:
            # A part of a record that goes on in the next range: its beginning (2), or more of one that began earlier (1).
            if cutter is not None and cutter.open is not None:
                rows.append((of[0], states[of][0], 1 if cutter.number is None else 2, cutter.number, b"".join(cutter.open).decode("utf-8", "replace")))

        for file, start, data in _runs(batches):
            if (file, start) != of:
                end()
                of = (file, start)
                cutter = Cutter(states[of][1], bases[file])
            for number, text in cutter.feed(data):
                rows.append((file, states[of][0], 1 if number is None else 0, number, text.decode("utf-8", "replace")))
                size += len(text)
                if size > 1 << 22:
                    yield flush()
                    size = 0
        end()
        yield flush()

    found = materialise(pieces.mapInArrow(cut, "file string, range long, kind int, number long, value string"))
    whole = found.where("kind = 0").select("value", "file", "range", "number")
    began = F.last(F.when(F.col("kind") == 2, F.col("range")), ignorenulls=True).over(Window.partitionBy("file").orderBy("range", "kind"))
    parts = found.where("kind > 0").withColumn("began", began).groupBy("file", "began")
    joined = parts.agg(F.array_join(F.array_sort(F.collect_list(F.struct("range", "kind", "value")))["value"], "").alias("value"), F.max("number").alias("number"))
    every = whole.unionByName(joined.select("value", "file", F.col("began").alias("range"), "number"))
    return every.select("value", "file", (F.coalesce("range", F.lit(0)) * (1 << 33) + F.coalesce("number", F.lit(0))).alias("_rid"))


def texts(spark: SparkSession, files: list[str], encoding: str = "utf-8") -> DataFrame:
    """value, _source and _rid of all records of ``files``, sound or not; _rid follows their order within each file."""
    found = layouts(spark, files)
    # Spark tells the paths of files as URLs and takes them plain.
    lines = [unquote(f) for f, kind in found.items() if kind == "lines"]
    whole = [unquote(f) for f, kind in found.items() if kind != "lines"]
    parts = []
    if lines:
        read = spark.read.text(lines).select("value", F.col(_FILE).alias("file"), F.col(_START).alias("start"))
        value = F.regexp_replace("value", "^﻿", "")
        parts.append(read.select(value.alias("value"), "file", F.monotonically_increasing_id().alias("_rid")).where(F.trim("value") != ""))
    if whole:
        # Numbers of records in arrays stand beside those of lines.
        parts.append(_cut(spark, whole, {f: int(kind == "array") for f, kind in found.items()}).withColumn("_rid", F.col("_rid") + (1 << 55)))
    if not parts:
        return spark.createDataFrame([], "value string, _source string, _rid long")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return materialise(every.select("value", name_of("file").alias("_source"), "_rid"))


def parsed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the sound records with their fields, _source and _rid; _source and _rid of the broken ones)."""
    schema = json_schema(records, "value")
    if clash := sorted({BROKEN, "_rid", "_source", "_sound"} & set(schema.names)):
        raise ValueError(f"records may not have fields of these names: {', '.join(clash)}")
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    read = records.select("_source", "_rid", F.ltrim("value").startswith("{").alias("object"), F.from_json("value", wide, {"columnNameOfCorruptRecord": BROKEN}).alias("r"))
    told = materialise(read.select("_rid", "_source", (F.col("object") & F.col("r").isNotNull() & F.col(f"r.{BROKEN}").isNull()).alias("_sound"), *(F.col("r")[f.name].alias(f.name) for f in schema.fields)))
    return told.where("_sound").drop("_sound"), told.where("not _sound").select("_source", "_rid")


def read(spark: SparkSession, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sound records and broken ones of JSON files of any layout, in UTF-8."""
    return parsed(texts(spark, files))
