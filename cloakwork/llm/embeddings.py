"""Near-duplicate embeddings by sorted projection passes.

Equal vectors of one label are one class. In each pass the classes are ordered by label and a string
of random projection signs, and each is compared with its next ``neighbours``; pairs of cosine
``threshold`` or more are links. The passes' links are united and their components found on Spark:
groups. Bounded windows miss links, so each vector is then compared with all of its label, block by
block, leaving out what lies too far from a tile of a group to link with any of it. Links are counted,
and those between groups join them, so links and components are exact; the passes save work only.

Vectors that are null, zero or hold null or non-finite components, and those without a label, link
with nothing; vectors of other lengths are compared with their like only. Rows without vec_id aren't
linked. Ties in the order go by class; repeated rows of a vec_id count as vectors each. An empty table gives no
rows; columns besides vec_id, embedding and label are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise, tidy
from .components import connected_components

PASSES, BITS, NEIGHBOURS = 16, 64, 10
THRESHOLD = 0.98
#: Vectors of a label in one block, as long as it has at most so many blocks; then blocks grow. Two blocks are compared at once.
BLOCK, BLOCKS, LARGEST = 512, 16, 32_768
#: Vectors that are compared with a block at once; those of one group stand together.
TILE = 256
_SEED = 20_240_607


def planes(number: int, bits: int, length: int) -> np.ndarray:
    """The random directions of a pass for vectors of a length."""
    return np.random.default_rng([_SEED, number, length]).standard_normal((length, bits))


def _vectors(column) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out: list[np.ndarray | None] = []
    for value in column:
        value = None if not value.is_valid or value.values.null_count else value.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if value is None or not len(value) or not np.isfinite(value).all() or not value.any():
            out.append(None)
        else:
            value = value / np.abs(value).max()  # squares of very large or small components stay finite
            out.append(value / np.sqrt(value @ value))
    return out


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, unit (little-endian doubles, null if the vector links with nothing) and a fingerprint of the given components."""

    def run(columns):
        units = [None if v is None else v.tobytes() for v in _vectors(columns["embedding"])]
        yield {"vec_id": columns["vec_id"], "label": columns["label"], "unit": units}

    read = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return arrow_map(read, run, "vec_id long, label string, unit binary").withColumn("unit", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("unit")))


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column.to_pylist()])


def _windows(classes: DataFrame, passes: int, bits: int, neighbours: int, threshold: float) -> DataFrame:
    """Verified links (a, b) that the passes show."""

    def keyed(columns):
        units = columns["unit"].to_pylist()
        lengths = np.array([len(u) // 8 for u in units])
        for number in range(passes):
            keys: list = [None] * len(units)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                signs = np.packbits(np.stack([np.frombuffer(units[i], "<f8") for i in own]) @ planes(number, bits, length) > 0, axis=1)
                for i, sign in zip(own.tolist(), signs, strict=True):
                    keys[i] = sign.tobytes()
            yield {"pass": [number] * len(units), "label": columns["label"], "length": lengths, "sign": keys, "id": columns["id"], "unit": columns["unit"]}

    kind = "pass int, label string, length int, sign binary, id long, unit binary"
    order = ["pass", "label", "length", "sign", "id"]
    ordered = arrow_map(classes, keyed, kind).repartitionByRange(*order).sortWithinPartitions(*order)

    def compare(batch: pa.RecordBatch, fresh: int, tally: list) -> None:
        """Compare each row from ``fresh`` on with the ``neighbours`` before it."""
        group = np.unique(np.array([f"{p}/{n}/{x}" for p, n, x in zip(*(batch.column(c).to_pylist() for c in ("pass", "length", "label")), strict=True)]), return_inverse=True)[1]
        ids, units = batch.column("id").to_numpy(), batch.column("unit").to_pylist()
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            unit = np.stack([np.frombuffer(units[i], "<f8") for i in rows])
            for k in range(1, min(neighbours, len(rows) - 1) + 1):
                near = (np.einsum("ij,ij->i", unit[:-k], unit[k:]) >= threshold) & (rows[k:] >= fresh)
                tally.append((ids[rows[:-k]][near], ids[rows[k:]][near]))

    names = ["kind", "pass", "label", "length", "sign", "id", "unit", "other"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]

    def linked(tally: list) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in tally] or [np.zeros(0, np.int64)])
        b = np.concatenate([x for _, x in tally] or [np.zeros(0, np.int64)])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        n = pairs.shape[1]
        empty = [pa.nulls(n, k) for k in kinds]
        empty[0], empty[5], empty[7] = pa.array(np.full(n, -1, np.int32)), pa.array(pairs[0]), pa.array(pairs[1])
        return pa.RecordBatch.from_arrays(empty, names=names)

    def edge(rows: pa.RecordBatch, border: int) -> pa.RecordBatch:
        columns = [pa.array(np.full(rows.num_rows, border, np.int32)), *(rows.column(c) for c in names[1:7]), pa.nulls(rows.num_rows, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    @tidy
    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of a range; its first and last rows go out again, to be compared across the border to the next."""
        from pyspark import TaskContext

        border = TaskContext.get().partitionId()
        tail: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if tail is None:
                yield edge(batch.slice(0, neighbours), border)
                whole, fresh = batch, 0
            else:
                whole, fresh = pa.concat_batches([tail, batch]), tail.num_rows
            for start in range(fresh, whole.num_rows, 4096):
                begin = max(0, start - neighbours)
                tally: list = []
                compare(whole.slice(begin, start + 4096 - begin), start - begin, tally)
                yield linked(tally)
            tail = whole.slice(max(0, whole.num_rows - neighbours))
        if tail is not None:
            yield edge(tail, border + 1)

    # kind -1: a link id - other; else a row beside the border of that number.
    schema = "kind int, pass int, label string, length int, sign binary, id long, unit binary, other long"
    slid = materialise(ordered.mapInArrow(slide, schema), "embedding-windows")

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        tally: list = []
        for batch in table.combine_chunks().to_batches():
            compare(batch, 0, tally)
        found = linked(tally)
        return pa.table({"a": found.column("id"), "b": found.column("other")})

    borders = slid.where("kind >= 0").drop("other").groupBy("kind").applyInArrow(across, "a long, b long")
    return slid.where("kind = -1").select(F.col("id").alias("a"), F.col("other").alias("b")).union(borders).distinct()


def _meet(own: pa.Table, other: pa.Table | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row of two blocks, by weight, and the pairs of groups that links join. Without ``other`` a block meets itself."""
    a, b = own, own if other is None else other
    ids, weights, groups, units = zip(*((t["id"].to_numpy(), t["weight"].to_numpy(), t["group"].to_numpy(), _matrix(t["unit"])) for t in (a, b)), strict=True)
    links = [np.zeros(len(x)) for x in ids]
    pairs = [np.zeros((0, 2), np.int64)]
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    for start in range(0, len(ids[0]), TILE):
        tile = slice(start, start + TILE)
        unit = units[0][tile]
        # Links of the tile lie within reach of the ball around it.
        centre = unit.mean(axis=0)
        radius = np.sqrt(((unit - centre) ** 2).sum(axis=1).max())
        far = np.sqrt(np.maximum(0.0, 1 - 2 * (units[1] @ centre) + centre @ centre)) > radius + reach
        if other is None:
            far[:start] = True
        beside = np.flatnonzero(~far)
        for begin in range(0, len(beside), 4096):
            near = beside[begin : begin + 4096]
            i, j = np.nonzero(unit @ units[1][near].T >= threshold)
            i, j = i + start, near[j]
            if other is None:
                i, j = i[i < j], j[i < j]
            links[0] += np.bincount(i, weights[1][j], len(links[0]))
            links[1] += np.bincount(j, weights[0][i], len(links[1]))
            joined = np.stack([groups[0][i], groups[1][j]], axis=1)
            joined = np.sort(joined[joined[:, 0] != joined[:, 1]], axis=1)
            if len(joined):
                pairs.append(np.unique(joined, axis=0))
    if other is None:
        return ids[0], links[0] + links[1], np.unique(np.concatenate(pairs), axis=0)
    return np.concatenate(ids), np.concatenate(links), np.unique(np.concatenate(pairs), axis=0)


def _completed(members: DataFrame, threshold: float) -> DataFrame:
    """All links of ``members`` (label, group, id, weight, unit), each compared with all of its label and length by pairs of blocks.

    Rows of kind 0: a is an id and b a number of its links; of kind 1: a and b are groups that a link joins.
    """
    of = ["label", "length"]
    members = members.withColumn("length", F.length("unit"))
    # Labels of up to BLOCKS * BLOCK vectors have blocks of about BLOCK; beyond it blocks grow up to LARGEST.
    blocks = F.greatest(F.least(F.ceil(F.count("*") / BLOCK), F.lit(BLOCKS)), F.ceil(F.count("*") / LARGEST)).cast("int")
    dealt = members.join(members.groupBy(*of).agg(blocks.alias("blocks")), of).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    met = dealt.select(*of, "block", every, "group", "id", "weight", "unit").withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("with")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("id", "ascending")])
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        own = table.filter(pc.equal(table["block"], low))
        other = None if low == high else table.filter(pc.equal(table["block"], high))
        if not len(own) or other is not None and not len(other):
            ids, links, pairs = np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 2), np.int64)
        else:
            ids, links, pairs = _meet(own, other, threshold)
        linked = links > 0
        kinds = np.repeat(np.array([0, 1], np.int32), [linked.sum(), len(pairs)])
        return pa.table({"kind": kinds, "a": np.concatenate([ids[linked], pairs[:, 0]]), "b": np.concatenate([links[linked].astype(np.int64), pairs[:, 1]])})

    return met.groupBy(*of, "low", "high").applyInArrow(compare, "kind int, a long, b long")


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, bits: int = BITS, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings`` (vec_id, embedding, label)."""
    rows = materialise(prepared(embeddings), "embedding-units")
    classes = rows.where("unit is not null").groupBy("label", "unit").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    # Repeated ids with other vectors: the class keeps a number of its own beside the smallest id.
    classes = classes.withColumn("key", F.xxhash64("label", "unit"))
    classes = materialise(classes, "embedding-classes")
    links = materialise(_windows(classes.select("label", "unit", F.col("key").alias("id")), passes, bits, neighbours, threshold), "embedding-links")
    groups = materialise(connected_components(links), "embedding-groups").withColumnRenamed("id", "key")
    members = classes.join(groups, "key", "left").select("label", F.coalesce("component", "key").alias("group"), "key", F.col("id").alias("smallest"), "weight", "unit")
    members = materialise(members, "embedding-members")
    found = materialise(_completed(members.select("label", "group", F.col("key").alias("id"), "weight", "unit"), threshold), "embedding-completed")
    counted = found.where("kind = 0").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("links"))
    # Groups that the passes left apart.
    joined = materialise(connected_components(found.where("kind = 1").select("a", "b")), "embedding-joined").withColumnRenamed("id", "group")
    members = members.join(joined, "group", "left").select("key", F.coalesce("component", "group").alias("component"), "smallest")
    names = members.groupBy("component").agg(F.min("smallest").alias("component_id"))
    facts = members.join(names, "component").join(counted, "key", "left")
    facts = facts.select("key", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    known = classes.join(facts, "key", "left").select("label", "unit", F.coalesce("component_id", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(known, ["label", "unit"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
