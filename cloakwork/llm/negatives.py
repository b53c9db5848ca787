"""Hard negatives of anchors by cover trees over norm-augmented vectors, with exact integer inner products.

A vector x of a tree whose longest has length M gets one more component, so that all have length M: for
an anchor a the nearest point is then the one of the largest inner product, as |a - x|^2 = |a|^2 + M^2 - 2ax.
Vectors of a label are dealt into trees of bounded size. A tree is made from the greedy order (each point
is the farthest from those before it): the points of distance over 2^i to all before them are level i, a
point hangs under the nearest point of the levels above its own, and for each node the covering radius of
what its levels below i hold is kept. From an anchor's exact product with a node and that radius follow the
largest and the smallest product under the node. A descent takes the node of the largest bound first,
passes over nodes outside all windows (or below what the windows hold already), and verifies each point
that it meets by its exact product.

First the anchors meet the trees of their own label: the best ones are their positives. Each positive's
score opens a window, and the anchors meet the trees of the other labels. Trees and anchors are dealt into
cells of bounded size, so every anchor meets every tree (the anchors are a stated query set), no task holds
a label, and the best of each cell are ranked at the end.

Rows with a null id, label or vector, with null or non-finite components (before or after scaling), or
whose scaled length reaches 2^31 (a score might not be a long) take no part; vectors of other lengths meet
their like only, vectors of no components score 0. Repeated rows count each; a row is never its own
positive, but a copy of it may be. Ties go by id. An empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Percent of a positive's score between which its negatives lie.
LOW, HIGH = 50, 95
#: Vectors in a tree; components (of all vectors together) in a cell of trees; anchors in a cell.
TREE, CELL, ANCHORS = 4096, 1 << 19, 2048
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_BOTTOM = -(1 << 15)
#: Anchors that meet the first nodes of a tree at once; partitions of the cells at most.
_TOGETHER, _TASKS = 256, 2000


def prepared(rows: DataFrame, anchor: Column, scale: int) -> DataFrame:
    """rid (unique), vec_id, label, anchor, length and q (floor(scale * x) as little-endian longs) of the rows that take part."""

    def run(columns):
        out: list[bytes | None] = []
        for value in columns["embedding"]:
            if not value.is_valid or value.values.null_count:
                out.append(None)
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                q = np.floor(scale * value.values.to_numpy(zero_copy_only=False).astype(np.float64))
                fits = bool(np.isfinite(q).all()) and float(q @ q) < 2.0**62
            out.append(q.astype("<i8").tobytes() if fits else None)
        yield {c: columns[c] for c in ("rid", "vec_id", "label", "anchor")} | {"length": [0 if q is None else len(q) // 8 for q in out], "q": out}

    given = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding"))
    given = given.where("vec_id is not null and label is not null and embedding is not null").withColumn("rid", F.monotonically_increasing_id())
    return arrow_map(given, run, "rid long, vec_id long, label string, anchor boolean, length int, q binary").where("q is not null")


def _matrix(column, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), length)


def cover(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """order, parent, level and reach of a cover tree over the integer rows of ``x``.

    ``order`` is the greedy order; the others go by place in it. The root is its own parent; ``reach`` is the
    largest (augmented) distance from a node's parent to anything under the node.
    """
    n = len(x)
    f = x.astype(np.float64)
    square = np.einsum("ij,ij->i", f, f)
    extra = np.sqrt(square.max() - square)
    f = np.concatenate([f, extra[:, None]], axis=1)
    square = np.einsum("ij,ij->i", f, f)

    def distance(a, b) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, ((f[a] - f[b]) ** 2).sum(axis=-1)))

    order, parent, level = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, _BOTTOM, np.int64)
    place = np.full(n, -1, np.int64)
    nearest, least = np.zeros(n, np.int64), np.full(n, np.inf)
    above, current, point, t = nearest, _MOST, 0, 0
    while True:
        order[t], place[point] = point, t
        d = np.maximum(0.0, square + square[point] - 2 * (f @ f[point]))
        d[point] = 0.0
        closer = d < least
        nearest = np.where(closer, point, nearest)
        least = np.where(closer, d, least)
        if t == 0:
            level[0] = _MOST >> 1
        t += 1
        point = int(least.argmax())
        # Different vectors of integers are 1 apart at least; what is left are copies.
        if t == n or least[point] < 0.5:
            break
        own = int(np.ceil(np.log2(least[point]) / 2)) - 1
        if own < current:
            above, current = nearest, own
        level[t], parent[t] = own, place[above[point]]
    rest = np.flatnonzero(place < 0)
    order[t:], place[rest] = rest, np.arange(t, n)
    parent[t:] = place[nearest[rest]]
    reach = np.zeros(n)
    at, branch = parent.copy(), np.arange(n)
    inner = np.flatnonzero(branch > 0)
    while len(inner):
        np.maximum.at(reach, branch[inner], distance(order[inner], order[at[inner]]))
        branch[inner], at[inner] = at[inner], parent[at[inner]]
        inner = inner[branch[inner] > 0]
    return order, parent, level, reach


def _index(vectors: DataFrame, tree: int, cell: int) -> DataFrame:
    """The nodes of all trees, one row each."""
    room = F.greatest(F.lit(1), F.floor(F.lit(cell) / F.greatest(F.col("length"), F.lit(1))))
    sizes = vectors.groupBy("length", "label").agg(F.count("*").alias("n")).withColumn("trees", F.ceil(F.col("n") / F.least(F.lit(tree), room)))
    dealt = vectors.join(sizes.select("length", "label", "trees"), ["length", "label"]).withColumn("tree", F.pmod(F.xxhash64("rid"), "trees").cast("int"))

    def build(table: pa.Table) -> pa.Table:
        length = table["length"][0].as_py()
        order, parent, level, reach = cover(_matrix(table["q"], length))
        table = table.take(pa.array(order))
        columns = {c: table[c] for c in ("length", "label", "tree", "rid", "vec_id", "q")}
        return pa.table(columns | {"place": np.arange(len(order)), "parent": parent, "level": level, "reach": reach})

    schema = "length int, label string, tree int, rid long, vec_id long, q binary, place long, parent long, level long, reach double"
    return dealt.select("length", "label", "tree", "rid", "vec_id", "q").groupBy("length", "label", "tree").applyInArrow(build, schema)


class Tree:
    """A tree of the index, ready for descents."""

    def __init__(self, table: pa.Table, length: int):
        table = table.sort_by("place")
        self.label = table["label"][0].as_py()
        self.rid, self.vec_id = table["rid"].to_numpy(), table["vec_id"].to_numpy()
        self.q = _matrix(table["q"], length)
        self.f = self.q.astype(np.float64)
        self.square = float(np.einsum("ij,ij->i", self.f, self.f).max())
        parent, level, reach = (table[c].to_numpy() for c in ("parent", "level", "reach"))
        nodes = np.arange(1, len(parent))
        # Children by parent, from the highest level down; groups of one parent and level.
        self.child = child = nodes[np.lexsort((-level[nodes], parent[nodes]))]
        new = np.ones(len(child), bool)
        new[1:] = (parent[child][1:] != parent[child][:-1]) | (level[child][1:] != level[child][:-1])
        self.starts = np.append(np.flatnonzero(new), len(child))
        owner = parent[child[self.starts[:-1]]] if len(child) else np.zeros(0, np.int64)
        #: The groups of a node, and the covering radius of it and all groups from one on.
        self.first = np.searchsorted(owner, np.arange(len(parent) + 1))
        self.radius = np.maximum.reduceat(reach[child], self.starts[:-1]) if len(child) else np.zeros(0)
        for g in range(len(self.radius) - 2, -1, -1):
            if owner[g] == owner[g + 1]:
                self.radius[g] = max(self.radius[g], self.radius[g + 1])
        self.has = self.first[1:] > self.first[:-1]

    def scores(self, nodes: np.ndarray, anchors: np.ndarray, square: float) -> np.ndarray:
        """Exact products of nodes with an anchor or several (as columns); doubles hold them where they stay below 2^53."""
        if square * self.square < 2.0**104:
            return (self.f[nodes] @ anchors.astype(np.float64)).astype(np.int64)
        return self.q[nodes] @ anchors

    def group(self, group: int) -> np.ndarray:
        return self.child[self.starts[group] : self.starts[group + 1]]


class Best:
    """The first ``k`` of each window: those of the highest score, then the smallest id."""

    def __init__(self, windows: list[tuple[int, int]], k: int):
        self.low, self.high, self.k = np.array([w[0] for w in windows]), np.array([w[1] for w in windows]), k
        self.held: list[list[tuple[int, int]]] = [[] for _ in windows]

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = np.flatnonzero((scores >= self.low.min(initial=_MOST)) & (scores <= self.high.max(initial=_LEAST)))
        if not len(fit):
            return
        fit = fit[np.lexsort((ids[fit], -scores[fit]))]
        scores, ids = scores[fit], ids[fit]
        # ~x falls as x rises and, unlike -x, is there for every long.
        starts, ends = np.searchsorted(~scores, ~self.high), np.searchsorted(~scores, ~self.low, side="right")
        for w in np.flatnonzero(starts < ends):
            held = self.held[w]
            these = slice(starts[w], min(ends[w], starts[w] + self.k))
            held += zip((-scores[these]).tolist(), ids[these].tolist(), strict=True)
            held.sort()
            del held[self.k :]
            if len(held) == self.k:
                self.low[w] = max(self.low[w], -held[-1][0])


def descend(tree: Tree, rid: int, anchor: np.ndarray, best: Best, first: np.ndarray | None = None) -> int:
    """Offer ``best`` all points of ``tree`` that can be among them; the number of points that were verified.

    ``first`` are the scores of the first group of the root, where they are known.
    """
    square = float(anchor.astype(np.float64) @ anchor.astype(np.float64))
    total = square + tree.square
    slack = 1e-6 * total + 1.0

    def bounds(score, radius):
        d = np.sqrt(np.maximum(0.0, total - 2.0 * score))
        return (total - np.maximum(0.0, d - radius) ** 2) / 2 + slack, (total - (d + radius) ** 2) / 2 - slack

    def open_(upper, lower) -> np.ndarray:
        low, high = best.low.astype(np.float64), best.high.astype(np.float64)
        return ((np.atleast_1d(upper)[:, None] >= low) & (np.atleast_1d(lower)[:, None] <= high)).any(axis=1)

    def met(nodes: np.ndarray, scores: np.ndarray | None = None) -> np.ndarray:
        scores = tree.scores(nodes, anchor, square) if scores is None else scores
        other = tree.rid[nodes] != rid
        best.offer(scores[other], tree.vec_id[nodes[other]])
        return scores

    root = np.zeros(1, np.int64)
    score = float(met(root)[0])
    verified, heap = 1, []

    def push(node: int, group: int, score: float) -> None:
        upper, lower = bounds(score, tree.radius[group])
        if open_(upper, lower)[0]:
            heapq.heappush(heap, (-float(upper), float(lower), group, node, score))

    if tree.has[0]:
        push(0, int(tree.first[0]), score)
    while heap:
        upper, lower, group, node, score = heapq.heappop(heap)
        if not open_(-upper, lower)[0]:
            continue
        children = tree.group(group)
        scores = met(children, first if node == 0 and group == tree.first[0] else None)
        verified += len(children)
        if group + 1 < tree.first[node + 1]:
            push(node, group + 1, score)
        inner = np.flatnonzero(tree.has[children])
        if len(inner):
            groups = tree.first[children[inner]]
            upper_, lower_ = bounds(scores[inner].astype(np.float64), tree.radius[groups])
            for i in np.flatnonzero(open_(upper_, lower_)):
                heapq.heappush(heap, (-float(upper_[i]), float(lower_[i]), int(groups[i]), int(children[inner[i]]), float(scores[inner[i]])))
    return verified


def _met(index: DataFrame, anchors: DataFrame, by: list[str], same: bool, k: int, low: int, high: int, cell: int, asked: int) -> DataFrame:
    """rid, window, score and vec_id: the first ``k`` of each window of each anchor, in every cell of trees.

    ``anchors`` have an array of positive scores, each a window, or none where ``same``: then all of the label are in one.
    """
    room = F.greatest(F.lit(1), F.floor(F.lit(cell) / F.greatest(F.col("length"), F.lit(1))))
    sizes = index.groupBy(*by).agg(F.count("*").alias("n")).join(anchors.groupBy(*by).agg(F.count("*").alias("m")), by)
    sizes = sizes.select(*by, F.ceil(F.col("n") / room).cast("int").alias("cells"), F.ceil(F.col("m") / F.lit(asked)).cast("int").alias("blocks"))
    trees = index.join(sizes, by).withColumn("cell", F.pmod(F.xxhash64("label", "tree"), "cells").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = anchors.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("rid"), "blocks").cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    shared = [*dict.fromkeys([*by, "length", "label", "block", "cell"]), "rid", "vec_id", "q"]
    none = F.lit(None)
    rows = trees.select(*shared, "tree", "place", "parent", "level", "reach", none.cast("array<long>").alias("windows")).unionByName(
        asking.select(*shared, none.cast("int").alias("tree"), *(none.cast("long").alias(c) for c in ("place", "parent", "level")), none.cast("double").alias("reach"), "windows")
    )

    def search(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        found: list[tuple[int, int, int, int]] = []
        own = table.filter(pc.is_null(table["tree"]))
        nodes = table.filter(pc.is_valid(table["tree"]))
        if len(own) and len(nodes):
            length = own["length"][0].as_py()
            keys = nodes.group_by(["label", "tree"]).aggregate([]).sort_by([("label", "ascending"), ("tree", "ascending")])
            trees = []
            for name, number in zip(keys["label"].to_pylist(), keys["tree"].to_pylist(), strict=True):
                trees.append(Tree(nodes.filter(pc.and_(pc.equal(nodes["label"], name), pc.equal(nodes["tree"], number))), length))
            vectors = _matrix(own["q"], length)
            squares = np.einsum("ij,ij->i", vectors.astype(np.float64), vectors.astype(np.float64))
            rids, names = own["rid"].to_pylist(), own["label"].to_pylist()
            bests = [Best([(_LEAST, _MOST)] if same else [(-(-low * s // 100), high * s // 100) for s in windows], k) for windows in own["windows"].to_pylist()]
            for tree in trees:
                asking = np.array([i for i, name in enumerate(names) if (tree.label == name) == same], np.int64)
                for begin in range(0, len(asking), _TOGETHER):
                    block = asking[begin : begin + _TOGETHER]
                    # The products with what hangs under the root, of many anchors at once.
                    first = tree.scores(tree.group(0), np.ascontiguousarray(vectors[block].T), float(squares[block].max())).T if tree.has[0] else [None] * len(block)
                    for i, scores in zip(block.tolist(), first, strict=True):
                        descend(tree, rids[i], vectors[i], bests[i], scores)
            found = [(rid, w, -s, vec_id) for rid, best in zip(rids, bests, strict=True) for w, held in enumerate(best.held) for s, vec_id in held]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table({c: pa.array(x, kind) for c, x, kind in zip(("rid", "window", "score", "vec_id"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    # Cells are few and costly, so they aren't put together by their bytes.
    tasks = max(1, min(_TASKS, int(sizes.agg(F.sum(F.col("cells").cast("long") * F.col("blocks"))).first()[0] or 0)))
    return rows.repartition(tasks, *by, "block", "cell").groupBy(*by, "block", "cell").applyInArrow(search, "rid long, window int, score long, vec_id long")


def hard_negatives(
    rows: DataFrame, anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    tree: int = TREE, cell: int = CELL, asked: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for ``rows`` (vec_id, embedding, label).

    ``anchor`` is a condition on vec_id and label. The positives of an anchor are its first ``positives`` other rows of the same label;
    the negatives of a positive the first ``negatives`` rows of other labels whose score is from ``low`` to ``high`` percent of the positive's.
    """
    vectors = materialise(prepared(rows, anchor, scale), "negative-vectors")
    index = materialise(_index(vectors, tree, cell), "negative-trees")
    anchors = vectors.where("anchor").select("rid", "vec_id", "label", "length", "q")

    def first(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("rid", "window").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = _met(index, anchors.withColumn("windows", F.lit(None).cast("array<long>")), ["length", "label"], True, positives, low, high, cell, asked)
    near = materialise(first(near, positives).select("rid", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negative-positives")
    windows = near.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("w"))
    asking = anchors.join(windows.select("rid", F.col("w")["positive_score"].alias("windows")), "rid")
    far = first(_met(index, asking, ["length"], False, negatives, low, high, cell, asked), negatives)
    named = near.join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid").withColumn("window", F.col("rank") - 1).drop("rank")
    return far.join(named, ["rid", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The same for the given table, every anchor against every row.
ORACLE_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid <> b.rid
), p AS (
  SELECT rid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS n FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.rid, p.n ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND p.n <= {POSITIVES} AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
