"""Hard-negative mining: score-window searches over R-trees packed by sort-tile-recursive order."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, materialize, ship_package
from .whitening import exact_sums, quantized

ANCHOR_STRIDE, RELABEL_STRIDE, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from 0.3 to 0.9 of the positive's: low * positive <= 100 * negative <= high * positive.
LOW, HIGH = 30, 90
#: Rows of a leaf, children of a node, rows of one tree.
LEAF, FANOUT, TREE_ROWS = 256, 8, 16_384
#: Anchors of one pass, broadcast: at most 16,384 * 8 * dimensions bytes, 8.4 MB at 64 dimensions.
ANCHOR_BLOCK = 16_384


# --- the tree ----------------------------------------------------------------------------------------------------------


def str_order(x: np.ndarray, leaf: int, dims: np.ndarray) -> np.ndarray:
    """Places of rows in sort-tile-recursive order: slabs along the first dimension, each cut along the next, down to leaves."""

    def tiled(at: np.ndarray, left: int) -> list[np.ndarray]:
        leaves = -(-len(at) // leaf)
        if leaves <= 1 or left == len(dims):
            return [at]
        at = at[np.argsort(x[at, dims[left]], kind="stable")]
        slabs = leaves if left == len(dims) - 1 else int(np.ceil(leaves ** (1 / (len(dims) - left))))
        size = -(-leaves // max(2, slabs)) * leaf
        return [p for k in range(0, len(at), size) for p in tiled(at[k : k + size], left + 1)]

    return np.concatenate(tiled(np.arange(len(x)), 0)) if len(x) else np.arange(0)


class Tree:
    """Minimum bounding boxes over rows in packed order, level by level; a node also knows the labels below it.

    ``lows[0]`` and ``highs[0]`` are the leaves' boxes, each next level has a box for ``FANOUT`` of those before it.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        leaves = -(-len(x) // leaf)
        dims = np.argsort(-x.var(axis=0), kind="stable")[: max(1, int(np.log2(max(2, leaves))))]
        order = str_order(x, leaf, dims)
        self.ids, self.labels, self.x, self.leaf, self.fanout = ids[order], labels[order], x[order], leaf, fanout
        starts = np.arange(0, len(x), leaf)
        self.lows, self.highs = [np.minimum.reduceat(self.x, starts)], [np.maximum.reduceat(self.x, starts)]
        self.held = [[frozenset(self.labels[s : s + leaf].tolist()) for s in starts]]
        while len(self.lows[-1]) > 1:
            starts = np.arange(0, len(self.lows[-1]), fanout)
            self.lows.append(np.minimum.reduceat(self.lows[-1], starts))
            self.highs.append(np.maximum.reduceat(self.highs[-1], starts))
            self.held.append([frozenset().union(*self.held[-1][s : s + fanout]) for s in starts])

    @property
    def root(self) -> int:
        return len(self.lows) - 1

    def intervals(self, level: int, nodes: slice, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each node's box allows with ``q``, coordinate by coordinate."""
        a, b = self.lows[level][nodes] * q, self.highs[level][nodes] * q
        return np.minimum(a, b).sum(axis=1), np.maximum(a, b).sum(axis=1)

    def rows(self, leaf: int) -> slice:
        return slice(leaf * self.leaf, (leaf + 1) * self.leaf)


@dataclass
class ScoreWindow:
    """One search's score window and its best rows so far, ``(-score, vec_id)`` in order."""

    low: float
    high: float
    k: int
    best: list[tuple[float, int]]

    @property
    def least(self) -> float:
        """Scores strictly below can't enter any more."""
        return max(self.low, -self.best[-1][0]) if len(self.best) == self.k else self.low

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.least) & (scores <= self.high))
        if len(fits) > self.k:
            edge = np.partition(scores[fits], len(fits) - self.k)[len(fits) - self.k]
            fits = fits[scores[fits] >= edge]
        if len(fits):
            self.best = heapq.nsmallest(self.k, [*self.best, *zip((-scores[fits]).tolist(), ids[fits].tolist(), strict=True)])


def search(tree: Tree, q: np.ndarray, own: int, label, same: bool, windows: list[ScoreWindow]) -> int:
    """Best-first over one tree for all windows of an anchor; returns the number of leaves looked at.

    A box goes if it has no row of a wanted label, and for every window lies outside of it or strictly below its k-th row.
    """

    def wanted(level: int, node: int, low: float, high: float) -> bool:
        held = tree.held[level][node]
        if (label not in held) if same else held == {label}:
            return False
        return any(high >= w.least and low <= w.high for w in windows)

    tie, seen = count(), 0
    low, high = tree.intervals(tree.root, slice(0, 1), q)
    queue = [(-float(high[0]), next(tie), tree.root, 0, float(low[0]))]
    while queue:
        bound, _, level, node, low_bound = heapq.heappop(queue)
        if -bound < min(w.least for w in windows):
            break
        if not wanted(level, node, low_bound, -bound):
            continue
        if level:
            children = slice(node * tree.fanout, (node + 1) * tree.fanout)
            lows, highs = tree.intervals(level - 1, children, q)
            for k, (low_k, high_k) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True), children.start):
                if wanted(level - 1, k, low_k, high_k):
                    heapq.heappush(queue, (-high_k, next(tie), level - 1, k, low_k))
            continue
        seen += 1
        rows = tree.rows(node)
        scores = tree.x[rows] @ q
        fits = (tree.ids[rows] != own) & ((tree.labels[rows] == label) == same) & (scores >= min(w.least for w in windows))
        if fits.any():
            scores, ids = scores[fits], tree.ids[rows][fits]
            for w in windows:
                w.take(scores, ids)
    return seen


# --- passes over the packed table --------------------------------------------------------------------------------------


def _trees(batches: Iterator[pa.RecordBatch], rows: int = TREE_ROWS) -> Iterator[Tree]:
    """A tree for each run of at most ``rows`` rows of a task."""
    hold, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            if hold and size + part.num_rows > rows:
                yield _tree(hold)
                hold, size = [], 0
            hold.append(part)
            size += part.num_rows
    if size:
        yield _tree(hold)


def _tree(parts: list[pa.RecordBatch]) -> Tree:
    ids, labels = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in (0, 1))
    x = np.concatenate([p.column(2).flatten().to_numpy(zero_copy_only=False).reshape(p.num_rows, -1) for p in parts])
    return Tree(ids, labels, x.astype(np.float64))


#: An anchor of a pass: id, label, vector, windows as (key, low, high).
Asked = tuple[int, int, np.ndarray, list[tuple[int, float, float]]]


def _pass(asked, same: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = asked.value
        found = [[ScoreWindow(low, high, k, []) for _, low, high in windows] for _, _, _, windows in todo]
        for tree in _trees(batches):
            for (own, label, q, _), windows in zip(todo, found, strict=True):
                search(tree, q, own, label, same, windows)
        rows = [(own, key, int(-s), i) for (own, _, _, keys), windows in zip(todo, found, strict=True) for (key, _, _), w in zip(keys, windows, strict=True) for s, i in w.best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["anchor_id", "key", "score", "vec_id"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each search: at most k rows a task come to one, and Spark cuts them before the shuffle too."""
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(spark: SparkSession, packed: DataFrame, blocks: Iterator[list[Asked]], same: bool, k: int) -> DataFrame:
    """One pass over the packed table for each block of anchors; what it finds is written before the next."""
    schema = "anchor_id long, key long, score long, vec_id long"
    out = spark.createDataFrame([], schema)
    for asked in blocks:
        out = out.unionByName(cut(_ranked(packed.mapInArrow(_pass(spark.sparkContext.broadcast(asked), same, k), schema), k).drop("rank")))
    return out


def labelled(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, label, x)`` of rows that can take part: with an id, a label and a finite vector, as whole numbers."""
    label = F.col(label_col).cast("long").alias("label")
    return quantized(vectors, id_col, vector_col, keep=(label,)).where("vec_id is not null and label is not null")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of every anchor and positive.

    ``rows`` are ``(vec_id, label, x)`` with whole numbers in ``x``; ``anchors`` are ids among them.  Rows are packed once:
    ranges along the dimension that varies most, parted by a hash of the id where they tie, and in each range trees in
    sort-tile-recursive order.  A pass finds every anchor's nearest rows of its label, a second one the best rows of other labels
    in each score window; anchors go in blocks.  Of a repeated id the smallest label and vector count.  An anchor
    without another row of its label, or a window without rows, gives no rows; so do empty tables.  Vectors of another
    length than most take no part.  Scores must stay below 2^53 in size, so that doubles hold them.
    """
    spark = rows.sparkSession
    ship_package(spark)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = materialize(rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x"), "labelled-rows")
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths["n"])
    widest = _widest(rows, lengths["n"])
    packed = materialize(rows.repartitionByRange(F.get("x", F.lit(widest)), F.xxhash64("vec_id")), "packed-rows")
    asked = cut(packed.join(anchors.select(F.col("vec_id").alias("anchor")).distinct(), F.col("vec_id") == F.col("anchor")).select("vec_id", "label", "x"))
    blocks = max(1, -(-asked.count() // ANCHOR_BLOCK))
    block = F.pmod(F.xxhash64(F.lit(11), "vec_id"), F.lit(blocks))

    def first() -> Iterator[list[Asked]]:
        for b in range(blocks):
            some = asked.where(block == b).collect()  # some ANCHOR_BLOCK rows, whatever their number in all
            if some:
                yield [(r["vec_id"], r["label"], np.array(r["x"], dtype=np.float64), [(0, -np.inf, np.inf)]) for r in some]

    near = cut(_searched(spark, packed, first(), True, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("p"))  # at most `positives` each

    def second() -> Iterator[list[Asked]]:
        both = asked.join(windows, F.col("vec_id") == F.col("anchor_id"))
        for b in range(blocks):
            some = both.where(block == b).select("vec_id", "label", "x", "p").collect()
            if some:
                # Whole scores: 100 n from low * p to high * p.
                yield [(r["vec_id"], r["label"], np.array(r["x"], dtype=np.float64), [(p["positive_id"], float(-(-low * p["positive_score"] // 100)), float(high * p["positive_score"] // 100)) for p in r["p"]]) for r in some]

    found = _ranked(_searched(spark, packed, second(), False, negatives), negatives)
    out = found.join(near, (found["anchor_id"] == near["anchor_id"]) & (found["key"] == near["positive_id"]))
    return out.select(found["anchor_id"], near["positive_id"], found["rank"], found["vec_id"].alias("negative_id"), near["positive_score"], found["score"].alias("negative_score"))


def _widest(rows: DataFrame, dims: int) -> int:
    """The dimension that varies most, by exact sums."""
    n, sums = exact_sums(rows)
    _, squares = exact_sums(rows.select(F.transform("x", lambda v: v * v).alias("x")))
    return int(np.argmax([q * n - s * s for q, s in zip(squares, sums, strict=True)]))


def op13_str_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    relabelled = table.select("vec_id", F.when(F.col("vec_id") % RELABEL_STRIDE == 0, (label + 1) % LABELS).otherwise(label).alias("label"), "embedding")
    rows = labelled(relabelled)
    return hard_negatives(rows, rows.where(F.col("vec_id") % ANCHOR_STRIDE == 0).select("vec_id"))
