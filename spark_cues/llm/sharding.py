"""Histogram sort: exact splitters by counted probes, then one exchange."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, materialize, ship_package

SHARDS = 40
#: A splitter may miss its target by this share of a shard's bytes; groups of equal texts under it stay whole.
TOLERANCE = 0.01
#: Probes between the bounds of one open splitter in one round.
PROBES = 32
#: Probes of all splitters in one round, about.
MOST_PROBES = 1_000_000
#: Text bytes of one bucket: the exchange has whole shards cut into buckets of about this size.
BUCKET_BYTES = 128 << 20
FIXED_BYTES = 16
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _weights(probes: np.ndarray):
    """Bytes and rows in each cell between sorted probes ``(hash, doc)``, of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(len(probes) + 1, dtype=np.int64)
        rows = size.copy()
        for batch in batches:
            h, doc, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cell = _cells(probes, h, doc)
            size += _sums(cell, n, len(size))
            rows += np.bincount(cell, minlength=len(size))
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(size[at]), pa.array(rows[at])], names=["cell", "bytes", "rows"])

    return run


def _sums(cell: np.ndarray, n: np.ndarray, cells: int) -> np.ndarray:
    out = np.zeros(cells, dtype=np.int64)
    np.add.at(out, cell, n)
    return out


def _cells(probes: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each key the number of probes at or below it; probes are sorted rows ``(hash, doc)``."""
    lo, hi = np.searchsorted(probes[:, 0], h, side="left"), np.searchsorted(probes[:, 0], h, side="right")
    for k in np.flatnonzero(hi > lo):
        lo[k] += np.searchsorted(probes[lo[k] : hi[k], 1], doc[k], side="right")
    return lo


class _Splitter:
    """A target number of bytes below, and the keys known to lie under and over it."""

    def __init__(self, target: int, total: int):
        self.target, self.low, self.high = target, (_LOW, _LOW), (_HIGH, _HIGH)
        self.low_bytes, self.high_bytes, self.best = 0, total, None

    def take(self, key: tuple[int, int], below: int) -> None:
        miss = abs(below - self.target)
        if self.best is None or miss < self.best[0]:
            self.best = (miss, key)
        if below <= self.target and key >= self.low:
            self.low, self.low_bytes = key, below
        if below >= self.target and key <= self.high:
            self.high, self.high_bytes = key, below

    def open(self, slack: float) -> bool:
        return (self.best is None or self.best[0] > slack) and self._room()

    def _room(self) -> bool:
        return self.high[0] - self.low[0] > 1 or (self.high[0] > self.low[0] and self.low[1] < _HIGH) or self.high[1] - self.low[1] > 1

    def probes(self, count: int) -> list[tuple[int, int]]:
        """Whole hashes while the bounds differ in the hash (groups stay whole), doc ids within one hash after."""
        (a, x), (b, y) = self.low, self.high
        if b - a > 1:
            step = [a + (b - a) * i // (count + 1) for i in range(1, count + 1)]
            share = (self.target - self.low_bytes) / max(1, self.high_bytes - self.low_bytes)
            step.append(min(b - 1, max(a + 1, a + int((b - a) * share))))
            return [(int(s), _LOW) for s in step if a < s < b]
        if b > a:  # all keys between have the hash a, from doc x on; b's own cell starts at y
            y = _HIGH
        return [(a, v) for v in {x + (y - x) * i // (count + 1) for i in range(1, count + 1)} if x < v <= y]


def find_splitters(keys: DataFrame, targets: list[int], slack: float, total: int, probes: int = PROBES, max_rounds: int = 80) -> tuple[list[tuple[int, int]], int]:
    """Keys ``(hash, doc)`` with about ``targets`` bytes below, and the rounds it took.

    Each round counts exact bytes below every probe with one narrow pass over ``keys (h, doc, n)``.  The
    driver holds a few numbers for each probe: some ``len(targets) * probes``, and fewer probes a target where targets are many
    (a million in all, or two for each target).
    """
    probes = max(2, min(probes, MOST_PROBES // max(1, len(targets))))
    splitters = [_Splitter(t, total) for t in targets]
    for rounds in range(max_rounds):
        asked = sorted({p for s in splitters if s.open(slack) for p in s.probes(probes)})
        if not asked:
            return [s.best[1] for s in splitters], rounds
        below = _below(keys, asked)[0]
        for s in splitters:  # counts rise with the keys, so two searches find the bounds next to the target
            under, over = bisect_right(below, s.target) - 1, bisect_left(below, s.target)
            places = {over} if under < 0 else {bisect_left(below, below[under]), under, over}
            for at in sorted(places):
                if at < len(asked):
                    s.take(asked[at], below[at])
    return [s.best[1] for s in splitters], max_rounds


def _below(keys: DataFrame, probes: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    grid = np.array(probes, dtype=np.int64).reshape(-1, 2)
    cells = keys.mapInArrow(_weights(grid), "cell long, bytes long, rows long").groupBy("cell").agg(F.sum("bytes"), F.sum("rows")).collect()
    size, rows = np.zeros(len(grid) + 1, dtype=np.int64), np.zeros(len(grid) + 1, dtype=np.int64)
    for cell, b, r in cells:
        size[cell], rows[cell] = b, r
    return np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def _assign(grid: np.ndarray, starts: np.ndarray):
    """A key's bucket and the bucket's first slot."""

    def run(h, doc):
        import pandas as pd

        bucket = _cells(grid, h.to_numpy(), doc.to_numpy())
        return pd.DataFrame({"b": bucket.astype(np.int32), "start": starts[bucket]})

    return F.pandas_udf(run, "b int, start long")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``size, shard, slot``: shards of near equal bytes, slots gapless from 0 in each shard.

    Rows are sorted by (hash of text, doc_id), so equal texts lie side by side and share a shard unless
    the group is too large for the tolerance, when it is split by doc_id (by row where one id repeats that text so often).  Splitters come from exact counts.  Shards larger
    than ``bucket_bytes`` are cut into buckets by further splitters, so that no task holds a whole shard;
    a slot is the bucket's counted start plus the row's place in it.  Rows cross the network once.

    A row's size is its text's UTF-8 bytes (null: none) plus 16.  A null id sorts as the smallest; repeated
    rows take separate slots, in any order; an empty table gives no rows.  Columns of ``docs`` named like the new ones are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs, text = docs.drop("size", "shard", "slot"), F.col(text_col).cast("string")
    named = docs.withColumns({"size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + FIXED_BYTES, "__h": F.xxhash64(F.coalesce(text, F.lit(""))), "__d": F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW))})
    keys = cut(named.select("__h", "__d", "size"))
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    same = keys.groupBy("__h", "__d").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    if not same.where((F.col("rows") > 1) & (F.col("n") > tolerance * total / shards)).isEmpty():
        # One text with one id fills much of a shard: its rows are told apart by a number that is written with them.
        named = materialize(named.withColumn("__d", F.monotonically_increasing_id()), "numbered")
        keys = cut(named.select("__h", "__d", "size"))
    buckets = shards * max(1, -(-total // (shards * bucket_bytes)))
    per = buckets // shards
    targets = [total * k // buckets for k in range(1, buckets)]
    splitters, _ = find_splitters(keys, targets, tolerance * total / buckets, total)
    grid = np.array(sorted(splitters), dtype=np.int64).reshape(-1, 2)
    rows = [0, *_below(keys, [tuple(x) for x in grid.tolist()])[1]] if buckets > 1 else [0]
    starts = np.array([rows[b] - rows[b - b % per] for b in range(buckets)], dtype=np.int64)
    dealt = named.withColumn("__a", _assign(grid, starts)("__h", "__d")).withColumns({"__b": F.col("__a.b"), "__start": F.col("__a.start")}).drop("__a").repartitionById(buckets, F.col("__b"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", "__d")).cast("long") - 1
    return dealt.withColumns({"shard": F.floor(F.col("__b") / per).cast("int"), "slot": F.col("__start") + place}).drop("__h", "__d", "__b", "__start")


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
