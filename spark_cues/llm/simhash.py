"""SimHash near-duplicate groups found with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ship_package
from .components import connected_components

BITS, SEED, SHINGLE = 64, 42, 3
#: A bit string has four segments of 16 bits on a ring; at most three bits may differ.
SEGMENTS, WIDTH, RADIUS = 4, 16, 3
#: Fingerprints that share a key are compared in blocks of at most this many.
BLOCK = 2048
_CHUNK = 1 << 18


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of lower-cased (A-Z) 3-word shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        spans = [(0, len(joined))]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        spans = list(zip([0, *ends[: -SHINGLE]], [e - 1 for e in ends[SHINGLE - 1 :]], strict=True))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(spans), _CHUNK):
        part = np.array([digest(joined[a:b], SEED) for a, b in spans[at : at + _CHUNK]], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2)
        out = np.fromiter((fingerprint(texts[i].as_py()) for i in range(len(texts))), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["doc_id", "t", "fp"])


def _keys() -> F.Column:
    """The eight join keys of a fingerprint: segment i equal, and one half of segment i+1 equal.

    On a ring of four segments with three differing bits in all, some chain starts with a segment that
    differs by 0 <= 3/4 bits and has at most 1 <= 6/4 bits differing over its first two segments, so one
    half of the second segment is equal too.  The key holds chain start, that segment and that half.
    """
    seg = lambda i, w, off=0: F.shiftrightunsigned("fp", WIDTH * (i % SEGMENTS) + off).bitwiseAND(F.lit((1 << w) - 1))
    keys = []
    for i in range(SEGMENTS):
        for half in range(2):
            keys.append(F.lit(i * 2 + half).cast("long") * (1 << 24) + seg(i, WIDTH) * 256 + seg(i + 1, WIDTH // 2, half * (WIDTH // 2)))
    return F.array(*keys)


def _chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """For chains from ``start``: the bits of the first l segments and their budget floor(3 l / 4)."""
    out, mask = [], 0
    for length in range(1, SEGMENTS + 1):
        mask |= ((1 << WIDTH) - 1) << (WIDTH * ((start + length - 1) % SEGMENTS))
        out.append((np.uint64(mask), RADIUS * length // SEGMENTS))
    return out


_MASKS = [_chain_masks(i) for i in range(SEGMENTS)]


def _forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among ``fps``: n-1 pairs at most, never all pairs."""
    out, left = [], np.arange(1, len(fps))
    queue, at = [0], 0
    while len(left):
        if at == len(queue):
            queue.append(int(left[0]))
            left = left[1:]
            continue
        here = queue[at]
        at += 1
        diff, near = fps[left] ^ fps[here], np.arange(len(left))
        for mask, budget in _MASKS[start]:
            near = near[np.bitwise_count(diff[near] & mask) <= budget]
            if not len(near):
                break
        if len(near):
            out += [(here, int(k)) for k in left[near]]
            queue += left[near].tolist()
            left = np.delete(left, near)
    return out


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; a group holds at most two blocks, so memory is bounded."""
    hold: list[np.ndarray] = []

    def finish(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1)) + 1
        bounds = np.concatenate([[0], cuts, [len(rows)]])
        a, b = [], []
        for k in np.flatnonzero(np.diff(bounds) > 1):
            part = rows[bounds[k] : bounds[k + 1]]
            for i, j in _forest(part[:, 3].view(np.uint64), int(part[0, 0] >> 25)):
                a.append(part[i, 3])
                b.append(part[j, 3])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a)), pa.array(np.array(b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        hold.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        rows = np.concatenate(hold)
        last = np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))
        edge = int(last[-1]) + 1 if len(last) else 0
        if edge:
            yield from finish(np.ascontiguousarray(rows[:edge]))
        hold = [rows[edge:]]
    if hold and len(hold[0]):
        yield from finish(np.ascontiguousarray(hold[0]))


def _links(classes: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between fingerprints, enough of them to connect every group."""
    keyed = classes.select("fp", F.explode(_keys()).alias("key"))
    large = keyed.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("n"))
    dealt = keyed.join(large, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    pairs = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.select("key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), "fp")
    return pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(_link_groups, "a long, b long")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, t, fp, part, component_id)`` of every row: text digest, fingerprint, smallest fingerprint and smallest id reachable."""
    ship_package(docs.sparkSession)
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    prints = cut(narrow.mapInArrow(_fingerprints, "doc_id long, t long, fp long"))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(_links(classes.select("fp")), "a", "b")
    parts = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    named = parts.join(parts.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("fp", "part", "component_id")
    return prints.join(named, "fp").select("doc_id", "t", "fp", "part", "component_id")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    Equal fingerprints form one class; classes are linked at 3 or fewer differing bits by pigeonring
    chains; ``component_id`` is the smallest doc_id reachable.  A null text counts as empty; texts without
    words share fingerprint zero and are one class.  Rows with a null id link like any other and get the
    component of their group (null where no member has an id).  Repeated rows stay; an empty table gives no rows.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one row of each near-duplicate group; columns unchanged.

    The row kept has the group's smallest doc_id and, where that id stands on several texts of the group, the
    smallest digest of the text.  An id may stand in several groups and stay in each.  Of rows that repeat both id and
    text any one stays.  Rows with a null doc_id can't be named in a result and all stay.  An empty table stays empty.
    """
    rows = _grouped(docs, id_col, text_col).where("doc_id is not null").groupBy("part", F.struct("doc_id", "t").alias("row")).agg(F.count("*").alias("n"))
    kept = cut(rows.groupBy("part").agg(F.min(F.struct("row", "n")).alias("x")).select(F.col("x.row.doc_id").alias("__k"), F.col("x.row.t").alias("__t"), F.col("x.n").alias("__n")))
    key = ["__k", "__t"]
    keyed = docs.withColumns({"__k": F.col(id_col).cast("long"), "__t": F.xxhash64(F.col(text_col).cast("string"))})
    # A left join, so that rows without an id pass in the same reading.
    once = keyed.join(kept, key, "left").where("__n = 1 or __k is null").select(*docs.columns)
    repeated = kept.where("__n > 1").select(*key)
    if repeated.isEmpty():
        return once
    return once.unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates(key).select(*docs.columns))


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
