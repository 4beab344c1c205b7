"""Document fingerprints: bottom-k sketches of shingle hashes, mergeable across parts of a corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package

#: Hashes that a sketch keeps, and words of a shingle.
K, SHINGLE, SEED = 128, 5, 42
#: Keys whose sketches a task holds before it passes them on.
HELD_KEYS = 10_000
#: Sketches of one key are merged by this many tasks before the last merge.
MERGE_PARTS = 16
#: Signs of scripts without spaces are words of their own; other words are cut after 32 signs, so that a text without spaces has shingles too.
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]{{1,32}}")
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_LAST = np.iinfo(np.int64).min


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct 63-bit hashes, ascending, of the text's five-word shingles in lower case; fewer words are one shingle, none give none."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    single = np.array([digest(w.encode("utf-8", "replace"), SEED) for w in words], dtype=np.uint64)
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    whole = np.full(count, width, dtype=np.uint64)
    for place in range(width):
        whole = whole + _mixed(single[place : place + count] + _FACTORS[place]) * _FACTORS[place]
    return np.unique((_mixed(whole) >> np.uint64(1)).astype(np.int64))


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct shingle hashes, ascending; all of them where there are fewer."""
    return shingle_hashes(text)[:k]


def merged(parts: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of what the parts' texts hold together, without looking at the texts again."""
    return np.unique(np.concatenate([np.empty(0, dtype=np.int64), *parts]))[:k]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance (shared over all distinct shingles), exact where the sketches hold all; two texts without words are alike."""
    both = merged((a, b), k if max(len(a), len(b)) >= k else 2 * k)
    if not len(both):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, shared, assume_unique=True).sum() / len(both))


def _written(s: np.ndarray) -> str:
    return s.astype(">i8").tobytes().hex()


def read_fingerprint(s: Column) -> Column:
    """A fingerprint string as its sketch, ``array<long>``."""
    places = F.sequence(F.lit(0), (F.length(s) / 16).cast("int") - 1)
    return F.when(F.length(s) > 0, F.transform(places, lambda i: F.conv(F.substring(s, i * 16 + 1, F.lit(16)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles behind a sketch: exact under ``k``, else from how densely the smallest lie."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / ((F.element_at(s, -1).cast("double") + 1) / float(1 << 63)))


def _union(a: Column, b: Column, k: int) -> Column:
    """The smallest ``k`` of both; all where both sketches are whole."""
    return F.slice(F.array_sort(F.array_union(a, b)), F.lit(1), F.when(F.greatest(F.size(a), F.size(b)) < k, 2 * k).otherwise(k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of distinct shingles that two sketches' texts have in common; 1 for two empty sketches."""
    both = _union(a, b, k)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's distinct shingles that the second has too; 1 where the first has none."""
    both = _union(a, b, k)
    count = F.when(F.greatest(F.size(a), F.size(b)) < k, F.size(both).cast("double")).otherwise(distinct_shingles(both, k))
    shared = resemblance(a, b, k) * count
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: tuple[str, ...] = (), k: int = K) -> DataFrame:
    """``(doc_id, *keys, sketch)`` of every row; a null text counts as empty, null ids and repeated rows stay, no row is moved."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            out = pa.array([sketch(texts[i].as_py(), k) for i in range(len(texts))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], out], names=[*batch.schema.names[1:], "sketch"])

    kept = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("doc_id"), *keys)
    return kept.mapInArrow(run, kept.drop("__text").withColumn("sketch", F.lit(None).cast("array<long>")).schema)


def merge_sketches(parts: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """``(key, sketch, n_parts)``: one sketch for each value of ``key``, null included, of any number of sketches.

    Tasks merge what they read before anything is shuffled; a key's partial sketches meet in some tasks first and then in
    one, as a stream, so a key that holds most rows costs no task more than a few sketches from each other.  A null
    sketch counts as empty; an empty table gives no rows.
    """
    ship_package(parts.sparkSession)
    kind = parts.select(F.col(key).alias("key")).schema["key"].dataType
    schema = parts.select(F.col(key).alias("key"), F.lit(None).cast("array<long>").alias("sketch"), F.lit(0).cast("long").alias("n_parts")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, tuple[np.ndarray, int]] = {}

        def rows(names) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), names.field(0).type), pa.array([s for s, _ in held.values()], pa.list_(pa.int64())), pa.array([n for _, n in held.values()], pa.int64())], names=["key", "sketch", "n_parts"])

        for batch in batches:
            lists = batch.column(1)
            for i, (name, count) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                one = lists[i].values
                found, n = held.get(name, (np.empty(0, dtype=np.int64), 0))
                held[name] = found if one is None else merged((found, one.to_numpy(zero_copy_only=False)), k), n + count
            if len(held) > HELD_KEYS:
                yield rows(batch.schema)
                held.clear()
        if held:
            yield rows(batch.schema)

    part = parts.select(F.col(key).cast(kind).alias("key"), F.col(sketch_col).alias("sketch"), F.lit(1).cast("long").alias("n_parts")).mapInArrow(run, schema)
    some = part.withColumn("deal", F.pmod(F.xxhash64("sketch"), F.lit(MERGE_PARTS))).repartition("key", "deal").sortWithinPartitions("key").drop("deal").mapInArrow(run, schema)
    # A task may have passed a key on before it had read all of it, so the few rows that are left are merged by key.
    whole = some.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, k).alias("sketch"), F.sum("n_parts").alias("n_parts"))
    return whole.select(F.col("key").alias(key), "sketch", "n_parts")


# --- each document against its edited text and the next document -------------------------------------------------------


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _buckets(splitters: np.ndarray):
    """Bucket of an (id, text hash), falling as ids rise; ids that fill more than a bucket are parted by their hash."""

    def find(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(splitters, ids, "left"), np.searchsorted(splitters, ids, "right")
        share = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
        return len(splitters) - low - np.minimum(np.floor((1 - share) * (high - low + 1)), high - low).astype(np.int64)

    return find


def _compare(k: int):
    """Rows come by bucket, ids falling; a bucket's last rows are those of the next bucket's first, lent to close it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, done = None, None, True  # done: the bucket's last row has met what follows
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                at, lent, doc, text = (c[i].as_py() for c in batch.columns)
                if at == bucket and done:
                    continue  # a further lent row that repeats the first
                own = sketch(text, k)
                if at == bucket:
                    was, before, mark = held
                    edited = _edited(before, text)
                    other = sketch(edited, k)
                    out.append((was, len(before), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), _written(mark), _written(other), likeness(mark, other, k), likeness(mark, own, k)))
                bucket, held, done = at, (doc, text, own), lent
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has its last floor(n / 2) code points replaced by the first as many, or all, of the document with the
    next smaller id; the last document is followed by the first.  Rows go once to buckets of ids, as many as there are
    shuffle partitions, and are compared in order as they stream by; each bucket also gets the row that
    begins the next one.  A null text counts as empty; a text without words has an empty fingerprint.  Rows that
    repeat an id follow by their text's hash, rows without an id come last, equal rows stay; ids that fill several buckets
    are parted by that hash.  A single document is its own next one; an empty table gives no rows.  Other columns are left out.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("k"), F.xxhash64(text).alias("h"))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / wanted for i in range(1, wanted)]
    found = rows.agg(F.percentile_approx("k", shares, 100 * wanted).alias("s")).first()["s"] if shares else []
    find = _buckets(np.array(found or [], dtype=np.int64))

    @F.pandas_udf("long")
    def bucket(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(find(ids.to_numpy(), hashes.to_numpy()))

    # One row a bucket: the key that begins it.
    order = F.struct((-F.col("k").cast("decimal(20,0)")).alias("a"), F.col("h"), F.col("k"))
    heads = [(r["b"], r["o"]["k"], r["o"]["h"]) for r in rows.select(bucket("k", "h").alias("b"), order.alias("o")).groupBy("b").agg(F.min("o").alias("o")).orderBy("b").collect()]
    before = {(k_, h): heads[i - 1][0] for i, (_, k_, h) in enumerate(heads)}

    @F.pandas_udf("array<long>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """The row's bucket, and the bucket that it is lent to if it begins its own."""
        own = find(ids.to_numpy(), hashes.to_numpy()).tolist()
        return pd.Series([[b, before[key]] if (key := (i, h)) in before else [b] for b, i, h in zip(own, ids.tolist(), hashes.tolist(), strict=True)])

    placed = rows.withColumn("p", places("k", "h")).select("doc_id", "text", "k", "h", F.posexplode("p").alias("lent", "bucket"))
    ordered = placed.repartition("bucket").sortWithinPartitions("bucket", "lent", F.desc("k"), "h").select("bucket", (F.col("lent") > 0).alias("lent"), "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_compare(k), schema)


def op12_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
