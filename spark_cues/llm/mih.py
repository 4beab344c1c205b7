"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ship_package

K, QUERY_STRIDE = 10, 100
#: Rows that rotations and the radius are fitted on, at most: those with the smallest hash of the id.
FIT_ROWS = 20_000
#: Rotations of as many bits as there are dimensions each; substrings of this many bits.
ROTATIONS, SUBSTRING = 2, 16
#: The radius holds this share of the fitted rows' true neighbours.
COVER = 0.95
#: Queries of one pass, broadcast: at most 32,768 * (8 * dimensions + code) bytes, 18 MB at 64 dimensions.
QUERY_BLOCK = 32_768
#: Queries that a task probes together, and pairs that it reranks together.
PROBE_BLOCK, RERANK_BLOCK = 64, 32_768
#: Rows that are indexed together in a task.
INDEX_BLOCK = 16_384
_COUNTS = np.bitwise_count(np.arange(1 << SUBSTRING, dtype=np.uint32)).astype(np.uint8)


@dataclass(frozen=True)
class Coder:
    """Centre, rotations and the Hamming radius that was fitted for them."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """Codes as 16-bit substrings, a column for each index."""
        bits = ((x - self.mean) @ self.rotation) > 0
        packed = np.packbits(bits, axis=1)
        packed = np.pad(packed, ((0, 0), (0, packed.shape[1] % 2)))
        return packed.view(">u2").astype(np.uint16)


def _rotations(x: np.ndarray, count: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: principal axes, then orthogonal rotations that bring rows close to their signs."""
    _, axes = np.linalg.eigh(x.T @ x)
    v, out = x @ axes, []
    for seed in range(count):
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return np.concatenate(out, axis=1)


def fit_coder(sample: np.ndarray, k: int = K, rotations: int = ROTATIONS, cover: float = COVER) -> Coder:
    """Fit on a bounded sample; the radius holds ``cover`` of the sample's true ``k`` neighbours of 400 of its rows."""
    mean = sample.mean(axis=0)
    rotation = _rotations(sample - mean, rotations)
    coder = Coder(mean, rotation, rotation.shape[1])
    codes, seen = coder.parts(sample), []
    for i in range(0, len(sample), max(1, len(sample) // 400)):
        far = np.linalg.norm(sample - sample[i], axis=1)
        far[i] = np.inf
        near = np.argpartition(far, min(k, len(far) - 1))[:k]
        seen.append(_COUNTS[codes[near[np.isfinite(far[near])]] ^ codes[i]].sum(axis=1))
    found = np.concatenate(seen) if seen else np.array([])
    return Coder(mean, rotation, int(np.quantile(found, cover)) if len(found) else rotation.shape[1])


def reaches(radius: int, tables: int) -> list[int]:
    """Bits that each substring is probed within: a code within ``radius`` lies within one of them, as all exceeded would add up to more."""
    whole, left = divmod(radius, tables)
    return [whole if i <= left else whole - 1 for i in range(tables)]


def _ball(reach: int) -> np.ndarray:
    """All differences of a substring in at most ``reach`` bits."""
    return np.flatnonzero(_COUNTS <= reach).astype(np.uint16)


class MultiIndex:
    """A block of rows, indexed by each substring of its codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, [np.unique(part, return_inverse=True) for part in codes.T]
        self.wide = _wide(codes)

    def probed(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """Which rows (columns) the probes of each code (rows) hit.

        A table's ball is enumerated while it is smaller than the table; beyond that (wide radii) the table's distinct values are compared.
        """
        hit = np.zeros((len(asked), len(self.codes)), dtype=bool)
        for part, (values, place), reach in zip(asked.T, self.tables, reaches(radius, len(self.tables)), strict=True):
            if reach < 0:
                continue
            ball = _ball(reach)
            if len(ball) < len(values):
                at = np.minimum(np.searchsorted(values, part[:, None] ^ ball), len(values) - 1)
                near = np.zeros((len(part), len(values)), dtype=bool)
                row, col = np.nonzero(values[at] == part[:, None] ^ ball)
                near[row, at[row, col]] = True
            else:
                near = _COUNTS[part[:, None] ^ values] <= reach
            hit |= near[:, place]
        return hit

    def pairs(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places ``(code, row)`` of every row within ``radius`` bits of each code, by code and row."""
        code, row = np.nonzero(self.probed(asked, radius))
        near = np.bitwise_count(self.wide[row] ^ _wide(asked)[code]).sum(axis=1) <= radius
        return code[near], row[near]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row within ``radius`` bits of one code."""
        return self.pairs(code[None], radius)[1]


def _wide(codes: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words."""
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))).view(np.uint64)


def _search(coder: Coder, ids, vectors, codes, k: int, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, q_codes = ids.value, vectors.value, codes.value
        best: list[list[tuple[float, int]]] = [[] for _ in q_ids]
        bound = np.full(len(q_ids), np.inf)
        for row_ids, x in _blocks(batches, q.shape[1]):
            index = MultiIndex(coder.parts(x))
            for at in range(0, len(q_ids), PROBE_BLOCK):
                asked, row = index.pairs(q_codes[at : at + PROBE_BLOCK], radius)
                asked += at
                other = row_ids[row] != q_ids[asked]
                asked, row = asked[other], row[other]
                score = _distances(q, x, asked, row)
                near = score <= bound[asked]
                asked, row, score = asked[near], row[near], score[near]
                edges = np.searchsorted(asked, np.arange(at, min(at + PROBE_BLOCK, len(q_ids)) + 1))
                for i, (a, b) in enumerate(pairwise(edges.tolist()), at):
                    if a < b:
                        best[i] = _merged(best[i] + _nearest_once(score[a:b], row_ids[row[a:b]], k), k)
                        bound[i] = best[i][-1][0] if len(best[i]) == k else np.inf
        rows = [(int(q_ids[i]), v, s) for i, found in enumerate(best) for s, v in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def _distances(q: np.ndarray, x: np.ndarray, asked: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pair, in double precision, a bounded number of pairs at a time."""
    out = np.empty(len(row))
    for at in range(0, len(row), RERANK_BLOCK):
        part = slice(at, at + RERANK_BLOCK)
        gap = x[row[part]] - q[asked[part]]
        out[part] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _nearest_once(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    """At least the ``k`` nearest ids, with ties, each at its nearest row."""
    if len(score) > 4 * k:
        order = np.lexsort((score, ids))
        once = order[np.unique(ids[order], return_index=True)[1]]
        score, ids = score[once], ids[once]
        if len(score) > k:
            near = score <= np.partition(score, k - 1)[k - 1]
            score, ids = score[near], ids[near]
    return list(zip(score.tolist(), ids.tolist(), strict=True))


def _merged(found: list[tuple[float, int]], k: int) -> list[tuple[float, int]]:
    """The ``k`` nearest, one for each id, ties to the smaller id."""
    out, seen = [], set()
    for score, vec in sorted(found):
        if vec not in seen:
            seen.add(vec)
            out.append((score, vec))
            if len(out) == k:
                break
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    hold, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        hold.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)))
        size += batch.num_rows
        if size >= INDEX_BLOCK:
            yield np.concatenate([a for a, _ in hold]), np.concatenate([b for _, b in hold])
            hold, size = [], 0
    if hold:
        yield np.concatenate([a for a, _ in hold]), np.concatenate([b for _, b in hold])


def _usable(vector: Column) -> Column:
    """Neither null, zero nor holding null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found for each query, by Euclidean distance.

    Codes are learned on a bounded sample.  Every row is coded and indexed by all substrings, in blocks, by the
    task that reads it; each block of queries is one pass over the rows.  All codes within the fitted radius are
    reranked by exact double-precision distance; queries left with fewer than ``k`` rows are searched again at the full
    radius, which is exhaustive.  Rows with null ids, or vectors that are null, zero, not finite or of another length than
    most, take no part.  A repeated id counts once, at its nearest vector, and as a query at its first vector in sort order.
    """
    spark = vectors.sparkSession
    ship_package(spark)

    def clean(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & _usable(F.col("x")))

    rows = clean(vectors)
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    schema = "query_id long, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = lengths["n"]
    rows = rows.where(F.size("x") == dim)
    sample = np.array([r["x"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("x").collect()])
    coder = fit_coder(sample, k)
    asked = cut(clean(queries).where(F.size("x") == dim).groupBy("id").agg(F.min("x").alias("x")))
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))

    def search(wanted: DataFrame, parts: int, radius: int) -> DataFrame:
        found = []
        for block in range(parts):  # a block has some QUERY_BLOCK rows, whatever the number of queries
            rows_of = wanted.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == block).orderBy("id").collect()
            if rows_of:
                q = np.array([r["x"] for r in rows_of])
                share = [spark.sparkContext.broadcast(v) for v in (np.array([r["id"] for r in rows_of]), q, coder.parts(q))]
                found.append(cut(rows.mapInArrow(_search(coder, *share, k, radius), schema)))
        out = spark.createDataFrame([], schema)
        for df in found:
            out = out.unionByName(df)
        return out

    found = search(asked, blocks, coder.radius)
    full = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = cut(asked.join(full, asked["id"] == full["query_id"], "left_anti"))
    left = short.count()
    if left and coder.radius < coder.bits:
        found = found.unionByName(search(short, max(1, -(-left // QUERY_BLOCK)), coder.bits))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    # At most k rows a task come to each query, so a query's group is small.
    nearest_first = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    out = best.groupBy("query_id").agg(nearest_first.alias("found")).select("query_id", F.posexplode("found").alias("place", "f"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where(F.col("vec_id") % QUERY_STRIDE == 0))
