"""Weighted lexicon toxicity scores by Aho-Corasick over folded text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, ship_package

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "​": "", "‌": "", "‍": "", "­": "", "﻿": "",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
#: A lexicon entry inside one of these phrases isn't counted.
EXCEPTIONS = ("clown fish", "clown shoes", "class clown", "trash can", "trash bin", "trash collection", "pond scum", "not stupid", "sore loser rule")

#: Labelled rows that the lexicon and its calibration are fitted on, at most.
FIT_ROWS = 20_000
#: Word starts of these many letters are candidate entries, besides whole words.
STEM_LETTERS = (5, 6, 7, 8)
#: A candidate needs this many toxic documents and this log odds ratio.
LEAST_DOCS, LEAST_WEIGHT, ENTRIES = 8, 2.5, 400

_FULLWIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_FOLD = _FULLWIDTH | {ord(k): v for k, v in HOMOGLYPHS.items()}
#: A whole run before a letter; a run is looked at once, however long.
_MIXED = re.compile(r"(?<![0134578@$!])[0134578@$!]++(?=[^\W\d_])")
_APART = re.compile(r"[\W_]+")
_DIGITS = str.maketrans(DIGITS)


def fold(text: str | None) -> str:
    """Lower case, look-alike letters made Latin, digits inside words made letters, other signs one space."""
    low = (text or "").translate(_FULLWIDTH).lower().translate(_FOLD)
    return " " + _APART.sub(" ", _MIXED.sub(lambda m: m[0].translate(_DIGITS), low)).strip() + " "


@dataclass(frozen=True)
class Lexicon:
    """Entries (folded, with a leading space) to weights; logistic coefficients over :meth:`features`."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, ...] = (-3.0, 4.0, 1.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for phrase in self.exceptions:
            out.add_word(fold(phrase), (fold(phrase), None))
        for entry, weight in self.weights.items():
            out.add_word(entry, (entry, weight))
        if len(out):
            out.make_automaton()
        return out


def lexicon_hits(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, float]]:
    """``(start, weight)`` of each word hit, the heaviest entry of a word, without those in exception phrases."""
    if not len(automaton):
        return []
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (entry, weight) in automaton.iter(folded):
        start = end - len(entry) + 1
        if weight is None:
            spared.append((start, end - 1))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    out, at, until = [], 0, 0
    spared.sort()
    for start, weight in sorted(best.items()):  # both lists in order: each phrase is looked at once
        while at < len(spared) and spared[at][0] <= start:
            until = max(until, spared[at][1])
            at += 1
        if start >= until:
            out.append((start, weight))
    return out


def features(folded: str, automaton: ahocorasick.Automaton) -> list[float]:
    """Constant, weight per word (scaled), the sum's logarithm, the logarithm of the length."""
    words, total = folded.count(" ") - 1 if len(folded) > 2 else 0, sum(w for _, w in lexicon_hits(folded, automaton))
    return [1.0, float(np.log1p(100.0 * total / max(50, words))), float(np.log1p(total)), float(np.log1p(words)) / 5.0]


def _scores(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, beta = lexicon.automaton(), np.array(lexicon.coefficients)
        for batch in batches:
            texts, out = batch.column(1), np.empty(batch.num_rows)
            for k in range(batch.num_rows):
                out[k] = np.array(features(fold(texts[k].as_py()), automaton)) @ beta
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))], names=["doc_id", "score"])

    return run


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    entries, toxics = [], []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(toxics, pa.int64())], names=["entry", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(fold(text).split())
            found = {f" {w} " for w in words if len(w) > 2}
            found.update(f" {w[:n]}" for w in words for n in STEM_LETTERS if len(w) >= n)
            entries += sorted(found)
            toxics += [toxic] * len(found)
            if len(entries) > 50_000:
                yield made()
                entries, toxics = [], []
    yield made()


def _measured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            rows = np.array([features(fold(x), automaton) for x in batch.column(0).to_pylist()]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(rows[:, k]) for k in range(1, 4))], names=["toxic", "a", "b", "c"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; both labels weigh the same in all."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    beta, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id, as text, leaves 0 when divided by 5; never fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_lexicon(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Fit entries, weights and calibration on at most ``rows`` labelled rows outside the held-out fifth.

    The rows are those with the smallest hash of the id, so the sample doesn't depend on order.  A document's
    label is the largest of its non-null labels; of texts with one id the smallest is taken.  One half of them (by another hash) gives the entries and their smoothed log odds
    ratios, the other the logistic calibration.  Without both labels the lexicon is empty.
    """
    ship_package(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("long").alias("toxic")).where(~held_out(F.col("id")))
    # At most `rows` ids: a bounded table.
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(chosen, "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    sample = cut(texts.select("text", "toxic", (F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(2)) == 0).alias("first")))
    n = {(r["first"], r["toxic"]): r["count"] for r in sample.groupBy("first", F.col("toxic")).count().collect()}
    pos, neg = n.get((True, 1), 0), n.get((True, 0), 0)
    if not pos or not neg or not n.get((False, 1)) or not n.get((False, 0)):
        return Lexicon({}, exceptions, (-1.0, 0.0, 0.0, 0.0))
    counts = sample.where("first").select("text", "toxic").mapInArrow(_stems, "entry string, toxic long").groupBy("entry").agg(F.sum("toxic").alias("p"), F.count("*").alias("n"))
    weight = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (neg + 1))
    strong = counts.where(F.col("p") >= min(LEAST_DOCS, max(1, pos // 4))).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT).orderBy(F.desc("weight"), "entry").limit(ENTRIES).collect()
    lexicon = Lexicon({r["entry"]: float(r["weight"]) for r in strong}, exceptions)
    rest = np.array(sample.where("not first").select("text", "toxic").mapInArrow(_measured(lexicon), "toxic long, a double, b double, c double").collect(), dtype=float)
    beta = _logistic(np.column_stack([np.ones(len(rest)), rest[:, 1:]]), rest[:, 0])
    return Lexicon(lexicon.weights, exceptions, tuple(float(x) for x in beta))


def toxicity_scores(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row; score is from 0 to 1.  Null and empty texts have no hits; ids may be null or repeat."""
    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scores(lexicon), "doc_id long, score double")


def op9_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = fit_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity_scores(docs, lexicon)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` scored under ``threshold``, columns unchanged; scored in place, without a shuffle."""
    ship_package(docs.sparkSession)

    def score(texts):
        automaton, beta = lexicon.automaton(), np.array(lexicon.coefficients)
        import pandas as pd

        return pd.Series([float(np.array(features(fold(x), automaton)) @ beta) for x in texts], dtype="float64")

    logit = float(np.log(threshold / (1 - threshold)))
    return docs.where(F.pandas_udf(score, "double")(F.col(text_col)) < logit)
