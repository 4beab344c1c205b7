import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F
from spark_cues.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, fingerprint string, k long, bucket string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], SCHEMA).repartition(3)


def plain(rows):
    """Every row in descending id against its edited text and the next row, by whole sets where they are small."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sets = [set(fp.shingle_hashes(t).tolist()) for t in (text, edited, after)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), like(sets[0], sets[1]), like(sets[0], sets[2]))
    return out


def test_edited_texts_and_likenesses(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    rows = [(k * 7 - 50, " ".join(rng.choice(words, n))) for k, n in enumerate(rng.integers(0, 120, 90))]
    rows += [(900, None), (901, ""), (902, rows[5][1]), (903, rows[5][1]), (904, "one"), (905, "ab 日本語 ümlaut 𝔘")]
    got = {r["doc_id"]: r for r in fp.edited_fingerprints(frame(spark, rows)).collect()}
    want = plain(rows)
    assert len(got) == len(rows)
    for i, (n, sha, edited, after) in want.items():
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (n, sha)
        assert got[i]["near_edited"] == pytest.approx(edited) and got[i]["near_next"] == pytest.approx(after)
    assert got[902]["fingerprint"] == got[903]["fingerprint"] and got[903]["near_next"] == 1.0
    assert got[900]["fingerprint"] == "" and got[901]["near_next"] == 1.0


def test_one_row_none_and_repeated_or_missing_ids(spark):
    assert fp.edited_fingerprints(frame(spark, []).limit(0)).collect() == []
    one = fp.edited_fingerprints(frame(spark, [(3, "a b c d e f")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"a b c a b c").hexdigest()[:64]
    rows = [(None, f"none {k} x y z") for k in range(40)] + [(5, f"five {k} x y z") for k in range(80)] + [(5, "same text of five words")] * 30 + [(k, f"text {k}") for k in range(6, 16)]
    got = fp.edited_fingerprints(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    # Each row is followed by exactly one other, in one ring, however ids fall into buckets.
    assert sum(r["near_next"] == 1.0 for r in got) >= 29


def test_buckets_keep_the_order():
    splitters = np.array([3, 5, 5, 5, 9])
    find = fp._buckets(splitters)
    keys = sorted(itertools.product([1, 3, 4, 5, 7, 9, 11], [-(1 << 62), -5, 1 << 61, (1 << 63) - 1]), key=lambda x: (-x[0], x[1]))
    found = find(*(np.array(c) for c in zip(*keys, strict=True)))
    assert sorted(found.tolist()) == found.tolist() and 0 <= found.min() and found.max() <= 5
    assert len({b for b, (i, _) in zip(found.tolist(), keys, strict=True) if i == 5}) >= 3


def test_long_texts_and_estimates():
    rng = np.random.default_rng(1)
    a, b = (rng.choice([f"v{k}" for k in range(20000)], 100_000) for _ in range(2))
    text, mixed = " ".join(a), " ".join([*a[:60_000], *b[:40_000]])
    whole = [set(fp.shingle_hashes(t).tolist()) for t in (text, mixed)]
    assert fp.likeness(fp.sketch(text), fp.sketch(mixed)) == pytest.approx(len(whole[0] & whole[1]) / len(whole[0] | whole[1]), abs=0.12)
    assert len(fp.shingle_hashes("x" * 1_000_000)) > 0 and len(fp.shingle_hashes(" " * 1_000_000)) == 0
    parts = [" ".join(a[k : k + 25_004]) for k in range(0, 100_000, 25_000)]
    assert fp.merged(map(fp.sketch, parts)).tolist() == fp.sketch(text).tolist()


def test_columns_over_sketches(spark):
    texts = ["a b c d e f g", "b c d e f g h", "", None, " ".join(map(str, range(5000))), " ".join(map(str, range(2500)))]
    df = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["sketch"] for r in fp.sketches(df, keys=("fingerprint",)).collect()}
    assert all(got[i] == fp.sketch(t).tolist() for i, t in enumerate(texts))
    pair = spark.createDataFrame([(got[0], got[1], got[4], got[5], got[2])], "a array<long>, b array<long>, c array<long>, d array<long>, e array<long>")
    r = pair.select(fp.resemblance(F.col("a"), F.col("b")).alias("ab"), fp.containment(F.col("a"), F.col("b")).alias("in_b"), fp.resemblance(F.col("e"), F.col("e")).alias("ee"), fp.distinct_shingles(F.col("c")).alias("n"), fp.containment(F.col("d"), F.col("c")).alias("in_c"), fp.resemblance(F.col("c"), F.col("d")).alias("cd")).first()
    assert r["ab"] == pytest.approx(2 / 4) and r["in_b"] == pytest.approx(2 / 3) and r["ee"] == 1.0
    assert r["n"] == pytest.approx(4996, rel=0.3) and r["in_c"] > 0.7 and r["cd"] == pytest.approx(0.5, abs=0.13)
    written = spark.createDataFrame([(fp._written(fp.sketch(texts[4])),), ("",)], "s string").select(fp.read_fingerprint(F.col("s")).alias("s")).collect()
    assert [x["s"] for x in written] == [got[4], []]


def test_merging_by_key_equals_one_sketch_of_all(spark):
    rows = [(k, " ".join(f"t{(k * 5 + j) % 900}" for j in range(30))) for k in range(400)]
    df = frame(spark, [*rows, (None, None)]).withColumn("site", F.when(F.col("doc_id") % 3 > 0, F.lit("hot")).when(F.col("doc_id") < 300, F.lit("cold")))
    got = {r["site"]: (r["sketch"], r["n_parts"]) for r in fp.merge_sketches(fp.sketches(df, keys=("site",)), "site").collect()}
    for site, test in (("hot", lambda k: k % 3 > 0), ("cold", lambda k: k % 3 == 0 and k < 300)):
        own = [t for k, t in rows if test(k)]
        assert got[site] == (fp.merged(map(fp.sketch, own)).tolist(), len(own))
    assert got[None][1] == sum(k % 3 == 0 and k >= 300 for k, _ in rows) + 1
    assert fp.merge_sketches(fp.sketches(df.limit(0), keys=("site",)), "site").collect() == []


def test_query_equals_plain_twin(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got, want = {r["doc_id"]: r for r in fp.op12_bottom_k(spark, tiny).collect()}, plain(rows)
    assert got.keys() == want.keys()
    assert all((got[i]["n_chars"], got[i]["edited_sha256"]) == want[i][:2] for i in want)
    off = [max(abs(got[i]["near_edited"] - want[i][2]), abs(got[i]["near_next"] - want[i][3])) for i in want]
    assert max(off) < 0.2 and np.mean(off) < 0.03
    same = {}
    for i, t in rows:
        same.setdefault(t, set()).add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())
