from collections import Counter, defaultdict

from spark_cues.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def check(got, data, shards):
    assert len(got) == len(data)
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return sizes


def test_sizes_are_near_equal_and_small_groups_stay_whole(spark):
    data = [(k, f"text {k} " + "é" * (k % 40), "old") for k in range(3000)] + [(k, "a shared text", "old") for k in range(3000, 3010)] + [(None, None, "old"), (1, "text 1 é", "old")]
    got = sharding.shard_by_bytes(spark.createDataFrame(data, SCHEMA).repartition(5), 10, 0.02, bucket_bytes=9000).collect()
    sizes = check(got, data, 10)
    mean = sum(sizes.values()) / 10
    assert len(sizes) == 10 and all(abs(s - mean) <= 0.06 * mean for s in sizes.values())
    assert len({r["shard"] for r in got if r["text"] == "a shared text"}) == 1


def test_a_third_of_all_rows_with_one_text_is_split(spark):
    data = [(k, "the same text for many", "x") for k in range(1000)] + [(k, f"other {k} with some words", "x") for k in range(1000, 3000)]
    sizes = check(sharding.shard_by_bytes(spark.createDataFrame(data, SCHEMA).repartition(5), 10, 0.01).collect(), data, 10)
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 10


def test_one_huge_row_and_few_rows(spark):
    data = [(1, "x" * 100_000, "x"), (2, "y", "x"), (3, "z", "x")]
    check(sharding.shard_by_bytes(spark.createDataFrame(data, SCHEMA), 4).collect(), data, 4)


def test_empty_table(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], SCHEMA), 4).count() == 0


def test_below_counts_exactly(spark):
    keys = spark.createDataFrame([(5, 1, 10), (5, 2, 20), (7, 0, 30), (-3, 9, 40)], "h long, d long, n long")
    assert sharding._below(keys, [(-3, 0), (5, 2), (7, sharding._LOW), (9, 0)])[0] == [0, 50, 70, 100]


def test_rows_that_repeat_text_and_id_are_split_too(spark):
    data = [(k if k % 2 else None, "one text", "x") for k in [1, 2] * 2000]
    got = sharding.shard_by_bytes(spark.createDataFrame(data, SCHEMA).repartition(5), 40).collect()
    sizes = check(got, data, 40)
    assert len(sizes) == 40 and max(sizes.values()) <= 1.05 * sum(sizes.values()) / 40


def test_many_splitters_take_few_steps(monkeypatch):
    import time

    import numpy as np

    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(-(1 << 62), 1 << 62, 200_000))
    size = rng.integers(20, 200, len(h))
    upto = np.concatenate([[0], np.cumsum(size)])

    def below(keys, probes):
        at = np.searchsorted(h, [p[0] for p in probes], side="left")
        return upto[at].tolist(), at.tolist()

    monkeypatch.setattr(sharding, "_below", below)
    total, n = int(upto[-1]), 5000
    targets = [total * k // n for k in range(1, n)]
    began = time.process_time()
    found, rounds = sharding.find_splitters(None, targets, total / n, total)
    assert time.process_time() - began < 60 and rounds < 20
    got = upto[np.searchsorted(h, [f[0] for f in found], side="left")]
    assert np.abs(got - targets).max() <= total / n
