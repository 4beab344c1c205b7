import random
import re

import numpy as np
import pytest
import xxhash
from spark_cues.llm import components, simhash

SCHEMA = "doc_id long, text string, fp string, count long"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable from each of ``(id, fingerprint)``."""
    out = {k: d for k, (d, _) in enumerate(prints)}
    fps = np.array([f for _, f in prints], dtype=np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
            low = min((out[j] for j in near if out[j] is not None), default=None)
            for j in near:
                if low is not None and (out[j] is None or out[j] > low):
                    out[j], changed = low, True
    return out


def texts(n=120, seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("alpha beta gamma delta rho sigma tau phi".split()) + str(rng.randrange(60)) for _ in range(rng.randrange(60, 160))) for _ in range(12)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(0, 3)):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(9)
        out.append(" ".join(words))
    return out


def rows():
    edge = [None, "", " \t\n", "One", "one  TWO", "é Ünï ñandú\x0bÀ", "a b c", "A  B\tC", "w " * 30_000]
    return [(k, t, "x", 1) for k, t in enumerate(texts() + edge)]


def test_fingerprints_match_a_plain_version():
    for _, t, _, _ in rows():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("block", [2048, 3])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    data = [*rows(), (None, "a b c", "x", 1), (3, rows()[3][1], "x", 1)]
    got = simhash.near_duplicate_components(spark.createDataFrame(data, SCHEMA).repartition(3)).collect()
    want = plain_components([(d, plain_fingerprint(t)) for d, t, _, _ in data])
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == sorted((d if d is not None else -1, plain_fingerprint(t), want[k]) for k, (d, t, _, _) in enumerate(data))


def test_many_fingerprints_under_one_key_need_few_links():
    rng = np.random.default_rng(1)
    fps = np.array([int(x) for x in {(1 << 40) ^ (1 << int(a)) for a in rng.integers(0, 60, 200)}], dtype=np.uint64)
    links = simhash._forest(fps, 0)
    assert len(links) < len(fps)


def test_drop_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(5, "a b c d", "s", 1), (2, "A b  c d", "t", 2), (9, "other words entirely here now", "u", 3), (9, "other words entirely here now", "u", 3), (None, "a b c d", "v", 4)], SCHEMA)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["fp"]) for r in kept.collect()) == [(-1, "v"), (2, "t"), (9, "u")]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicate_components(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


def test_long_chain_of_links(spark):
    links = [(k, k + 1) for k in range(70)] + [(200, 201), (201, 201), (None, 3), (200, 201)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(71)}, 200: 200, 201: 200}


def test_repeated_ids_are_told_apart_by_text(spark):
    one, two = "some words of the first text here", "another text that shares nothing at all"
    docs = spark.createDataFrame([(2, two, "a", 1), (5, one, "b", 1), (5, two, "c", 1), (5, one, "d", 1), (7, one, "e", 1)], SCHEMA)
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(2, two), (5, one)]


def test_rows_without_ids_link_others(spark):
    got = simhash.near_duplicate_components(spark.createDataFrame([(None, "a b c", "x", 1), (4, "a b c", "x", 1), (None, "z", "x", 1)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 4), (4, 4)]
