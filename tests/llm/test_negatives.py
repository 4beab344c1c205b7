import math

import numpy as np
import pytest
from spark_cues.llm import negatives as neg

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "clash", "clash") for i, v, c in rows], SCHEMA).repartition(3)


def plain(rows, anchors, positives=5, negatives=10):
    """Every pair scored."""
    good = {}
    for i, v, c in sorted((r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[2], r[1])):
        good.setdefault(i, ([math.floor(256 * x) for x in v], c))
    out = set()
    for a in anchors:
        if a not in good:
            continue
        q, own = good[a]
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, c) for i, (v, c) in good.items() if i != a)
        for p, i, c in [s for s in scored if s[2] == own][:positives]:
            p = -p
            fits = [(j, -n) for n, j, d in scored if d != own and 30 * p <= -100 * n <= 90 * p][:negatives]
            out |= {(a, i, rank, j, p, n) for rank, (j, n) in enumerate(fits, 1)}
    return out


def mined(spark, rows, anchors, **more):
    df = neg.labelled(frame(spark, rows))
    asked = spark.createDataFrame([(a,) for a in anchors], "vec_id long")
    got = [tuple(r) for r in neg.hard_negatives(df, asked, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_clustered_and_tied_rows(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 9))
    x = np.concatenate([rng.normal(size=(250, 9)), centres[rng.integers(0, 6, 250)] + 0.05 * rng.normal(size=(250, 9)), np.repeat(centres, 40, axis=0)])
    rows = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, rng.integers(0, 4, len(x)), strict=True))]
    assert mined(spark, rows, list(range(0, 740, 60))) == plain(rows, list(range(0, 740, 60)))


def test_unusable_rows_repeats_few_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.5, 0.5], 2), (3, None, 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 2), (6, [1.0, 1.0], None), (7, [None, 1.0], 2), (None, [0.6, 0.6], 2), (8, [0.0, 0.0], 3), (9, [-1.0, -1.0], 2), (2, [0.4, 0.4], 5), (2, [0.5, 0.5], 2), (10, [], 1)]
    assert mined(spark, rows, [0, 1, 2, 3, 77]) == plain(rows, [0, 1, 2])
    assert mined(spark, rows + [(11, [1.0, 2.0, 3.0], 1)], [0]) == plain(rows, [0])
    assert mined(spark, rows, []) == set()
    assert neg.hard_negatives(neg.labelled(frame(spark, []).limit(0)), spark.createDataFrame([(1,)], "vec_id long")).collect() == []
    assert mined(spark, [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [5.0, 1.0], 2)], [0]) == plain([(0, [0.0, 0.0], 1), (1, [0.0, 0.0], 1), (2, [5.0, 1.0], 2)], [0]) == {(0, 1, 1, 2, 0, 0)}


def test_anchors_in_blocks_and_one_vector_for_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(neg, "ANCHOR_BLOCK", 3)
    rng = np.random.default_rng(9)
    rows = [(k, (np.ones(4) if k % 3 == 0 else rng.normal(size=4)).tolist(), k % 5) for k in range(300)]
    assert mined(spark, rows, list(range(0, 300, 30))) == plain(rows, list(range(0, 300, 30)))


def test_a_tree_prunes_and_misses_nothing():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 60
    x = np.round(centres[rng.integers(0, 40, 5000)] + rng.normal(size=(5000, 16)) * 3)
    labels = rng.integers(0, 4, 5000)
    tree = neg.Tree(np.arange(5000), labels, x, leaf=32)
    assert sorted(tree.ids.tolist()) == list(range(5000))
    low, high = tree.intervals(0, slice(None), x[0])
    for leaf in range(len(low)):
        scores = tree.x[tree.rows(leaf)] @ x[0]
        assert low[leaf] <= scores.min() and scores.max() <= high[leaf]
    seen = 0
    for a in range(0, 5000, 500):
        scores = x @ x[a]
        windows = [neg.ScoreWindow(*w, 10, []) for w in ((-np.inf, np.inf), (0.3 * scores[a], 0.9 * scores[a]), (5000.0, 5200.0))]
        for w in windows:
            one = neg.ScoreWindow(w.low, w.high, w.k, [])
            seen += neg.search(tree, x[a], a, labels[a], False, [one])
            fits = [(-s, i) for i, s in enumerate(scores.tolist()) if labels[i] != labels[a] and w.low <= s <= w.high]
            assert one.best == sorted(fits)[:10]
    assert seen < 0.35 * 30 * len(low)


def test_packed_order_is_by_tiles():
    x = np.random.default_rng(0).uniform(size=(1024, 2))
    order = neg.str_order(x, 16, np.array([0, 1]))
    assert sorted(order.tolist()) == list(range(1024))
    tiles = x[order].reshape(64, 16, 2)
    area = (tiles.max(axis=1) - tiles.min(axis=1)).prod(axis=1)
    assert area.mean() < 2 / 64
    assert len(neg.str_order(np.empty((0, 2)), 16, np.array([0]))) == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, tiny, scale):
    where = tiny.replace("sf0.001", scale)
    rows = [(r["vec_id"], list(r["embedding"]), (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()]
    got = {tuple(r) for r in neg.op13_str_tree(spark, where).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}
    assert got == plain(rows, [i for i, _, _ in rows if i % 100 == 0]) and got
