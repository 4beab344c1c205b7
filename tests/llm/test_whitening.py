import math
from fractions import Fraction

import numpy as np
import pytest
from spark_cues.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, n string, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, components=4):
    """Exact sums, a covariance in fractions, and numpy's own eigenpairs."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = [list(v) for v in dict.fromkeys(tuple(v) for _, v in good)]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = len(sums)
    v = np.array([[float(sum((Fraction(x[i]) - Fraction(sums[i], n)) * (Fraction(x[j]) - Fraction(sums[j], n)) for x in fit) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    out = {}
    for i, x in good:
        off = [n * a - s for a, s in zip(x, sums, strict=True)]
        w = (np.array(x, dtype=float) - np.array(sums) / n) @ vectors[:, order] / np.sqrt(values[order])
        out[i] = (sum(a * a for a in off), w, values[order] / np.trace(v))
    return n, out


def check(rows, n, want, components):
    by_component = {}
    assert len(rows) == components * len(want)
    for r in rows:
        deviation, w, explained = want[r["vec_id"]]
        assert (r["n"], int(r["deviation"])) == (n, deviation)
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9) and r["identity_error"] < 1e-9
        by_component.setdefault(r["component"], []).append((r["whitened"], w[r["component"] - 1]))
    assert sorted(by_component) == list(range(1, components + 1))
    for pairs in by_component.values():
        a, b = map(np.array, zip(*pairs, strict=True))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_rows_equal_a_plain_twin(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 7)) * [5, 3, 2, 1.5, 1, 0.5, 0.2]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, x[3].tolist()) for k in range(60)]
    bad = [(2000, None), (2001, []), (2002, [None] + [0.0] * 6), (2003, [float("nan")] + [0.0] * 6), (2004, [float("inf")] + [0.0] * 6), (2005, [1.0])]
    got = wh.whitened(frame(spark, rows + bad)).collect()
    n, want = plain(rows)
    assert n == 80
    check(got, n, want, 4)


def test_few_rows_low_rank_and_repeats(spark):
    assert wh.whitened(frame(spark, []).limit(0)).collect() == []
    assert wh.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])).collect() == []
    two = [(1, [1.0, -2.0, 0.5]), (2, [3.0, 5.0, 0.25]), (2, [1.0, -2.0, 0.5]), (None, [3.0, 5.0, 0.25])]
    got = wh.whitened(frame(spark, two)).collect()
    assert [r["component"] for r in got] == [1] * 4 and all(r["n"] == 2 and r["explained"] == pytest.approx(1.0) for r in got)
    assert sorted(round(abs(r["whitened"]), 9) for r in got) == [1.0] * 4


def test_large_numbers_stay_exact(spark):
    rows = [(k, [1e9 + k, -1e9 - 2.0 * k * k]) for k in range(30)]
    n, want = plain(rows, 2)
    check(wh.whitened(frame(spark, rows)).collect(), n, want, 2)


@pytest.mark.parametrize("spectrum", [[9, 7, 5, 3, 1, 0.5], [9, 9, 9, 9, 9, 1], [5, 4, 3, 3 - 1e-7, 3 - 2e-7, 1], [1, 0, 0, 0, 0, 0], [1e12, 1e6, 1, 1e-3, 0, 0], list(np.linspace(2, 1, 40)), [4.0], [3, 3], [1 + 1e-10, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]])
def test_eigenpairs(spectrum):
    d = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))[0]
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, vectors = wh.top_eigenpairs(a)
    want = [v for v in sorted(np.linalg.eigvalsh(a), reverse=True) if v > max(spectrum) * d * 4 * 2.3e-16][:4]
    assert values == pytest.approx(want, rel=1e-9, abs=1e-12 * max(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-10
    assert np.abs(a @ vectors - vectors * values).max() < 1e-11 * max(spectrum)


def test_inertia_counts():
    a = np.random.default_rng(0).normal(size=(20, 20))
    a = a + a.T
    values, counts = np.linalg.eigvalsh(a), wh.Inertia(a)
    for shift in np.linspace(values[0] - 1, values[-1] + 1, 57):
        assert counts.above(shift) == (values > shift).sum()
    low, high = counts.between(3, 1e-9)
    assert low <= values[-3] + 1e-9 and values[-3] - 1e-9 <= high and high - low <= 1e-9
    assert wh.Inertia(np.diag([1.0, 2.0, 2.0])).above(1.5) == 2


def test_nothing_to_find():
    assert len(wh.top_eigenpairs(np.zeros((3, 3)))[0]) == 0 and len(wh.top_eigenpairs(np.empty((0, 0)))[0]) == 0


def test_query_equals_plain_twin(spark, tiny):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    small = [(i, v[:12]) for i, v in rows]
    n, want = plain(small)
    check(wh.whitened(frame(spark, small)).collect(), n, want, 4)
    got = wh.op11_feast_whitening(spark, tiny)
    assert dict(got.dtypes)["deviation"] == "bigint"
    x = np.floor(256 * np.array([v for _, v in rows]))
    v = np.cov(x.T, bias=True)
    values, vectors = np.linalg.eigh(v)
    for k in range(4):
        part = {r["vec_id"]: r for r in got.collect() if r["component"] == k + 1}
        own = (x - x.mean(axis=0)) @ vectors[:, -1 - k] / np.sqrt(values[-1 - k])
        w = np.array([part[i]["whitened"] for i, _ in rows])
        assert min(np.abs(w - own).max(), np.abs(w + own).max()) < 1e-6
        assert part[rows[0][0]]["explained"] == pytest.approx(values[-1 - k] / np.trace(v), rel=1e-9) and part[rows[0][0]]["identity_error"] < 1e-9
