"""Long groups cut into ranges give the rows that one piece gives."""

import random

import pytest
from pyspark.sql import functions as F
from spark_cues.operators import folds, intervals, phrases, ranges

CUES = "media_id long, track string, seq long, start double, end double, text string"


def media(seed, back=False, count=160):
    """One medium with nearly all cues, and some short ones; with ``back`` times that jump back."""
    rng, out = random.Random(seed), []
    for m, n in ((0, count), (1, 3), (2, 1), (3, 40)):
        clock = 0.0
        for k in range(n):
            clock += rng.choice([0.0, 0.0, 0.2, 0.4, 3.0, 12.0])
            if back and rng.random() < 0.15:
                clock -= rng.choice([4.0, 40.0])
            length = rng.choice([0.5, 1.2, 2.5, 7.0, 31.0])
            out.append((m, "t", k, round(clock, 3), round(clock + length, 3), rng.choice(["so", "it is", "done.", "", "end!"])))
            clock += length
    return out


def plain_chunks(rows, least=8.0, most=30.0, pause=0.3):
    out = {}
    for m in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == m), key=lambda r: r[2])
        begun, number = None, -1
        for k, (_, _, seq, start, end, text) in enumerate(own):
            closes = text.strip()[-1:] in (".", "!", "?", "…") and text.strip() != "" or (k + 1 < len(own) and round(own[k + 1][3] - end, 6) >= pause)
            if not text.strip():
                continue
            if begun is not None and round(end - begun, 6) > most:
                begun = None
            if begun is None:
                begun, number = start, number + 1
            out.setdefault((m, number), []).append((seq, start, end, text.strip()))
            if round(end - begun, 6) >= least and closes:
                begun = None
    return {k: (len(v), v[0][1], v[-1][2], " ".join(t for *_, t in v)) for k, v in out.items()}


@pytest.mark.parametrize(("width", "back"), [(5, False), (17, False), (7, True), (1, False), (10_000, True)])
def test_chunks(spark, width, back):
    for seed in range(3):
        rows = media(seed, back)
        got = folds.merge_long(spark.createDataFrame(rows, CUES).repartition(5), width=width).collect()
        assert {(r["media_id"], r["chunk_no"]): (r["n_cues"], r["start"], r["end"], r["text"]) for r in got} == plain_chunks(rows)


@pytest.mark.parametrize("seconds", [3.0, 20.0, 1e9])
def test_picks(spark, seconds):
    rng = random.Random(5)
    rows = [(m, i, float(x)) for m, n in ((0, 200), (1, 4), (2, 1)) for i, x in enumerate(sorted(rng.choice([2.0 * k, rng.uniform(0, 400)]) for k in range(n)))]
    want = set()
    for m in range(3):
        last = None
        for _, i, x in sorted((r for r in rows if r[0] == m), key=lambda r: (r[2], r[1])):
            if last is None or x - last >= 5.0:
                want.add((m, i, x))
                last = x
    got = folds.dedup_min_gap(spark.createDataFrame(rows, "media_id long, i int, seconds double").repartition(4), seconds=seconds)
    assert got.columns == ["media_id", "i", "seconds"] and {tuple(r) for r in got.collect()} == want


def test_a_long_group_spreads_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("media_id"), F.lit("t").alias("track"), F.col("id").alias("seq"), (F.col("id") * 2.0).alias("start"), (F.col("id") * 2.0 + 1.9).alias("end"), F.when(F.col("id") % 7 == 6, "end.").otherwise("so").alias("text"))
    near = ranges.with_neighbours(rows, ["media_id", "track"], "seq", lead=["start"], width=500)
    assert near.groupBy("__b").count().where("count > 500").count() == 0
    got = folds.merge_long(rows, width=500)
    assert got.agg(F.sum("n_cues"), F.count("*"), F.max("chunk_no")).first()[0] == 20_000
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, folds.merge_long(rows).collect()))


def test_neighbours_and_counts(spark):
    rows = spark.createDataFrame([(m, s, float(s)) for m, n in ((None, 9), (1, 23), (2, 1)) for s in range(0, 3 * n, 3)], "m long, s long, v double")
    near = ranges.with_neighbours(rows, ["m"], "s", lag=["v"], lead=["v"], width=10)
    got = ranges.numbered_groups(near, ["m"], "s", ["v"], ["v"], lambda row, last: last.isNull() | (row["v"] % 2 == 0), "upto", width=10).collect()
    assert len(got) == 33
    for r in got:
        last = {None: 24, 1: 66, 2: 0}[r["m"]]
        assert (r["before"] and r["before"]["v"]) == (r["s"] - 3.0 if r["s"] else None)
        assert (r["after"] and r["after"]["v"]) == (r["s"] + 3.0 if r["s"] < last else None)
        assert r["upto"] == sum(v % 2 == 0 for v in range(0, r["s"] + 1, 3))


@pytest.mark.parametrize("width", [4, 33])
def test_gaps_and_phrases(spark, width):
    rows = [r for r in media(8) if r[0] != 3]
    cues = spark.createDataFrame(rows, CUES).repartition(4)
    durations = spark.createDataFrame([(0, 2000.0), (1, 90.0), (2, 3.0), (7, 50.0)], "media_id long, duration double")
    assert sorted(map(tuple, intervals.find_gaps(cues, durations, width=width).collect())) == sorted(map(tuple, intervals.find_gaps(cues, durations).collect()))
    want = []
    for m in range(3):
        own, number, before = sorted(r for r in rows if r[0] == m), 0, None
        for r in own:
            number += before is None or before[5].strip().endswith((".", "!")) or round(r[3] - before[4], 6) > 2.0
            want.append((m, r[2], number))
            before = r
    got = phrases.phrase_groups(cues, width=width).select("media_id", "seq", "phrase_no").collect()
    assert sorted(map(tuple, got)) == want
    assert sorted(map(tuple, phrases.merge_phrases(cues, width=width).collect())) == sorted(map(tuple, phrases.merge_phrases(cues).collect()))


def plain_window(rows, least=20.0, most=60.0, words=20):
    out = {}
    for m in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == m), key=lambda r: r[2])
        best = None
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                span, n = round(own[b][4] - own[a][3], 6), n + len(own[b][5].split())
                if span > most:
                    break
                if span >= least and (best is None or n > best[2]):
                    best = (own[a][2], own[b][2], n)
        if best and best[2] >= words and own[-1][4] - own[0][3] >= least:
            out[m] = best
    return out


@pytest.mark.parametrize(("width", "back"), [(30, False), (8, False), (20, True), (100_000, False)])
def test_clone_windows_equal_all_pairs(spark, width, back):
    for seed in (1, 2):
        rows = [(*r[:5], " ".join(["w"] * (hash((seed, r[2])) % 7))) for r in media(seed, back, count=400)]
        got = intervals.best_clone_window(spark.createDataFrame(rows, CUES).repartition(5), width=width, words=3)
        assert {r["media_id"]: (r["i"], r["j"], r["n_words"]) for r in got.collect()} == plain_window(rows, words=3)
