"""State by key: replays in triggers of any size, restarts, expiry, and a crash between write and commit."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F
from spark_cues.operators import phrases
from spark_cues.streaming import live, processors

T0 = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
CUES = "media_id long, seq long, start double, end double, text string, ts timestamp"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def play(spark, tmp, name, rows, schema, slots, start):
    """Slots of rows arrive one after another; each run goes on from the checkpoint."""
    source = f"file://{tmp}/{name}"
    for k in range(0, len(rows), slots):
        spark.createDataFrame(rows[k : k + slots], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        assert start(stream, f"{source}-cp").awaitTermination(180)


def captions():
    out = []
    for m in range(3):
        clock = 0.0
        for k in range(14):
            clock += 5.0 if k % 6 == 5 else 1.0
            out.append((m, 10 * k, clock, clock + 1.5, "ends here." if k % 4 == 3 else f"word {k}", at(clock + 1.5)))
            clock += 1.5
            if k in (2, 9):
                out.append((m, 10 * k + 1, clock - 3, clock - 1, "late", at(clock + 0.1)))
            if k == 11:
                clock += 200  # a silence over the time a phrase is held
    return sorted(out, key=lambda r: r[5])


def plain(rows, gap=2.0, hold=60.0):
    """One cue after another, in order of time."""
    out = []
    for m in sorted({r[0] for r in rows}):
        phrase, tail, stamp = None, None, None
        for _, seq, start, end, text, ts in sorted((r for r in rows if r[0] == m), key=lambda r: (r[5], r[1])):
            if tail is not None and (ts - stamp).total_seconds() > hold:
                out += [phrase] if phrase else []
                phrase = tail = None
            if tail is not None and start < tail:
                out.append((m, seq, start, end, text, True))
                continue
            if phrase and round(start - tail, 6) > gap:
                out.append(phrase)
                phrase = None
            phrase = (m, phrase[1], phrase[2], end, f"{phrase[4]} {text}", False) if phrase else (m, seq, start, end, text, False)
            tail, stamp = end, ts
            if text.endswith("."):
                out.append(phrase)
                phrase = None
        out += [phrase] if phrase else []
    return sorted(out)


@pytest.mark.parametrize("slots", [7, 1000])
def test_phrases_do_not_depend_on_triggers(spark, tmp_path, slots):
    rows = captions()
    swapped = [rows[i ^ 1] if i ^ 1 < len(rows) else rows[i] for i in range(len(rows))]  # neighbours out of order, within the delay
    beat = [(9, None, 0.0, 0.0, None, at(3600))]
    out = f"file://{tmp_path}/out"
    play(spark, tmp_path, "in", swapped + beat, CUES, slots, lambda s, cp: live.write_phrases(live.stream_merge_phrases(s, delay="20 seconds"), out, cp))
    got = [tuple(r) for name, late in (("phrases", False), ("late", True)) for r in spark.read.schema("media_id long, first_seq long, start double, end double, text string").parquet(f"{out}/{name}").drop("trigger").withColumn("late", F.lit(late)).collect()]
    assert sorted(got) == plain(rows)
    on_time = spark.createDataFrame([r for r in rows if r[4] != "late"], CUES).withColumn("track", F.lit("t"))
    cut = {(r["media_id"], r["first_seq"]) for r in phrases.merge_phrases(on_time).collect()}
    assert {(g[0], g[1]) for g in got if not g[5]} == cut  # the silence is a pause as well


def test_statuses_touch_only_runs_that_speak_and_survive_restarts(spark, tmp_path):
    patterns = spark.createDataFrame([(1, "failed", "error"), (2, "synthesising", "segment")], "priority int, status string, pattern string")
    rows = [(1, k, "segment 1/9" if k == 0 else "quiet") for k in range(3)] + [(2, 0, "error")] + [(1, k, "quiet") for k in range(3, 25)]
    out = f"file://{tmp_path}/out"
    play(spark, tmp_path, "in", rows, "run_id long, line_no long, line string", 4, lambda s, cp: live.stream_phase(s, patterns, out, cp))
    first = {r["run_id"]: r["status"] for r in spark.read.parquet(f"{out}/status/v0").collect()}
    assert first == {1: "synthesising segment 1/9", 2: "failed"}
    assert {r["run_id"] for r in spark.read.parquet(f"{out}/status/v2").collect()} == {1}
    assert {r["run_id"]: r["status"] for r in live.current_statuses(spark, out).collect()} == {1: "processing", 2: "failed"}
    assert processors.phase_of([(3, "segment x"), (4, None or "")], [(2, "synthesising", "segment")]) == "synthesising"


def test_unfinished_texts_leave_and_repeats_count_once(spark, tmp_path):
    rows = [(1, 1, "b", True, at(2)), (1, 0, "a", False, at(1)), (2, 0, "x", False, at(1)), (2, 2, "z", True, at(3)), (2, 0, "x", False, at(3)), (3, 0, "q", True, at(5)), (4, 0, None, False, at(6)), (None, None, "", False, at(9000)), (5, 0, "new", True, at(9000))]
    out = f"file://{tmp_path}/out"

    def start(s, cp):
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/n={n}")
        with live.state_store(spark):
            return live.stream_text(s, limit_ms=60_000, delay="30 seconds").writeStream.foreachBatch(write).option("checkpointLocation", cp).trigger(availableNow=True).start()

    play(spark, tmp_path, "in", rows, "request_id long, token_no long, token string, done boolean, ts timestamp", 3, start)
    got = sorted((r["request_id"], r["text"], r["complete"]) for r in spark.read.schema("request_id long, text string, complete boolean").parquet(out).collect())
    assert got == [(1, "ab", True), (2, "xz", False), (3, "q", True), (4, "", False), (5, "new", True)]


def test_a_crash_between_write_and_commit_adds_nothing_twice(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/media"
    batch = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "media_id long, v string")
    live.add_new(batch(1, 2, 2, None), 0, path, ["media_id"], buckets=4)
    commit = live.Manifest.commit
    monkeypatch.setattr(live.Manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        live.add_new(batch(2, 3, 4), 1, path, ["media_id"], buckets=4)
    monkeypatch.setattr(live.Manifest, "commit", commit)
    ids = lambda: sorted((r["media_id"] is None, r["media_id"] or 0) for r in live.read_added(spark, path).collect())
    assert ids() == [(False, 1), (False, 2), (True, 0)]
    live.add_new(batch(2, 3, 4), 1, path, ["media_id"], buckets=4)
    live.add_new(batch(2, 3, 4, 9), 1, path, ["media_id"], buckets=4)  # the number is committed: nothing is added
    live.add_new(batch(None, 1, 2, 3, 4), 2, path, ["media_id"], buckets=4)
    assert ids() == [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)]


def test_the_key_index_is_folded_and_reads_only_its_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/media"
    for n in range(7):
        live.add_new(spark.createDataFrame([(k, n) for k in range(n * 2, n * 2 + 4)], "media_id long, n int"), n, path, ["media_id"], buckets=4, fold_after=3)
    got = sorted((r["media_id"], r["n"]) for r in live.read_added(spark, path).collect())
    assert [k for k, _ in got] == list(range(16)) and all(n == max(0, (k - 2) // 2) for k, n in got)
    entries = live.Manifest(spark, path).committed()
    assert sorted(entries) == list(range(7)) and sum(e["base"] for e in entries.values()) >= 2


def test_a_long_answer_takes_linear_time(spark, tmp_path):
    n = 4000
    rows = [(1, k, f"{k} ", k == n - 1) for k in reversed(range(n))]
    began = time.monotonic()
    out = f"file://{tmp_path}/out"

    def start(s, cp):
        with live.state_store(spark):
            return live.stream_text(s).writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/n={k}")).option("checkpointLocation", cp).trigger(availableNow=True).start()

    play(spark, tmp_path, "in", rows, "request_id long, token_no long, token string, done boolean", 2000, start)
    assert [r["text"] for r in spark.read.schema("request_id long, text string").parquet(out).collect()] == ["".join(f"{k} " for k in range(n))]
    assert time.monotonic() - began < 120
