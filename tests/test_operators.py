import math
import random

import pytest
from pyspark.sql import functions as F

from spark_cues.operators import audio, intervals, models, phrases, reconcile, rollups, selection

CUES = "media_id long, track string, seq long, idx string, start double, end double, text string"


def cues(spark, rows, m=1):
    return spark.createDataFrame([(m, "t", k, str(k + 1), float(a), float(b), t) for k, (a, b, t) in enumerate(rows)], CUES)


def test_phrases_end_at_sentences_and_pauses(spark):
    got = phrases.merge_phrases(cues(spark, [(0, 1, "one"), (1, 2, "two. "), (2, 3, " "), (3, 4, "three"), (6.5, 7, "four"), (7, 6, "end")])).orderBy("phrase_no").collect()
    assert [(r["text"], r["start"], r["end"]) for r in got] == [("one two.", 0.0, 2.0), ("three", 2.0, 4.0), ("four end", 6.5, 6.0)]


def test_gaps_at_the_head_between_and_at_the_tail(spark):
    durations = spark.createDataFrame([(1, 30.0), (2, 9.0), (3, 4.0)], "media_id long, duration double")
    got = intervals.find_gaps(cues(spark, [(6, 7, "a"), (12, 13, "b"), (18.5, 19, "c")]), durations).collect()
    assert sorted(map(tuple, got)) == [(1, 0.0, 6.0), (1, 13.0, 18.5), (1, 19.0, 30.0), (2, 0.0, 9.0)]


def test_order_of_rows_does_not_matter(spark):
    rng = random.Random(2)
    rows = [(k * 2.0, k * 2 + rng.uniform(0.5, 3.0), rng.choice(["a", "b.", "c"])) for k in range(60)]
    df = cues(spark, rows)
    mixed = spark.createDataFrame(rng.sample(df.collect(), 60), CUES).repartition(7)
    for f in (phrases.merge_phrases, phrases.media_report, lambda d: intervals.batch_with_context(d, 10, 4), intervals.best_clone_window):
        assert sorted(map(tuple, f(df).collect())) == sorted(map(tuple, f(mixed).collect()))


def test_clone_window_matches_a_plain_double_loop(spark):
    rng = random.Random(8)
    for m in range(25):
        at, rows = 0.0, []
        for _ in range(rng.randrange(1, 30)):
            end = at + rng.uniform(0.5, 9)
            rows.append((round(at, 2), round(end, 2), "w " * rng.randrange(1, 9)))
            at = max(0.0, end + rng.choice([0, 0.5, 3, -4]))
        best = None
        for i in range(len(rows)):
            n = 0
            for j in range(i, len(rows)):
                n += len(rows[j][2].split())
                span = round(rows[j][1] - rows[i][0], 6)
                if span > 60:
                    break
                if span >= 20 and (best is None or n > best[2]):
                    best = (i, j, n)
        want = [(m, *best)] if best and best[2] >= 20 and rows[-1][1] - rows[0][0] >= 20 else []
        assert [tuple(r) for r in intervals.best_clone_window(cues(spark, rows, m)).collect()] == want


def test_batches_cover_every_cue_once(spark):
    got = intervals.batch_with_context(cues(spark, [(k, k + 1, "x") for k in range(50)])).collect()
    main = [r["seq"] for r in got if r["role"] == "main"]
    assert sorted(main) == list(range(50))
    assert sorted(r["seq"] for r in got if r["batch_id"] == 1 and r["role"] == "before") == [20, 21, 22, 23]
    assert sorted(r["seq"] for r in got if r["batch_id"] == 1 and r["role"] == "after") == [48, 49]


def test_repaired_groups(spark):
    groups = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [4, 5]), (2, 0, [2, 1]), (2, 1, [1]), (3, 0, [1, 3])], "b long, group_no long, members array<int>")
    sizes = spark.createDataFrame([(1, 6), (2, 2), (3, 3)], "b long, total long")
    faults = {r["b"]: (r["valid"], r["repairable"]) for r in phrases.group_faults(groups, sizes, ["b"]).collect()}
    assert faults == {1: (False, True), 2: (False, False), 3: (False, False)}
    fixed = sorted((r["number"], r["group_key"]) for r in phrases.fix_groups(groups, sizes, ["b"]).collect())
    assert fixed == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)]


def test_even_samples(spark):
    rows = spark.createDataFrame([(m, k) for m, n in ((1, 100), (2, 5), (3, 9)) for k in range(n)], "m long, k long")
    got = {}
    for r in reconcile.even_sample(rows, 8, ["m"], ["k"]).collect():
        got.setdefault(r["m"], []).append(r["k"])
    assert sorted(got[1]) == [int(i * (100 / 8)) for i in range(8)] and sorted(got[2]) == list(range(5)) and sorted(got[3]) == [int(i * (9 / 8)) for i in range(8)]


def test_upper_median_of_an_even_count(spark):
    got = rollups.segment_mode(spark.createDataFrame([(1,), (2,)], "media_id long"), cues(spark, [(0, 1, "a"), (0, 4, "b")])).orderBy("media_id").collect()
    assert [(r["median_dur"], r["mode"]) for r in got] == [(4.0, "short"), (5.0, "short")]


def test_validity_by_kind(spark):
    rows = spark.createDataFrame([("a.mp3", 1024, ""), ("a.mp3", 1023, ""), ("a.srt", 1, "1\n00:00:01,000 --> 00:00:02,000\nx"), ("a.srt", 9999, "no"), ("a.json", 1, '{"a": 1}'), ("a.json", 1, "{"), ("a.json", 1, None)], "path string, bytes long, head string")
    assert [r["valid"] for r in rollups.artifact_validity(rows).collect()] == [True, False, True, False, True, False, False]


def test_unknown_languages_are_kept_apart(spark):
    names = spark.createDataFrame([("English", True)], "name string, speakable boolean")
    good, bad = rollups.validate_language(spark.createDataFrame([("english",), ("Auto",), ("xx",), (None,)], "wanted string"), names)
    assert sorted(r["name"] for r in good.collect()) == ["English", "auto"] and sorted(r["wanted"] or "" for r in bad.collect()) == ["", "xx"]


def test_mixing_adds_fades_and_limits_the_peak(spark):
    clips = spark.createDataFrame([(1, 0.0, [1.0] * 8), (1, 0.5, [1.0] * 8)], "media_id long, start double, samples array<float>")
    durations = spark.createDataFrame([(1, 2.0)], "media_id long, duration double")
    got = [x for r in audio.mix_timeline(clips, durations, 8, 4, tail_ms=0).orderBy("chunk_no").collect() for x in r["samples"]]
    assert got == [0.5] * 4 + [1.0] * 4 + [0.5] * 4 + [0.0] * 4


def test_mix_with_gaps_and_overlaps_matches_a_loop(spark):
    clips = [(1, 0.25, [0.5, -0.5, 0.75]), (1, 0.5, [0.9, 0.4]), (1, 4.0, [0.0, 0.25, 0.0]), (1, -0.25, [0.3] * 3), (2, 9.0, [1.0]), (3, 0.0, [])]
    durations = {1: 3.0, 2: 1.0, 3: 0.5}
    rate, chunk, want = 8, 4, {}
    for m, duration in durations.items():
        total, mix = math.floor((duration + 2) * rate), {}
        for c, start, xs in clips:
            for k, x in enumerate(xs):
                pos = math.floor(start * rate) + k
                if c == m and 0 <= pos < total:
                    mix[pos] = round(mix.get(pos, 0.0) + x, 6)
        stop = max((p + 1 for p, x in mix.items() if x), default=math.floor(duration * rate))
        length, tail = min(max(stop, math.floor(duration * rate)), total), min(int(500 * rate / 1000), stop // 2)
        out = [mix.get(p, 0.0) for p in range(length)]
        if tail >= 2:
            for p in range(stop - tail, min(stop, length)):
                out[p] *= 0.5 * (1 - math.cos(math.pi * (stop - 1 - p) / (tail - 1)))
        peak = max([1.0, *map(abs, out)])
        want[m] = [round(x / peak, 6) for x in out]
    frame = spark.createDataFrame(clips, "media_id long, start double, samples array<float>")
    got = audio.mix_timeline(frame, spark.createDataFrame(list(durations.items()), "media_id long, duration double"), rate, chunk, tail_ms=500)
    found = {}
    for r in got.orderBy("media_id", "chunk_no").collect():
        found.setdefault(r["media_id"], []).extend(r["samples"])
    assert {m: [round(x, 4) for x in xs] for m, xs in found.items()} == {m: [round(x, 4) for x in xs] for m, xs in want.items()}


def test_translations_match_a_loop(spark):
    rng, cues, answers, want = random.Random(5), [], [], []
    for m in range(40):
        own = [(m, "source", k, rng.choice([str(k + 1)] * 9 + [f"x{k}"]), float(k), k + 0.5 if rng.random() < 0.95 else None, f"t{k}") for k in range(rng.randint(1, 12))]
        said = []
        for p in range(rng.randint(0, 10)):
            a = rng.randint(1, 14)
            said.append((m, "source", p, rng.choice([str(a), f"{a}-{a + rng.randint(-1, 4)}", f" {a} ", "x3"]), rng.choice([f"new{p}", "", " ", "two  words"])))
        cues, answers = cues + own, answers + said
        by_label, gone, given = {c[3]: c for c in own}, {}, []
        ranges = [(p, i.strip(), *map(int, i.split("-")), " ".join(t.split())) for _, _, p, i, t in said if "-" in i]
        ranges = [r for r in ranges if r[3] > r[2] and r[4] and str(r[2]) in by_label]
        for p, label, a, b, text in ranges:
            first, last = by_label[str(a)], by_label.get(str(b))
            if last and last[5] is not None:
                given.append((m, p, first[2], label, first[4], last[5], text))
                for n in range(a + 1, b + 1):
                    gone[str(n)] = min(p, gone.get(str(n), p))
            else:
                given.append((m, p, first[2], first[3], first[4], first[5], text))
        for _, _, p, i, t in said:
            c = by_label.get(i.strip())
            if "-" not in i and c and gone.get(c[3], p + 1) > p:
                given.append((m, p, c[2], c[3], c[4], c[5], " ".join(t.split()) or c[6]))
        taken = {g[2] for g in given}
        given += [(m, None, c[2], c[3], c[4], c[5], c[6]) for c in own if c[2] not in taken and c[3] not in gone]
        want += given
    got = reconcile.apply_translations(
        spark.createDataFrame(cues, "media_id long, track string, seq long, idx string, start double, end double, text string"),
        spark.createDataFrame(answers, "media_id long, track string, pos long, idx string, text string"),
    )
    found = got.select("media_id", "pos", "from_seq", "idx", "start", "end", "text").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_tempo_modes(spark):
    rows = spark.createDataFrame([(2.0, 1.0), (1.02, 1.0), (0.5, 1.0), (0.9, 1.0), (0.0, 1.0)], "actual_dur double, budget double")
    plan = lambda **k: [(round(r["tempo"], 4), r["outcome"]) for r in audio.tempo_plan(rows, **k).collect()]
    assert plan() == [(1.5, "sped_up"), (1.0, "ok"), (0.82, "slowed_down"), (1.0, "ok"), (1.0, "skipped")]
    assert plan(mode="fixed", fixed=1.2)[0] == (1.2, "sped_up") and plan(mode="off")[0] == (1.0, "ok")


def test_choices(spark):
    formats = spark.createDataFrame([(1, "a", 1080), (1, "b", 480), (2, "c", 1440), (2, "d", 1080)], "media_id long, format_id string, height int")
    pick = lambda q: {r["media_id"]: r["format_id"] for r in selection.pick_media_variant(formats, q).collect()}
    assert pick("medium") == {1: "b", 2: "c"} and pick("high") == {1: "a", 2: "c"}
    want, rejects = selection.resolve_theme(spark.createDataFrame([(1, "x", "English"), (2, "y", "English")], "media_id long, theme string, language string"), spark.createDataFrame([("x", "F", "English", "i", "r")], "theme string, gender string, language string, instruct string, ref_text string"))
    assert want.first()["profile"] == "general-english-f-x" and rejects.first()["media_id"] == 2


def test_model_hooks_make_one_client_a_partition(spark):
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(6)], "k long, prompt string").repartition(2)

    def make():
        calls = []

        def call(row):
            calls.append(row)
            return {"raw": row["prompt"] + str(row["temperature"]), "input_tokens": len(calls), "output_tokens": 1}

        return call

    got = models.map_model(rows, make, "translate").collect()
    assert {r["raw"] for r in got} == {f"p{k}0.3" for k in range(6)} and max(r["input_tokens"] for r in got) > 1
    heard = models.map_recognise(rows, lambda: lambda row: {"segments": [{"start": 0.0, "end": 1.0, "text": row["prompt"]}]}).collect()
    assert {r["segments"][0]["text"] for r in heard} == {f"p{k}" for k in range(6)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], CUES)
    durations = spark.createDataFrame([], "media_id long, duration double")
    assert phrases.media_report(none).count() == 0 and intervals.find_gaps(none, durations).count() == 0
    assert intervals.best_clone_window(none).count() == 0 and intervals.cues_in_windows(none).count() == 0


def test_v01_hands_whole_texts_to_the_model(spark, tiny, monkeypatch):
    from spark_cues.operators import models
    from spark_cues.plans import registry

    seen, mapped = [], models.map_model
    monkeypatch.setattr(models, "map_model", lambda requests, *rest: seen.append(requests) or mapped(requests, *rest))
    registry.queries()["v01_map_model"](spark, tiny)
    want = spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id as media_id", "text as prompt")
    assert seen[0].select("media_id", "prompt").exceptAll(want).count() == 0


def test_artifacts_are_judged_by_their_whole_content(spark):
    rows = spark.createDataFrame(
        [
            ("a.srt", "srt", "x" * 90 + "\n00:00:01,000-->00:00:02,000\nhi", 10),
            ("b.srt", "srt", "no arrow --> here", 10),
            ("c.json", "meta", '{"title": "' + "t" * 90 + '", "id": null}', 10),
            ("d.json", "meta", '{"title": 1}', 10),
            ("e.json", "thumbs", "[]", 10),
            ("f.json", "thumbs", '[{"path": "x"}]', 10),
            ("g.json", "meta", "{broken", 10),
            ("h.mp4", "media", None, 2000),
        ],
        "path string, stage string, content string, bytes long",
    )
    got = rollups.artifact_validity(rows, required={"meta": ["title", "id"]}).orderBy("path").collect()
    assert [r["valid"] for r in got] == [True, False, True, False, False, True, False, True]


def test_terms_keep_their_first_spelling_and_order(spark):
    rows = spark.createDataFrame([(1, ["b", " A", "a", None, "", "B ", "c", "d"]), (2, []), (3, None), (4, [" "])], "k long, terms array<string>")
    got = {r["k"]: r["terms"] for r in rollups.dedup_terms(rows, ["k"], "terms", 3).collect()}
    assert got == {1: ["b", "A", "c"]}


@pytest.mark.parametrize(("frame", "chunk"), [(5, 16), (7, 4), (16, 16), (40, 16), (3, 1)])
def test_frames_over_chunk_edges_equal_plain_ones(spark, frame, chunk):
    rng = random.Random(frame)
    media = {m: [rng.uniform(-1, 1) for _ in range(n)] for m, n in ((0, 61), (1, 3), (2, 80), (3, 0))}
    rows = [(m, k, 8, x[k * chunk : (k + 1) * chunk]) for m, x in media.items() for k in range(max(1, -(-len(x) // chunk)))]
    got = {(r["media_id"], r["frame_no"]): r["rms"] for r in audio.frame_rms(spark.createDataFrame(rows, "media_id long, chunk_no long, sample_rate int, samples array<double>"), frame, chunk).collect()}
    want = {(m, f): math.sqrt(sum(v * v for v in x[f * frame : (f + 1) * frame]) / frame) for m, x in media.items() for f in range(len(x) // frame)} | {(m, 0): 0.0 for m, x in media.items() if len(x) < frame}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_many_clips_on_one_place_are_added_as_blocks(spark):
    clips = spark.range(3000).select(F.lit(1).cast("long").alias("media_id"), F.lit(0.5).alias("start"), F.array_repeat(F.lit(0.0001), 10).alias("samples")).repartition(6)
    got = audio.mix_timeline(clips, spark.createDataFrame([(1, 2.0)], "media_id long, duration double"), 10, 8, tail_ms=0).orderBy("chunk_no").collect()
    assert [round(x, 4) for r in got for x in r["samples"]] == [0.0] * 5 + [0.3] * 10 + [0.0] * 5
    assert [r["n_sounding"] for r in got] == [3, 7, 0]
