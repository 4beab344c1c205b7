import json
import math

import pytest
from pyspark.sql import functions as F
from spark_cues.operators import audio, intervals, requests

CUES = "media_id long, seq long, idx string, start double, end double, text string, role string, batch_id int, target_words int"
THUMBS = "media_id long, seconds double, timestamp string, reason string, url string"


def test_translation_requests_hold_their_parts_and_limits(spark):
    cues = spark.createDataFrame([(1, k, str(k + 1), k * 10.0, k * 10.0 + 9, f" line {k} ", "before" if k < 1 else "after" if k > 3 else "main", 0, 5) for k in range(5)] + [(2, 0, "1", 0.0, 1.0, 'say "x"', "main", 0, 4), (3, 0, "1", 0.0, 1.0, "only context", "before", 0, 4)], CUES)
    media = spark.createDataFrame([(1, "T", "d" * 600, "", "up", [f"t{k}" for k in range(30)], ["k1", "k2"], ["p1", "p2"])], "media_id long, title string, description string, channel string, uploader string, tags array<string>, keywords array<string>, keypoints array<string>")
    thumbs = spark.createDataFrame([(1, float(s), f"0:{s}", "slide", f"u{s}") for s in range(0, 50, 4)], THUMBS)
    got = {r["media_id"]: r["messages"] for r in requests.translation_requests(cues, media, thumbs, F.lit("sys"), "French").collect()}
    assert sorted(got) == [1, 2]
    system, user = got[1]
    assert (system["role"], system["content"][0]["text"], user["role"]) == ("system", "sys", "user")
    context, *middle, task = user["content"]
    assert context["text"].split("\n") == ["About this video:", "Keypoints: p1; p2", "Keywords: k1, k2", "Title: T", "Description: " + "d" * 500 + "…", "Channel: up", "Tags: " + ", ".join(f"t{k}" for k in range(15))]
    near = [s for s in range(0, 50, 4) if 10 <= s <= 39]
    kept = [near[int(i * len(near) / 4)] for i in range(4)]
    assert [p["url"] for p in middle if p["type"] == "image_url"] == [f"u{s}" for s in kept] and middle[0]["text"] == "Screenshots:" and middle[1]["text"] == f"[0:{kept[0]}] slide"
    head, before, entries, after = task["text"].split("\n\n")
    assert "French" in head and before.split("\n")[1] == '1: "line 0"' and after.split("\n")[1] == '5: "line 4"'
    assert json.loads(entries.split("\n", 1)[1]) == [{"index": str(k + 1), "text": f" line {k} ", "target_words": 5} for k in (1, 2, 3)]
    assert [p["type"] for p in got[2][1]["content"]] == ["text"] and '\\"x\\"' in got[2][1]["content"][0]["text"]


def test_review_and_description_requests(spark):
    cues = spark.createDataFrame([(1, k, str(k + 1), float(k), k + 1.0, f"l{k}", "main", 0, 1) for k in range(300)], CUES)
    review = requests.review_requests(cues, F.lit("sys")).first()["messages"][1]["content"]
    assert len(review) == 1 and review[0]["text"].startswith("## Entries to correct\n[") and "Before" not in review[0]["text"]
    media = spark.createDataFrame([(1, None, "d" * 1100, "ch", None, ["t"] * 30, ["c1", "c2"])], "media_id long, title string, description string, channel string, uploader string, tags array<string>, categories array<string>")
    thumbs = spark.createDataFrame([(1, float(s), str(s), "r", f"u{s}") for s in range(25)], THUMBS)
    parts = requests.description_requests(cues, media, thumbs, F.lit("sys")).first()["messages"][1]["content"]
    meta = parts[0]["text"].split("\n")
    assert meta == ["Metadata:", "Description: " + "d" * 1000 + "…", "Channel: ch", "Tags: " + ", ".join(["t"] * 20), "Categories: c1, c2"]
    assert [p["url"] for p in parts if p["type"] == "image_url"] == [f"u{int(i * 2.5)}" for i in range(10)]
    assert parts[-2]["text"].split("\n")[1:] == [f"{int(i * 2.5) + 1}. l{int(i * 2.5)}" for i in range(120)]
    bare = requests.description_requests(cues.where("seq < 2"), media.limit(0), thumbs.limit(0), F.lit("sys")).first()["messages"][1]["content"]
    assert [p["text"] for p in bare][0] == "Captions:\n1. l0\n2. l1"


@pytest.mark.parametrize("chunk", [32, 100])
def test_speech_in_gaps_is_recovered(spark, chunk):
    rate = 32
    tone = lambda n, level: [level * math.sin(2 * math.pi * 3 * k / rate) for k in range(n)]
    # Speech, a gap with speech, speech, a silent gap, speech; the second medium has a silent reference, the third no gap.
    signal = {1: tone(20 * rate, 0.5) + [0.0] * (10 * rate) + tone(10 * rate, 0.5), 2: [0.0] * (40 * rate), 3: tone(5 * rate, 0.5)}
    pcm = spark.createDataFrame([(m, k, rate, x[k * chunk : (k + 1) * chunk]) for m, x in signal.items() for k in range(-(-len(x) // chunk))], "media_id long, chunk_no long, sample_rate int, samples array<float>")
    cues = spark.createDataFrame([(m, k, a, b, f"words {k}") for m in (1, 2) for k, (a, b) in enumerate([(0.0, 5.0), (15.0, 20.0), (30.0, 39.0)])] + [(3, 0, 0.0, 5.0, "all of it")], "media_id long, seq long, start double, end double, text string")
    durations = spark.createDataFrame([(1, 40.0), (2, 40.0), (3, 5.0)], "media_id long, duration double")
    assert intervals.find_gaps(cues, durations).count() == 4
    heard = lambda: lambda row: {"segments": [{"start": 0.5, "end": 1.25, "text": f"heard {row['start']:g}-{row['end']:g}"}]}
    got = {}
    for r in audio.validate_transcription(cues, pcm, durations, chunk, heard).orderBy("media_id", "seq").collect():
        got.setdefault((r["media_id"], r["modified"]), []).append((r["seq"], r["start"], r["end"], r["text"]))
    assert got[1, True] == [(0, 0.0, 5.0, "words 0"), (1, 5.5, 6.25, "heard 5-15"), (2, 15.0, 20.0, "words 1"), (3, 30.0, 39.0, "words 2")]
    assert [t for *_, t in got[2, False]] == ["words 0", "words 1", "words 2"] and len(got[3, False]) == 1
    assert audio.validate_transcription(cues, pcm, durations, chunk).where("modified").count() == 0
