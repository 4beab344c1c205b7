import base64

import pytest
from pyspark.sql import functions as F
from spark_cues.sources import media, srt

CUES = "media_id long, seq long, idx string, start double, end double, text string"
DIRTY = """```srt
5
00:00:01,000 --> 00:00:02,000
<text>Hello</text>
there

00:00:03,000 --> 00:00:04,000
no number

00:00:05,000 --> 00:00:06,000
1999
9
00:00:07,000 --> 00:00:08,000
last
```"""


def test_documents_are_parsed(spark):
    text = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\n\r\nx\r\nnot a time\r\ny\r\n\r\n2\n00:00:03,000 --> 00:00:04,000\n\n7\n00:00:05,000 --> 00:00:06,000\nend"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "media_id long, text string")
    got = [tuple(r) for r in srt.parse_srt(docs).orderBy("seq").collect()]
    assert got == [(1, 0, "1", 1.0, 2.5, "Hello\nthere"), (1, 1, "7", 5.0, 6.0, "end")]
    assert srt.parse_srt(docs, flat=True).orderBy("seq").first()["text"] == "Hello there"


def test_documents_with_equal_columns_keep_their_own_numbers(spark):
    block = "{0}\n00:00:0{0},000 --> 00:00:0{0},500\nline {0}"
    docs = spark.createDataFrame([(1, "\n\n".join(block.format(k) for k in ks)) for ks in ((1, 2), (3, 4), (5,))], "media_id long, text string")
    want = [(0, "1"), (0, "3"), (0, "5"), (1, "2"), (1, "4")]
    assert sorted((r["seq"], r["idx"]) for r in srt.parse_srt(docs).collect()) == want
    assert sorted((r["seq"], r["idx"]) for r in srt.parse_srt(docs.select("text")).collect()) == want


def test_model_output_is_rebuilt(spark):
    docs = spark.createDataFrame([(1, DIRTY)], "media_id long, text string")
    text = srt.sanitize_srt(docs, ["media_id"]).first()["text"]
    rows = [(r["idx"], r["start"], r["text"]) for r in srt.parse_srt(spark.createDataFrame([(1, text)], "media_id long, text string")).orderBy("seq").collect()]
    # The line of digits after the third time is an index, so that entry has no text and goes.
    assert rows == [("5", 1.0, "Hello there"), ("7", 3.0, "no number"), ("9", 7.0, "last")]


def test_files_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([(m, k, str(k + 1), k * 2.0, k * 2 + 1.5, f"text {m} {k}") for m in range(3) for k in range(4)], CUES)
    path = f"file://{tmp_path}/srt"
    srt.write_srt(cues, path)
    back = srt.read_srt(spark, path).withColumn("media_id", F.regexp_extract("path", r"media_id=(\d+)", 1).cast("long")).select(*cues.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cues.collect()))


def test_built_documents_are_numbered_and_wrapped(spark):
    cues = spark.createDataFrame([(1, 4, "9", 0.0, 1.0, "a"), (1, 7, "x", 1.0, 2.0, "word " * 12)], CUES)
    text = srt.build_srt(cues, ["media_id"]).first()["srt"]
    assert text.startswith("1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n") and text.split("\n\n")[1].count("\n") == 4


def test_json_metadata_tracks_and_images(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"media_id": 1, "title": "T", "subtitles": {"en": [{"ext": "srt", "url": "u"}]},\n "automatic_captions": {"en-orig": [{"ext": "vtt", "url": "v"}]}}')
    (tmp_path / "bad.json").write_text('{"media_id": 2}')
    got = {r["media_id"]: r for r in media.read_metadata_json(spark, f"file://{tmp_path}/*.json").collect()}
    assert got[1]["available_subtitles"] == ["en"] and got[2]["available_auto_captions"] == []
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.jpg").write_bytes(bytes(range(200)))
    part = media.read_images(spark, f"file://{tmp_path}/i").first()["content"]
    assert base64.b64decode(part["url"].split(",")[1]) == bytes(range(200)) and part["detail"] == "low"
    media.write_json_docs(spark.range(2), f"file://{tmp_path}/out")
    assert media.read_json_docs(spark, f"file://{tmp_path}/out", "id long").count() == 2


def test_recogniser_answers(spark, tmp_path):
    lines = ['{"media_id":1,"language":"en","utterances":[{"start":1.0,"end":2.0,"transcript":" hi ","words":[{"word":"hi","punctuated_word":"Hi.","start":1.0,"end":2.0}]}]}', '{"media_id":2,"transcript":"alone","words":[{"word":"alone","start":0.5,"end":0.9}]}', '{"media_id":3,"transcript":"no words"}', '{"media_id":4,"transcript":"  "}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    got = {r["media_id"]: r for r in media.recogniser_segments(spark.read.schema(media.RECOGNISED).json(f"file://{tmp_path}/r.json")).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["text"] == "hi" and got[1]["words"][0]["word"] == "Hi." and got[2]["language"] == "unknown"
    assert (got[2]["start"], got[2]["end"], got[3]["start"], got[3]["end"]) == (0.5, 0.9, 0.0, 0.0)


def test_profiles_without_voice_or_script_are_rejected(spark):
    files = spark.createDataFrame([("/p/a/script.txt",), ("/p/a/v.mp3",), ("/p/a/v.wav",), ("/p/b/script.txt",), ("/p/c/v.m4a",)], "path string")
    good, bad = media.voice_profiles(files)
    assert [tuple(r) for r in good.collect()] == [("a", "/p/a/v.wav", "/p/a/script.txt")]
    assert sorted(r["name"] for r in bad.collect()) == ["b", "c"]


@pytest.mark.parametrize("flat", [False, True])
def test_empty_tables(spark, flat):
    assert srt.parse_srt(spark.createDataFrame([], "media_id long, text string"), flat=flat).count() == 0
    assert srt.srt_documents(spark.createDataFrame([], CUES), ["media_id"]).count() == 0
