import pytest
from pyspark.sql import functions as F
from spark_cues.functions import text as X


def values(spark, f, *rows):
    df = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r, None))) for k, r in enumerate(rows)], "k int, a string, b string")
    return [r["v"] for r in df.orderBy("k").select(f(F.col("a"), F.col("b")).alias("v")).collect()]


def test_times(spark):
    assert values(spark, lambda a, b: X.srt_to_seconds(a), "01:02:03,004", "00:00:01.5", "x", None) == [3723.004, 1.5, None, None]
    times = spark.createDataFrame([(0.9996,), (3723.0045,), (59.9999,), (-1.0,), (360000.0,)], "t double").select(X.seconds_to_srt(F.col("t")).alias("s"), X.short_timestamp(F.col("t")).alias("m")).collect()
    assert [r["s"] for r in times] == ["00:00:01,000", "01:02:03,004", "00:01:00,000", "00:00:00,000", "100:00:00,000"]
    assert [r["m"] for r in times[:3]] == ["0:00", "1:02:03", "0:59"]
    assert values(spark, lambda a, b: X.parse_timestamp(a), "1:02:03.5", "2:03", "7.25", "a:b", "", "1:2:3:4") == [3723.5, 123.0, 7.25, None, None, None]


def test_cleaning(spark):
    assert values(spark, lambda a, b: X.clean_asr_text(a), "هنااااااك", "so so so so it is", "1000 ...", "  a \t b ", "x ترجمة نانسي قنقر") == ["هناك", "so it is", "10 .", "a b", "x"]
    dirty = ("[00:12] <text>Hi</text>", "[duration: 4.0s | target: ~6 words] 12. Hello", "00:00:01,000 --> 00:00:05,000 ok", "```json\nx```", "3: three")
    assert values(spark, lambda a, b: X.clean_llm_text(a), *dirty) == ["Hi", "Hello", "ok", "x", "three"]
    assert values(spark, lambda a, b: X.safe_edit(a, b), ("abcde", "x" * 30), ("abcde", "x" * 31), ("abcdef", "ab"), ("abcdef", "a"), ("abcdef", " "), ("abcdef", None)) == [True, False, True, False, False, False]


def test_wrapping(spark):
    long = "the quick brown fox jumps over the lazy dog again and again"
    got = values(spark, lambda a, b: X.wrap_mid(a), "short", long, "x" * 50)
    assert got[0] == "short" and got[1].replace("\n", " ") == long and abs(got[1].index("\n") - len(long) // 2) <= 10
    assert got[2] == "x" * 25 + "\n" + "x" * 25


def test_right_to_left(spark):
    assert values(spark, lambda a, b: X.mark_rtl(a), "سلام", "12 سلام", "hi سلام") == ["‫سلام‬", "‫12 سلام‬", "hi سلام"]
    assert values(spark, lambda a, b: X.space_lines(a, 1), "a\nb") == ["a\n \nb"] and values(spark, lambda a, b: X.space_lines(a, 0), "a\nb") == ["a\nb"]


def test_names_and_addresses(spark):
    assert values(spark, lambda a, b: X.slugify(a), " Été à Paris! ", "a--b", "!!") == ["été-à-paris", "a-b", ""]
    assert values(spark, lambda a, b: X.strip_playlist_params(a), "https://www.youtube.com/watch?v=1&list=2&index=3", "https://youtu.be/x?list=1", "https://example.org/?list=1") == ["https://www.youtube.com/watch?v=1", "https://youtu.be/x", "https://example.org/?list=1"]
    assert values(spark, lambda a, b: X.artifact_name(a), "7", "12345") == ["seg_0007.wav", "seg_12345.wav"]


def test_indexes_and_json(spark):
    got = values(spark, lambda a, b: X.range_index(a), "3-5", "3 – 5", "3", "a-b")
    assert [tuple(x) if x else None for x in got] == [(3, 5), (3, 5), None, None]
    assert values(spark, lambda a, b: X.loose_json(a), 'say ```json\n[{"a": 1}]\n``` end', "none") == ['[{"a": 1}]', None]


@pytest.mark.parametrize(("seconds", "want"), [(0.5, 4), (2.5 / 0.85, 8), (10.0, 26)])
def test_word_budget_rounds_half_even(spark, seconds, want):
    assert spark.range(1).select(X.word_budget(F.lit(seconds), F.lit(3.0)).alias("v")).first()["v"] == want


def test_initial_prompt(spark):
    df = spark.createDataFrame([("T", "first\n\nsecond", ["a", "b"]), (None, " ", []), ("T" * 900, None, None)], "t string, d string, g array<string>")
    assert [r["v"] for r in df.select(X.initial_prompt(F.col("t"), F.col("d"), F.col("g")).alias("v")).collect()] == ["T. first. a, b", None, "T" * 800]
