import time

from spark_cues.operators import phrases, rollups
from spark_cues.plans import fixtures as fx
from spark_cues.streaming import live
from pyspark.sql import functions as F


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    return df.sparkSession.table(name)


def feed(spark, df, path, parts):
    """A file stream of ``df`` in several files."""
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_usage_windows_equal_the_batch(spark, tiny, tmp_path):
    calls = fx.llm_calls(spark, tiny).withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain(live.stream_usage(feed(spark, calls, f"file://{tmp_path}/in", 1)), "usage")
    want = live.stream_usage(calls)
    last = calls.agg(F.max("ts")).first()[0]
    closed = want.where(F.col("window_start") < F.lit(last) - F.expr("interval 15 minutes"))
    rows = set(map(tuple, got.collect()))
    assert set(map(tuple, closed.collect())) <= rows <= set(map(tuple, want.collect()))


def test_latest_phases_equal_the_batch(spark, tiny, tmp_path):
    from spark_cues.functions.dimensions import phases

    lines = fx.log_lines(spark, tiny).select("run_id", "line_no", "line")
    stream = feed(spark, lines, f"file://{tmp_path}/in", 3)
    assert live.stream_phase(stream, phases(spark), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out/status/v2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rollups.latest_phase(lines, phases(spark)).collect()))


def test_live_phrases_equal_the_batch_but_for_the_open_one(spark, tmp_path):
    rows = [(m, k, k * 2.0 + (3 if k % 7 == 6 else 0), k * 2.0 + 1.5 + (3 if k % 7 == 6 else 0), "done." if k % 4 == 3 else f"word{k}") for m in range(3) for k in range(12)]
    cues = spark.createDataFrame(rows, "media_id long, seq long, start double, end double, text string")
    source = f"file://{tmp_path}/in"
    for low in (0, 4, 8):
        cues.where(f"seq >= {low} and seq < {low + 4}").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken by time
    stream = spark.readStream.schema(cues.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = drain(live.stream_merge_phrases(stream, idle_ms=None), "phrases").where("not late")
    late = spark.table("phrases").where("late")
    kept = cues.join(late.select("media_id", F.col("first_seq").alias("seq")), ["media_id", "seq"], "left_anti")
    want = phrases.merge_phrases(kept.withColumn("track", F.lit("t"))).select("media_id", "first_seq", "start", "end", "text")
    rows_of = lambda df: sorted(map(tuple, df.select("media_id", "first_seq", "start", "end", "text").collect()))
    assert rows_of(got) == rows_of(want)


def test_texts_come_out_complete_and_in_order(spark, tmp_path):
    rows = [(r, k, f"t{k} ", k == 5) for r in range(4) for k in range(6) if (r, k) != (3, 2)]
    tokens = spark.createDataFrame(rows, "request_id long, token_no long, token string, done boolean")
    got = drain(live.stream_text(feed(spark, tokens, f"file://{tmp_path}/in", 3)), "texts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.text_concat(tokens.where("request_id < 3")).collect()))


def test_new_media_are_added_once(spark, tmp_path):
    rows = spark.createDataFrame([(k % 5, f"v{k % 5}") for k in range(20)], "media_id long, v string")
    stream = feed(spark, rows, f"file://{tmp_path}/in", 4)
    assert live.stream_new_media(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", ["media_id"]).awaitTermination(120)
    assert sorted(r["media_id"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == list(range(5))
