import uuid

from pyspark.sql import functions as F
from spark_cues.operators import rollups
from spark_cues.sources import media as sources


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().toString()


def test_tables_by_language_prune_join_without_exchange_and_replace_one_language(spark, tmp_path):
    tag = uuid.uuid4().hex[:10]
    rows = spark.createDataFrame([(m, ("en", "fr", "de")[m % 3], s, f"t{m}-{s}") for m in range(60) for s in range(3)], "media_id long, lang string, seq long, text string")
    one = sources.write_language_table(rows, f"a_{tag}", f"file://{tmp_path}/a", buckets=4)
    two = sources.write_language_table(rows.withColumn("seq", F.col("seq") * 2), f"b_{tag}", f"file://{tmp_path}/b", buckets=4)
    assert all("/lang=fr/" in f for f in one.where("lang = 'fr'").inputFiles()) or "PartitionFilters: [isnotnull(lang" in plan_of(one.where("lang = 'fr'"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right = one.where("lang = 'fr'").groupBy("media_id").agg(F.count("*").alias("n")), two.where("lang = 'fr'")
        both = left.join(right, "media_id")
        assert both.count() == 60 and "Exchange" not in plan_of(both)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    new = rows.where("lang = 'fr' and media_id < 10").withColumn("text", F.lit("new"))
    again = sources.write_language_table(new, f"a_{tag}", f"file://{tmp_path}/a", buckets=4)
    assert again.where("lang = 'fr'").select("text").distinct().collect()[0]["text"] == "new" and again.where("lang = 'fr'").count() == new.count()
    assert again.where("lang <> 'fr'").count() == 120
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_files_are_listed_and_lists_must_name_one(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.jpg").write_bytes(b"x" * 7)
    (tmp_path / "t" / "notes.txt").write_text("no")
    listing = sources.list_files(spark, f"file://{tmp_path}", "*.jpg")
    assert [r["bytes"] for r in listing.collect()] == [7]
    there = listing.select("path").first()["path"]
    rows = [("a/meta.json", "thumbs", f'[{{"path": "gone"}}, {{"path": "{there}"}}]'), ("b/meta.json", "thumbs", '[{"path": "gone"}]'), ("c/meta.json", "thumbs", "[]"), ("d/meta.json", "thumbs", None), ("e.srt", "s", "00:00:01,000 --> 00:00:02,000"), ("f.srt", "s", "00:00:01,000 -->"), ("g.json", "d", "[1]")]
    df = spark.createDataFrame([(p, s, 5, c) for p, s, c in rows], "path string, stage string, bytes long, content string")
    got = {r["path"]: r["valid"] for r in rollups.artifact_validity(df, required={"d": ["k"]}, listing=listing).collect()}
    assert got == {"a/meta.json": True, "b/meta.json": False, "c/meta.json": False, "d/meta.json": False, "e.srt": True, "f.srt": False, "g.json": True}


def test_artefacts_of_tracks(spark):
    got = sources.project_artefacts(spark.createDataFrame([(1, "s", "fr"), (2, "t", None)], "media_id long, slug string, lang string"), "out/").collect()
    paths = {(r["media_id"], r["stage"]): r["path"] for r in got}
    assert len(paths) == 26
    assert paths[1, "final_srt"] == "out/projects/s/lang/fr/subtitles/translated.srt" and paths[1, "video"] == "out/projects/s/source/video.mp4" and paths[2, "final_audio"] == "out/projects/t/tts/dubbed.wav"
