"""Metadata, track lists, documents, images, profiles and recogniser answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

TRACK_MAP = "map<string,array<struct<ext:string,url:string>>>"
METADATA = f"media_id bigint, title string, description string, uploader string, channel string, upload_date string, duration double, categories array<string>, tags array<string>, language string, subtitles {TRACK_MAP}, automatic_captions {TRACK_MAP}"
RECOGNISED = "media_id bigint, language string, transcript string, words array<struct<word:string,punctuated_word:string,start:double,end:double>>, utterances array<struct<start:double,end:double,transcript:string,words:array<struct<word:string,punctuated_word:string,start:double,end:double>>>>"


def read_metadata_json(spark: SparkSession, path: str) -> DataFrame:
    """Media rows with manual and automatic caption codes as lists; one JSON object a file or line."""
    return metadata(spark.read.schema(METADATA).option("multiLine", "true").json(path))


def metadata(raw: DataFrame) -> DataFrame:
    keys = lambda c: F.coalesce(F.sort_array(F.map_keys(c)), F.array().cast("array<string>"))
    return raw.withColumns({"available_subtitles": keys("subtitles"), "available_auto_captions": keys("automatic_captions")}).drop("subtitles", "automatic_captions")


def read_tracks(raw: DataFrame) -> DataFrame:
    """``(media_id, bucket, code, pos, ext, url)``: nested track lists as rows, order kept."""
    buckets = F.array(*[F.struct(F.lit(b).alias("bucket"), F.map_entries(b).alias("codes")) for b in ("subtitles", "automatic_captions")])
    by_code = raw.select("media_id", F.explode(buckets).alias("b")).select("media_id", "b.bucket", F.explode("b.codes").alias("c"))
    return by_code.select("media_id", "bucket", F.col("c.key").alias("code"), F.posexplode("c.value").alias("pos", "t")).select("media_id", "bucket", "code", F.col("pos").cast("bigint").alias("pos"), "t.ext", "t.url")


def read_json_docs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_docs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)``: each image as a data-address content part of low detail."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    address = F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64("content"), "[\r\n]", ""))
    return files.select("path", F.struct(F.lit("image_url").alias("type"), address.alias("url"), F.lit("low").alias("detail")).alias("content"))


# What each stage leaves, and whether it depends on the language.
LAYOUT = (("video", "source/video.mp4", False), ("audio", "source/audio.mp3", False), ("transcript", "transcription/source.raw.srt", False), ("thumbs", "thumbnails/meta.json", False), ("description", "analysis/description.json", False), ("translation", "translation/translated.srt", True), ("speech", "tts/segments", True), ("dub", "output/dubbed.wav", True))


def artifact_layout(media: DataFrame, languages: DataFrame) -> DataFrame:
    """``(media_id, slug, lang, stage, path)``: shared stages once a medium (null lang), the others once a language."""
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(p).alias("file"), F.lit(x).alias("scoped")) for s, p, x in LAYOUT])
    each = media.select("media_id", "slug", F.explode(stages).alias("s")).select("media_id", "slug", "s.*")
    shared = each.where("not scoped").select("media_id", "slug", F.lit(None).cast("string").alias("lang"), "stage", F.concat_ws("/", "slug", "file").alias("path"))
    scoped = each.where("scoped").join(languages.select("media_id", "lang"), "media_id")
    return shared.unionByName(scoped.select("media_id", "slug", "lang", "stage", F.concat_ws("/", "slug", "lang", "file").alias("path")))


# The thirteen artefacts of a project, whether they depend on the language, and where they lie in it.
ARTEFACTS = (
    ("video", False, "source/video.mp4"), ("audio", False, "source/audio.mp3"), ("video_meta", False, "source/video_meta.json"), ("source_srt", False, "transcription/source.srt"), ("source_raw_srt", False, "transcription/source.raw.srt"),
    ("translated_raw_srt", True, "transcription/translated.raw.srt"), ("final_srt", True, "subtitles/translated.srt"), ("thumbs_meta", False, "thumbnails/meta.json"), ("description", False, "analysis/description.json"), ("final_audio", True, "tts/dubbed.wav"),
    ("final_video", True, "tts/dubbed.mp4"), ("profile_voice", True, "voice_profile/voice.wav"), ("profile_script", True, "voice_profile/script.txt"),
)


def project_artefacts(tracks: DataFrame, base: str) -> DataFrame:
    """``(media_id, lang, stage, path)`` of all thirteen artefacts of ``tracks (media_id, slug, lang)``; shared ones have one path in all languages, and a track without a language keeps all in its root."""
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(x).alias("scoped"), F.lit(p).alias("file")) for s, x, p in ARTEFACTS])
    each = tracks.select("media_id", "lang", "slug", F.explode(stages).alias("s")).select("media_id", "lang", "slug", "s.*")
    place = F.when(F.col("scoped") & F.col("lang").isNotNull(), F.concat(F.lit("/lang/"), "lang")).otherwise("")
    return each.select("media_id", "lang", "stage", F.concat(F.lit(f"{base.rstrip('/')}/projects/"), "slug", place, F.lit("/"), "file").alias("path"))


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, bytes, modified)`` of every file below ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def write_language_table(rows: DataFrame, name: str, path: str, order: str = "seq", buckets: int = 64) -> DataFrame:
    """Save rows of ``(media_id, lang, …)`` as table ``name`` at ``path``: a folder a language, bucketed by medium and sorted in it.

    Written again, the table's languages among ``rows`` are replaced and its others stay.  A reader of one language opens only its
    files, and two such tables with as many buckets join, and aggregate, by medium without an exchange.
    """
    spark = rows.sparkSession
    placed = rows.select(*[c for c in rows.columns if c != "lang"], "lang").repartition(buckets, "media_id")
    if not spark.catalog.tableExists(name):
        placed.write.format("parquet").option("path", path).partitionBy("lang").bucketBy(buckets, "media_id").sortBy("media_id", order).saveAsTable(name)
    else:
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")
        try:
            placed.select(*spark.table(name).columns).write.mode("overwrite").insertInto(name)
        finally:
            spark.conf.set(mode, before)
    return spark.table(name)


def voice_profiles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles ``(name, voice, script)`` of listed files ``(path)``, and the names that lack a voice or a script.

    A profile is a folder with a script and a voice file; of several voices wav goes before m4a before mp3.
    """
    name, file = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)$", 1)
    rank = F.array_position(F.array(F.lit("wav"), F.lit("m4a"), F.lit("mp3")), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    rows = files.select("path", name.alias("name"), file.alias("file"), rank.alias("rank")).where("name <> ''")
    found = rows.groupBy("name").agg(F.min_by("path", F.when(F.col("rank") > 0, F.struct("rank", "path"))).alias("voice"), F.max(F.when(F.col("file") == "script.txt", F.col("path"))).alias("script"))
    return found.where("voice is not null and script is not null"), found.where("voice is null or script is null")


def recogniser_segments(raw: DataFrame) -> DataFrame:
    """``(media_id, seq, start, end, text, language, words)``: an answer's utterances, or one segment of its transcript.

    The fallback spans its first to last word (0 without words); blank texts give nothing; the language is ``unknown`` if not told.
    """
    spoken = lambda w: F.transform(w, lambda x: F.struct(F.coalesce(x["punctuated_word"], x["word"]).alias("word"), x["start"].alias("start"), x["end"].alias("end")))
    language = F.coalesce("language", F.lit("unknown")).alias("language")
    many = raw.where("size(utterances) > 0").select("media_id", language, F.posexplode("utterances").alias("seq", "u"))
    given = many.select("media_id", F.col("seq").cast("bigint").alias("seq"), F.col("u.start").alias("start"), F.col("u.end").alias("end"), strip(F.col("u.transcript")).alias("text"), "language", spoken(F.col("u.words")).alias("words"))
    one = raw.where("coalesce(size(utterances), 0) <= 0").select(
        "media_id", F.lit(0).cast("bigint").alias("seq"), F.coalesce(F.get("words", F.lit(0))["start"], F.lit(0.0)).alias("start"), F.coalesce(F.get("words", F.size("words") - 1)["end"], F.lit(0.0)).alias("end"), strip(F.col("transcript")).alias("text"), language, spoken(F.col("words")).alias("words")
    )
    return given.unionByName(one).where("text <> ''")
