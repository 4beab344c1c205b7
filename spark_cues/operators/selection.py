"""First-best choices of tracks, languages, voices, variants and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: Column, *columns: str) -> DataFrame:
    """The first row of each group in an order; one aggregation, no sort of groups."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("__x")).select(*keys, "__x.*")


def pick_track(tracks: DataFrame) -> DataFrame:
    """For each (media_id, code): the first SRT entry, manual subtitles before automatic ones."""
    rank = F.when(F.col("bucket") == "subtitles", 0).otherwise(1)
    return first_by(tracks.where("ext = 'srt'"), ["media_id", "code"], F.struct(rank, "pos"), "bucket", "url")


def original_codes(tracks: DataFrame) -> DataFrame:
    """``(media_id, orig_code, base)``: the first automatic code that ends in ``-orig``."""
    orig = tracks.where("bucket = 'automatic_captions' and code like '%-orig'")
    return orig.groupBy("media_id").agg(F.min_by("code", "pos").alias("orig_code")).withColumn("base", F.regexp_replace("orig_code", "-orig$", ""))


def original_language(media: DataFrame, tracks: DataFrame, codes: DataFrame) -> DataFrame:
    """``(media_id, original_language)``: by the original caption code, else as declared."""
    known = F.broadcast(codes.select(F.col("code").alias("base"), "name"))
    named = original_codes(tracks).join(known, "base", "left").select("media_id", F.coalesce("name", "base").alias("found"))
    return media.join(named, "media_id", "left").select("media_id", F.coalesce("found", "language").alias("original_language"))


def wanted_tracks(tracks: DataFrame, targets: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """``(media_id, code, file)`` of codes to fetch: the original track, its base, and target languages' preferred codes.

    ``targets (media_id, code)``; media without targets want every code in ``codes``.  Codes that a medium lacks are left out;
    one among its manual tracks is named ``.manual.srt``.
    """
    orig = original_codes(tracks)
    want = orig.select("media_id", F.col("orig_code").alias("code")).unionByName(orig.select("media_id", F.col("base").alias("code"))).unionByName(targets.select("media_id", "code"))
    if codes is not None:
        free = tracks.select("media_id").distinct().join(targets.select("media_id"), "media_id", "left_anti")
        want = want.unionByName(free.join(tracks.select("media_id", "code"), "media_id").join(F.broadcast(codes.select("code")), "code", "left_semi").select("media_id", "code"))
    there = tracks.groupBy("media_id", "code").agg(F.bool_or(F.col("bucket") == "subtitles").alias("manual"))
    return want.distinct().join(there, ["media_id", "code"]).select("media_id", "code", F.concat("code", F.when(F.col("manual"), F.lit(".manual.srt")).otherwise(".srt")).alias("file"))


def resolve_theme(wanted: DataFrame, themes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted ``(media_id, theme, language)`` with voice text and profile key, and those that no theme offers."""
    offered = F.broadcast(themes)
    found = wanted.join(offered, ["theme", "language"]).withColumn("profile", F.lower(F.concat_ws("-", F.lit("general"), "language", "gender", "theme")))
    return found, wanted.join(offered, ["theme", "language"], "left_anti")


def resolve_voice(media: DataFrame, explicit: DataFrame, profiles: DataFrame, themed: DataFrame, cloned: DataFrame) -> DataFrame:
    """``(media_id, voice, provenance)`` by priority: given sample, profile, theme, own clone; each table is ``(media_id, voice)``."""
    out, names = media.select("media_id"), []
    for name, t in (("sample", explicit), ("profile", profiles), ("theme", themed), ("clone", cloned)):
        out = out.join(t.select("media_id", F.col("voice").alias(name)), "media_id", "left")
        names.append(name)
    source = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names])
    return out.select("media_id", F.coalesce(*names).alias("voice"), source.alias("provenance"))


def choose_track(asr: DataFrame, platform: DataFrame, answers: DataFrame) -> DataFrame:
    """Cues of the judged track: B (platform) where the answer says so and there is one, else A (recognised)."""
    said = F.upper(F.trim(F.coalesce(F.get_json_object("raw", "$.choice"), F.lit("A"))))
    verdict = answers.select("media_id", F.when(said == "B", "B").otherwise("A").alias("choice"))
    b = platform.select("media_id").distinct().join(verdict.where("choice = 'B'"), "media_id", "left_semi")
    return asr.join(b, "media_id", "left_anti").withColumn("chosen", F.lit("A")).unionByName(platform.join(b, "media_id", "left_semi").withColumn("chosen", F.lit("B")))


QUALITY = {"low": 360, "medium": 720, "high": None}


def pick_media_variant(formats: DataFrame, quality: str = "medium") -> DataFrame:
    """The highest variant within the preset's height, else the highest of all; ties to the smaller id."""
    cap = QUALITY[quality]
    within = F.lit(0) if cap is None else F.when(F.col("height") <= cap, 0).otherwise(1)
    return first_by(formats, ["media_id"], F.struct(within, -F.col("height"), "format_id"), "format_id", "height")


def pick_display_track(tracks: DataFrame, preference: list[str]) -> DataFrame:
    """Each medium's first track in order of preference."""
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col("track"))
    return first_by(tracks.withColumn("__r", rank).where("`__r` > 0"), ["media_id"], F.col("__r"), "track")


def valid_timestamps(picks: DataFrame, cues: DataFrame) -> DataFrame:
    """Picks whose ``raw_seconds`` is a number within the medium."""
    ends = cues.groupBy("media_id").agg(F.max("end").alias("__end"))
    return picks.withColumn("seconds", F.expr("try_cast(raw_seconds as double)")).join(ends, "media_id").where("seconds between 0 and `__end`").drop("__end")


def uniform_picks(extents: DataFrame, gap: float = 5.0) -> DataFrame:
    """``(media_id, i, seconds)``: 1 to 8 picks spaced evenly over ``last_end``, for media without valid ones."""
    n = F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.col("last_end") / max(gap, 10.0)))).cast("int")
    rows = extents.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    return rows.select("media_id", F.col("i").cast("bigint").alias("i"), (F.floor(F.col("last_end") * F.col("i") / (F.col("n") + 1) * 10 + 0.5) / 10).alias("seconds"))


def classify_source(path: Column) -> Column:
    """url, audio, video or unknown, by scheme and extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(F.regexp_like(path, F.lit("(?i)^https?://")), "url").when(ext.isin("mp3", "wav", "m4a", "flac", "ogg", "aac", "wma", "opus"), "audio").when(ext.isin("mp4", "mkv", "avi", "mov", "webm", "flv", "wmv", "m4v"), "video").otherwise("unknown")
