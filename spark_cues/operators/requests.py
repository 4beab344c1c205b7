"""What models are asked: messages built from batches, context, metadata and images, each part within its limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_text, strip
from .intervals import thumbs_for_range
from .reconcile import even_sample

# How much of a medium's texts and lists a request holds.
BRIEF_DESCRIPTION, FULL_DESCRIPTION = 500, 1000
BRIEF_TAGS, FULL_TAGS = 15, 20
IMAGES, LINES = 4, 120
PART = "struct<type:string,text:string,url:string>"
MESSAGES = f"array<struct<role:string,content:array<{PART}>>>"


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("url"))


def image_part(url: Column) -> Column:
    return F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), url.alias("url"))


def _line(label: str, value: Column) -> Column:
    """``label: value``, null where there is no value."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def _listed(values: Column, most: int | None = None, sep: str = ", ") -> Column:
    return F.array_join(F.slice(values, 1, most) if most else values, sep)


def metadata_lines(full: bool = False) -> Column:
    """Title, description, channel, tags and, in ``full``, categories of a media row, a line each, those that are empty left out."""
    description = cut_text(F.col("description"), FULL_DESCRIPTION if full else BRIEF_DESCRIPTION, "…")
    channel = F.when(F.coalesce("channel", F.lit("")) != "", F.col("channel")).otherwise(F.col("uploader"))
    lines = [_line("Title", F.col("title")), _line("Description", description), _line("Channel", channel), _line("Tags", _listed(F.col("tags"), FULL_TAGS if full else BRIEF_TAGS))]
    return F.array_join(F.array_compact(F.array(*lines, *([_line("Categories", _listed(F.col("categories")))] if full else []))), "\n")


def _ordered(value: Column, when: Column, order: str = "seq") -> Column:
    """The values of a group's rows for which ``when`` holds, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(F.col(order).alias("o"), value.alias("x"))))), lambda p: p["x"])


def _sections(before: Column, main: Column, after: Column, task: str) -> Column:
    """Context before, entries and context after under their headings; empty context has none."""
    around = lambda title, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"## {title} (context only, not to be returned)\n"), x))
    return F.array_join(F.array_compact(F.array(around("Before", before), F.concat(F.lit(f"## {task}\n"), main), around("After", after))), "\n\n")


def _batches(cues: DataFrame, keys: list[str], entry: list[Column]) -> DataFrame:
    """``(*keys, before, main, after, range_start, range_end)`` of cues with roles: entries as JSON, context as quoted lines."""
    is_ = lambda role: F.col("role") == role
    quoted = F.concat(F.col("idx"), F.lit(': "'), strip(F.col("text")), F.lit('"'))
    parts = cues.groupBy(*keys).agg(_ordered(quoted, is_("before")).alias("b"), _ordered(F.struct(*entry), is_("main")).alias("m"), _ordered(quoted, is_("after")).alias("a"), F.min(F.when(is_("main"), F.col("start"))).alias("range_start"), F.max(F.when(is_("main"), F.col("end"))).alias("range_end"))
    return parts.where(F.size("m") > 0).select(*keys, F.array_join("b", "\n").alias("before"), F.to_json("m").alias("main"), F.array_join("a", "\n").alias("after"), "range_start", "range_end")


def _images(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``(*keys, pictures)``: a caption and an image for each of at most ``most`` evenly spaced thumbnails ``(seconds, timestamp, reason, url)``."""
    kept = even_sample(rows, most, keys, ["seconds"])
    pair = F.array(text_part(F.concat(F.lit("["), "timestamp", F.lit("] "), "reason")), image_part(F.col("url")))
    return kept.groupBy(*keys).agg(F.flatten(_ordered(pair, F.lit(True), "seconds")).alias("pictures"))


def _messages(system: Column, parts: Column) -> Column:
    said = F.filter(parts, lambda p: (p["type"] != "text") | (F.coalesce(p["text"], F.lit("")) != ""))
    return F.array(F.struct(F.lit("system").alias("role"), F.array(text_part(system)).alias("content")), F.struct(F.lit("user").alias("role"), said.alias("content"))).cast(MESSAGES)


def translation_requests(cues: DataFrame, media: DataFrame, thumbs: DataFrame, system: Column, language: str, keys: tuple[str, ...] = ("media_id", "batch_id")) -> DataFrame:
    """``(*keys, messages)``, one a batch of ``cues`` with ``role`` (before, main, after) and ``target_words``.

    The user's parts are the medium's context (``keypoints``, ``keywords`` and metadata of ``media``), up to four images from within the batch, and the
    entries between their neighbours.  Batches without main entries ask nothing; media without metadata or images do without.
    """
    keys = list(keys)
    batches = _batches(cues, keys, [F.col("idx").alias("index"), F.col("text"), F.col("target_words")])
    near = thumbs_for_range(batches.select(*keys, "range_start", "range_end"), thumbs)
    context = F.array_join(F.array_compact(F.array(F.lit("About this video:"), _line("Keypoints", _listed(F.col("keypoints"), sep="; ")), _line("Keywords", _listed(F.col("keywords"))), F.when(metadata_lines() != "", metadata_lines()))), "\n")
    known = media.select("media_id", context.alias("context"))
    both = batches.join(known, "media_id", "left").join(_images(near, keys, IMAGES), keys, "left")
    task = F.concat(F.lit(f"Translate the entries into {language} for dubbing, close to their target_words. Return a JSON array of index and text, in order.\n\n"), _sections(F.col("before"), F.col("main"), F.col("after"), "Entries"))
    pictures = F.when(F.size("pictures") > 0, F.concat(F.array(text_part(F.lit("Screenshots:"))), F.col("pictures"))).otherwise(F.array().cast(f"array<{PART}>"))
    return both.select(*keys, _messages(system, F.concat(F.array(text_part(F.col("context"))), pictures, F.array(text_part(task)))).alias("messages"))


def review_requests(cues: DataFrame, system: Column, keys: tuple[str, ...] = ("media_id", "batch_id")) -> DataFrame:
    """``(*keys, messages)``: entries to correct between their neighbours."""
    batches = _batches(cues, list(keys), [F.col("idx").alias("index"), F.col("text")])
    return batches.select(*keys, _messages(system, F.array(text_part(_sections(F.col("before"), F.col("main"), F.col("after"), "Entries to correct")))).alias("messages"))


def description_requests(cues: DataFrame, media: DataFrame, thumbs: DataFrame, system: Column, most_images: int = 10, lines: int = LINES) -> DataFrame:
    """``(media_id, messages)``: what a medium is about, from its full metadata, evenly spaced images and at most ``lines`` evenly spaced captions."""
    kept = even_sample(cues, lines, ["media_id"], ["seq"])
    said = kept.groupBy("media_id").agg(F.array_join(_ordered(F.concat("idx", F.lit(". "), strip(F.col("text"))), F.lit(True)), "\n").alias("said"))
    known = media.select("media_id", metadata_lines(full=True).alias("meta"))
    both = said.join(known, "media_id", "left").join(_images(thumbs, ["media_id"], most_images), "media_id", "left")
    head = text_part(F.when(F.col("meta") != "", F.concat(F.lit("Metadata:\n"), "meta")))
    parts = F.concat(F.array(head), F.coalesce("pictures", F.array().cast(f"array<{PART}>")), F.array(text_part(F.concat(F.lit("Captions:\n"), "said")), text_part(F.lit("Return one JSON object, without repeated keypoints or keywords."))))
    return both.select("media_id", _messages(system, parts).alias("messages"))
