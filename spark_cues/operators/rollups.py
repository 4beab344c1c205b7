"""Roll-ups: speech rates, usage, durations, tempo, benchmarks, term lists, phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_budget, word_count


def _upper_median(name: str) -> Column:
    """``sorted[n // 2]``: the lower middle of the negated values, merged as counts by value, not as a list."""
    return F.expr(f"-percentile_disc(0.5) within group (order by -{name})")


def estimate_wps(cues: DataFrame, rates: DataFrame, default: float = 3.0) -> DataFrame:
    """``(media_id, wps)``: words a second, at most the language's rate; that rate where there is under a second or five words.

    ``rates (media_id, rate)``.
    """
    sums = cues.groupBy("media_id").agg(F.sum(word_count(F.col("text"))).alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"))
    both = sums.join(rates, "media_id", "left").withColumn("rate", F.coalesce("rate", F.lit(default)))
    return both.select("media_id", F.when((F.col("seconds") < 1.0) | (F.col("n") < 5), F.col("rate")).otherwise(F.least(F.col("n") / F.col("seconds"), F.col("rate"))).alias("wps"))


def usage_by_stage(calls: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Calls and tokens a stage, its first model, and the grand total (null stage) of each ``keys``."""
    keys = list(keys)
    each = calls.groupBy(*keys, "stage").agg(F.min_by("model", "event_id").alias("model"), F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    total = each.groupBy(*keys).agg(F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("model"), F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return each.unionByName(total)


def usage_report(usage: DataFrame) -> DataFrame:
    """One line of text for each row of :func:`usage_by_stage`."""
    name = F.coalesce(F.concat(F.col("stage"), F.lit(" ("), F.col("model"), F.lit(")")), F.lit("total"))
    number = lambda c: F.format_number(c, 0)
    return usage.select("stage", F.concat_ws(" ", name, F.lit("calls:"), number("calls"), F.lit("in:"), number("input_tokens"), F.lit("out:"), number("output_tokens")).alias("line"))


def segment_mode(media: DataFrame, cues: DataFrame, short: float = 3.0, empty: float = 5.0) -> DataFrame:
    """``(media_id, median_dur, mode)``: long where the upper median duration is under ``short``; empty tracks count as ``empty``."""
    med = cues.withColumn("d", F.round(F.col("end") - F.col("start"), 3)).groupBy("media_id").agg(_upper_median("d").alias("median_dur"))
    return media.select("media_id").join(med, "media_id", "left").withColumn("median_dur", F.coalesce("median_dur", F.lit(empty))).withColumn("mode", F.when(F.col("median_dur") < short, "long").otherwise("short"))


def chunk_stats(chunks: DataFrame, most: float = 30.0) -> DataFrame:
    """Least, greatest and upper median chunk length of each medium, and chunks over 1.1 times ``most``."""
    rows = chunks.withColumn("d", F.round(F.col("end") - F.col("start"), 3))
    return rows.groupBy("media_id").agg(F.min("d").alias("min_dur"), F.max("d").alias("max_dur"), _upper_median("d").alias("median_dur"), F.sum((F.col("d") > 1.1 * most).cast("bigint")).alias("n_over"))


def media_extent(cues: DataFrame) -> DataFrame:
    return cues.groupBy("media_id").agg(F.max("end").alias("last_end"), (F.max_by("end", "seq") - F.min_by("start", "seq")).alias("span"))


def bench_summary(runs: DataFrame) -> DataFrame:
    """Latency mean, population deviation and least, mean real-time factor and characters a second of each label; the overall mean of label means in a null label."""
    each = runs.groupBy("label").agg(F.avg("latency_s").alias("latency_mean"), F.stddev_pop("latency_s").alias("latency_std"), F.min("latency_s").alias("latency_min"), F.avg(F.col("latency_s") / F.col("audio_dur_s")).alias("rtf_mean"), (F.avg("chars") / F.avg("latency_s")).alias("chars_per_s"))
    every = each.agg(F.lit(None).cast("string").alias("label"), *[F.avg(c).alias(c) for c in each.columns[1:]])
    return each.unionByName(every)


def dedup_terms(lists: DataFrame, keys: list[str], terms: str, cap: int) -> DataFrame:
    """Terms trimmed, blanks and repeats (any case) dropped, first ones kept in order, at most ``cap``."""
    low = F.transform(terms, lambda t: F.lower(F.trim(t)))
    # Distinct values keep their first places; the spelling is that of the first place, looked up for those kept alone.
    spelt = lambda x: F.transform(F.slice(F.array_distinct(F.filter(x["low"], lambda t: t != "")), 1, cap), lambda t: F.trim(F.get(x["terms"], (F.array_position(x["low"], t) - 1).cast("int"))))
    kept = F.transform(F.array(F.struct(low.alias("low"), F.col(terms).alias("terms"))), spelt)[0]
    return lists.select(*keys, kept.alias(terms)).where(F.size(terms) > 0)


def theme_catalog(themes: DataFrame) -> DataFrame:
    return themes.groupBy("theme", "gender").agg(F.sort_array(F.collect_set("language")).alias("languages"))


def latest_phase(lines: DataFrame, patterns: DataFrame, last: int = 20) -> DataFrame:
    """``(run_id, status)``: of the last matching line among the last ``last``; the first pattern in priority wins in a line.

    Synthesis shows its segment count.  A run without a match is ``processing``.  ``patterns`` is a small dimension: it becomes
    one chain of conditions, so that the lines are read once and aggregated once.
    """
    chain = F.lit(None).cast("string")
    for p in reversed(patterns.orderBy("priority").collect()):
        chain = F.when(F.contains("line", F.lit(p["pattern"])), F.lit(p["status"])).otherwise(chain)
    marked = lines.select("run_id", "line_no", "line", chain.alias("status"))
    hit = F.when(F.col("status").isNotNull(), F.col("line_no"))
    # The newest matching line of all is the newest among the last ones, or none of those matches.
    best = marked.groupBy("run_id").agg(F.max("line_no").alias("top"), F.max_by(F.struct("line_no", "status", "line"), hit).alias("x"))
    part = F.regexp_extract("x.line", r"segment (\d+/\d+)", 1)
    status = F.when((F.col("x.status") == "synthesising") & (part != ""), F.concat(F.lit("synthesising segment "), part)).otherwise(F.col("x.status"))
    return best.select("run_id", F.coalesce(F.when(F.col("x.line_no") > F.col("top") - last, status), F.lit("processing")).alias("status"))


def budget_violations(source: DataFrame, translated: DataFrame, rates: DataFrame, keys: list[str], tolerance: float = 1.5) -> DataFrame:
    """Translated cues with over ``tolerance`` times their word budget: ``actual``, ``target`` and ``excess``."""
    target = word_budget(F.col("end") - F.col("start"), F.col("wps"))
    asked = source.join(rates, "media_id").select(*keys, target.alias("target"))
    told = translated.select(*keys, word_count(F.col("text")).alias("actual"))
    return asked.join(told, keys).where(F.col("actual") > F.col("target") * tolerance).withColumn("excess", F.col("actual") - F.col("target"))


def oversize(cues: DataFrame) -> DataFrame:
    """Which splitters a cue needs: each has its own limits."""
    chars, seconds = F.length(F.trim("text")), F.round(F.col("end") - F.col("start"), 6)
    return cues.withColumns({"asr": (chars > 84) | (seconds > 5.0), "caption": chars > 300, "display": F.length(F.regexp_replace("text", "\n", " ")) > 120})


def artifact_validity(artifacts: DataFrame, least: int = 1024, required: dict[str, list[str]] | None = None, listing: DataFrame | None = None) -> DataFrame:
    """``valid``: media by size, SRT by a timestamp arrow, JSON by parsing; the stage's kind is its path's ending.

    The arrow and the JSON are looked for in the whole ``content`` where the table has it, else in ``head``.  ``required`` names,
    for a stage, the keys that its JSON must hold if it is an object; the stage ``thumbs`` must be a list that isn't empty, and with a
    ``listing (path)`` of the files there are, one of its entries must name such a file.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    body = F.col("content" if "content" in artifacts.columns else "head")
    # Fixed value: a stamp, an arrow and a stamp.
    arrow = F.regexp_like(body, F.lit(r"\d{2}:\d{2}:\d{2},\d{3}\s*-->\s*\d{2}:\d{2}:\d{2},\d{3}"))
    parsed, stage = F.try_parse_json(body).isNotNull(), F.col("stage") if "stage" in artifacts.columns else F.lit("")
    for name, keys in (required or {}).items():
        lacks = F.size(F.array_except(F.lit(keys), F.json_object_keys(body))) > 0
        parsed = parsed & ~((stage == name) & F.coalesce(lacks, F.lit(False)))
    parsed = parsed & ((stage != "thumbs") | (F.coalesce(F.json_array_length(body), F.lit(0)) > 0))
    valid = F.when(kind == "srt", arrow).when(kind == "json", parsed).otherwise(F.col("bytes") >= least)
    if listing is None:
        return artifacts.withColumn("valid", F.coalesce(valid, F.lit(False)))
    # The paths that lists name meet the files there are; a list with one hit is kept by its own path.
    named = artifacts.where("stage = 'thumbs'").select(F.col("path").alias("__list"), F.explode(F.from_json(body, "array<struct<path:string>>")["path"]).alias("__file"))
    there = named.join(listing.select(F.col("path").alias("__file")), "__file", "left_semi").select(F.col("__list").alias("__p")).distinct()
    seen = artifacts.join(there, F.col("path") == F.col("__p"), "left")
    return seen.withColumn("valid", F.coalesce(valid & ((stage != "thumbs") | F.col("__p").isNotNull()), F.lit(False))).drop("__p")


def track_readiness(artifacts: DataFrame, stages: list[str]) -> DataFrame:
    """Which stages of each medium and language are valid, a column a stage."""
    return artifacts.groupBy("media_id", "lang").pivot("stage", stages).agg(F.bool_or("valid"))


def validate_language(rows: DataFrame, languages: DataFrame, column: str = "wanted") -> tuple[DataFrame, DataFrame]:
    """Rows with the canonical ``name`` (``auto`` allowed), and rows with unknown languages."""
    known = F.broadcast(languages.select(F.lower("name").alias("__l"), "name", "speakable"))
    found = rows.withColumn("__l", F.lower(column)).join(known, "__l", "left")
    ok = F.col("name").isNotNull() | (F.col("__l") == "auto")
    named = found.where(ok).withColumn("name", F.coalesce("name", F.lit("auto"))).drop("__l")
    return named, found.where(~F.coalesce(ok, F.lit(False))).select(*rows.columns)


def overflow_report(clips: DataFrame, over: float = 1.05) -> DataFrame:
    """Clips longer than ``over`` times their target: how many, and the seconds beyond, a medium."""
    late = clips.where(F.col("actual_dur") > F.col("target_dur") * over)
    return late.groupBy("media_id").agg(F.count("*").alias("n_over"), F.round(F.sum(F.col("actual_dur") - F.col("target_dur")), 3).alias("excess"))
