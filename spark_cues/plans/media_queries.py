"""Queries over media metadata, tracks, artifacts, usage and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dimensions import LANGUAGES, PHASES, SPEAKABLE, THEMES, caption_codes, codes, languages, phases, themes, values_sql
from ..operators import audio, intervals, models, rollups, selection
from ..runtime import scratch_path
from ..sources import media as sources
from . import fixtures as fx
from .registry import query

_CODES = f"codes(code, name) as (values {values_sql(caption_codes())})"
_ORIG = """orig as (select media_id, arg_min(code, pos) as orig_code, regexp_replace(arg_min(code, pos), '-orig$', '') as base from tracks where bucket = 'automatic_captions' and code like '%-orig' group by media_id)"""


@query("j09_pick_track", f"""with {fx.TRACKS_SQL}, r as (select *, row_number() over (partition by media_id, code order by case when bucket = 'subtitles' then 0 else 1 end, pos) as k from tracks where ext = 'srt') select media_id, code, bucket, url from r where k = 1""")
def pick_track(spark, sf):
    return selection.pick_track(fx.tracks(spark, sf))


@query(
    "j10_wanted_tracks",
    f"""with {fx.TRACKS_SQL}, {_ORIG}, want as (select media_id, orig_code as code from orig union select media_id, base from orig union select page_id, 'fr' from pages where page_id % 2 = 0)
    select media_id, code, code || case when bool_or(bucket = 'subtitles') then '.manual.srt' else '.srt' end as file from want join tracks using (media_id, code) group by media_id, code""",
)
def wanted_tracks(spark, sf):
    targets = fx.table(spark, sf, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("media_id"), F.lit("fr").alias("code"))
    return selection.wanted_tracks(fx.tracks(spark, sf), targets)


@query(
    "j11_original_language",
    f"""with {fx.TRACKS_SQL}, {_CODES}, {_ORIG} select page_id as media_id, coalesce(c.name, o.base, case when page_id % 4 = 0 then 'Dutch' end) as original_language from pages left join orig o on o.media_id = page_id left join codes c on c.code = o.base""",
)
def original_language(spark, sf):
    media = fx.table(spark, sf, "pages").select(F.col("page_id").alias("media_id"), F.when(F.col("page_id") % 4 == 0, "Dutch").alias("language"))
    return selection.original_language(media, fx.tracks(spark, sf), codes(spark))


_THEMES = f"themes as (select theme, gender, language, theme || '|' || language as voice from (values {values_sql([(t, g) for t, g, _ in THEMES])}) t(theme, gender), (values {values_sql([(n,) for n, _ in SPEAKABLE])}) l(language))"
_NAMES = [t for t, _, _ in THEMES] + ["unknown"]


def _wanted(spark, sf):
    theme = F.get(F.array(*map(F.lit, _NAMES)), (F.col("page_id") % 5).cast("int"))
    return fx.table(spark, sf, "pages").select(F.col("page_id").alias("media_id"), theme.alias("theme"), F.when(F.col("page_id") % 3 == 0, "French").otherwise("English").alias("language"))


@query(
    "j12_resolve_theme",
    f"""with {_THEMES}, want as (select page_id as media_id, ({_NAMES})[page_id % 5 + 1] as theme, case when page_id % 3 = 0 then 'French' else 'English' end as language from pages)
    select media_id, gender, lower('general-' || language || '-' || gender || '-' || theme) as profile from want join themes using (theme, language)""",
)
def resolve_theme(spark, sf):
    found, _ = selection.resolve_theme(_wanted(spark, sf), themes(spark))
    return found.select("media_id", "gender", "profile")


@query(
    "j13_resolve_voice",
    """select page_id as media_id, case when page_id % 7 = 0 then 'v1' when page_id % 5 = 0 then 'v2' when page_id % 3 = 0 then 'v3' when page_id % 2 = 0 then 'v4' end as voice,
    case when page_id % 7 = 0 then 'sample' when page_id % 5 = 0 then 'profile' when page_id % 3 = 0 then 'theme' when page_id % 2 = 0 then 'clone' end as provenance from pages""",
)
def resolve_voice(spark, sf):
    media = fx.table(spark, sf, "pages").select(F.col("page_id").alias("media_id"))
    some = [media.where(f"media_id % {k} = 0").withColumn("voice", F.lit(v)) for k, v in ((7, "v1"), (5, "v2"), (3, "v3"), (2, "v4"))]
    return selection.resolve_voice(media, *some)


@query(
    "j14_choose_track",
    f"""with {fx.CUES_SQL}, c as (select media_id, seq, media_id % 3 = 0 and media_id % 2 = 0 as b from cues)
    select media_id, seq, case when b then 'B' else 'A' end as chosen from c where not b or seq % 2 = 0""",
)
def choose_track(spark, sf):
    asr = fx.cues(spark, sf).select("media_id", "seq", "text")
    platform = asr.where("media_id % 2 = 0 and seq % 2 = 0").withColumn("text", F.upper("text"))
    raw = F.when(F.col("media_id") % 3 == 0, '{"choice": "b", "reason": "cleaner"}').when(F.col("media_id") % 3 == 1, '{"choice": "C"}').otherwise("not json")
    answers = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("media_id")).withColumn("raw", raw)
    return selection.choose_track(asr, platform, answers).select("media_id", "seq", "chosen")


@query(
    "j15_pick_media_variant",
    """with f as (select page_id as media_id, 'f' || h as format_id, h as height from (select page_id, unnest([240, 480, 1080, 720, 1440][page_id % 3 + 1:5]) as h from pages)),
    r as (select *, row_number() over (partition by media_id order by case when height <= 720 then 0 else 1 end, height desc, format_id) as k from f) select media_id, format_id, height from r where k = 1""",
)
def pick_media_variant(spark, sf):
    heights = F.slice(F.array(*map(F.lit, (240, 480, 1080, 720, 1440))), (F.col("page_id") % 3 + 1).cast("int"), F.lit(5))
    formats = fx.table(spark, sf, "pages").select(F.col("page_id").alias("media_id"), F.explode(heights).alias("height")).withColumn("format_id", F.concat(F.lit("f"), F.col("height").cast("string")))
    return selection.pick_media_variant(formats)


@query(
    "j16_pick_display_track",
    """select doc_id as media_id, case when doc_id % 4 = 0 then 'translated' when doc_id % 2 = 0 then 'final' else 'source' end as track from documents""",
)
def pick_display_track(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"))
    every = docs.withColumn("track", F.lit("source")).unionByName(docs.where("media_id % 2 = 0").withColumn("track", F.lit("final"))).unionByName(docs.where("media_id % 4 = 0").withColumn("track", F.lit("translated")))
    return selection.pick_display_track(every, ["translated", "final", "reviewed", "source"])


@query(
    "g02_usage_by_stage",
    f"""with {fx.LLM_SQL}, e as (select stage, arg_min(model, event_id) as model, count(*) as calls, sum(input_tokens) as input_tokens, sum(output_tokens) as output_tokens from llm_calls group by stage)
    select stage, model, calls, cast(input_tokens as bigint) as input_tokens, cast(output_tokens as bigint) as output_tokens from e union all select null, null, cast(sum(calls) as bigint), cast(sum(input_tokens) as bigint), cast(sum(output_tokens) as bigint) from e""",
)
def usage_by_stage(spark, sf):
    return rollups.usage_by_stage(fx.llm_calls(spark, sf))


@query(
    "g03_usage_report",
    f"""with {fx.LLM_SQL}, e as (select stage, arg_min(model, event_id) as model, count(*) as calls, sum(input_tokens) as i, sum(output_tokens) as o from llm_calls group by stage), a as (from e union all select null, null, sum(calls), sum(i), sum(o) from e)
    select stage, coalesce(stage || ' (' || model || ')', 'total') || ' calls: ' || format('{{:,}}', cast(calls as bigint)) || ' in: ' || format('{{:,}}', cast(i as bigint)) || ' out: ' || format('{{:,}}', cast(o as bigint)) as line from a""",
)
def usage_report(spark, sf):
    return rollups.usage_report(rollups.usage_by_stage(fx.llm_calls(spark, sf)))


@query(
    "r01_usage_windows",
    f"""with {fx.LLM_SQL} select to_timestamp(run_id * 300) at time zone 'UTC' as window_start, stage, count(*) as calls, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from llm_calls group by 1, 2""",
)
def usage_windows(spark, sf):
    from ..streaming.live import stream_usage

    return stream_usage(fx.llm_calls(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "g07_bench_summary",
    f"""with {fx.BENCH_SQL}, e as (select label, avg(latency_s) as m, stddev_pop(latency_s) as s, min(latency_s) as l, avg(latency_s / audio_dur_s) as r, avg(chars) / avg(latency_s) as c from bench_runs group by label), a as (from e union all select null, avg(m), avg(s), avg(l), avg(r), avg(c) from e)
    select label, round(m, 6) as latency_mean, round(s, 6) as latency_std, round(l, 6) as latency_min, round(r, 6) as rtf_mean, round(c, 6) as chars_per_s from a""",
)
def bench_summary(spark, sf):
    out = rollups.bench_summary(fx.bench_runs(spark, sf))
    return out.select("label", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    "g09_dedup_terms",
    """with t as (select doc_id, pos, trim(term, ' ' || chr(10)) as term from (select doc_id, unnest(string_split(text, ' ')) as term, unnest(range(len(string_split(text, ' ')))) as pos from documents)),
    o as (select doc_id, lower(term) as low, arg_min(term, pos) as term, min(pos) as pos from t where trim(term, ' ') <> '' group by doc_id, lower(term)), r as (select *, row_number() over (partition by doc_id order by pos) as k from o)
    select doc_id as media_id, string_agg(term, '|' order by pos) as terms from r where k <= 20 group by doc_id""",
)
def dedup_terms(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), F.transform(F.split("text", " ", -1), lambda x: F.btrim(x, F.lit(" \n"))).alias("terms"))
    return rollups.dedup_terms(docs, ["media_id"], "terms", 20).select("media_id", F.array_join("terms", "|").alias("terms"))


@query("g11_theme_catalog", f"""with {_THEMES} select theme, gender, array_to_string(list_sort(list(distinct language)), ',') as languages, (select count(*) from pages) as n_pages from themes group by theme, gender""")
def theme_catalog(spark, sf):
    pages = fx.table(spark, sf, "pages").agg(F.count("*").alias("n_pages"))
    return rollups.theme_catalog(themes(spark)).withColumn("languages", F.array_join("languages", ",")).join(pages, how="cross")


_PHASES = f"phases(priority, status, pattern) as (values {values_sql(PHASES)})"


@query(
    "g12_latest_phase",
    f"""with {fx.LOGS_SQL}, {_PHASES}, top as (select run_id, max(line_no) as top from log_lines group by run_id),
    r as (select l.run_id, status, line, row_number() over (partition by l.run_id order by line_no desc, priority) as k from log_lines l join top using (run_id) join phases on contains(line, pattern) where line_no > top - 20)
    select run_id, coalesce(case when status = 'synthesising' and regexp_extract(line, 'segment (\\d+/\\d+)', 1) <> '' then 'synthesising segment ' || regexp_extract(line, 'segment (\\d+/\\d+)', 1) else status end, 'processing') as status from top left join (from r where k = 1) using (run_id)""",
)
def latest_phase(spark, sf):
    return rollups.latest_phase(fx.log_lines(spark, sf), phases(spark))


@query(
    "p08_artifact_validity",
    f"""with {fx.ARTIFACTS_SQL} select media_id, stage, bytes >= 1024 as valid from artifacts""",
)
def artifact_validity(spark, sf):
    return rollups.artifact_validity(fx.artifacts(spark, sf)).select("media_id", "stage", "valid")


@query(
    "p14_track_readiness",
    f"""with {fx.ARTIFACTS_SQL} select media_id, lang, {', '.join(f"bool_or(bytes >= 1024) filter (stage = '{s}') as {s}" for s in fx.STAGES)} from artifacts group by media_id, lang""",
)
def track_readiness(spark, sf):
    return rollups.track_readiness(rollups.artifact_validity(fx.artifacts(spark, sf)), list(fx.STAGES))


_SPEAK = {n for n, _ in SPEAKABLE}


@query(
    "p09_validate_language",
    f"""with l(name, low, speakable) as (values {values_sql([(n, n.lower(), n.split(' (')[0] in _SPEAK) for n, _, _ in LANGUAGES])}), w as (select doc_id, (['ENGLISH', 'french', 'Klingon', 'auto', 'Hindi'])[doc_id % 5 + 1] as wanted from documents)
    select doc_id as media_id, coalesce(name, 'auto') as name, speakable from w left join l on low = lower(wanted) where name is not null or wanted = 'auto'""",
)
def validate_language(spark, sf):
    rows = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), F.get(F.array(*map(F.lit, ("ENGLISH", "french", "Klingon", "auto", "Hindi"))), (F.col("doc_id") % 5).cast("int")).alias("wanted"))
    return rollups.validate_language(rows, languages(spark))[0].select("media_id", "name", "speakable")


@query(
    "p11_classify_source",
    """select page_id as media_id, case page_id % 4 when 0 then 'url' when 1 then 'audio' when 2 then 'video' else 'unknown' end as kind from pages""",
)
def classify_source(spark, sf):
    name = F.concat(F.lit("/data/"), F.col("page_id").cast("string"))
    path = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://example.org/"), F.col("page_id").cast("string"))).when(F.col("page_id") % 4 == 1, F.concat(name, F.lit(".MP3"))).when(F.col("page_id") % 4 == 2, F.concat(name, F.lit(".mkv"))).otherwise(name)
    return fx.table(spark, sf, "pages").select(F.col("page_id").alias("media_id"), selection.classify_source(path).alias("kind"))


@query(
    "p13_overflow_report",
    f"""with {fx.TTS_SQL} select media_id, count(*) as n_over, round(sum(actual_dur - target_dur), 3) as excess from tts_segments where actual_dur > target_dur * 1.05 group by media_id""",
)
def overflow_report(spark, sf):
    return rollups.overflow_report(fx.tts_segments(spark, sf))


_PLAN = f"""{fx.TTS_SQL}, {fx.DURATIONS_SQL}, n as (select *, lead(start) over (partition by media_id order by start, seq) as nxt from tts_segments where actual_dur is not null),
b as (select *, greatest(case when nxt is not null then nxt - start - 0.05 else duration - start end, target_dur) as budget, nxt is null as is_last from n join durations using (media_id)),
r as (select *, round(actual_dur / budget, 9) as ratio from b), s as (select *, round(greatest(ratio / 0.92, 0.82), 9) as slow from r),
plan as (select *, case when actual_dur <= 0 then 1.0 when ratio > 1.05 then least(ratio, 1.5) when ratio < 0.95 and slow < 0.95 then slow else 1.0 end as tempo, case when actual_dur <= 0 then 'skipped' when ratio > 1.05 then 'sped_up' when ratio < 0.95 and slow < 0.95 then 'slowed_down' else 'ok' end as outcome from s),
over as (select *, round(actual_dur / tempo, 6) as p, is_last and round(actual_dur / tempo, 6) > budget + 2 as trimmed, case when is_last then 0.0 else round(greatest(0.0, round(actual_dur / tempo, 6) - budget), 6) end as overlap from plan)"""


def _plan(spark, sf):
    return audio.tempo_plan(intervals.tempo_budget(fx.tts_segments(spark, sf), fx.durations(spark, sf)))


@query("a07_tempo_plan", f"with {_PLAN} select media_id, seq, round(tempo, 6) as tempo, outcome from plan")
def tempo_plan(spark, sf):
    return _plan(spark, sf).select("media_id", "seq", F.round("tempo", 6).alias("tempo"), "outcome")


@query("a08_overflow_plan", f"with {_PLAN} select media_id, seq, round(case when trimmed then budget else p end, 3) as planned, trimmed, round(overlap, 3) as overlap, case when trimmed then 150 when is_last then 200 else 50 end as fade_out_ms from over")
def overflow_plan(spark, sf):
    return audio.overflow_plan(_plan(spark, sf)).select("media_id", "seq", F.round("planned", 3).alias("planned"), "trimmed", F.round("overlap", 3).alias("overlap"), "fade_out_ms")


@query(
    "g06_tempo_stats",
    f"""with {_PLAN} select media_id, {', '.join(f"count(*) filter (outcome = '{o}') as n_{o}" for o in ('sped_up', 'slowed_down', 'ok', 'skipped'))}, count(*) filter (trimmed) as n_trimmed, round(sum(overlap), 3) as overflow from over group by media_id""",
)
def tempo_stats(spark, sf):
    return audio.tempo_stats(audio.overflow_plan(_plan(spark, sf)))


@query(
    "s10_artifact_layout",
    f"""with files(stage, file, scoped) as (values {values_sql(sources.LAYOUT)})
    select page_id as media_id, case when scoped then lang end as lang, stage, 'p' || page_id || case when scoped then '/' || lang else '' end || '/' || file as path from pages, files, (values ('en'), ('fr')) l(lang) where scoped or lang = 'en'""",
)
def artifact_layout(spark, sf):
    media = fx.table(spark, sf, "pages").select(F.col("page_id").alias("media_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("slug"))
    spoken = media.select("media_id", F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("lang"))
    return sources.artifact_layout(media, spoken).drop("slug")


def _raw_media(spark, sf):
    """Metadata objects as JSON text, read with the fixed schema."""
    lists = F.create_map(F.lit("en"), F.array(F.struct(F.lit("srt").alias("ext"), F.col("url").alias("url")), F.struct(F.lit("vtt").alias("ext"), F.col("url").alias("url"))))
    auto = F.create_map(F.lit("en-orig"), F.array(F.struct(F.lit("srt").alias("ext"), F.col("url").alias("url"))), F.lit("fr"), F.array(F.struct(F.lit("vtt").alias("ext"), F.col("url").alias("url"))))
    rows = fx.table(spark, sf, "pages").select(F.to_json(F.struct(F.col("page_id").alias("media_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.when(F.col("page_id") % 2 == 0, lists).alias("subtitles"), auto.alias("automatic_captions"))).alias("j"))
    return rows.select(F.from_json("j", sources.METADATA).alias("m")).select("m.*")


@query("s06_metadata", """select page_id as media_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, case when page_id % 2 = 0 then 'en' else '' end as subtitles, 'en-orig,fr' as auto from pages""")
def metadata(spark, sf):
    return sources.metadata(_raw_media(spark, sf)).select("media_id", "title", F.array_join("available_subtitles", ",").alias("subtitles"), F.array_join("available_auto_captions", ",").alias("auto"))


@query(
    "s07_tracks",
    """select page_id as media_id, bucket, code, cast(pos as bigint) as pos, ext, url from pages, (values ('subtitles', 'en', 0, 'srt'), ('subtitles', 'en', 1, 'vtt'), ('automatic_captions', 'en-orig', 0, 'srt'), ('automatic_captions', 'fr', 0, 'vtt')) t(bucket, code, pos, ext) where bucket <> 'subtitles' or page_id % 2 = 0""",
)
def read_tracks(spark, sf):
    return sources.read_tracks(_raw_media(spark, sf))


@query(
    "s11_voice_profiles",
    """with f as (select page_id % 100 as n, page_id from pages) select 'v' || n as name, max('/p/v' || n || '/voice.' || case when n % 3 = 0 then 'wav' when n % 3 = 1 then 'm4a' else 'mp3' end) as voice, '/p/v' || n || '/script.txt' as script from f where n % 5 <> 4 group by n""",
)
def voice_profiles(spark, sf):
    base = fx.table(spark, sf, "pages").select((F.col("page_id") % 100).alias("n")).distinct()
    name = F.concat(F.lit("/p/v"), F.col("n").cast("string"), F.lit("/"))
    more = F.when(F.col("n") % 3 == 0, F.array(F.lit("voice.mp3"), F.lit("voice.wav"), F.lit("voice.m4a"))).when(F.col("n") % 3 == 1, F.array(F.lit("voice.mp3"), F.lit("voice.m4a"))).otherwise(F.array(F.lit("voice.mp3")))
    script = F.when(F.col("n") % 5 != 4, F.array(F.lit("script.txt"))).otherwise(F.array().cast("array<string>"))
    files = base.select(F.explode(F.concat(more, script)).alias("f"), name.alias("d")).select(F.concat("d", "f").alias("path"))
    return sources.voice_profiles(files)[0]


@query(
    "s12_recogniser_segments",
    """with c as (select conv_id, turn, trim(text, ' ' || chr(10)) as text from conversations) select conv_id as media_id, turn as seq, turn * 10.0 as start, turn * 10.0 + 5 as "end", text, case when conv_id % 2 = 0 then 'en' else 'unknown' end as language from c where text <> ''""",
)
def recogniser_segments(spark, sf):
    rows = fx.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    said = F.struct((F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 5).alias("end"), F.col("text").alias("transcript"), F.lit(None).cast("array<struct<word:string,punctuated_word:string,start:double,end:double>>").alias("words"))
    each = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("u")))), lambda x: x["u"]).alias("utterances"))
    raw = each.select(F.to_json(F.struct(F.col("conv_id").alias("media_id"), F.when(F.col("conv_id") % 2 == 0, "en").alias("language"), "utterances")).alias("j")).select(F.from_json("j", sources.RECOGNISED).alias("r")).select("r.*")
    return sources.recogniser_segments(raw).drop("words")


@query("v01_map_model", """select doc_id as media_id, substr(text, 1, 50) || '!' as raw, length(text) // 3 as input_tokens, cast(1 as bigint) as output_tokens from documents""")
def map_model(spark, sf):
    requests = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), F.col("text").alias("prompt"), X.estimate_tokens(F.col("text")).alias("size"))
    make = lambda: lambda row: {"raw": row["prompt"][:50] + "!", "input_tokens": row["size"], "output_tokens": 1}
    return models.map_model(requests, make, "translate").select("media_id", "raw", "input_tokens", "output_tokens")


@query("v03_map_synthesise", f"""with {fx.TTS_SQL} select media_id, seq, round((len(idx) + 1) * 8000 / 16000.0, 3) as actual_dur from tts_segments where actual_dur is null""")
def map_synthesise(spark, sf):
    todo = fx.tts_segments(spark, sf).where("actual_dur is null").select("media_id", "seq", "idx")
    make = lambda: lambda row: {"samples": [0.0] * (8000 * (len(row["idx"]) + 1)), "sample_rate": 16000}
    return models.map_synthesise(todo, make).select("media_id", "seq", F.round("actual_dur", 3).alias("actual_dur"))


@query(
    "v02_map_recognise",
    f"""with {fx.CUES_SQL}, {fx.DURATIONS_SQL}, every as (
      select media_id, 0.0 as gap_start, start as gap_end from cues where seq = 0
      union all select media_id, "end", coalesce(lead(start) over (partition by media_id order by seq), duration) from cues join durations using (media_id)),
    gaps as (select media_id, round(gap_start, 3) as gap_start, round(gap_end, 3) as gap_end from every where gap_end - gap_start > 5.0)
    select media_id, gap_start, gap_end, round(gap_end - 1.0, 3) as "end", 'heard in ' || media_id as text from gaps""",
)
def map_recognise(spark, sf):
    """Gaps heard by a stand-in that finds one segment in each."""
    gaps = intervals.find_gaps(fx.cues(spark, sf), fx.durations(spark, sf)).select("media_id", F.round("gap_start", 3).alias("gap_start"), F.round("gap_end", 3).alias("gap_end"))
    make = lambda: lambda row: {"segments": [{"start": row["gap_start"], "end": row["gap_end"] - 1.0, "text": f"heard in {row['media_id']}"}]}
    heard = models.map_recognise(gaps, make).select("media_id", "gap_start", "gap_end", F.explode("segments").alias("s"))
    return heard.select("media_id", "gap_start", "gap_end", F.round("s.end", 3).alias("end"), "s.text")


@query("s08_json_docs", """select doc_id, text, lang, cast(n_chars as bigint) as n_chars from documents""")
def json_docs(spark, sf):
    """Documents written as JSON lines and read back."""
    path = scratch_path(spark, "json-docs")
    sources.write_json_docs(fx.table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    return sources.read_json_docs(spark, path, "doc_id bigint, text string, lang string, n_chars bigint")
