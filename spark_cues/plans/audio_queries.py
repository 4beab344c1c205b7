"""Queries over sample chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio
from . import fixtures as fx
from .registry import query

CHUNK, FRAME = 64, 32
_SAMPLES = f"{fx.PCM_SQL}, s as (select media_id, chunk_no * {CHUNK} + i - 1 as pos, cast(samples[i] as double) as x from (select *, unnest(range(1, {CHUNK} + 1)) as i from pcm))"
_FRAMES = f"{_SAMPLES}, frames as (select media_id, pos // {FRAME} as frame_no, round(sqrt(avg(x * x)), 6) as rms from s group by 1, 2 having count(*) = {FRAME})"


@query("a01_frame_rms", f"with {_FRAMES} select media_id, frame_no, rms from frames")
def frame_rms(spark, sf):
    return audio.frame_rms(fx.pcm(spark, sf), FRAME, CHUNK)


@query("a02_zero_crossing_rate", f"with {_SAMPLES}, c as (select media_id, x, lag(sign(x)) over (partition by media_id order by pos) as p from s) select media_id, round(sum(case when p is not null and p <> sign(x) then 1 else 0 end) / count(*), 9) as zcr from c group by media_id")
def zero_crossing_rate(spark, sf):
    return audio.zero_crossing_rate(fx.pcm(spark, sf), CHUNK)


@query("a03_speech_density", f"with {_FRAMES} select media_id, round(avg(case when rms >= pow(10, -18 / 20.0) then 1 else 0 end), 9) as density from frames group by media_id")
def speech_density(spark, sf):
    return audio.speech_density(fx.pcm(spark, sf), CHUNK, FRAME, -18.0)


@query(
    "a04_trim_points",
    f"""with {_FRAMES}, b as (select media_id, cast(count(*) * 3 // 4 as bigint) as n from frames group by media_id), near as (select f.* from frames f join b using (media_id) where frame_no < n and frame_no > floor(n * 0.2)),
    t as (select media_id, max(frame_no) filter (rms < pow(10, -18.5 / 20.0)) as silent, arg_min(frame_no, struct_pack(r := rms, f := frame_no)) as low from near group by media_id) select media_id, coalesce(silent, low, n) as cut_frame from b left join t using (media_id)""",
)
def trim_points(spark, sf):
    pcm = fx.pcm(spark, sf)
    budgets = audio.frame_rms(pcm, FRAME, CHUNK).groupBy("media_id").agg(F.floor(F.count("*") * 3 / 4).alias("budget_frames"))
    return audio.trim_points(pcm, budgets, CHUNK, FRAME, -18.5)


@query(
    "a05_fade",
    f"""with {fx.PCM_SQL}, s as (select media_id, chunk_no, i - 1 as p, cast(samples[i] as double) as x from (select *, unnest(range(1, {CHUNK} + 1)) as i from pcm))
    select media_id, chunk_no, p as pos, round(x * case when p < 16 then 0.5 * (1 - cos(pi() * p / 15.0)) else 1.0 end * case when p >= 44 then 0.5 * (1 - cos(pi() * (63 - p) / 19.0)) else 1.0 end, 6) as x from s""",
)
def fade(spark, sf):
    rows = fx.pcm(spark, sf).select("media_id", "chunk_no", F.posexplode("samples").alias("pos", "x"))
    gain = audio.fade_gain(F.col("pos"), F.lit(CHUNK), F.lit(16), F.lit(20))
    return rows.select("media_id", "chunk_no", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("x").cast("double") * gain, 6).alias("x"))


@query(
    "a06_mix_timeline",
    f"""with {fx.PCM_SQL}, dur as (select media_id, max(chunk_no) * 0.5 + 1 as duration from pcm group by media_id), tot as (select *, cast(floor((duration + 2) * 64) as bigint) as total from dur),
    placed as (select media_id, cast(floor(chunk_no * 0.5 * 64) as bigint) + i - 1 as pos, cast(samples[i] as double) as x from (select *, unnest(range(1, 65)) as i from pcm)),
    mixed as (select p.media_id, pos, round(sum(x), 6) as x from placed p join tot using (media_id) where pos < total group by p.media_id, pos),
    ends as (select media_id, duration, total, max(pos) filter (x <> 0) + 1 as stop from mixed join tot using (media_id) group by all),
    lim as (select media_id, stop, least(greatest(stop + 6, cast(floor(duration * 64) as bigint)), total) as length, least(19, stop // 2) as tail from ends),
    faded as (select media_id, pos, case when pos < stop and pos >= stop - tail and tail >= 2 then x * 0.5 * (1 - cos(pi() * (stop - 1 - pos) / (tail - 1.0))) else x end as x from mixed join lim using (media_id) where pos < length)
    select f.media_id, count(*) as n_sounding, round(sum(abs(round(x / greatest(peak, 1.0), 6))), 2) as loudness, any_value(length) as length from faded f join (select media_id, max(abs(x)) as peak from faded group by media_id) using (media_id) join lim using (media_id) group by f.media_id""",
)
def mix_timeline(spark, sf):
    pcm = fx.pcm(spark, sf)
    clips = pcm.select("media_id", (F.col("chunk_no") * 0.5).alias("start"), "samples")
    durations = pcm.groupBy("media_id").agg((F.max("chunk_no") * 0.5 + 1).alias("duration"))
    mixed = audio.mix_timeline(clips, durations, 64, 256)
    loud = F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    sums = mixed.groupBy("media_id").agg(F.sum("n_sounding").alias("n_sounding"), F.round(F.sum(loud), 2).alias("loudness"), F.sum(F.size("samples")).alias("length"))
    return sums.select("media_id", "n_sounding", "loudness", "length")


@query("g10_peak", f"with {_SAMPLES} select media_id, round(max(abs(x)), 6) as peak, greatest(round(max(abs(x)), 6), 1.0) as scale from s group by media_id")
def peak(spark, sf):
    return audio.peak_scale(fx.pcm(spark, sf))


_RANGES = "ranges as (select media_id, chunk_no as range_no, chunk_no + 0.25 as a, chunk_no + 1.75 as z from pcm where chunk_no % 3 = 0)"
_FEATURES = f"""{_SAMPLES}, {_RANGES}, r as (select media_id, range_no, pos, x, lag(sign(x)) over (partition by media_id, range_no order by pos) as p from ranges join s using (media_id) where pos >= floor(a * 64) and pos < floor(z * 64)),
features as (select media_id, range_no, count(*) as n_samples, round(sqrt(sum(x * x) / count(*)), 6) as rms, round(sum(case when p is not null and p <> sign(x) then 1 else 0 end) / count(*), 9) as zcr from r group by media_id, range_no)"""


def _ranges(pcm):
    return pcm.where("chunk_no % 3 = 0").select("media_id", F.col("chunk_no").alias("range_no"), (F.col("chunk_no") + 0.25).alias("start"), (F.col("chunk_no") + 1.75).alias("end"))


@query("a01_range_features", f"with {_FEATURES} select * from features")
def range_features(spark, sf):
    pcm = fx.pcm(spark, sf)
    return audio.range_features(pcm, _ranges(pcm), CHUNK)


@query("p12_speech_band", f"with {_FEATURES}, ref as (select media_id, rms as ref_rms from features where range_no = 0) select f.media_id, f.range_no from features f join ref using (media_id) where ref_rms >= 1e-6 and rms > ref_rms * 0.97 and zcr > 0.01 and zcr < 0.5")
def speech_band(spark, sf):
    pcm = fx.pcm(spark, sf)
    found = audio.range_features(pcm, _ranges(pcm), CHUNK)
    return audio.speech_band(found, found.where("range_no = 0").select("media_id", F.col("rms").alias("ref_rms")), 0.97, 0.01, 0.5).select("media_id", "range_no")


@query("w11_silent_gaps", f"with {_SAMPLES}, g as (select media_id, chunk_no * 2 as seq, chunk_no * 2 + 0.5 as a, chunk_no * 2 + 2.0 as z from pcm where chunk_no * 2 + 2 <= (select max(chunk_no) from pcm p where p.media_id = pcm.media_id)), f as (select g.media_id, g.seq, sqrt(avg(x * x)) as rms, count(*) as n from g join s using (media_id) where pos >= floor(a * 64) and pos < floor(z * 64) group by 1, 2) select media_id, seq from f where round(rms, 6) < pow(10, -18.06 / 20) and n >= 1.28")
def silent_gaps(spark, sf):
    pcm = fx.pcm(spark, sf)
    last = pcm.groupBy("media_id").agg(F.max("chunk_no").alias("top"))
    cues = pcm.join(last, "media_id").where("chunk_no * 2 <= top").select("media_id", (F.col("chunk_no") * 2).alias("seq"), (F.col("chunk_no") * 2.0).alias("start"), (F.col("chunk_no") * 2 + 0.5).alias("end"))
    return audio.silent_gaps(pcm, cues, CHUNK, 0.3, -18.06)


_MIXED = f"{fx.PCM_SQL}, b as (select media_id, chunk_no - 1 as chunk_no, samples as other from pcm where chunk_no % 2 = 1)"


@query("a10_mix_background", f"with {_MIXED} select p.media_id, p.chunk_no, round(list_sum(list_transform(range(1, 65), lambda i: cast(samples[i] as double) + 0.5 * coalesce(cast(other[i] as double), 0))), 4) as total from pcm p left join b using (media_id, chunk_no)")
def mix_background(spark, sf):
    pcm = fx.pcm(spark, sf)
    other = pcm.where("chunk_no % 2 = 1").withColumn("chunk_no", F.col("chunk_no") - 1)
    return audio.mix_background(pcm, other, 0.5).select("media_id", "chunk_no", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("a11_level_match", f"with {_SAMPLES} select media_id, round(sqrt(avg(x * x)) * 2, 4) as level from s group by media_id")
def level_match(spark, sf):
    pcm = fx.pcm(spark, sf)
    loud = pcm.withColumn("samples", F.transform("samples", lambda x: (x * 2).cast("float")))
    square = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return audio.level_match(pcm, loud).groupBy("media_id").agg(F.round(F.sqrt(F.sum(square) / F.sum(F.size("samples"))), 4).alias("level"))


@query("a09_recover_gaps", f"with {fx.PCM_SQL}, c as (select media_id, chunk_no as seq, chunk_no * 1.0 as start, 'a' as text, 0 as t from pcm where chunk_no % 2 = 0 union all select media_id, chunk_no, chunk_no + 0.25, 'b', 1 from pcm where chunk_no % 3 = 0) select media_id, row_number() over (partition by media_id order by start, t, seq) - 1 as seq, start, text from c")
def recover_gaps(spark, sf):
    pcm = fx.pcm(spark, sf)
    cues = pcm.where("chunk_no % 2 = 0").select("media_id", F.col("chunk_no").alias("seq"), (F.col("chunk_no") * 1.0).cast("double").alias("start"), (F.col("chunk_no") + 0.2).cast("double").alias("end"), F.lit("a").alias("text"))
    gaps = pcm.where("chunk_no % 3 = 0").select("media_id", F.col("chunk_no").alias("range_no"), F.col("chunk_no").cast("double").alias("start"))
    said = gaps.select("media_id", "range_no", F.lit(0.25).alias("start"), F.lit(0.5).alias("end"), F.lit("b").alias("text"))
    return audio.recover_gaps(cues, gaps, said).select("media_id", "seq", "start", "text")
