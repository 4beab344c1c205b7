"""Operators over decoded samples in fixed chunks ``(media_id, chunk_no, sample_rate, samples)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import ship_package


def _square_sum(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))


def frame_rms(pcm: DataFrame, frame: int, chunk: int) -> DataFrame:
    """``(media_id, frame_no, rms)`` of whole frames; a medium with less than a frame has one of 0.

    Every chunk but the last has ``chunk`` samples.  A chunk folds the frames that lie within it; of a frame over an edge it gives
    a count and a sum, which meet those of the chunks beside it.
    """
    from_, size = F.col("chunk_no") * chunk, F.size("samples")
    numbers = F.sequence(F.floor(from_ / frame).cast("bigint"), F.floor((from_ + size - 1) / frame).cast("bigint"))
    low = lambda f: F.greatest(f * frame - from_, F.lit(0)).cast("int")
    high = lambda f: F.least((f + 1) * frame - from_, size.cast("bigint")).cast("int")
    folded = F.transform(numbers, lambda f: F.struct(f.alias("frame_no"), (high(f) - low(f)).alias("n"), _square_sum(F.slice("samples", low(f) + 1, high(f) - low(f))).alias("s")))
    parts = pcm.where(size > 0).select("media_id", F.explode(folded).alias("f")).select("media_id", "f.*")
    rms = lambda s: F.round(F.sqrt(s / frame), 6).alias("rms")
    inner = parts.where(F.col("n") == frame).select("media_id", "frame_no", rms(F.col("s")))
    over = parts.where(F.col("n") < frame).groupBy("media_id", "frame_no").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = inner.unionByName(over.where(F.col("n") == frame).select("media_id", "frame_no", rms(F.col("s"))))
    length = pcm.groupBy("media_id").agg(F.sum(size).alias("n")).where(F.col("n") < frame)
    return whole.unionByName(length.select("media_id", F.lit(0).cast("bigint").alias("frame_no"), F.lit(0.0).alias("rms")))


def zero_crossing_rate(pcm: DataFrame, chunk: int) -> DataFrame:
    """``(media_id, zcr)``: sign changes a sample, changes to and from 0 included; 0 under two samples.

    Chunks count their inner changes; the change over each edge needs only the chunks' first and last signs.
    """
    sign = F.transform("samples", lambda x: F.signum(x))
    inside = F.aggregate(F.zip_with(sign, F.concat(F.slice(sign, 1, 1), F.slice(sign, F.lit(1), F.size(sign) - 1)), lambda a, b: F.when(a != b, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
    per = pcm.where(F.size("samples") > 0).select("media_id", "chunk_no", F.size("samples").alias("n"), inside.alias("c"), F.element_at(sign, 1).alias("first"), F.element_at(sign, -1).alias("last"))
    edge = F.when(F.lag("last").over(Window.partitionBy("media_id").orderBy("chunk_no")) != F.col("first"), 1).otherwise(0)
    sums = per.withColumn("e", edge).groupBy("media_id").agg(F.sum("n").alias("n"), F.sum(F.col("c") + F.col("e")).alias("c"))
    return sums.select("media_id", F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.col("c") / F.col("n"), 9)).alias("zcr"))


def speech_density(pcm: DataFrame, chunk: int, frame: int, threshold_db: float = -40.0) -> DataFrame:
    """Share of frames at or over a level."""
    return frame_rms(pcm, frame, chunk).groupBy("media_id").agg(F.round(F.avg((F.col("rms") >= 10 ** (threshold_db / 20)).cast("int")), 9).alias("density"))


def trim_points(pcm: DataFrame, budgets: DataFrame, chunk: int, frame: int, threshold_db: float = -40.0) -> DataFrame:
    """``(media_id, cut_frame)`` for ``budgets (media_id, budget_frames)``.

    The last silent frame above a fifth of the budget, else the quietest there (the first on ties), else the budget.
    """
    quiet = 10 ** (threshold_db / 20)
    near = frame_rms(pcm, frame, chunk).join(budgets, "media_id").where((F.col("frame_no") < F.col("budget_frames")) & (F.col("frame_no") > F.floor(F.col("budget_frames") * 0.2)))
    best = near.groupBy("media_id").agg(F.max(F.when(F.col("rms") < quiet, F.col("frame_no"))).alias("silent"), F.min_by("frame_no", F.struct("rms", "frame_no")).alias("low"))
    return budgets.join(best, "media_id", "left").select("media_id", F.coalesce("silent", "low", F.col("budget_frames").cast("bigint")).alias("cut_frame"))


def fade_gain(pos: Column, total: Column, fade_in: Column, fade_out: Column) -> Column:
    """Raised-cosine gain at a sample: fades in samples, each half the clip at most, none under two samples."""
    half = F.floor(total / 2)
    n_in, n_out = F.least(fade_in, half), F.least(fade_out, half)
    ramp = lambda i, n: F.lit(0.5) * (1 - F.cos(F.lit(3.141592653589793) * i / (n - 1)))
    rise = F.when((n_in >= 2) & (pos < n_in), ramp(pos, n_in)).otherwise(1.0)
    fall = F.when((n_out >= 2) & (pos >= total - n_out), ramp(total - 1 - pos, n_out)).otherwise(1.0)
    return rise * fall


#: Blocks that a task adds up at a time before it passes them on.
HELD_BLOCKS = 64


def added_blocks(pieces: DataFrame, size: int) -> DataFrame:
    """``(media_id, chunk_no, x, seen)``: pieces ``(media_id, chunk_no, off, x)`` of blocks of ``size`` samples added up as vectors, and which samples any piece covers.

    Tasks add what they read, then blocks are dealt by (medium, chunk) and added as they stream by: rows of a shuffle are blocks,
    and a block under any number of clips takes the memory of one.
    """
    ship_package(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

        def rows(schema) -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[0] for k in keys], schema.field(0).type), pa.array([k[1] for k in keys], pa.int64()), pa.array([0] * len(keys), pa.int32()), pa.array([x for x, _ in held.values()], pa.list_(pa.float64())), pa.array([seen for _, seen in held.values()], pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        schema = None
        for b in batches:
            schema = b.schema
            for i, (medium, chunk_no, off) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if (medium, chunk_no) not in held:
                    if len(held) >= HELD_BLOCKS:
                        yield rows(schema)
                        held.clear()
                    held[medium, chunk_no] = np.zeros(size), np.zeros(size, dtype=bool)
                total, seen = held[medium, chunk_no]
                part, known = b.column(3)[i].values.fill_null(0.0).to_numpy(zero_copy_only=False), b.column(4)[i].values
                total[off : off + len(part)] += part
                seen[off : off + len(part)] |= True if known is None else known.to_numpy(zero_copy_only=False)
        if held:
            yield rows(schema)

    shaped = pieces.select("media_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("off").cast("int").alias("off"), F.col("x").cast("array<double>").alias("x"), F.lit(None).cast("array<boolean>").alias("seen"))
    some = shaped.mapInArrow(run, shaped.schema)
    return some.repartition("media_id", "chunk_no").sortWithinPartitions("media_id", "chunk_no").mapInArrow(run, shaped.schema).drop("off")


def mix_timeline(clips: DataFrame, durations: DataFrame, rate: int, chunk: int = 4096, tail_ms: int = 300) -> DataFrame:
    """``(media_id, chunk_no, sample_rate, samples, n_sounding)``: clips ``(media_id, start, samples)`` added up on a timeline.

    Clips are cut at the chunks' edges and added up by (medium, chunk) as arrays, so a long medium spreads over tasks.  The timeline
    ends 0.1 s after the last sound, or at the duration if later; the last ``tail_ms`` of sound fade out; a peak over 1 is
    scaled to 1.  ``n_sounding`` counts the samples of a chunk that any clip covers.
    """
    total = F.floor((F.col("duration") + 2) * rate).cast("bigint")
    known = clips.join(durations, "media_id").select("media_id", F.floor(F.col("start") * rate).cast("bigint").alias("at"), total.alias("total"), "samples")
    first, last = F.greatest("at", F.lit(0)), F.least(F.col("at") + F.size("samples"), F.col("total")) - 1
    placed = known.where(last >= first).withColumn("chunk_no", F.explode(F.sequence(F.floor(first / chunk).cast("bigint"), F.floor(last / chunk).cast("bigint"))))
    begin, end = F.greatest(first, F.col("chunk_no") * chunk), F.least(last + 1, (F.col("chunk_no") + 1) * chunk)
    pieces = placed.select("media_id", "chunk_no", (begin - F.col("chunk_no") * chunk).alias("off"), F.slice("samples", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("x"))
    chunks = added_blocks(pieces, chunk).withColumn("x", F.transform("x", lambda v: F.round(v, 6)))
    origin = F.col("chunk_no") * chunk
    sound = F.max(origin + F.array_max(F.transform("x", lambda v, i: F.when(v != 0, i))) + 1)
    ends = durations.join(chunks.groupBy("media_id").agg(sound.alias("sound")), "media_id", "left")
    stop = F.coalesce("sound", F.floor(F.col("duration") * rate).cast("bigint"))
    limits = ends.select("media_id", stop.alias("stop"), F.least(F.greatest(stop + int(0.1 * rate), F.floor(F.col("duration") * rate).cast("bigint")), total).alias("length"))
    tail = F.least(F.lit(int(tail_ms * rate / 1000)), F.floor(F.col("stop") / 2))
    # Only the last chunks of sound fade: elsewhere the arrays stay as they are.
    fading = (origin + chunk > F.col("stop") - tail) & (origin < F.col("stop"))
    faded = F.transform("x", lambda v, i: F.when(origin + i < F.col("stop"), v * fade_gain(origin + i, F.col("stop"), F.lit(0), tail)).otherwise(v))
    size = F.greatest(F.least(F.lit(chunk), F.col("length") - origin), F.lit(0)).cast("int")
    shaped = chunks.join(limits, "media_id").select("media_id", "chunk_no", F.slice(F.when(fading, faded).otherwise(F.col("x")), F.lit(1), size).alias("x"), F.size(F.filter(F.slice("seen", F.lit(1), size), lambda v: v)).alias("n_sounding"))
    peaks = shaped.groupBy("media_id").agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("peak"))
    counted = limits.withColumn("chunk_no", F.explode(F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / chunk).cast("bigint")))))
    whole = counted.join(shaped, ["media_id", "chunk_no"], "left").join(peaks, "media_id", "left")
    scaled = F.transform("x", lambda v: F.round(v / F.greatest("peak", F.lit(1.0)), 6))
    filled = F.coalesce(scaled, F.array_repeat(F.lit(0.0), size)).cast("array<float>")
    return whole.select("media_id", "chunk_no", F.lit(rate).alias("sample_rate"), filled.alias("samples"), F.coalesce("n_sounding", F.lit(0)).alias("n_sounding"))


def peak_scale(pcm: DataFrame) -> DataFrame:
    """``(media_id, peak, scale)``: the largest absolute sample, and what to divide by (1 unless it is over 1)."""
    top = F.array_max(F.transform("samples", lambda x: F.abs(x)))
    return pcm.groupBy("media_id").agg(F.round(F.max(top.cast("double")), 6).alias("peak")).withColumn("scale", F.greatest("peak", F.lit(1.0)))


def tempo_plan(budgets: DataFrame, mode: str = "auto", most: float = 1.5, fixed: float = 1.0, tolerance: float = 0.05, floor: float = 0.82, fill: float = 0.92) -> DataFrame:
    """``tempo`` and ``outcome`` of each clip: sped up past its budget, slowed down when short, or left."""
    ratio = F.round(F.col("actual_dur") / F.col("budget"), 9)
    slow = F.round(F.greatest(ratio / fill, F.lit(floor)), 9)
    plain = F.col("actual_dur") > 0
    if mode == "fixed":
        tempo, outcome = F.lit(fixed), F.lit("sped_up")
    elif mode == "off":
        tempo, outcome = F.lit(1.0), F.lit("ok")
    else:
        over, short = ratio > 1 + tolerance, (ratio < 1 - tolerance) & (slow < 1 - tolerance)
        tempo = F.when(over, F.least(ratio, F.lit(most))).when(short, slow).otherwise(1.0)
        outcome = F.when(over, "sped_up").when(short, "slowed_down").otherwise("ok")
    return budgets.withColumns({"tempo": F.when(plain, tempo).otherwise(1.0), "outcome": F.when(plain, outcome).otherwise("skipped")})


def overflow_plan(plan: DataFrame, slack: float = 2.0) -> DataFrame:
    """``planned, trimmed, overlap, fade_out_ms``: only a last clip more than ``slack`` over is trimmed; others may overlap."""
    planned = F.round(F.col("actual_dur") / F.col("tempo"), 6)
    trimmed = F.col("is_last") & (planned > F.col("budget") + slack)
    overlap = F.when(F.col("is_last"), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), planned - F.col("budget")), 6))
    return plan.withColumns({"planned": F.when(trimmed, F.col("budget")).otherwise(planned), "trimmed": trimmed, "overlap": overlap, "fade_out_ms": F.when(trimmed, 150).when(F.col("is_last"), 200).otherwise(50)})


def tempo_stats(plan: DataFrame) -> DataFrame:
    count = lambda o: F.sum((F.col("outcome") == o).cast("bigint")).alias(f"n_{o}")
    return plan.groupBy("media_id").agg(*[count(o) for o in ("sped_up", "slowed_down", "ok", "skipped")], F.sum(F.col("trimmed").cast("bigint")).alias("n_trimmed"), F.round(F.sum("overlap"), 3).alias("overflow"))


def range_features(pcm: DataFrame, ranges: DataFrame, chunk: int) -> DataFrame:
    """``rms`` and ``zcr`` of ``ranges (media_id, range_no, start, end)``: samples meet ranges through the chunks they cover."""
    rate = pcm.groupBy("media_id").agg(F.first("sample_rate").alias("rate"))
    spans = ranges.join(rate, "media_id").select("media_id", "range_no", F.floor(F.col("start") * F.col("rate")).cast("bigint").alias("lo"), F.floor(F.col("end") * F.col("rate")).cast("bigint").alias("hi")).where("hi > lo")
    spread = spans.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("lo") / chunk).cast("bigint"), F.floor((F.col("hi") - 1) / chunk).cast("bigint"))))
    first, last = F.greatest(F.col("lo") - F.col("chunk_no") * chunk, F.lit(0)).cast("int"), F.least(F.col("hi") - F.col("chunk_no") * chunk, F.size("samples").cast("bigint")).cast("int")
    part = spread.join(pcm, ["media_id", "chunk_no"]).where(last > first).withColumn("x", F.slice("samples", first + 1, last - first))
    sign = F.transform("x", lambda v: F.signum(v))
    inside = F.aggregate(F.zip_with(sign, F.concat(F.slice(sign, 1, 1), F.slice(sign, F.lit(1), F.size(sign) - 1)), lambda a, b: F.when(a != b, 1).otherwise(0)), F.lit(0), lambda a, v: a + v)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    per = part.select("media_id", "range_no", "chunk_no", F.size("x").alias("n"), square.alias("s"), inside.alias("c"), F.element_at(sign, 1).alias("a"), F.element_at(sign, -1).alias("b"))
    w = Window.partitionBy("media_id", "range_no").orderBy("chunk_no")
    edged = per.withColumn("e", F.when(F.lag("b").over(w) != F.col("a"), 1).otherwise(0))
    sums = edged.groupBy("media_id", "range_no").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("c") + F.col("e")).alias("c"))
    return sums.select("media_id", "range_no", F.col("n").alias("n_samples"), F.round(F.sqrt(F.col("s") / F.col("n")), 6).alias("rms"), F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.col("c") / F.col("n"), 9)).alias("zcr"))


def silent_gaps(pcm: DataFrame, cues: DataFrame, chunk: int, least: float = 0.3, threshold_db: float = -40.0) -> DataFrame:
    """``(media_id, seq)`` of cues followed by a pause of ``least`` seconds or more (20 ms of samples at least) under a level."""
    w = Window.partitionBy("media_id").orderBy("seq")
    gaps = cues.select("media_id", F.col("seq").alias("range_no"), F.col("end").alias("start"), F.lead("start").over(w).alias("end")).where(F.round(F.col("end") - F.col("start"), 6) >= least)
    rate = pcm.groupBy("media_id").agg(F.first("sample_rate").alias("rate"))
    quiet = range_features(pcm, gaps, chunk).join(rate, "media_id").where((F.col("rms") < 10 ** (threshold_db / 20)) & (F.col("n_samples") >= F.col("rate") * 0.02))
    return quiet.select("media_id", F.col("range_no").alias("seq"))


def speech_band(gaps: DataFrame, reference: DataFrame, share: float = 0.3, low: float = 0.01, high: float = 0.40) -> DataFrame:
    """Gaps ``(media_id, range_no, rms, zcr)`` that sound like speech beside ``reference (media_id, ref_rms)``; silent references rule a medium out."""
    return gaps.join(reference.where("ref_rms >= 1e-6"), "media_id").where((F.col("rms") > F.col("ref_rms") * share) & (F.col("zcr") > low) & (F.col("zcr") < high))


def recover_gaps(cues: DataFrame, gaps: DataFrame, recovered: DataFrame) -> DataFrame:
    """``cues`` with segments recognised in gaps: ``recovered (media_id, range_no, start, end, text)`` moves by its gap's start."""
    from .phrases import order_merge

    at = gaps.select("media_id", "range_no", F.col("start").alias("__at"))
    moved = recovered.join(at, ["media_id", "range_no"]).withColumns({"start": F.bround(F.col("start") + F.col("__at"), 3), "end": F.bround(F.col("end") + F.col("__at"), 3), "seq": F.col("range_no")})
    return order_merge(cues.select("media_id", "seq", "start", "end", "text"), moved.select("media_id", "seq", "start", "end", "text"), keys=["media_id"])


def validate_transcription(cues: DataFrame, pcm: DataFrame, durations: DataFrame, chunk: int, make: Callable[[], Callable] | None = None, threshold: float = 5.0, share: float = 0.3) -> DataFrame:
    """``(media_id, seq, start, end, text, modified)``: cues with what ``make()`` recognises in the gaps that sound like speech.

    Gaps longer than ``threshold`` are measured beside the medium's reference cue; those with over ``share`` of its level and a speech-like
    rate of sign changes go to the hook, a row ``(media_id, range_no, start, end)`` each, which gives segments on the gap's own clock.
    Media without such gaps, without a reference or with a silent one, and all if there is no hook, keep their cues.
    """
    from .intervals import find_gaps, reference_cue
    from .models import map_recognise

    gaps = find_gaps(cues, durations, threshold).select("media_id", F.col("gap_start").alias("start"), F.col("gap_end").alias("end"))
    gaps = gaps.withColumn("range_no", (F.row_number().over(Window.partitionBy("media_id").orderBy("start")) - 1).cast("bigint"))
    # The reference is one more range of its medium, so that samples are read once.
    measured = gaps.unionByName(reference_cue(cues).select("media_id", "start", "end", F.lit(-1).cast("bigint").alias("range_no")))
    found = range_features(pcm, measured, chunk)
    spoken = speech_band(found.where("range_no >= 0"), found.where("range_no = -1").select("media_id", F.col("rms").alias("ref_rms")), share)
    asked = gaps.join(spoken.select("media_id", "range_no"), ["media_id", "range_no"], "left_semi")
    own = cues.select("media_id", "seq", "start", "end", "text")
    if make is None:
        return own.withColumn("modified", F.lit(False))
    heard = map_recognise(asked.select("media_id", "range_no", "start", "end"), make).select("media_id", "range_no", F.explode("segments").alias("s")).select("media_id", "range_no", "s.start", "s.end", "s.text")
    changed = heard.select("media_id").distinct().withColumn("__m", F.lit(True))
    merged = recover_gaps(own, gaps, heard).join(changed, "media_id", "left")
    return merged.select("media_id", "seq", "start", "end", "text", F.coalesce("__m", F.lit(False)).alias("modified"))


def mix_background(dub: DataFrame, background: DataFrame, volume: float) -> DataFrame:
    """``dub + volume * background`` by chunk; the dub's length holds."""
    other = background.select("media_id", "chunk_no", F.col("samples").alias("__b"))
    n = F.size("samples")
    both = F.zip_with("samples", F.slice(F.coalesce("__b", F.array().cast("array<float>")), F.lit(1), n), lambda a, b: (a + volume * F.coalesce(b, F.lit(0.0))).cast("float"))
    return dub.join(other, ["media_id", "chunk_no"], "left").withColumn("samples", both).select(*dub.columns)


def level_match(dub: DataFrame, source: DataFrame, floor_db: float = -30.0) -> DataFrame:
    """``dub`` scaled to the source's RMS level, which counts as ``floor_db`` at least; silence stays."""
    square = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    level = lambda t, name: t.groupBy("media_id").agg(F.sqrt(F.sum(square) / F.sum(F.size("samples"))).alias(name))
    both = level(dub, "a").join(level(source, "b"), "media_id")
    scale = both.select("media_id", F.when(F.col("a") > 0, F.greatest("b", F.lit(10 ** (floor_db / 20))) / F.col("a")).otherwise(1.0).alias("__k"))
    return dub.join(scale, "media_id", "left").withColumn("samples", F.transform("samples", lambda x: (x * F.coalesce("__k", F.lit(1.0))).cast("float"))).select(*dub.columns)
