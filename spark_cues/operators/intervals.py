"""Gaps, budgets, windows and range joins over ordered cues of a track."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, word_count
from ..runtime import ship_package
from .ranges import WIDTH, with_neighbours

KEY = ("media_id",)


def _ordered(keys=KEY, *order) -> Window:
    return Window.partitionBy(*keys).orderBy(*(order or ("seq",)))


def find_gaps(cues: DataFrame, durations: DataFrame, threshold: float = 5.0, width: int = WIDTH) -> DataFrame:
    """``(media_id, gap_start, gap_end)``: head, inner and tail gaps longer than ``threshold``; all of a medium without cues.

    A long medium is looked at in ranges of ``width`` cue numbers.
    """
    near = with_neighbours(cues.select("media_id", "seq", "start", "end"), list(KEY), "seq", lag=["seq"], lead=["start"], width=width)
    first, after = F.col("before").isNull(), F.col("after.start")
    # A cue goes on only if a gap may be beside it: at the head, within, or at the tail, where the duration decides; a medium's first and last cue do always.
    wide = first | after.isNull() | (after - F.col("end") > threshold)
    marked = near.where(wide).select("media_id", "start", "end", after.alias("next"), first.alias("first"))
    # Media without cues come from the same join, so cues are read for it once.
    known = marked.join(durations, "media_id", "full")
    bare = F.col("first").isNull()
    head = F.struct(F.lit(0.0).alias("a"), F.when(bare, F.col("duration")).otherwise(F.col("start")).alias("b"), (bare | F.col("first")).alias("on"))
    inner = F.struct(F.col("end").alias("a"), F.coalesce("next", "duration").alias("b"), (~bare).alias("on"))
    every = known.select("media_id", F.explode(F.array(head, inner)).alias("g")).where("g.on").select("media_id", F.col("g.a").alias("gap_start"), F.col("g.b").alias("gap_end"))
    return every.where(F.col("gap_end") - F.col("gap_start") > threshold)


def tempo_budget(clips: DataFrame, durations: DataFrame, gap: float = 0.05) -> DataFrame:
    """Seconds each clip with audio may take: up to the next clip's start less ``gap``, or the medium's end; its own length at least."""
    w = _ordered(KEY, "start", "seq")
    voiced = clips.where(F.col("actual_dur").isNotNull()).withColumn("__next", F.lead("start").over(w)).join(durations, "media_id", "left")
    room = F.when(F.col("__next").isNotNull(), F.col("__next") - F.col("start") - gap).otherwise(F.col("duration") - F.col("start"))
    return voiced.withColumns({"budget": F.greatest(room, F.col("target_dur")), "is_last": F.col("__next").isNull()}).drop("__next")


def reference_cue(cues: DataFrame, least: float = 0.5, most: float = 10.0, chars: int = 5) -> DataFrame:
    """The cue nearest the middle of each timeline, among those of fit length if any; the first on ties."""
    total = Window.partitionBy("media_id")
    length = F.col("end") - F.col("start")
    middle = (F.min(F.struct("seq", "start")).over(total)["start"] + F.max(F.struct("seq", "end")).over(total)["end"]) / 2
    fit = (length >= least) & (length <= most) & (F.length(strip(F.col("text"))) > chars)
    ranked = cues.withColumn("__far", F.round(F.abs((F.col("start") + F.col("end")) / 2 - middle), 6)).withColumn("__fit", fit)
    best = ranked.groupBy("media_id").agg(F.min_by(F.struct("seq", "start", "end", "text"), F.struct((~F.col("__fit")).alias("bad"), "__far", "seq")).alias("x"))
    return best.select("media_id", "x.*")


def best_clone_window(cues: DataFrame, least: float = 20.0, most: float = 60.0, words: int = 20, width: int = WIDTH) -> DataFrame:
    """``(media_id, i, j, n_words)``: the run of cues spanning ``least`` to ``most`` seconds with most words; earliest on ties.

    From a first cue the run grows until its span first exceeds ``most``.  Cues stream by in order past the queue of first cues
    whose runs are still open, so no pairs are made.  A long medium whose times never go back is cut in ranges of ``width`` cue
    numbers, each with the next one's first cues lent to it; others stay in one piece, as a stream.
    """
    ship_package(cues.sparkSession)
    counted = cues.select("media_id", "seq", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), word_count(F.col("text")).cast("bigint").alias("n"))
    near = with_neighbours(counted, list(KEY), "seq", lag=["start", "end"], width=width)
    back = F.coalesce((F.col("start") < F.col("before.start")) | (F.col("end") < F.col("before.end")), F.lit(False))
    rows = near.withColumn("back", back).drop("before", "after")
    ranges = rows.groupBy("media_id", "__b").agg(F.min("start").alias("lo"), F.max("start").alias("hi"), F.bool_or("back").alias("back"))
    w = Window.partitionBy("media_id").orderBy("__b")
    # A range must span a run at least, so that none reaches past the next range.
    beside = ranges.withColumns({"left": F.lag("hi").over(w), "inner": F.lead("__b").over(w).isNotNull()}).withColumn("bad", F.col("back") | (F.col("inner") & (F.col("hi") - F.col("lo") < most)))
    whole = beside.withColumn("one", F.max("bad").over(Window.partitionBy("media_id"))).select(F.col("media_id").alias("m"), F.col("__b").alias("b"), F.lag("__b").over(w).alias("prev"), "left", "one")
    known = rows.join(whole, (F.col("media_id") == F.col("m")) & (F.col("__b") == F.col("b")))
    own = F.struct(F.when(F.col("one"), 0).otherwise(F.col("b")).alias("part"), F.lit(False).alias("lent"))
    lent = F.when(~F.col("one") & (F.col("end") <= F.col("left") + most), F.struct(F.col("prev").alias("part"), F.lit(True).alias("lent")))
    dealt = known.withColumn("p", F.explode(F.array_compact(F.array(own, lent)))).select("media_id", F.col("p.part").cast("bigint").alias("part"), F.col("p.lent").alias("lent"), "seq", "start", "end", "n")
    runs = dealt.repartition("media_id", "part").sortWithinPartitions("media_id", "part", "seq").mapInPandas(_best_runs(least, most), "media_id bigint, i bigint, j bigint, n_words bigint")
    best = runs.groupBy("media_id").agg(F.min_by(F.struct("i", "j", "n_words"), F.struct(-F.col("n_words"), "i", "j")).alias("x")).select("media_id", "x.*").where(F.col("n_words") >= words)
    span = cues.groupBy("media_id").agg((F.max_by("end", "seq") - F.min_by("start", "seq")).alias("span")).where(F.col("span") >= least)
    return best.join(span.select("media_id"), "media_id", "left_semi")


def _best_runs(least: float, most: float):
    """The best run of each part.  Open first cues stand in a queue by number, and in a heap by start, from which an end beyond their span takes them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, queue, starts, gone, total, best = None, deque(), [], set(), 0, None
        for batch in batches:
            out = []
            for medium, part, lent, seq, start, end, n in zip(*(batch[c].tolist() for c in ("media_id", "part", "lent", "seq", "start", "end", "n")), strict=True):
                if (medium, part) != at:
                    if best:
                        out.append((at[0], best[1], best[2], -best[0]))
                    at, queue, starts, gone, total, best = (medium, part), deque(), [], set(), 0, None
                if not lent:
                    queue.append((seq, start, total))
                    heapq.heappush(starts, (start, seq))
                total += n
                while starts and round(end - starts[0][0], 6) > most:
                    gone.add(heapq.heappop(starts)[1])
                while queue and queue[0][0] in gone:
                    gone.discard(queue.popleft()[0])
                # Words only grow with the run, so the first open cue that is early enough has the most.
                first = next((q for q in queue if q[0] not in gone and round(end - q[1], 6) >= least), None)
                if first:
                    found = (first[2] - total, first[0], seq)
                    best = found if best is None or found < best else best
            yield pd.DataFrame(out, columns=["media_id", "i", "j", "n_words"])
        if best:
            yield pd.DataFrame([(at[0], best[1], best[2], -best[0])], columns=["media_id", "i", "j", "n_words"])

    return run


def thumbs_for_range(ranges: DataFrame, thumbs: DataFrame, width: float = 300.0) -> DataFrame:
    """Thumbnails within ``[range_start, range_end]``, ends included; ranges meet thumbnails in buckets of ``width`` seconds."""
    low, high = F.floor(F.col("range_start") / width), F.floor(F.col("range_end") / width)
    spread = ranges.where("range_end >= range_start").withColumn("__b", F.explode(F.sequence(low, high)))
    placed = thumbs.withColumn("__b", F.floor(F.col("seconds") / width))
    return spread.join(placed, ["media_id", "__b"]).where(F.col("seconds").between(F.col("range_start"), F.col("range_end"))).drop("__b")


def cues_in_windows(cues: DataFrame, size: float = 330.0, step: float = 300.0) -> DataFrame:
    """Each cue with the windows it overlaps: ``end > window_start`` and ``start < window_end``; windows start before the last end."""
    last = cues.groupBy("media_id").agg(F.max("end").alias("__last"))
    low = F.greatest(F.floor((F.col("start") - size) / step), F.lit(0)).cast("bigint")
    spread = cues.join(last, "media_id").withColumn("window_no", F.explode(F.sequence(low, F.greatest(low, F.floor(F.col("end") / step).cast("bigint")))))
    at = F.col("window_no") * step
    return spread.where((F.col("end") > at) & (F.col("start") < at + size) & (at < F.col("__last"))).drop("__last")


def batch_with_context(cues: DataFrame, n: int = 24, overlap: int = 8, keys=KEY) -> DataFrame:
    """Cues with ``batch_id`` and ``role`` (before, main, after): ``overlap // 2`` neighbours belong to the next batches as context."""
    if overlap // 2 > n:
        raise ValueError("half the overlap can't exceed the batch")
    h, p = overlap // 2, F.col("__p")
    total = F.count("*").over(Window.partitionBy(*keys))
    placed = cues.withColumn("__p", F.row_number().over(_ordered(keys)) - 1).withColumn("__n", total)
    b = F.floor(p / n).cast("int")
    one = lambda i, role, on: F.when(on, F.struct(i.alias("batch_id"), F.lit(role).alias("role")))
    roles = F.array(one(b, "main", F.lit(True)), one(b + 1, "before", (p % n >= n - h) & ((b + 1) * n < F.col("__n"))), one(b - 1, "after", (p % n < h) & (p >= n)))
    return placed.withColumn("__r", F.explode(F.array_compact(roles))).select(*cues.columns, "__r.*")


def pad_speech_clips(clips: DataFrame, durations: DataFrame, guard: float = 1.0) -> DataFrame:
    """``(media_id, start, end)`` with a head clip when speech starts over ``guard`` in, a tail clip likewise; all when there is none."""
    ends = clips.groupBy("media_id").agg(F.min("start").alias("a"), F.max("end").alias("b")).join(durations, "media_id")
    head = ends.where(F.col("a") > guard).select("media_id", F.lit(0.0).alias("start"), F.col("a").alias("end"))
    tail = ends.where(F.col("duration") - F.col("b") > guard).select("media_id", F.col("b").alias("start"), F.col("duration").alias("end"))
    whole = durations.join(clips.select("media_id"), "media_id", "left_anti").select("media_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"))
    return clips.select("media_id", "start", "end").unionByName(head).unionByName(tail).unionByName(whole)


def slice_timeline(rows: DataFrame, start: float, end: float) -> DataFrame:
    """Rows that overlap ``[start, end)``, cut to it and set to begin at 0."""
    if end <= start:
        raise ValueError("end must be after start")
    kept = rows.where((F.col("end") > start) & (F.col("start") < end))
    return kept.withColumns({"start": F.greatest(F.col("start"), F.lit(start)) - start, "end": F.least(F.col("end"), F.lit(end)) - start})


def timed_pieces(pieces: DataFrame, keys: list[str], weight: Column, total: Column | None = None, least: float = 0.0, force_last: bool = True) -> DataFrame:
    """``piece_start`` and ``piece_end`` of each piece of a parent ``[start, end]``, in order of ``piece_no``.

    A piece gets its share of the parent's seconds by ``weight`` of ``total`` (default: all pieces' weight), ``least`` seconds at
    any rate; none passes the parent's end, and the last ends there if ``force_last``.
    """
    every, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("piece_no")
    share = F.greatest(F.lit(least), (F.col("end") - F.col("start")) * weight / (F.sum(weight).over(every) if total is None else total))
    timed = pieces.withColumn("__d", share).withColumn("__to", F.col("start") + F.sum("__d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__last", F.lead("piece_no").over(order).isNull())
    stop = F.least(F.col("__to"), F.col("end"))
    begin = F.least(F.col("__to") - F.col("__d"), F.col("end"))
    return timed.withColumns({"piece_start": begin, "piece_end": F.when(F.col("__last") & F.lit(force_last), F.col("end")).otherwise(stop)}).drop("__d", "__to", "__last")
