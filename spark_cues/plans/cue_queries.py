"""Queries over cues: merges, gaps, windows, budgets, batches, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.dimensions import LANGUAGES, values_sql
from ..functions.dimensions import languages as language_table
from ..operators import documents, folds, intervals, phrases, reconcile, rollups, selection
from ..sources import srt
from . import fixtures as fx
from . import fold_sql
from .registry import query

R3 = lambda *names: {n: F.round(n, 3) for n in names}
_STRIP = "trim(text, ' ' || chr(10) || chr(9) || chr(13))"
_PHRASES = f"""marked as (select *, {_STRIP} as t, lag({_STRIP}) over w as pt, lag("end") over w as pe from cues window w as (partition by media_id, track order by seq)),
flagged as (select *, case when pt is null or regexp_matches(pt, '[.!?…؟。！？]\\s*$') or round(start - pe, 6) > 2.0 then 1 else 0 end as b from marked),
grouped as (select *, sum(b) over (partition by media_id, track order by seq rows unbounded preceding) as g from flagged)"""


@query(
    "media_report",
    f"""with {fx.CUES_SQL}, {_PHRASES}
    select media_id, track, count(*) as n_cues, cast(max(g) as bigint) as n_phrases, max(round(greatest(coalesce(start - pe, 0.0), 0.0), 3)) as longest_pause,
      round(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) / round(sum("end" - start), 3), 6) as words_per_second from grouped group by media_id, track""",
)
def media_report(spark, sf):
    return phrases.media_report(fx.cues(spark, sf))


@query(
    "w02_merge_phrases",
    f"""with {fx.CUES_SQL}, {_PHRASES}
    select media_id, cast(g as bigint) as phrase_no, min(seq) as first_seq, count(*) as n_cues, round(arg_min(start, seq), 3) as start, round(arg_max("end", seq), 3) as "end", trim(string_agg(t, ' ' order by seq)) as text
    from grouped group by media_id, track, g""",
)
def merge_phrases(spark, sf):
    return phrases.merge_phrases(fx.cues(spark, sf)).drop("track").withColumns(R3("start", "end"))


@query(
    "w01_find_gaps",
    f"""with {fx.CUES_SQL}, {fx.DURATIONS_SQL}, every as (
      select media_id, 0.0 as gap_start, start as gap_end from cues where seq = 0
      union all select media_id, "end", coalesce(lead(start) over (partition by media_id order by seq), duration) from cues join durations using (media_id))
    select media_id, round(gap_start, 3) as gap_start, round(gap_end, 3) as gap_end from every where gap_end - gap_start > 5.0""",
)
def find_gaps(spark, sf):
    return intervals.find_gaps(fx.cues(spark, sf), fx.durations(spark, sf)).withColumns(R3("gap_start", "gap_end"))


@query(
    "w06_tempo_budget",
    f"""with {fx.TTS_SQL}, {fx.DURATIONS_SQL}, n as (select *, lead(start) over (partition by media_id order by start, seq) as nxt from tts_segments where actual_dur is not null)
    select media_id, seq, round(greatest(case when nxt is not null then nxt - start - 0.05 else duration - start end, target_dur), 3) as budget, nxt is null as is_last from n join durations using (media_id)""",
)
def tempo_budget(spark, sf):
    return intervals.tempo_budget(fx.tts_segments(spark, sf), fx.durations(spark, sf)).select("media_id", "seq", F.round("budget", 3).alias("budget"), "is_last")


@query(
    "w07_reference_cue",
    f"""with {fx.CUES_SQL}, c as (select *, (arg_min(start, seq) over (partition by media_id) + arg_max("end", seq) over (partition by media_id)) / 2 as mid from cues),
    r as (select *, row_number() over (partition by media_id order by case when "end" - start between 0.5 and 10.0 and length({_STRIP}) > 5 then 0 else 1 end, round(abs((start + "end") / 2 - mid), 6), seq) as k from c)
    select media_id, seq, round(start, 3) as start, round("end", 3) as "end", text from r where k = 1""",
)
def reference_cue(spark, sf):
    return intervals.reference_cue(fx.cues(spark, sf)).withColumns(R3("start", "end"))


@query(
    "w08_best_clone_window",
    f"""with {fx.CUES_SQL}, n as (select media_id, seq, start, "end" as e, sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) over (partition by media_id order by seq rows unbounded preceding) as total, len(list_filter(string_split(text, ' '), lambda x: x <> '')) as w from cues),
    p as (select a.media_id, a.seq as i, b.seq as j, cast(b.total - a.total + a.w as bigint) as n_words from n a join n b on a.media_id = b.media_id and b.seq >= a.seq and round(b.e - a.start, 6) between 20 and 60),
    k as (select *, row_number() over (partition by media_id order by n_words desc, i, j) as r from p),
    s as (select media_id from cues group by media_id having arg_max("end", seq) - arg_min(start, seq) >= 20)
    select media_id, i, j, n_words from k where r = 1 and n_words >= 20 and media_id in (from s)""",
)
def best_clone_window(spark, sf):
    return intervals.best_clone_window(fx.cues(spark, sf))


_BATCH = f"""{fx.CUES_SQL}, placed as (select *, seq // 24 as b, seq % 24 as r, count(*) over (partition by media_id) as n from cues),
batches as (select media_id, seq, start, "end", cast(b as integer) as batch_id, 'main' as role from placed
  union all select media_id, seq, start, "end", cast(b + 1 as integer), 'before' from placed where r >= 20 and (b + 1) * 24 < n
  union all select media_id, seq, start, "end", cast(b - 1 as integer), 'after' from placed where r < 4 and seq >= 24)"""


@query("w05_batch_with_context", f"with {_BATCH} select media_id, seq, batch_id, role from batches")
def batch_with_context(spark, sf):
    return intervals.batch_with_context(fx.cues(spark, sf)).select("media_id", "seq", "batch_id", "role")


@query(
    "j01_thumbs_for_range",
    f"""with {_BATCH}, {fx.THUMBS_SQL}, ranges as (select media_id, batch_id, min(start) as a, max("end") as z from batches group by media_id, batch_id)
    select r.media_id, r.batch_id, t.i, round(t.seconds, 3) as seconds from ranges r join thumbs t on r.media_id = t.media_id and t.seconds between r.a and r.z""",
)
def thumbs_for_range(spark, sf):
    ranges = intervals.batch_with_context(fx.cues(spark, sf)).groupBy("media_id", "batch_id").agg(F.min("start").alias("range_start"), F.max("end").alias("range_end"))
    return intervals.thumbs_for_range(ranges, fx.thumbs(spark, sf)).select("media_id", "batch_id", "i", F.round("seconds", 3).alias("seconds"))


@query(
    "j02_cues_in_windows",
    f"""with {fx.CUES_SQL}, last as (select media_id, max("end") as z from cues group by media_id),
    w as (select media_id, z, unnest(range(0, cast(ceil(z / 300) as bigint))) as window_no from last)
    select c.media_id, c.seq, window_no from cues c join w on c.media_id = w.media_id and c."end" > window_no * 300 and c.start < window_no * 300 + 330""",
)
def cues_in_windows(spark, sf):
    return intervals.cues_in_windows(fx.cues(spark, sf)).select("media_id", "seq", "window_no")


@query(
    "w12_pad_speech_clips",
    f"""with {fx.CUES_SQL}, {fx.DURATIONS_SQL}, clips as (select media_id, start, "end" as e from cues where seq % 3 = 1), ends as (select media_id, min(start) as a, max(e) as b, any_value(duration) as d from clips join durations using (media_id) group by media_id)
    select media_id, round(start, 3) as start, round("end", 3) as "end" from (select media_id, start, e as "end" from clips union all select media_id, 0.0, a from ends where a > 1 union all select media_id, b, d from ends where d - b > 1
    union all select media_id, 0.0, duration from durations where media_id not in (select media_id from clips))""",
)
def pad_speech_clips(spark, sf):
    clips = fx.cues(spark, sf).where("seq % 3 = 1").select("media_id", "start", "end")
    return intervals.pad_speech_clips(clips, fx.durations(spark, sf)).withColumns(R3("start", "end"))


@query(
    "a12_slice_timeline",
    f"""with {fx.CUES_SQL} select media_id, seq, round(greatest(start, 30.0) - 30.0, 3) as start, round(least("end", 90.0) - 30.0, 3) as "end" from cues where "end" > 30.0 and start < 90.0""",
)
def slice_timeline(spark, sf):
    return intervals.slice_timeline(fx.cues(spark, sf), 30.0, 90.0).select("media_id", "seq", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


_GROUPS = f"""{fx.CUES_SQL}, placed as (select *, seq // 40 as batch_id, cast(seq % 40 + 1 as integer) as number from cues),
sizes as (select media_id, batch_id, count(*) as total from placed group by media_id, batch_id),
members as (select media_id, batch_id, (number - 1) // (1 + batch_id % 4) as group_no, number from placed where not (batch_id % 6 = 5 and number = 2)),
merge_groups as (select media_id, batch_id, group_no, list(case when batch_id % 7 = 6 then 1 else number end order by number) as members from members group by media_id, batch_id, group_no)"""


def _groups(spark, sf):
    placed = fx.cues(spark, sf).withColumn("batch_id", F.floor(F.col("seq") / 40)).withColumn("number", (F.col("seq") % 40 + 1).cast("int"))
    kept = placed.where("not (batch_id % 6 = 5 and number = 2)").withColumn("group_no", F.floor((F.col("number") - 1) / (1 + F.col("batch_id") % 4)))
    value = F.when(F.col("batch_id") % 7 == 6, 1).otherwise(F.col("number"))
    groups = kept.groupBy("media_id", "track", "batch_id", "group_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", value.alias("v")))), lambda x: x["v"]).alias("members"))
    return placed, groups, placed.groupBy("media_id", "track", "batch_id").agg(F.count("*").alias("total"))


_FAULTS = f"""{_GROUPS}, one as (select *, len(members) as n, list_min(members) as low, list_max(members) as high, len(list_distinct(members)) as d from merge_groups),
rising as (select *, lag(high) over (partition by media_id, batch_id order by group_no) as ph from one),
per as (select media_id, batch_id, bool_and(n between 1 and 8 and d = n and high - low + 1 = n and (ph is null or ph < low)) as ok, sum(n) as covered, min(low) as low, max(high) as high from rising group by media_id, batch_id),
faults as (select media_id, batch_id, ok and low >= 1 and high <= total and covered = total as valid, ok and low >= 1 and high <= total as repairable from per join sizes using (media_id, batch_id))"""


@query("p10_merge_group_faults", f"with {_FAULTS} select * from faults")
def merge_group_faults(spark, sf):
    _, groups, sizes = _groups(spark, sf)
    return phrases.group_faults(groups, sizes, ["media_id", "track", "batch_id"]).drop("track")


@query(
    "w04_fix_merge_groups",
    f"""with {_FAULTS}, member as (select media_id, batch_id, list_min(members) as first, unnest(members) as number from merge_groups)
    select p.media_id, p.batch_id, p.number, cast(coalesce(m.first, p.number) as bigint) as group_key from placed p join faults f on p.media_id = f.media_id and p.batch_id = f.batch_id and f.repairable
    left join member m on p.media_id = m.media_id and p.batch_id = m.batch_id and p.number = m.number""",
)
def fix_merge_groups(spark, sf):
    _, groups, sizes = _groups(spark, sf)
    return phrases.fix_groups(groups, sizes, ["media_id", "track", "batch_id"]).drop("track")


@query(
    "w03_merge_by_groups",
    f"""with {_FAULTS}, member as (select media_id, batch_id, list_min(members) as first, unnest(members) as number from merge_groups),
    fixed as (select p.*, {_STRIP} as t, case when f.repairable then coalesce(m.first, p.number) end as k from placed p left join faults f on p.media_id = f.media_id and p.batch_id = f.batch_id
      left join member m on f.repairable and p.media_id = m.media_id and p.batch_id = m.batch_id and p.number = m.number),
    r as (select *, lag(t) over w as pt, lag("end") over w as pe from fixed window w as (partition by media_id, batch_id order by seq)),
    g as (select *, case when k is null then 100000 + sum(case when pt is null or regexp_matches(pt, '[.!?…؟。！？]\\s*$') or round(start - pe, 6) > 2.0 then 1 else 0 end) over (partition by media_id, batch_id order by seq rows unbounded preceding) else k end as gk from r),
    i as (select *, lag("end") over (partition by media_id, batch_id, gk order by seq) as ge from g),
    c as (select *, sum(case when k is not null and ge is not null and round(start - ge, 6) > 1.5 then 1 else 0 end) over (partition by media_id, batch_id, gk order by seq rows unbounded preceding) as part from i)
    select media_id, batch_id, min(seq) as first_seq, count(*) as n_cues, round(arg_min(start, seq), 3) as start, round(arg_max("end", seq), 3) as "end", trim(string_agg(t, ' ' order by seq)) as text from c group by media_id, batch_id, gk, part""",
)
def merge_by_groups(spark, sf):
    placed, groups, _ = _groups(spark, sf)
    return phrases.merge_by_groups(placed.drop("batch_id", "number"), groups).drop("track").withColumns(R3("start", "end"))


_RATES = f"rates as (select d.media_id, d.lang, coalesce(l.rate, 3.0) as rate from (select distinct media_id, lang from cues) d left join (values {values_sql([(n, c, r) for n, c, r in LANGUAGES])}) l(name, code, rate) on d.lang = l.code)"
_WORDS = "len(list_filter(string_split(text, ' '), lambda x: x <> ''))"
_WPS = f"""wps as (select media_id, case when s < 1.0 or n < 5 then rate else least(n / s, rate) end as wps from (select media_id, sum({_WORDS}) as n, round(sum("end" - start), 3) as s from cues group by media_id) join rates using (media_id))"""


def _rates(spark, cues):
    return cues.select("media_id", F.col("lang").alias("code")).distinct().join(F.broadcast(language_table(spark)), "code", "left").select("media_id", F.coalesce("rate", F.lit(3.0)).alias("rate"))


@query("g01_estimate_wps", f"with {fx.CUES_SQL}, {_RATES}, {_WPS} select media_id, round(wps, 6) as wps from wps")
def estimate_wps(spark, sf):
    cues = fx.cues(spark, sf)
    return rollups.estimate_wps(cues, _rates(spark, cues)).withColumn("wps", F.round("wps", 6))


@query("p05_word_budget", f"""with {fx.CUES_SQL} select media_id, seq, cast(greatest(4, round_even(("end" - start) * 3.0 * 0.85, 0)) as integer) as target from cues""")
def word_budget(spark, sf):
    return fx.cues(spark, sf).select("media_id", "seq", X.word_budget(F.col("end") - F.col("start"), F.lit(3.0)).alias("target"))


@query(
    "p06_budget_violations",
    f"""with {fx.CUES_SQL}, {_RATES}, {_WPS}, t as (select media_id, seq, cast(greatest(4, round_even(("end" - start) * wps * 0.85, 0)) as integer) as target, {_WORDS} * (1 + seq % 3) as actual from cues join wps using (media_id))
    select media_id, seq, target, cast(actual as integer) as actual, cast(actual - target as integer) as excess from t where actual > target * 1.5""",
)
def budget_violations(spark, sf):
    cues = fx.cues(spark, sf)
    longer = cues.withColumn("text", F.array_join(F.array_repeat("text", (F.col("seq") % 3 + 1).cast("int")), " "))
    return rollups.budget_violations(cues, longer, rollups.estimate_wps(cues, _rates(spark, cues)), ["media_id", "seq"]).select("media_id", "seq", "target", "actual", "excess")


@query(
    "p07_oversize",
    f"""with {fx.LONG_CUES_SQL} select media_id, seq, length(trim(text)) > 84 or round("end" - start, 6) > 5.0 as asr, length(text) > 300 as caption, length(replace(text, chr(10), ' ')) > 120 as display from long_cues""",
)
def oversize(spark, sf):
    return rollups.oversize(fx.long_cues(spark, sf)).select("media_id", "seq", "asr", "caption", "display")


_MEDIAN = """list_sort(list(round("end" - start, 3)))[len(list(seq)) // 2 + 1]"""


@query(
    "g04_segment_mode",
    f"""with {fx.CUES_SQL}, m as (select media_id, {_MEDIAN} as d from cues group by media_id)
    select doc_id as media_id, coalesce(d, 5.0) as median_dur, case when coalesce(d, 5.0) < 3.0 then 'long' else 'short' end as mode from documents left join m on doc_id = m.media_id""",
)
def segment_mode(spark, sf):
    return rollups.segment_mode(fx.table(spark, sf, "documents").select(F.col("doc_id").alias("media_id")), fx.cues(spark, sf))


@query("g05_chunk_stats", f"""with {fx.CUES_SQL} select media_id, min(round("end" - start, 3)) as min_dur, max(round("end" - start, 3)) as max_dur, {_MEDIAN} as median_dur, count(*) filter (round("end" - start, 3) > 1.1 * 3.0) as n_over from cues group by media_id""")
def chunk_stats(spark, sf):
    return rollups.chunk_stats(fx.cues(spark, sf), 3.0)


@query("g08_media_extent", f"""with {fx.CUES_SQL} select media_id, round(max("end"), 3) as last_end, round(arg_max("end", seq) - arg_min(start, seq), 3) as span from cues group by media_id""")
def media_extent(spark, sf):
    return rollups.media_extent(fx.cues(spark, sf)).withColumns(R3("last_end", "span"))


@query(
    "f01_merge_long",
    f"""with recursive {fx.CUES_SQL}, n as (select media_id, seq, start, "end" as e, right({_STRIP}, 1) in ('.', '!', '?', '…', '؟', '。', '！', '？') or coalesce(round(lead(start) over (partition by media_id order by seq) - "end", 6) >= 0.3, false) as closes from cues),
    f(media_id, seq, begun, number, chunk_no) as (
      select media_id, seq, case when round(e - start, 6) >= 8.0 and closes then null else start end, 0, 0 from n where seq = 0
      union all
      select n.media_id, n.seq, case when round(n.e - b, 6) >= 8.0 and n.closes then null else b end, c, c from (
        select n.media_id, n.seq, n.e, n.closes, case when f.begun is null or round(n.e - f.begun, 6) > 30.0 then n.start else f.begun end as b, case when f.begun is null or round(n.e - f.begun, 6) > 30.0 then f.number + 1 else f.number end as c
        from f join n on n.media_id = f.media_id and n.seq = f.seq + 1) n)
    select f.media_id, cast(chunk_no as bigint) as chunk_no, count(*) as n_cues, round(arg_min(start, c.seq), 3) as start, round(arg_max("end", c.seq), 3) as "end", string_agg({_STRIP}, ' ' order by c.seq) as text from f join cues c on c.media_id = f.media_id and c.seq = f.seq group by f.media_id, chunk_no""",
)
def merge_long(spark, sf):
    return folds.merge_long(fx.cues(spark, sf)).drop("track").withColumns(R3("start", "end"))


@query(
    "f02_dedup_min_gap",
    f"""with recursive {fx.CUES_SQL}, {fx.THUMBS_SQL}, o as (select *, row_number() over (partition by media_id order by seconds, i) as k from thumbs),
    f(media_id, k, i, seconds, last, keep) as (select media_id, k, i, seconds, seconds, true from o where k = 1
      union all select o.media_id, o.k, o.i, o.seconds, case when o.seconds - f.last >= 5.0 then o.seconds else f.last end, o.seconds - f.last >= 5.0 from f join o on o.media_id = f.media_id and o.k = f.k + 1)
    select media_id, i, seconds from f where keep""",
)
def dedup_min_gap(spark, sf):
    return folds.dedup_min_gap(fx.thumbs(spark, sf))


@query(
    "f04_pack_words",
    f"""with {fx.LONG_CUES_SQL} select media_id, seq, cast(unnest(range(0, len(p))) as integer) as piece_no, unnest(p) as piece from (select media_id, seq, {fold_sql.pack(fold_sql.words('text'), 84)} as p from long_cues)""",
)
def pack_words(spark, sf):
    return fx.long_cues(spark, sf).select("media_id", "seq", F.posexplode(folds.pack_words(F.col("text"), 84)).alias("piece_no", "piece"))


@query(
    "f05_pack_sentences",
    f"""with {fx.LONG_CUES_SQL} select media_id, seq, cast(unnest(range(0, len(p))) as integer) as piece_no, unnest(p) as piece from (select media_id, seq, {fold_sql.pack_sentences('text', 300)} as p from long_cues)""",
)
def pack_sentences(spark, sf):
    return fx.long_cues(spark, sf).select("media_id", "seq", F.posexplode(folds.pack_sentences(F.col("text"), 300)).alias("piece_no", "piece"))


@query(
    "f06_pack_display",
    f"""with {fx.LONG_CUES_SQL} select media_id, seq, cast(unnest(range(0, len(p))) as integer) as piece_no, unnest(p) as piece from (select media_id, seq, {fold_sql.pack_display('text', 120)} as p from long_cues)""",
)
def pack_display(spark, sf):
    return fx.long_cues(spark, sf).select("media_id", "seq", F.posexplode(folds.pack_display(F.col("text"), 120)).alias("piece_no", "piece"))


@query(
    "f10_split_for_display",
    f"""with {fx.LONG_CUES_SQL}, flat as (select media_id, seq, start, "end" as e, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as f from long_cues),
    cut as (select media_id, seq, start, e, case when length(f) > 120 then {fold_sql.pack_display('f', 120)} else [text] end as p from flat),
    parts as (select media_id, seq, start, e, list_sum(list_transform(p, lambda x: length(x))) as total, unnest(p) as piece, unnest(range(0, len(p))) as piece_no from cut),
    timed as (select *, greatest(0.5, (e - start) * length(piece) / total) as d, start + sum(greatest(0.5, (e - start) * length(piece) / total)) over (partition by media_id, seq order by piece_no rows unbounded preceding) as upto from parts)
    select media_id, seq, cast(piece_no as integer) as piece_no, piece, round(least(upto - d, e) + {fold_sql.CLEAR}, 3) as start, round(least(upto, e) + {fold_sql.CLEAR}, 3) as "end" from timed""",
)
def split_for_display(spark, sf):
    return folds.split_for_display(fx.long_cues(spark, sf), ["media_id", "seq"]).select("media_id", "seq", "piece_no", "piece", F.round(F.col("piece_start") + fold_sql.CLEAR, 3).alias("start"), F.round(F.col("piece_end") + fold_sql.CLEAR, 3).alias("end"))


@query(
    "f09_resegment_captions",
    f"""with {fx.CUES_SQL}, {_PHRASES}, merged as (select media_id, cast(g as bigint) as phrase_no, arg_min(start, seq) as start, arg_max("end", seq) as e, trim(string_agg(t, ' ' order by seq)) as text from grouped group by media_id, g),
    long as (select media_id, phrase_no, start, e, case when length(text) <= 300 then [text] else {fold_sql.pack_sentences('text', 300)} end as pieces from merged), {fold_sql.distributed('long', 'media_id, phrase_no')}
    select media_id, phrase_no, piece_no, piece, start, "end" from timed""",
)
def resegment_captions(spark, sf):
    merged = phrases.merge_phrases(fx.cues(spark, sf))
    return folds.resegment_captions(merged, ["media_id", "phrase_no"], 300).select("media_id", "phrase_no", "piece_no", "piece", F.round("piece_start", 3).alias("start"), F.round("piece_end", 3).alias("end"))


@query(
    "f07_distribute_words",
    f"""with {fx.LONG_CUES_SQL}, long as (select media_id, seq, start, "end" as e, {fold_sql.pack_sentences('text', 100)} as pieces from long_cues), {fold_sql.distributed('long', 'media_id, seq', clear=fold_sql.CLEAR)}
    select media_id, seq, piece_no, start, "end" from timed""",
)
def distribute_words(spark, sf):
    parents = fx.long_cues(spark, sf).select("media_id", "seq", "start", "end", folds.pack_sentences(F.col("text"), 100).alias("pieces"))
    return folds.distribute_words(parents).select("media_id", "seq", "piece_no", F.round(F.col("piece_start") + fold_sql.CLEAR, 3).alias("start"), F.round(F.col("piece_end") + fold_sql.CLEAR, 3).alias("end"))


def _segments(spark, sf):
    """Long cues with words timed evenly; every fourth word ends 120 ms early; every fifth segment has no word times."""

    def timed(v):
        at = lambda i: (F.col("start_ms") + F.floor(i * (F.col("end_ms") - F.col("start_ms")) / F.size(v["w"]))) / 1000.0
        early = lambda i: F.when(F.pmod(F.col("seq") + i, F.lit(4)) == 0, 0.12).otherwise(0.0)
        known = F.col("seq") % 5 != 4
        return F.transform(v["w"], lambda x, i: F.struct(x.alias("word"), F.when(known, at(i)).alias("start"), F.when(known, at(i + 1) - early(i)).alias("end")))

    said = F.transform(F.array(F.struct(X.words(F.col("text")).alias("w"))), timed)[0]
    return fx.long_cues(spark, sf).select("media_id", "seq", "start", "end", "text", said.alias("words"))


_SEGMENTS = f"""{fx.LONG_CUES_SQL}, segs as (select media_id, seq, start, "end" as e, text, w, list_transform(range(1, len(w) + 1), lambda i: {{'word': w[i], 'a': cast((start_ms + floor((i - 1) * (end_ms - start_ms) / len(w))) / 1000.0 as double),
  'z': cast((start_ms + floor(i * (end_ms - start_ms) / len(w))) / 1000.0 as double) - case when (seq + i - 1) % 4 = 0 then cast(0.12 as double) else cast(0.0 as double) end}}) as said from (select *, {fold_sql.words('text')} as w from long_cues))"""
_CHUNKS = "select media_id, seq, cast(piece_no as integer) as piece_no, x.t as piece, round(x.a, 3) as start, round(x.z, 3) as \"end\" from (select media_id, seq, unnest(c) as x, unnest(range(0, len(c))) as piece_no from chunks)"


@query("f03_split_by_words", f"with {_SEGMENTS}, chunks as (select media_id, seq, {fold_sql.spoken_chunks('said', 84, 5.0)} as c from segs where seq % 5 <> 4) {_CHUNKS}")
def split_by_words(spark, sf):
    return folds.split_by_words(_segments(spark, sf).where("seq % 5 <> 4")).select("media_id", "seq", "piece_no", "piece", F.round("piece_start", 3).alias("start"), F.round("piece_end", 3).alias("end"))


_SHARES = "list_transform(range(1, len(p) + 1), lambda i: {'a': least(start + list_sum(list_transform(p[1:i], lambda x: (e - start) * length(x) / greatest(length(text), 1))) - (e - start) * length(p[i]) / greatest(length(text), 1), e), 'z': case when i = len(p) then e else least(start + list_sum(list_transform(p[1:i], lambda x: (e - start) * length(x) / greatest(length(text), 1))), e) end, 't': p[i]})"


@query(
    "f08_resegment_asr",
    f"""with {_SEGMENTS}, packed as (select *, {fold_sql.pack('w', 84)} as p from segs),
    chunks as (select media_id, seq, [{{'a': start, 'z': e, 't': trim(text)}}] as c from packed where length(trim(text)) <= 84 and e - start <= 5.0
      union all select media_id, seq, {fold_sql.spoken_chunks('said', 84, 5.0)} from packed where not (length(trim(text)) <= 84 and e - start <= 5.0) and seq % 5 <> 4
      union all select media_id, seq, {_SHARES} from packed where not (length(trim(text)) <= 84 and e - start <= 5.0) and seq % 5 = 4) {_CHUNKS}""",
)
def resegment_asr(spark, sf):
    return folds.resegment_asr(_segments(spark, sf), ["media_id", "seq"]).select("media_id", "seq", "piece_no", "piece", F.round("piece_start", 3).alias("start"), F.round("piece_end", 3).alias("end"))


_PIECES = f"""{fx.LONG_CUES_SQL}, parts as (select media_id, seq, start, "end" as e, text, p - 1 as piece_no, trim(w[p * 8 - 7:p * 8].array_to_string(' ')) as piece, (len(w) + 7) // 8 as n from (select *, list_filter(string_split(text, ' '), lambda x: x <> '') as w from long_cues), lateral (select unnest(range(1, (len(w) + 7) // 8 + 1)) as p))"""


def _eights(spark, sf):
    w = X.words(F.col("text"))
    parts = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(8)), lambda i: F.array_join(F.slice("w", i, F.lit(8)), " "))
    return fx.long_cues(spark, sf).withColumn("w", w).select("media_id", "seq", "start", "end", "text", F.posexplode(parts).alias("piece_no", "piece"))


@query(
    "w09_distribute_chars",
    f"""with {_PIECES}, t as (select *, start + sum((e - start) * length(piece) / length(text)) over (partition by media_id, seq order by piece_no rows unbounded preceding) as z from parts)
    select media_id, seq, cast(piece_no as integer) as piece_no, round(case when piece_no = n - 1 then e else least(z, e) end + 1e-7, 3) as "end" from t""",
)
def distribute_chars(spark, sf):
    out = intervals.timed_pieces(_eights(spark, sf), ["media_id", "seq"], F.length("piece"), F.length("text"))
    return out.select("media_id", "seq", "piece_no", F.round(F.col("piece_end") + 1e-7, 3).alias("end"))


@query(
    "w10_distribute_display",
    f"""with {_PIECES}, s as (select *, sum(length(piece)) over (partition by media_id, seq) as chars from parts),
    t as (select *, start + sum(greatest(0.5, (e - start) * length(piece) / chars)) over (partition by media_id, seq order by piece_no rows unbounded preceding) as z from s)
    select media_id, seq, cast(piece_no as integer) as piece_no, round(least(z, e) + 1e-7, 3) as "end" from t""",
)
def distribute_display(spark, sf):
    out = intervals.timed_pieces(_eights(spark, sf), ["media_id", "seq"], F.length("piece"), least=0.5, force_last=False)
    return out.select("media_id", "seq", "piece_no", F.round(F.col("piece_end") + 1e-7, 3).alias("end"))


@query(
    "t01_even_sample",
    f"""with {fx.CUES_SQL}, p as (select media_id, seq, count(*) over (partition by media_id) as n from cues), pos as (select media_id, n, cast(floor(i * (n / 8.0)) as bigint) as seq from (select distinct media_id, n, unnest(range(0, 8)) as i from p where n > 8))
    select media_id, seq from p where n <= 8 union all select distinct media_id, seq from pos""",
)
def even_sample(spark, sf):
    return reconcile.even_sample(fx.cues(spark, sf).select("media_id", "seq"), 8, ["media_id"], ["seq"])


@query(
    "t02_order_merge",
    f"""with {fx.CUES_SQL}, e as (select media_id, start, text, 0 as t, seq from cues where seq % 2 = 0 union all select media_id, start, text, 1, seq from cues where seq % 2 = 1)
    select media_id, row_number() over (partition by media_id order by start, t, seq) - 1 as seq, text from e""",
)
def order_merge(spark, sf):
    c = fx.cues(spark, sf).select("media_id", "seq", "start", "text")
    return phrases.order_merge(c.where("seq % 2 = 0"), c.where("seq % 2 = 1"), keys=["media_id"]).select("media_id", "seq", "text")


@query(
    "f11_uniform_picks",
    f"""with {fx.CUES_SQL}, e as (select media_id, max("end") as z, greatest(1, least(8, cast(floor(max("end") / 10) as integer))) as n from cues group by media_id)
    select media_id, i, floor(z * i / (n + 1) * 10 + 0.5) / 10 as seconds from (select *, unnest(range(1, n + 1)) as i from e)""",
)
def uniform_picks(spark, sf):
    return selection.uniform_picks(rollups.media_extent(fx.cues(spark, sf)).select("media_id", "last_end"))


@query(
    "p04_valid_timestamps",
    f"""with {fx.CUES_SQL}, {fx.THUMBS_SQL}, raw as (select media_id, i, case when i % 6 = 5 then 'soon' when i % 6 = 4 then '-1' else cast(seconds as varchar) end as raw_seconds from thumbs)
    select r.media_id, r.i, try_cast(raw_seconds as double) as seconds from raw r join (select media_id, max("end") as z from cues group by media_id) using (media_id) where try_cast(raw_seconds as double) between 0 and z""",
)
def valid_timestamps(spark, sf):
    raw = F.when(F.col("i") % 6 == 5, "soon").when(F.col("i") % 6 == 4, "-1").otherwise(F.col("seconds").cast("string"))
    picks = fx.thumbs(spark, sf).select("media_id", "i", raw.alias("raw_seconds"))
    return selection.valid_timestamps(picks, fx.cues(spark, sf)).select("media_id", "i", "seconds")


_ANSWERS = """answers as (select media_id, seq // 24 as batch_id, seq as pos, case when seq % 24 = 5 and (seq // 24) % 5 = 1 then idx || '-' || (seq + 3) else idx end as idx, case when seq % 11 = 3 then '' when seq % 7 = 2 then text || text || text || text else translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') end as text from cues where not (seq % 24 = 7 and (seq // 24) % 5 = 0))"""


def _answers(cues):
    batch = F.floor(F.col("seq") / 24)
    idx = F.when((F.col("seq") % 24 == 5) & (batch % 5 == 1), F.concat("idx", F.lit("-"), (F.col("seq") + 3).cast("string"))).otherwise(F.col("idx"))
    text = F.when(F.col("seq") % 11 == 3, "").when(F.col("seq") % 7 == 2, F.concat("text", "text", "text", "text")).otherwise(fx.upper("text"))
    kept = cues.where(~((F.col("seq") % 24 == 7) & (batch % 5 == 0)))
    return kept.select("media_id", "track", batch.alias("batch_id"), F.col("seq").alias("pos"), idx.alias("idx"), text.alias("text"))


@query(
    "j03_apply_reviews",
    f"""with {fx.CUES_SQL}, {_ANSWERS} select c.media_id, c.seq, case when a.text is not null and trim(a.text) <> '' and case when length(c.text) <= 5 then length(trim(a.text)) <= 30 else length(trim(a.text)) * 3 >= length(c.text) and length(trim(a.text)) <= length(c.text) * 3 end then trim(a.text) else c.text end as text
    from cues c left join answers a on a.media_id = c.media_id and a.batch_id = c.seq // 24 and a.idx = c.idx""",
)
def apply_reviews(spark, sf):
    cues = fx.cues(spark, sf).withColumn("batch_id", F.floor(F.col("seq") / 24))
    return reconcile.apply_reviews(cues, _answers(cues), ["media_id", "track", "batch_id"]).select("media_id", "seq", "text")


@query(
    "j04_apply_translations",
    f"""with {fx.CUES_SQL}, {_ANSWERS}, r as (select *, trim(regexp_replace(trim(regexp_replace(text, '\\s{{2,}}', ' ', 'g')), '^\\d+[.:]\\s+', '')) as new, regexp_extract(idx, '^(\\d+)-(\\d+)$', 1) as a, regexp_extract(idx, '^(\\d+)-(\\d+)$', 2) as b from answers),
    spans as (select r.media_id, r.pos, r.idx, r.new, f.seq as from_seq, f.start, f."end" as a_end, z."end" as b_end, cast(r.a as bigint) as a, cast(r.b as bigint) as b, f.idx as a_idx from r join cues f on f.media_id = r.media_id and f.idx = r.a left join cues z on z.media_id = r.media_id and z.idx = r.b where r.a <> '' and new <> ''),
    gone as (select media_id, n, min(pos) as gone from (select media_id, pos, unnest(range(a + 1, b + 1)) as n from spans where b_end is not null) group by media_id, n),
    given as (select media_id, from_seq, idx, start, b_end as e, new as text from spans where b_end is not null union all select media_id, from_seq, a_idx, start, a_end, new from spans where b_end is null
      union all select c.media_id, c.seq, c.idx, c.start, c."end", case when new <> '' then new else c.text end from r join cues c on c.media_id = r.media_id and c.idx = r.idx left join gone g on g.media_id = c.media_id and g.n = c.seq + 1 where r.a = '' and (gone is null or gone > r.pos)),
    every as (from given union all select c.media_id, c.seq, c.idx, c.start, c."end", c.text from cues c where not exists (select 1 from given g where g.media_id = c.media_id and g.from_seq = c.seq) and not exists (select 1 from gone g where g.media_id = c.media_id and g.n = c.seq + 1))
    select media_id, from_seq, idx, round(start, 3) as start, round(e, 3) as "end", text from every""",
)
def apply_translations(spark, sf):
    cues = fx.cues(spark, sf)
    return reconcile.apply_translations(cues, _answers(cues)).select("media_id", "from_seq", "idx", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@query("j05_srt_fallback", f"""with {fx.CUES_SQL}, {_ANSWERS} select c.media_id, c.seq, case when trim(a.text) <> '' then trim(a.text) else c.text end as text from cues c left join answers a on a.media_id = c.media_id and a.idx = c.idx""")
def srt_fallback(spark, sf):
    cues = fx.cues(spark, sf)
    return reconcile.srt_fallback(cues, _answers(cues)).select("media_id", "seq", "text")


@query("j06_apply_refinements", f"""with {fx.CUES_SQL} select media_id, seq, case when seq % 3 = 0 then trim(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) else text end as text from cues""")
def apply_refinements(spark, sf):
    cues = fx.cues(spark, sf)
    line = F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("] "), F.when(F.col("seq") % 3 == 0, fx.upper("text")).otherwise(""))
    lines = cues.select("media_id", "track", F.col("seq").alias("pos"), line.alias("line"))
    return reconcile.apply_refinements(cues, lines).select("media_id", "seq", "text")


@query("j08_pending", f"""with {fx.TTS_SQL} select media_id, seq from tts_segments where actual_dur is null""")
def pending(spark, sf):
    clips = fx.tts_segments(spark, sf)
    return reconcile.pending(clips.select("media_id", "seq"), clips.where("actual_dur is not null"), ["media_id", "seq"])


@query(
    "j07_media_without_cues",
    f"""with {fx.CUES_SQL}, captioned as (select * from cues where lang = 'en'), durations as (select doc_id as media_id, n_chars / 5.0 as duration from documents), every as (
      select media_id, 0.0 as gap_start, start as gap_end from captioned where seq = 0
      union all select media_id, "end", coalesce(lead(start) over (partition by media_id order by seq), duration) from captioned join durations using (media_id)
      union all select media_id, 0.0, duration from durations where media_id not in (select media_id from captioned))
    select media_id, round(gap_start, 3) as gap_start, round(gap_end, 3) as gap_end from every where gap_end - gap_start > 5.0""",
)
def media_without_cues(spark, sf):
    """Gaps where only English media have captions: the others are one gap each."""
    durations = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), (F.col("n_chars") / 5.0).alias("duration"))
    return intervals.find_gaps(fx.cues(spark, sf).where("lang = 'en'"), durations).withColumns(R3("gap_start", "gap_end"))


def _raw_documents(spark, sf):
    """Captions of each document as one SRT text, as a model returns it."""
    return fx.srt_texts(spark, sf).select("media_id", F.concat(F.lit("```srt\n"), "srt", F.lit("```\n")).alias("text"))


@query("f09_resegment_documents")
def resegment_documents(spark, sf):
    """SRT text in, SRT text of whole phrases out."""
    return documents.resegment_documents(_raw_documents(spark, sf), ["media_id"])


@query("f10_display_documents")
def display_documents(spark, sf):
    """SRT texts of long captions made fit for display."""
    docs = srt.srt_documents(fx.long_cues(spark, sf), ["media_id"])
    return documents.split_documents_for_display(docs, "srt").select("media_id", "was_cut", "display")


_BATCHES = f"""{fx.CUES_SQL}, b as (select *, seq // 24 as batch_id, seq % 24 as pos, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as up from cues)"""


@query(
    "j05_translated_batches",
    f"""with {_BATCHES} select media_id, batch_id, seq as from_seq, idx, round(start, 3) as start, round("end", 3) as "end", case when batch_id % 4 = 2 or (batch_id % 4 = 0 and pos % 7 = 3) then text else up end as text,
      case batch_id % 4 when 2 then 'original' when 1 then 'srt' else 'json' end as source from b""",
)
def translated_batches(spark, sf):
    """Batches answered by JSON that skips some entries, by SRT, by nothing usable, and by JSON in a fence."""
    c = fx.cues(spark, sf).withColumn("batch_id", F.floor(F.col("seq") / 24))
    out = reconcile.translated_batches(c, fx.batch_answers(spark, sf), ["media_id", "batch_id"])
    return out.withColumns(R3("start", "end"))
