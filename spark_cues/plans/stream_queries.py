"""Queries over tables replayed as streams: slots of a table arrive one after another, each as a run that goes on from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dimensions import PHASES, phases, values_sql
from ..runtime import scratch_path
from ..streaming import live
from . import fixtures as fx
from .registry import query

SLOTS = 3
#: Event time at which every replay begins, in seconds.
_BEGIN = 1_700_000_000


def replay(rows: DataFrame, slot: str, start: Callable[[DataFrame, str], object], slots: int = SLOTS) -> None:
    """Write each slot of ``rows`` to a folder and let ``start(stream, checkpoint)`` take what has come."""
    spark, source = rows.sparkSession, scratch_path(rows.sparkSession, "replay")
    schema = rows.drop(slot).schema
    for k in range(slots):
        rows.where(F.col(slot) == k).drop(slot).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start(stream, f"{source}-checkpoint").awaitTermination()


def live_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as live captions, dealt to slots by time; after every fifth one comes a late one, and at the end a row that only moves the time."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = fx.table(spark, sf, "conversations").select(F.col("conv_id").alias("media_id"), (F.col("turn") * 10).alias("seq"), "text", F.sum(1000 + 60 * F.length("text")).over(w).alias("end_ms"), (60 * F.length("text")).alias("dur"))
    cues = said.select("media_id", "seq", "text", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")
    late = cues.where("seq % 50 = 40 and end_ms > start_ms").select("media_id", (F.col("seq") + 1).alias("seq"), F.lit("late").alias("text"), (F.col("start_ms") - 500).alias("start_ms"), "end_ms")
    every = cues.unionByName(late).withColumn("ts_ms", F.col("end_ms") + F.when(F.col("seq") % 10 == 1, 1).otherwise(0))
    last = every.agg(F.max("ts_ms")).first()[0] or 0
    slot = F.least(F.floor(F.col("ts_ms") * SLOTS / (last + 1)), F.lit(SLOTS - 1)).cast("int")
    timed = every.select("media_id", "seq", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"), "text", F.timestamp_millis(F.col("ts_ms") + _BEGIN * 1000).alias("ts"), slot.alias("slot"))
    beat = spark.range(1).select(F.lit(-1).cast("bigint").alias("media_id"), F.lit(None).cast("bigint").alias("seq"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.lit(None).cast("string").alias("text"), F.timestamp_millis(F.lit(last + (_BEGIN + 3600) * 1000)).alias("ts"), F.lit(SLOTS - 1).alias("slot"))
    return timed.unionByName(beat)


_LIVE_SQL = """said as (select conv_id as media_id, turn * 10 as seq, text, sum(1000 + 60 * length(text)) over (partition by conv_id order by turn) as end_ms, 60 * length(text) as dur from conversations),
  cues as (select media_id, seq, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as text, end_ms - dur as start_ms, end_ms, lag(trim(text, ' ' || chr(9) || chr(10) || chr(13))) over w as before, lag(end_ms) over w as end_before from said window w as (partition by media_id order by seq)),
  numbered as (select *, sum(case when before is null or regexp_matches(before, '[.!?…؟。！？]$') or start_ms - end_before > 2000 or end_ms - end_before > 60000 then 1 else 0 end) over (partition by media_id order by seq) as n from cues)"""


@query(
    "r03_live_phrases",
    f"""with {_LIVE_SQL} select media_id, min(seq) as first_seq, round(min(start_ms) / 1000.0, 3) as "start", round(max(end_ms) / 1000.0, 3) as "end", trim(string_agg(text, ' ' order by seq)) as text, false as late from numbered group by media_id, n
      union all select media_id, seq + 1, round((start_ms - 500) / 1000.0, 3), round(end_ms / 1000.0, 3), 'late', true from cues where seq % 50 = 40 and end_ms > start_ms""",
)
def live_phrases(spark, sf):
    out = scratch_path(spark, "live-phrases")
    replay(live_cues(spark, sf), "slot", lambda stream, checkpoint: live.write_phrases(live.stream_merge_phrases(stream), out, checkpoint))
    rows = lambda name, late: spark.read.schema("media_id bigint, first_seq bigint, start double, end double, text string").parquet(f"{out}/{name}").drop("trigger").withColumn("late", F.lit(late))
    both = rows("phrases", False).unionByName(rows("late", True))
    return both.withColumns({"start": F.round("start", 3), "end": F.round("end", 3)})


@query(
    "r02_stream_phase",
    f"""with {fx.LOGS_SQL}, phases as (select * from (values {values_sql(PHASES)}) t(priority, status, pattern)), top as (select run_id, max(line_no) as top from log_lines group by run_id),
    r as (select l.run_id, status, line, row_number() over (partition by l.run_id order by line_no desc, priority) as k from log_lines l join top using (run_id) join phases on contains(line, pattern) where line_no > top - 20)
    select run_id, coalesce(case when status = 'synthesising' and regexp_extract(line, 'segment (\\d+/\\d+)', 1) <> '' then 'synthesising segment ' || regexp_extract(line, 'segment (\\d+/\\d+)', 1) else status end, 'processing') as status from top left join (from r where k = 1) using (run_id)""",
)
def stream_phase(spark, sf):
    out = scratch_path(spark, "run-statuses")
    lines = fx.log_lines(spark, sf).select("run_id", "line_no", "line", F.pmod(F.xxhash64("run_id", "line_no"), F.lit(SLOTS)).cast("int").alias("slot"))
    replay(lines, "slot", lambda stream, checkpoint: live.stream_phase(stream, phases(spark), out, checkpoint))
    return live.current_statuses(spark, out)


def answer_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each turn as tokens that arrive out of order; every tenth conversation's turns lack their first one."""
    turns = fx.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "conv_id", F.split("text", " ", -1).alias("w"))
    rows = turns.select("request_id", "conv_id", F.size("w").alias("n"), F.posexplode("w").alias("token_no", "token")).where("token_no > 0 or conv_id % 10 > 0")
    tokens = rows.select("request_id", F.col("token_no").cast("bigint").alias("token_no"), F.concat("token", F.lit(" ")).alias("token"), (F.col("token_no") == F.col("n") - 1).alias("done"), F.timestamp_millis(F.lit(_BEGIN * 1000) + F.col("token_no")).alias("ts"), F.pmod(F.xxhash64("request_id", "token_no"), F.lit(SLOTS)).cast("int").alias("slot"))
    beat = spark.range(1).select(F.lit(-1).cast("bigint").alias("request_id"), F.lit(None).cast("bigint").alias("token_no"), F.lit("").alias("token"), F.lit(False).alias("done"), F.timestamp_millis(F.lit((_BEGIN + 360_000) * 1000)).alias("ts"), F.lit(SLOTS - 1).alias("slot"))
    return tokens.unionByName(beat)


@query(
    "r04_stream_text",
    """with turns as (select conv_id * 1000 + turn as request_id, conv_id, string_split(text, ' ') as w from conversations), kept as (select *, case when conv_id % 10 > 0 then w else w[2:] end as k from turns)
    select request_id, list_aggregate(list_transform(k, lambda x: x || ' '), 'string_agg', '') as text, conv_id % 10 > 0 as complete from kept where len(k) > 0""",
)
def stream_text(spark, sf):
    out = scratch_path(spark, "answers")

    def start(stream: DataFrame, checkpoint: str):
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/trigger={number}")
        with live.state_store(spark):
            return live.stream_text(stream, limit_ms=3_600_000, delay="1 hour").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    replay(answer_tokens(spark, sf), "slot", start)
    return spark.read.schema("request_id bigint, text string, complete boolean").parquet(out).drop("trigger")


@query("r05_new_media", "select page_id, url from pages")
def new_media(spark, sf):
    """Pages that arrive twice, in one slot and in the next or the same one, are added once."""
    out = scratch_path(spark, "media")
    pages = fx.table(spark, sf, "pages").select("page_id", "url", F.explode(F.array((F.col("page_id") % SLOTS).cast("int"), ((F.col("page_id") * 7 + 1) % SLOTS).cast("int"))).alias("slot"))
    replay(pages, "slot", lambda stream, checkpoint: live.stream_new_media(stream, out, checkpoint, ["page_id"]))
    return live.read_added(spark, out).select("page_id", "url")
