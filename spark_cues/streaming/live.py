"""Streaming forms of the roll-ups and merges.

State by key needs a store with column families: queries are started within :func:`state_store`, or in a session whose
``spark.sql.streaming.stateStore.providerClass`` is set to the same.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..runtime import ship_package
from .processors import PhraseMerger, RunLog, TokenText

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started within the block keep their state in RocksDB; the session's own setting is as before afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def stream_usage(calls: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Calls and tokens a window and stage of arriving calls; rows later than ``late`` are dropped."""
    windowed = calls.withWatermark("ts", late).groupBy(F.window("ts", width), "stage")
    out = windowed.agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return out.select(F.col("window.start").alias("window_start"), "stage", "calls", "input_tokens", "output_tokens")


def stream_statuses(lines: DataFrame, patterns: DataFrame, last: int = 20) -> DataFrame:
    """``(run_id, version, status)`` of arriving lines ``(run_id, line_no, line)``: a row for each run in a trigger, the highest version is the newest.

    A run's state is its ``last`` lines by number; runs without new lines aren't touched.  ``patterns`` is a small dimension.
    """
    ship_package(lines.sparkSession)
    known = [(r["priority"], r["status"], r["pattern"]) for r in patterns.select("priority", "status", "pattern").collect()]
    schema = "run_id bigint, version bigint, status string"
    return lines.select("run_id", "line_no", "line").groupBy("run_id").transformWithState(RunLog(known, last), schema, "update", "none")


def stream_phase(lines: DataFrame, patterns: DataFrame, path: str, checkpoint: str, last: int = 20) -> StreamingQuery:
    """A query that writes the statuses of each trigger's runs to ``path``/status/v<trigger>; restarts from ``checkpoint``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select("run_id", "status").write.mode("overwrite").parquet(f"{path}/status/v{number}")

    with state_store(lines.sparkSession):
        return stream_statuses(lines, patterns, last).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_statuses(spark: SparkSession, path: str) -> DataFrame:
    """Each run's newest ``(run_id, status)`` among those that :func:`stream_phase` wrote."""
    rows = spark.read.schema("run_id bigint, status string").parquet(f"{path}/status/*")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/v(\d+)/[^/]*$", 1).cast("bigint")
    return rows.groupBy("run_id").agg(F.max_by("status", number).alias("status"))


def stream_merge_phrases(cues: DataFrame, gap: float = 2.0, idle_ms: int | None = 60_000, delay: str = "30 seconds") -> DataFrame:
    """Phrases of live captions ``(media_id, first_seq, start, end, text, late)``: the open phrase is held until a sentence end or a pause.

    Cues ``(media_id, seq, start, end, text, ts)`` may come ``delay`` late by their event time ``ts``; they are taken in its order, so the rows
    don't depend on triggers.  A phrase open for ``idle_ms`` of event time ends there.  A cue that starts before the end of the one before it
    comes out alone, with ``late`` true.  Rows with a null ``seq`` only move the time.  With ``idle_ms`` None there are no event times: a finite
    replay, cues of one trigger taken by ``seq``, the last phrase held.
    """
    ship_package(cues.sparkSession)
    schema = "media_id bigint, first_seq bigint, start double, end double, text string, late boolean"
    wanted = ["media_id", "seq", "start", "end", "text"]
    if idle_ms is None:
        return cues.select(*wanted).groupBy("media_id").transformWithStateInPandas(PhraseMerger(gap, None), schema, "append", "none")
    timed = cues.select(*wanted, "ts").withWatermark("ts", delay)
    return timed.groupBy("media_id").transformWithStateInPandas(PhraseMerger(gap, idle_ms), schema, "append", "eventtime")


def write_phrases(merged: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A query that writes phrases to ``path``/phrases and, as a side output, late cues to ``path``/late, a folder a trigger; a repeated trigger replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, rows in (("phrases", batch.where("not late")), ("late", batch.where("late"))):
            rows.drop("late").write.mode("overwrite").parquet(f"{path}/{name}/trigger={number}")
        batch.unpersist()

    with state_store(merged.sparkSession):
        return merged.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_text(tokens: DataFrame, limit_ms: int | None = None, delay: str = "30 seconds") -> DataFrame:
    """Texts of requests from tokens ``(request_id, token_no, token, done)``, in token order, given out once complete.

    A request is complete when its last token (``done``) and all before it have come, in whatever order.  A repeated number counts once.
    With ``limit_ms`` tokens have an event time ``ts``; what isn't complete so long after its last token comes out as
    it is, and the rows have a column ``complete``.  Rows with a null ``token_no`` only move the time.
    """
    ship_package(tokens.sparkSession)
    wanted = ["request_id", "token_no", "token", "done"]
    if limit_ms is None:
        return tokens.select(*wanted).groupBy("request_id").transformWithState(TokenText(None), "request_id bigint, text string", "append", "none")
    timed = tokens.withWatermark("ts", delay).select(*wanted, F.unix_millis("ts").alias("ms"), "ts")
    return timed.groupBy("request_id").transformWithState(TokenText(limit_ms), "request_id bigint, text string, complete boolean", "append", "eventtime")


def text_concat(tokens: DataFrame) -> DataFrame:
    """The batch form of :func:`stream_text`."""
    parts = F.array_sort(F.collect_set(F.struct("token_no", "token")))
    return tokens.groupBy("request_id").agg(F.array_join(F.transform(parts, lambda x: x["token"]), "").alias("text"))


class Manifest:
    """Which batches of a table are committed, and which buckets each one's keys fall into: a small file for each batch, put in place by a rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, jvm = path, spark._jvm
        self.of = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/{name}")
        self.fs = self.of("x").getFileSystem(spark._jsc.hadoopConfiguration())
        self.read = lambda file: bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode()

    def committed(self) -> dict[int, dict]:
        if not self.fs.exists(self.of("x").getParent()):
            return {}
        out = {}
        for status in self.fs.listStatus(self.of("x").getParent()):
            name = status.getPath().getName()
            if name.endswith(".json"):
                file = self.fs.open(status.getPath())
                out[int(name.removesuffix(".json"))] = json.loads(self.read(file))
                file.close()
        return out

    def commit(self, number: int, entry: dict) -> None:
        draft, final = self.of(f"{number}.draft"), self.of(f"{number}.json")
        file = self.fs.create(draft, True)
        file.write(bytearray(json.dumps(entry).encode()))
        file.close()
        if not self.fs.rename(draft, final):
            raise OSError(f"batch {number} could not be committed")


#: Buckets of the key index; batches after which the index is written anew as one.
KEY_BUCKETS, FOLD_AFTER = 64, 50


def add_new(batch: DataFrame, number: int, path: str, keys: list[str], buckets: int = KEY_BUCKETS, fold_after: int = FOLD_AFTER) -> None:
    """Add the rows of ``batch`` whose keys the table at ``path`` lacks, as batch ``number``; a committed number adds nothing.

    Rows go to ``path``/__batch=<number>/__bucket=<b>, keys alone to an index beside them, and a manifest entry makes both count.  Only
    index buckets that the batch's keys fall into are read.  After a crash before the entry, the repeated batch
    replaces what the first try wrote.  Of rows that repeat a key in a batch one stays; null keys are keys too.
    """
    spark = batch.sparkSession
    manifest = Manifest(spark, path)
    done = manifest.committed()
    if number in done:
        return
    index = f"{path}/_keys"
    dealt = batch.dropDuplicates(keys).withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
    touched = sorted(r[0] for r in dealt.select("__bucket").distinct().collect())  # at most `buckets`
    base = max((n for n, e in done.items() if e["base"]), default=-1)
    live = {n: e for n, e in done.items() if n >= base}
    # The index up to a base stands in the base's folder; a later batch has its own.
    folders = [f"{index}/{'base' if n == base else 'batch'}={n}/__bucket={b}" for n, e in live.items() for b in (e["all"] if n == base else e["buckets"]) if b in touched]
    new = dealt
    if folders:
        known = spark.read.schema(dealt.select(*keys).schema).parquet(*folders)
        same = [dealt[k].eqNullSafe(known[k]) for k in keys]
        new = dealt.join(known, same, "left_anti")
    new.write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/__batch={number}")
    dealt.unpersist()
    added = spark.read.schema(dealt.schema).parquet(f"{path}/__batch={number}").select(*keys, "__bucket")
    added.write.mode("overwrite").partitionBy("__bucket").parquet(f"{index}/batch={number}")
    own = sorted(r[0] for r in added.select("__bucket").distinct().collect())
    every = sorted({b for n, e in live.items() for b in (e["all"] if n == base else e["buckets"])} | set(own))
    fold = len(live) + 1 > fold_after
    if fold:
        old = [f"{index}/{'base' if n == base else 'batch'}={n}" for n, e in live.items() if (e["all"] if n == base else e["buckets"])]
        whole = added
        for folder in old:
            whole = whole.unionByName(spark.read.schema(added.schema).parquet(folder))
        whole.write.mode("overwrite").partitionBy("__bucket").parquet(f"{index}/base={number}")
    manifest.commit(number, {"buckets": own, "base": fold, "all": every if fold else []})


def read_added(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed batches; what a crash left uncommitted isn't seen."""
    numbers = sorted(n for n, e in Manifest(spark, path).committed().items() if e["buckets"])
    return spark.read.option("basePath", path).parquet(*[f"{path}/__batch={n}" for n in numbers]).drop("__batch", "__bucket") if numbers else spark.createDataFrame([], "__none int").limit(0)


def stream_new_media(arrivals: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """A query that adds arriving rows whose keys are new to the table at ``path``; a repeated batch adds nothing."""
    write = lambda batch, number: add_new(batch, number, path, keys)
    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
