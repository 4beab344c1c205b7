"""SRT documents read, cleaned and written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TAGS, let, seconds_to_srt, srt_to_seconds, strip, wrap_mid

_ARROW = r"^\s*([\d:,]+) --> ([\d:,]+)"


def _blocks(text: Column) -> Column:
    """Blocks of at least an index, a time and a text line, as arrays of lines."""
    body = strip(F.regexp_replace(text, "\r\n?", "\n"))
    split = F.transform(F.split(body, r"\n\s*\n", -1), lambda x: F.split(strip(x), "\n", -1))
    return F.filter(split, lambda x: (F.size(x) >= 3) & F.regexp_like(F.get(x, F.lit(1)), F.lit(_ARROW)))


def parse_srt(docs: DataFrame, text: str = "text", flat: bool = False) -> DataFrame:
    """``(…, seq, idx, start, end, text)`` of documents: blocks apart by blank lines, with at least an index, a time and a text line.

    Text lines keep their line feeds, or are joined by spaces when ``flat``.  Other blocks are dropped.
    """
    keep = [c for c in docs.columns if c != text]
    # Numbered within the document's own array: no shuffle, and documents with equal columns don't mix.
    blocks = docs.select(*keep, F.posexplode(_blocks(F.col(text))).alias("seq", "__l"))
    stamp = lambda k: srt_to_seconds(F.regexp_extract(F.get("__l", F.lit(1)), _ARROW, k))
    lines = F.transform(F.slice("__l", F.lit(3), F.size("__l")), lambda x: strip(x) if flat else x)
    return blocks.select(*keep, F.col("seq").cast("bigint").alias("seq"), strip(F.get("__l", F.lit(0))).alias("idx"), stamp(1).alias("start"), stamp(2).alias("end"), F.array_join(lines, " " if flat else "\n").alias("text"))


def read_srt(spark: SparkSession, path: str, flat: bool = False) -> DataFrame:
    """Cues of every SRT file below ``path``, with its ``path``; a file is one row, read whole."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_srt(files, flat=flat)


def _bare(text: str | Column) -> Column:
    """Without wrapper tags and fences."""
    return F.regexp_replace(F.regexp_replace(text, rf"(?i)</?(?:{TAGS}|srt|output|subtitles)>", ""), r"(?m)^\s*```[a-z]*\s*$", "")


#: A time line before a line of nothing but digits that ends its block.
_DIGITS = r" --> [^\n]*\n\s*\d+\s*(?:\n\s*\n|$|```)"


def digit_captions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Captions of nothing but digits in blocks of their own, as :func:`parse_srt` gives them; :func:`sanitize_srt` takes these for indexes."""
    some = docs.where(F.regexp_like(text, F.lit(_DIGITS)))
    return parse_srt(some.withColumn(text, _bare(text)), text).where(F.regexp_like("text", F.lit(r"^\d+$")))


def sanitize_srt(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(*keys, text)`` of documents as models return them, rebuilt: tags, fences and blank lines gone, entries numbered.

    A time line opens an entry; a line of digits is the next entry's index (even if it was a caption); other lines are
    text.  Entries without text go.  An entry without an index line takes the last one plus the time lines since.
    """
    lines = docs.select(*keys, F.posexplode(F.split(F.regexp_replace(_bare(text), "\r\n?", "\n"), "\n", -1)).alias("p", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    stamp, digits = F.regexp_like("line", F.lit(r"^[\d:,]+ --> [\d:,]+")), F.regexp_like("line", F.lit(r"^\d+$"))
    w = Window.partitionBy(*keys).orderBy("p")
    one = lines.withColumns({"is_ts": stamp, "is_no": digits & ~stamp})
    run = one.withColumns({"ent": F.sum(F.col("is_ts").cast("int")).over(w), "dgrp": F.sum(F.col("is_no").cast("int")).over(w), "lastd": F.last(F.when(F.col("is_no"), F.col("line").cast("bigint")), True).over(w)})
    # Time lines since the last index: both counts run along the same order, so nothing is sorted anew.
    since = F.col("ent") - F.coalesce(F.last(F.when(F.col("is_no"), F.col("ent")), True).over(w), F.lit(0))
    label = F.when((F.col("dgrp") > 0) & (F.col("since") == 1), F.col("lastd")).otherwise(F.coalesce("lastd", F.lit(0)) + F.col("since"))
    placed = run.withColumn("since", since).withColumn("label", label).where("ent > 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_ts") & ~F.col("is_no"), F.struct("p", "line")))), lambda x: x["line"]), " ")
    entries = placed.groupBy(*keys, "ent").agg(F.max(F.when(F.col("is_ts"), F.col("label"))).alias("label"), F.max(F.when(F.col("is_ts"), F.col("line"))).alias("stamp"), said.alias("said")).where("said <> ''")
    block = F.concat_ws("\n", F.col("label").cast("string"), "stamp", "said")
    return entries.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ent", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


def _marked_lines(text: Column) -> Column:
    """Lines of a text as models return it, as ``array<struct<x,k>>``: whether a line is a time line (t), digits (n) or said (s)."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(_bare(text), "\r\n?", "\n"), "\n", -1), strip), lambda x: x != "")
    kind = lambda x: F.when(F.regexp_like(x, F.lit(r"^[\d:,]+ --> [\d:,]+")), "t").when(F.regexp_like(x, F.lit(r"^\d+$")), "n").otherwise("s")
    return F.transform(lines, lambda x: F.struct(x.alias("x"), kind(x).alias("k")))


def _places(items: Column, holds: Callable[[Column], Column]) -> Column:
    """Where ``holds`` is true in a list, from 0."""
    return F.filter(F.transform(items, lambda x, i: F.when(holds(x), i)), lambda i: i.isNotNull())


def _said(marked: Column, at: Column, places: Column, k: Column) -> Column:
    """What is said between a time line and the next."""
    body = F.filter(F.slice(marked, at + 1, F.coalesce(F.get(places, k + 1), F.size(marked)) - at), lambda x: x["k"] == "s")
    return F.array_join(F.transform(body, lambda x: x["x"]), " ")


def clean_entries(text: Column) -> Column:
    """What :func:`sanitize_srt` makes of a text and :func:`parse_srt` reads back, as ``array<struct<start,end,text>>``: for a document that is taken on within its row."""
    stamp = lambda line, k: let(F.regexp_extract(line, _ARROW, k), srt_to_seconds)

    def cut(marked: Column) -> Column:
        def entry(at: Column, places: Column, k: Column) -> Column:
            line = F.get(marked, at)["x"]
            return F.struct(stamp(line, 1).alias("start"), stamp(line, 2).alias("end"), _said(marked, at, places, k).alias("text"))

        return let(_places(marked, lambda x: x["k"] == "t"), lambda p: F.transform(p, lambda at, k: entry(at, p, k)))

    return F.filter(let(_marked_lines(text), cut), lambda e: e["text"] != "")


def read_captions(text: Column) -> Column:
    """What a model's answer says by index, as ``array<struct<pos,idx,text>>``: :func:`sanitize_srt` read back by :func:`parse_srt`, and :func:`digit_captions`, within the text's row."""

    def numbered(entries: Column) -> Column:
        """An index goes on from the last one written, so entries are taken in runs that begin with one."""

        def run(at: Column, starts: Column, k: Column) -> Column:
            part = F.slice(entries, at + 1, F.coalesce(F.get(starts, k + 1), F.size(entries)) - at)
            # Numbers too long to count on from give no index.
            counted = lambda no, m: F.try_add(F.coalesce(no, F.lit("0")).try_cast("bigint"), (m + 1).cast("bigint")).cast("string")
            label = lambda no, m: F.when((m == 0) & no.isNotNull(), F.regexp_replace(no, r"^0+(?=\d)", "")).otherwise(counted(no, m))
            return let(F.get(part, F.lit(0))["no"], lambda no: F.transform(part, lambda e, m: F.struct(label(no, m).alias("idx"), e["text"].alias("text"))))

        starts = F.filter(F.transform(entries, lambda e, k: F.when((k == 0) | e["no"].isNotNull(), k)), lambda k: k.isNotNull())
        return let(starts, lambda s: F.flatten(F.transform(s, lambda at, k: run(at, s, k))))

    def cut(marked: Column) -> Column:
        def entry(at: Column, places: Column, k: Column) -> Column:
            last = F.coalesce(F.get(places, k - 1), F.lit(-1))
            indexes = F.filter(F.slice(marked, last + 2, at - last - 1), lambda x: x["k"] == "n")
            return F.struct(let(indexes, lambda n: F.get(n, F.size(n) - 1)["x"]).alias("no"), _said(marked, at, places, k).alias("text"))

        return let(_places(marked, lambda x: x["k"] == "t"), lambda p: let(F.transform(p, lambda at, k: entry(at, p, k)), numbered))

    # Of two at one place the one of digits comes later.
    placed = lambda items, later: F.transform(items, lambda e, i: F.struct((i * 2 + later).alias("pos"), e["idx"].alias("idx"), e["text"].alias("text")))
    rest = lambda lines: F.struct(strip(F.get(lines, F.lit(0))).alias("idx"), F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n").alias("text"))
    digits = F.filter(placed(F.transform(_blocks(_bare(text)), rest), 1), lambda e: F.regexp_like(e["text"], F.lit(r"^\d+$")))
    none = F.array().cast("array<struct<pos:int,idx:string,text:string>>")
    read = placed(F.filter(let(_marked_lines(text), cut), lambda e: e["text"] != ""), 0)
    return F.concat(read, F.when(F.regexp_like(text, F.lit(_DIGITS)), digits).otherwise(none))


def cue_block(idx: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat_ws("\n", idx, F.concat(seconds_to_srt(start), F.lit(" --> "), seconds_to_srt(end)), text)


def srt_documents(cues: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, srt)``: one document a group, in order, indexes kept."""
    # Blocks are made before they are collected: an aggregate works its inputs out one by one, with nothing shared between them.
    blocks = cues.select(*keys, "seq", cue_block(F.col("idx"), F.col("start"), F.col("end"), F.col("text")).alias("b"))
    return blocks.groupBy(*keys).agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "b"))), lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("srt"))


def build_srt(cues: DataFrame, keys: list[str], wrap_at: int = 42) -> DataFrame:
    """As :func:`srt_documents`, numbered from 1, long texts broken once near the middle (``wrap_at`` 0: never)."""
    w = Window.partitionBy(*keys).orderBy("seq")
    text = wrap_mid(F.col("text"), wrap_at) if wrap_at else F.col("text")
    return srt_documents(cues.withColumns({"idx": F.row_number().over(w).cast("string"), "text": text}), keys)


def write_srt(cues: DataFrame, path: str, key: str = "media_id") -> None:
    """One text file a medium, in a folder by key."""
    srt_documents(cues, [key]).repartition(key).write.partitionBy(key).option("lineSep", "\n").mode("overwrite").text(path)
