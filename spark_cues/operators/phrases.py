"""Fragments merged into phrases, by rule and by given groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LONG_END, strip
from .ranges import WIDTH, numbered_groups

KEY = ["media_id", "track"]


def _joined(cues: DataFrame, keys: list[str]) -> DataFrame:
    """One row a group: first start, last end by position, stripped texts joined by spaces."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", strip(F.col("text")).alias("t")))), lambda x: x["t"]), " ")
    return cues.groupBy(*keys).agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_cues"), F.min_by("start", "seq").alias("start"), F.max_by("end", "seq").alias("end"), strip(texts).alias("text"))


def phrase_groups(cues: DataFrame, gap: float = 2.0, keys: list[str] = KEY, width: int = WIDTH) -> DataFrame:
    """``cues`` with ``phrase_no``: a cue begins a phrase after a sentence end or a pause over ``gap`` seconds.

    A long medium is numbered in ranges of ``width`` cue numbers, on top of the phrases that the ranges before it begin.
    """
    asked = cues.withColumn("__ends", _ends(F.col("text")))
    return numbered_groups(asked, list(keys), "seq", ["start"], ["__ends", "end"], lambda row, last: _begins(row, last, gap), "phrase_no", width).drop("__ends")


def _ends(text: Column) -> Column:
    """Whether a cue ends a sentence or has no text: asked before the windows, so that edges of ranges are found without carrying texts."""
    return F.coalesce(F.right(strip(text), F.lit(1)).isin(*LONG_END), F.lit(True))


def _begins(row: Column, last: Column, gap: float) -> Column:
    return last.isNull() | last["__ends"] | (F.round(row["start"] - last["end"], 6) > gap)


def merge_phrases(cues: DataFrame, gap: float = 2.0, keys: list[str] = KEY, width: int = WIDTH) -> DataFrame:
    """Phrases ``(*keys, phrase_no, first_seq, n_cues, start, end, text)``."""
    return _joined(phrase_groups(cues, gap, keys, width), [*keys, "phrase_no"])


def group_faults(groups: DataFrame, sizes: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """``(*keys, valid, repairable)`` of groupings ``(*keys, group_no, members)`` of the numbers 1 to ``n``.

    Valid: each number once, groups in order, members consecutive, at most ``most`` of them.  Repairable: the same but for missing numbers.
    """
    known = _checked_groups(groups, sizes, keys, most)
    return known.select(*keys, (F.col("__inside") & (F.col("covered") == F.col("total"))).alias("valid"), F.col("__inside").alias("repairable"))


def _checked_groups(groups: DataFrame, sizes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """A row a grouping: ``__inside``, whether it is repairable, how many numbers it covers of ``total``, and its groups ``spans (low, high)`` in order."""
    one = groups.select(*keys, "group_no", F.size("members").alias("n"), F.array_min("members").alias("low"), F.array_max("members").alias("high"), F.size(F.array_distinct("members")).alias("d"))
    rising = F.lag("high").over(Window.partitionBy(*keys).orderBy("group_no")).isNull() | (F.lag("high").over(Window.partitionBy(*keys).orderBy("group_no")) < F.col("low"))
    sound = (F.col("n") > 0) & (F.col("n") <= most) & (F.col("d") == F.col("n")) & (F.col("high") - F.col("low") + 1 == F.col("n"))
    each = one.withColumn("ok", F.coalesce(sound & rising, F.lit(False)))
    spans = F.array_sort(F.collect_list(F.struct("low", "high")))
    per = each.groupBy(*keys).agg(F.bool_and("ok").alias("ok"), F.sum("n").alias("covered"), F.min("low").alias("low"), F.max("high").alias("high"), spans.alias("spans"))
    known = per.join(sizes, keys)
    return known.withColumn("__inside", F.col("ok") & (F.col("low") >= 1) & (F.col("high") <= F.col("total")))


def fix_groups(groups: DataFrame, sizes: DataFrame, keys: list[str], most: int = 8) -> DataFrame:
    """``(*keys, number, group_key)`` of repairable groupings; numbers that no group has become groups of their own."""
    good = group_faults(groups, sizes, keys, most).where("repairable").select(*keys)
    numbers = sizes.join(good, keys, "left_semi").select(*keys, F.explode(F.sequence(F.lit(1), F.col("total").cast("int"))).alias("number"))
    member = groups.select(*keys, F.array_min("members").alias("first"), F.explode("members").alias("number"))
    return numbers.join(member, [*keys, "number"], "left").select(*keys, "number", F.coalesce("first", "number").cast("bigint").alias("group_key"))


def merge_by_groups(cues: DataFrame, groups: DataFrame, batch: int = 40, cut_gap: float = 1.5, rule_gap: float = 2.0, keys: list[str] = KEY, most: int = 8) -> DataFrame:
    """Phrases by given groups ``(*keys, batch_id, group_no, members)``, members numbered from 1 in their batch.

    A group is cut at pauses over ``cut_gap``; a batch without a usable grouping is merged by rule within itself.
    """
    here = [*keys, "batch_id"]
    w = Window.partitionBy(*keys).orderBy("seq")
    number = lambda rows: rows.withColumn("__p", F.row_number().over(w) - 1).withColumn("batch_id", F.floor(F.col("__p") / batch).cast("bigint")).withColumn("number", (F.col("__p") % batch + 1).cast("int"))
    placed = number(cues.withColumn("__ends", _ends(F.col("text"))))
    sizes = number(cues).groupBy(*here).agg(F.count("*").alias("total"))
    # A repairable grouping, whose groups are runs of numbers, as one array: the first number of each number's group; it meets the batch's
    # cues as one row, and all that follows lies within the batch, so cues aren't shuffled again.
    good = _checked_groups(groups, sizes, here, most).where("__inside")
    until = lambda i: F.when(i > 0, F.get("spans", i - 1)["high"]).otherwise(F.lit(0))
    alone = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    firsts = F.flatten(F.transform("spans", lambda x, i: F.concat(alone(until(i) + 1, x["low"].cast("int") - 1), F.array_repeat(x["low"].cast("int"), x["high"].cast("int") - x["low"].cast("int") + 1))))
    fixed = good.select(F.struct(*here).alias("__k"), firsts.alias("__firsts"))
    both = placed.withColumn("__k", F.struct(*here)).join(fixed, "__k", "left").withColumn("by_rule", F.col("__firsts").isNull())
    own = Window.partitionBy("__k").orderBy("seq")
    begun = both.withColumn("__l", F.lag(F.struct("__ends", "end")).over(own)).withColumn("__v", F.when(_begins(F.struct("start"), F.col("__l"), rule_gap), 1).otherwise(0))
    phrase = F.sum("__v").over(own.rowsBetween(Window.unboundedPreceding, 0))
    key = F.when(F.col("by_rule"), phrase + 100_000).otherwise(F.coalesce(F.get("__firsts", F.col("number") - 1), F.col("number")))
    inner = Window.partitionBy("__k", "__g").orderBy("seq")
    cuts = F.round(F.col("start") - F.lag("end").over(inner), 6) > cut_gap
    marked = begun.withColumn("__g", key).withColumn("__c", (F.coalesce(cuts, F.lit(False)) & ~F.col("by_rule")).cast("int")).withColumn("part", F.sum("__c").over(inner))
    return _joined(marked, ["__k", "__g", "part"]).select(*[F.col("__k")[k].alias(k) for k in here], "first_seq", "n_cues", "start", "end", "text")


def order_merge(*tables: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Cue tables in one, numbered anew from 0 by start; earlier tables first on ties."""
    every = None
    for k, t in enumerate(tables):
        part = t.withColumn("__t", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("start", "__t", "seq")
    return every.withColumn("seq", (F.row_number().over(w) - 1).cast("bigint")).drop("__t")


def media_report(cues: DataFrame, gap: float = 2.0) -> DataFrame:
    """Per medium: cues, phrases, longest pause and words a second, over one shuffle."""
    w = Window.partitionBy(*KEY).orderBy("seq")
    grouped = phrase_groups(cues, gap).withColumn("pause", F.round(F.greatest(F.coalesce(F.col("start") - F.lag("end").over(w), F.lit(0.0)), F.lit(0.0)), 3))
    words = F.size(F.filter(F.split("text", " ", -1), lambda x: x != ""))
    out = grouped.groupBy(*KEY).agg(F.count("*").alias("n_cues"), F.max("phrase_no").alias("n_phrases"), F.max("pause").alias("longest_pause"), F.sum(words).alias("n_words"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("spoken"))
    return out.select("media_id", "track", "n_cues", "n_phrases", "longest_pause", F.round(F.col("n_words") / F.col("spoken"), 6).alias("words_per_second"))
