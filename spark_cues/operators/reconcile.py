"""Model answers matched to the cues they answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_llm_text, clean_llm_text_within, let, loose_json, range_index, safe_edit, strip
from ..sources.srt import read_captions

KEY = ["media_id", "track"]
ANSWER = "array<struct<index:string,text:string>>"


def answer_rows(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Responses to rows ``(…, pos, idx, text)``; unusable JSON gives none."""
    items = F.from_json(loose_json(F.col(raw)), ANSWER)
    keep = [c for c in responses.columns if c != raw]
    return responses.select(*keep, F.posexplode(items).alias("pos", "x")).select(*keep, F.col("pos").cast("bigint").alias("pos"), F.col("x.index").alias("idx"), F.col("x.text").alias("text"))


def _last(answers: DataFrame, keys: list[str]) -> DataFrame:
    """The last answer of each index."""
    return answers.groupBy(*keys, "idx").agg(F.max_by("text", "pos").alias("__new"))


def apply_reviews(cues: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Corrections by index within ``keys`` (the batch among them); the original stays unless the edit is safe."""
    both = cues.join(_last(answers, keys), [*keys, "idx"], "left")
    new = strip(F.col("__new"))
    text = F.when(safe_edit(F.col("text"), new), new).otherwise(F.col("text"))
    return both.withColumn("text", text).drop("__new").select(*cues.columns)


def apply_translations(cues: DataFrame, answers: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Answers by index, where ``a-b`` stands for all cues from a to b: its text spans them and later answers for them are ignored.

    ``answers (*keys, pos, idx, text)``.  Text is cleaned; an empty one keeps the original; an unknown index is dropped; a range
    with an unknown end counts as its first index.  Cues without an answer keep theirs.  Rows come with ``from_seq``, ordered by start.
    """
    number = lambda c: F.when(F.regexp_like(F.trim(c), F.lit(r"^\d+$")), F.trim(c).cast("bigint"))
    # Labels that are one number meet under it, in one struct with the keys, so that ranges, by number, and answers, by label, are joined over
    # one shuffle of the cues and one of the answers.
    under = lambda c: F.when(F.regexp_like(F.trim(c), F.lit(r"^\d+$")), F.regexp_replace(F.trim(c), r"^0+(?=\d)", "")).otherwise(c)
    place = lambda c: F.struct(*keys, c.alias("under")).alias("__at")
    known = cues.select(*keys, "seq", F.col("idx").alias("label"), number(F.col("idx")).alias("n"), "start", "end", F.col("text").alias("original"))
    said = answers.select(*keys, F.col("pos").cast("bigint").alias("pos"), F.trim("idx").alias("label"), range_index(F.trim("idx")).alias("r"), clean_llm_text(F.col("text")).alias("new"))
    ranged = said.where("r is not null and r.b > r.a and new <> ''").select(*keys, "pos", "label", "new", F.col("r.a").alias("a"), F.col("r.b").alias("b"))
    begun = ranged.join(known.select(*keys, F.col("n").alias("a")), [*keys, "a"], "left_semi")
    spans = begun.join(known.select(*keys, F.col("n").alias("b"), F.col("end").alias("b_end")), [*keys, "b"], "left")
    # By number: the ranges that begin at a cue, and the first answer whose range has swallowed it.
    covered = spans.withColumn("n", F.explode(F.sequence("a", F.when(F.col("b_end").isNotNull(), F.col("b")).otherwise(F.col("a")))))
    begins = F.collect_list(F.when(F.col("n") == F.col("a"), F.struct("pos", "label", "new", "b_end")))
    marks = covered.groupBy(place(F.col("n").cast("string"))).agg(F.min(F.when(F.col("n") > F.col("a"), F.col("pos"))).alias("gone"), begins.alias("begins"))
    singles = said.where("r is null").dropna(subset=keys).groupBy(place(under(F.col("label")))).agg(F.collect_list(F.struct("pos", "label", "new")).alias("singles"))
    both = known.drop("n").withColumn("__at", place(under(F.col("label")))).join(marks, "__at", "left").join(singles, "__at", "left")
    row = lambda pos, label, end, text: F.struct(pos.alias("pos"), F.col("seq").alias("from_seq"), label.alias("idx"), F.col("start").alias("start"), end.alias("end"), text.alias("text"))
    label, end, original = F.col("label"), F.col("end"), F.col("original")
    wide = F.transform("begins", lambda x: row(x["pos"], F.when(x["b_end"].isNotNull(), x["label"]).otherwise(label), F.coalesce(x["b_end"], end), x["new"]))
    live = F.filter("singles", lambda x: (x["label"] == F.col("label")) & (F.col("gone").isNull() | (F.col("gone") > x["pos"])))
    plain = F.transform(live, lambda x: row(x["pos"], label, end, F.when(x["new"] != "", x["new"]).otherwise(original)))
    given = F.concat(F.coalesce(wide, F.array()), F.coalesce(plain, F.array()))
    own = F.when(F.col("gone").isNull(), F.array(row(F.lit(None).cast("bigint"), label, end, original)))
    rows = both.withColumn("given", given).select(*keys, F.explode(F.when(F.size("given") > 0, F.col("given")).otherwise(own)).alias("x"))
    return rows.select(*keys, "x.*")


def srt_fallback(cues: DataFrame, answers: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Answers parsed from SRT, by index; the last wins, blank ones keep the original."""
    both = cues.join(_last(answers, keys), [*keys, "idx"], "left")
    return both.withColumn("text", F.when(strip(F.col("__new")) != "", strip(F.col("__new"))).otherwise(F.col("text"))).select(*cues.columns)


def translated_batches(cues: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, from_seq, idx, start, end, text, source)``: each batch by its response's JSON, else by SRT in it, else as it was.

    ``keys`` name a batch; ``responses (*keys, raw)`` are what models returned, one a batch.  A response is JSON if it holds a list with an
    entry, whatever the entry; it is SRT if a caption can be read from it once cleaned, or one of digits before.  ``source`` says which (json, srt, original); batches without a
    response stay as they were.  A batch's cues come to its response over one shuffle, and as a response is one row, so is its batch.
    """
    cue = F.struct(F.col("seq").alias("from_seq"), "idx", "start", "end", "text")
    # Cues whose keys hold a null meet no response: they are many groups, not one.
    alone = F.when(reduce(or_, [F.col(k).isNull() for k in keys]), F.xxhash64("seq", "idx", "start", "end", "text"))
    own = cues.select(*keys, alone.alias("__alone"), cue.alias("__cue"), F.lit(None).cast("string").alias("raw"))
    said = responses.dropna(subset=keys).select(*keys, F.lit(None).cast("bigint").alias("__alone"), F.lit(None).cast(own.schema["__cue"].dataType).alias("__cue"), "raw")
    met = own.unionByName(said).groupBy(*keys, "__alone").agg(F.collect_list("__cue").alias("__cues"), F.max("raw").alias("raw"))
    marked = met.withColumn("__items", F.from_json(loose_json(F.col("raw")), ANSWER))
    rows = marked.select(*[F.col(k).cast(cues.schema[k].dataType) for k in keys], F.explode(_batch_rows(F.col("__cues"), F.col("raw"), F.col("__items"))).alias("x"))
    return rows.select(*keys, "x.*")


def _batch_rows(cues: Column, raw: Column, items: Column) -> Column:
    """One batch's rows, as ``array<struct<from_seq,idx,start,end,text,source>>``, of its cues ``array<struct<from_seq,idx,start,end,text>>``, its response and the JSON read from that."""

    def row(x: Column, source: str, **new: Column) -> Column:
        return F.struct(*[new.get(c, x[c]).alias(c) for c in ("from_seq", "idx", "start", "end", "text")], F.lit(source).alias("source"))

    number = lambda c: F.when(F.regexp_like(F.trim(c), F.lit(r"^\d+$")), F.trim(c).try_cast("bigint"))
    said = lambda x, pos: let(F.trim(x["index"]), lambda label: F.struct(pos.alias("pos"), label.alias("idx"), range_index(label).alias("r"), clean_llm_text_within(x["text"]).alias("text")))
    plain = lambda x, a: row(x, "json", text=F.when(a["text"] != "", a["text"]).otherwise(x["text"]))

    def spans(answers: Column) -> Column:
        """Ranges that begin at a cue, each with the end of the cue they end at, null without one; null where no answer is a range."""
        ranged = F.filter(answers, lambda x: F.coalesce((x["r"]["b"] > x["r"]["a"]) & (x["text"] != ""), F.lit(False)))
        numbered = F.filter(F.transform(cues, lambda c: F.struct(number(c["idx"]).alias("n"), c["end"].alias("end"))), lambda c: c["n"].isNotNull())
        ends = lambda x, of: F.transform(F.filter(of, lambda c: c["n"] == x["r"]["b"]), lambda c: c["end"])
        every = lambda e: F.when(F.size(e) > 0, e).otherwise(F.array(F.get(e, F.lit(0))))
        span = lambda x, of: F.transform(let(ends(x, of), every), lambda e: F.struct(x["pos"].alias("pos"), x["idx"].alias("idx"), x["r"]["a"].alias("a"), x["r"]["b"].alias("b"), e.alias("end"), x["text"].alias("text")))
        begun = lambda some, of: F.filter(some, lambda x: F.exists(of, lambda c: c["n"] == x["r"]["a"]))
        known = lambda some: let(numbered, lambda of: F.flatten(F.transform(begun(some, of), lambda x: span(x, of))))
        return let(ranged, lambda some: F.when(F.size(some) > 0, known(some)))

    def among(x: Column, found: Column, spans: Column) -> Column:
        """Rows of a cue where there are ranges: those that begin at it, and the answers that no earlier range has swallowed."""

        def rows(at: Column) -> Column:
            live = F.filter(found, lambda a: at["gone"].isNull() | (at["gone"] > a["pos"]))
            own = F.filter(F.array(row(x, "json")), lambda _: at["gone"].isNull())
            wide = lambda s: row(x, "json", idx=F.when(s["end"].isNotNull(), s["idx"]).otherwise(x["idx"]), end=F.coalesce(s["end"], x["end"]), text=s["text"])
            given = F.concat(F.transform(F.filter(spans, lambda s: F.coalesce(s["a"] == at["n"], F.lit(False))), wide), F.transform(live, lambda a: plain(x, a)))
            return let(given, lambda g: F.when(F.size(g) > 0, g).otherwise(own))

        over = lambda n: F.filter(spans, lambda s: F.coalesce(s["end"].isNotNull() & (s["a"] < n) & (n <= s["b"]), F.lit(False)))
        return let(let(number(x["idx"]), lambda n: F.struct(n.alias("n"), F.array_min(F.transform(over(n), lambda s: s["pos"])).alias("gone"))), rows)

    def by_json(answers: Column) -> Column:
        """As :func:`apply_translations`."""
        singly = lambda x, found: F.when(F.size(found) > 0, F.transform(found, lambda a: plain(x, a))).otherwise(F.array(row(x, "json")))
        given = lambda x, find, s: let(find(x["idx"]), lambda found: F.when(s.isNull(), singly(x, found)).otherwise(among(x, found, s)))
        singles = F.filter(answers, lambda x: x["r"].isNull())
        asked = F.struct(let(singles, _dealt).alias("by_label"), spans(answers).alias("spans"))
        return let(asked, lambda t: F.flatten(F.transform(cues, lambda x: given(x, _finding(t["by_label"]), t["spans"]))))

    def by_srt(captions: Column) -> Column:
        """As :func:`srt_fallback`."""
        last = lambda found: let(F.array_max(F.transform(found, lambda a: F.struct(a["pos"], a["text"])))["text"], lambda t: clean_llm_text_within(t))
        return let(_dealt(captions), lambda p: F.transform(cues, lambda x: let(last(_finding(p)(x["idx"])), lambda t: row(x, "srt", text=F.when(t != "", t).otherwise(x["text"])))))

    as_were = F.transform(cues, lambda x: row(x, "original"))
    else_srt = let(read_captions(raw), lambda c: F.when(F.size(c) > 0, by_srt(c)).otherwise(as_were))
    return F.when(F.size(items) > 0, let(F.transform(items, said), by_json)).otherwise(else_srt)


def _dealt(items: Column) -> Column:
    """Items by ``idx`` in about sqrt(n) parts: a batch may be long, and a label is looked for in one of them."""
    n = F.greatest(F.ceil(F.sqrt(F.size(items))), F.lit(1))
    placed = F.transform(items, lambda x: F.struct(F.pmod(F.xxhash64(x["idx"]), n).alias("at"), x.alias("x")))
    return let(placed, lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.transform(F.filter(d, lambda x: x["at"] == k), lambda x: x["x"])))


def _finding(parts: Column) -> Callable[[Column], Column]:
    """Of :func:`_dealt` items those whose ``idx`` is a label."""
    return lambda label: F.filter(F.get(parts, F.pmod(F.xxhash64(label), F.size(parts)).cast("int")), lambda x: x["idx"] == label)


def apply_refinements(segments: DataFrame, lines: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``[i] text`` lines by position from 0; the last wins, empty ones are ignored; words go with the old text."""
    pattern = r"^\s*\[(\d+)\]\s*(.*)$"
    said = lines.where(F.regexp_like("line", F.lit(pattern))).select(*keys, "pos", F.regexp_extract("line", pattern, 1).cast("bigint").alias("seq"), strip(F.regexp_extract("line", pattern, 2)).alias("new"))
    best = said.where("new <> ''").groupBy(*keys, "seq").agg(F.max_by("new", "pos").alias("__new"))
    both = segments.join(best, [*keys, "seq"], "left").withColumn("text", F.coalesce("__new", "text")).drop("__new")
    if "words" in segments.columns:
        both = both.withColumn("words", F.lit(None).cast(segments.schema["words"].dataType))
    return both.select(*segments.columns)


def pending(work: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Work without a valid result; all of it when ``force``."""
    return work if force else work.join(done.select(*keys).distinct(), keys, "left_anti")


def numbered_lines(rows: DataFrame, keys: list[str], line, order: str = "seq", sep: str = "\n") -> DataFrame:
    """One text a group: ``line`` of each row, in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["l"]), sep).alias("lines"))


def entries_json(rows: DataFrame, keys: list[str], with_target: bool = False) -> DataFrame:
    """One JSON array a group of ``{index, text[, target_words]}``, in order."""
    fields = [F.col("idx").alias("index"), F.col("text")] + ([F.col("target_words")] if with_target else [])
    parts = F.array_sort(F.collect_list(F.struct(F.col("seq").alias("o"), F.struct(*fields).alias("x"))))
    return rows.groupBy(*keys).agg(F.to_json(F.transform(parts, lambda p: p["x"])).alias("entries"))


def build_messages(system, parts: list) -> F.Column:
    """A system message and a user message of the parts that aren't empty, as ``array<struct<role,content>>``."""
    said = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n\n")
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), said.alias("content")))


def flatten_messages(parts) -> F.Column:
    """Content parts ``array<struct<type,text,url>>`` to ``(text, images)``: texts by line, images without their data-address prefix."""
    texts = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    images = F.transform(F.filter(parts, lambda p: p["type"] == "image_url"), lambda p: F.substring_index(p["url"], ",", -1))
    return F.struct(texts.alias("text"), images.alias("images"))


def even_sample(rows: DataFrame, k: int, keys: list[str], order: list[str]) -> DataFrame:
    """At most ``k`` evenly spaced rows of each group: positions ``int(i * n / k)``; all where there are no more."""
    w = Window.partitionBy(*keys)
    placed = rows.withColumn("__n", F.count("*").over(w)).withColumn("__p", F.row_number().over(w.orderBy(*order)) - 1)
    i = F.ceil(F.col("__p") * k / F.col("__n"))
    hit = F.floor(i * (F.col("__n") / F.lit(float(k)))) == F.col("__p")
    return placed.where((F.col("__n") <= k) | (hit & (i < k))).drop("__n", "__p")
