"""Whole caption documents in, whole caption documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let as _let
from ..functions.text import ends_sentence, known, seconds_to_srt_within, srt_to_seconds, word_count, wrap_mid
from ..sources.srt import build_srt, clean_entries, parse_srt, sanitize_srt
from .folds import pack_display, pack_sentences, resegment_captions, share_seconds
from .phrases import merge_by_groups, merge_phrases


def resegment_documents(docs: DataFrame, keys: list[str], groups: DataFrame | None = None, answers: DataFrame | None = None, most_chars: int = 300) -> DataFrame:
    """``(*keys, srt)`` of documents ``(*keys, text)``: cleaned, fragments merged to phrases, long ones cut, and written again.

    ``groups`` and ``answers`` are what models said: groupings for :func:`merge_by_groups`, and pieces ``(*keys, first_seq, pieces)`` of long phrases,
    used where their words are the phrase's.  Without them, or where they don't hold, the rules decide.  Documents without a caption give no row.
    Where nothing has to be joined, a document is taken through all steps within its row.
    """
    if groups is None and answers is None:
        return docs.select(*keys, known(resegmented_text(F.col("text"), most_chars)).alias("srt"))
    cues = parse_srt(sanitize_srt(docs, keys))
    merged = merge_phrases(cues, keys=keys) if groups is None else merge_by_groups(cues, groups, keys=keys)
    pieces = resegment_captions(merged, [*keys, "first_seq"], most_chars, answers)
    ordered = pieces.select(*keys, F.struct("first_seq", "piece_no").alias("seq"), F.col("piece_start").alias("start"), F.col("piece_end").alias("end"), F.col("piece").alias("text"))
    return build_srt(ordered, keys)


def resegmented_text(text: Column, most_chars: int = 300, gap: float = 2.0, wrap_at: int = 42) -> Column:
    """:func:`resegment_documents` by rule of one text; null without a caption.  Indexes are numbered anew, so those of the text don't matter."""

    def phrases(cues: Column) -> Column:
        def begins(x: Column, k: Column) -> Column:
            before = F.get(cues, k - 1)
            return (k == 0) | ends_sentence(before["text"]) | F.coalesce(F.round(x["start"] - before["end"], 6) > gap, F.lit(False))

        def phrase(at: Column, places: Column, k: Column) -> Column:
            part = F.slice(cues, at + 1, F.coalesce(F.get(places, k + 1), F.size(cues)) - at)
            return _let(part, lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("start"), F.get(p, F.size(p) - 1)["end"].alias("end"), F.array_join(F.transform(p, lambda x: x["text"]), " ").alias("text")))

        places = F.filter(F.transform(cues, lambda x, k: F.when(begins(x, k), k)), lambda k: k.isNotNull())
        return _let(places, lambda p: F.transform(p, lambda at, k: phrase(at, p, k)))

    def pieces(x: Column) -> Column:
        """Of one phrase, timed as in ``distribute_words``."""
        parts = F.when(F.length(x["text"]) <= most_chars, F.array(x["text"])).otherwise(pack_sentences(x["text"], most_chars))

        def timed(t: Column) -> Column:
            upto = lambda i: F.aggregate(F.slice(t["s"], F.lit(1), i + 1), F.lit(0.0), lambda a, s: a + s)
            last = lambda i: i == F.size(t["p"]) - 1
            return F.transform(t["p"], lambda p, i: _let(upto(i), lambda u: F.struct((x["start"] + u - F.get(t["s"], i)).alias("start"), F.when(last(i), x["end"]).otherwise(x["start"] + u).alias("end"), p.alias("text"))))

        shared = lambda p: _let(F.struct(p.alias("p"), share_seconds(F.transform(p, word_count), x["end"] - x["start"]).alias("s")), timed)
        whole = lambda p: F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(p, F.lit(0)).alias("text")))
        return _let(parts, lambda p: F.when(F.size(p) == 1, whole(p)).otherwise(shared(p)))

    block = lambda x, i: F.concat_ws("\n", (i + 1).cast("string"), F.concat(seconds_to_srt_within(x["start"]), F.lit(" --> "), seconds_to_srt_within(x["end"])), wrap_mid(x["text"], wrap_at))
    cut = lambda cues: F.flatten(F.transform(_let(cues, phrases), pieces))
    written = lambda parts: F.when(F.size(parts) > 0, F.concat(F.array_join(F.transform(parts, block), "\n\n"), F.lit("\n")))
    return _let(cut(clean_entries(text)), written)


# Fixed value: a time line as display splitting reads it.
_TIMES = r"(\d{2}:\d{2}:\d{2}[,.]\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2}[,.]\d{3})"


def display_text(srt: Column, most: int = 120) -> Column:
    """An SRT text with captions over ``most`` characters cut and timed by characters, blocks numbered anew; null where nothing has to be cut.

    Blocks that fit, have no times or less than three lines keep their lines.  A piece takes its share of the seconds, half a
    second at least, and none passes the caption's end.
    """
    join = lambda x: F.array_join(x, "\n")
    rest = lambda lines, k: F.slice(lines, F.lit(k), F.greatest(F.size(lines), F.lit(1)))
    stamp = lambda line, k: _let(F.regexp_extract(line, _TIMES, k), srt_to_seconds)
    # Every value that is used more than once is bound: times would be read anew for each piece, and for each part of a clock.
    piece = lambda a, b, text: F.concat(seconds_to_srt_within(a), F.lit(" --> "), seconds_to_srt_within(b), F.lit("\n"), text)

    def cut(line: Column, flat: Column) -> Column:
        def timed(t: Column) -> Column:
            start, end, parts = t["a"], t["z"], t["p"]
            none = F.struct(F.array().cast("array<double>").alias("out"), start.alias("at"))

            def step(total: Column, s: Column, p: Column) -> Column:
                to = F.least(s["at"] + F.greatest(F.lit(0.5), (end - start) * (F.length(p) / total)), end)
                return _let(to, lambda to: F.struct(F.concat(s["out"], F.array(to)).alias("out"), to.alias("at")))

            def put(total: Column) -> Column:
                ends = F.aggregate(parts, none, lambda s, p: step(total, s, p), lambda s: s["out"])
                return _let(ends, lambda e: F.transform(parts, lambda p, i: piece(F.when(i > 0, F.get(e, i - 1)).otherwise(start), F.get(e, i), p)))

            return _let(F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p)), put)

        return _let(F.struct(stamp(line, 1).alias("a"), stamp(line, 2).alias("z"), pack_display(flat, most).alias("p")), timed)

    def block(lines: Column) -> Column:
        flat = F.btrim(F.regexp_replace(join(rest(lines, 3)), r"[\s\p{Z}]+", " "))
        keep = F.array(F.when(F.size(lines) > 1, join(rest(lines, 2))))
        line = F.get(lines, F.lit(1))
        long = lambda f: (F.size(lines) >= 3) & (F.length(f) > most) & F.regexp_like(line, F.lit(_TIMES))
        put = lambda t: F.struct(F.when(t["cut"], cut(line, t["flat"])).otherwise(keep).alias("bodies"), t["cut"].alias("cut"))
        return _let(flat, lambda f: _let(F.struct(f.alias("flat"), long(f).alias("cut")), put))

    blocks = F.transform(F.split(F.btrim(srt, F.lit(" \t\n\r\x0b\f")), r"\n\n+", -1), lambda b: _let(F.split(b, "\n", -1), block))
    numbered = lambda bodies: F.concat(F.array_join(F.transform(bodies, lambda b, i: F.concat_ws("\n", (i + 1).cast("string"), b)), "\n\n"), F.lit("\n"))
    return _let(blocks, lambda x: F.when(F.exists(x, lambda b: b["cut"]), _let(F.flatten(F.transform(x, lambda b: b["bodies"])), numbered)))


def split_documents_for_display(docs: DataFrame, text: str = "text", most: int = 120) -> DataFrame:
    """``docs`` with ``display``: the text to show, and ``was_cut``; a document that fits is shown as it is, a null stays null."""
    cut = docs.withColumn("__d", display_text(F.col(text), most))
    return cut.withColumns({"was_cut": F.col("__d").isNotNull(), "display": F.coalesce("__d", text)}).drop("__d")
