"""Column functions over caption text and times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular expression that covers Unicode's, as caption tools strip it.
WS = r"[\p{Z}\s\x{85}]"
#: The same signs as a list.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# The three sets of sentence ends that different steps use.
PHRASE_END = r"[.!?…؟。！？]\s*$"
LONG_END = (".", "!", "?", "…", "؟", "。", "！", "？")
CAPTION_MARKS = r"([.!?…؟])\s+"
DISPLAY_MARKS = r"([.!?…؟。！？])\s*"
# Fixed value: a caption that recognisers make up over silence.
PHANTOM = r"ترجمة\s+نانسي\s+قنقر"
# Tags that models wrap answers in.
TAGS = r"index|translated[_ ]?text|original[_ ]?text|start|end|subtitle|entry|segment|translation|text|source|target|item|lang"
RTL_OPEN, RTL_CLOSE = "‫", "‬"
_ARABIC = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.btrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """White-space tokens."""
    return F.filter(F.split(c, rf"{WS}+", -1), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: within lambdas nothing else shares what is asked for twice."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def known(value: Column) -> Column:
    """``value`` as a column of its rows that aren't null: a filter on it would have it worked out twice."""
    return F.explode(F.filter(F.array(value), lambda x: x.isNotNull()))


def srt_to_seconds(c: Column) -> Column:
    """``HH:MM:SS,mmm`` or with a point, as seconds; null otherwise."""
    # One pattern tells whether there are times; their parts lie between plain signs.
    plain = F.translate(F.btrim(c, F.lit(" \t\n\x0b\f\r")), ".", ",")
    clock = F.substring_index(plain, ",", 1)
    part = lambda k: F.substring_index(F.substring_index(clock, ":", k), ":", -1).cast("bigint")
    ms = (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + F.rpad(F.substring_index(plain, ",", -1), 3, "0").cast("bigint")
    return F.when(F.regexp_like(c, F.lit(r"^\s*\d+:\d+:\d+[,.]\d{1,3}\s*$")), ms / 1000.0)


def millis(seconds: Column) -> Column:
    """Whole milliseconds, ties to even; negative times count as 0."""
    return F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("bigint")


def clock(ms: Column, mark: str = ",") -> Column:
    """Whole milliseconds as ``HH:MM:SS,mmm``."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(ms / 3600000)
    head = F.when(hours > 99, hours.cast("string")).otherwise(two(hours))
    return F.concat(head, F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(mark), F.lpad((ms % 1000).cast("string"), 3, "0"))


def seconds_to_srt(c: Column, mark: str = ",") -> Column:
    """``HH:MM:SS,mmm``; a fraction that rounds to 1000 ms carries into the seconds."""
    return clock(millis(c), mark)


def seconds_to_srt_within(c: Column, mark: str = ",") -> Column:
    """:func:`seconds_to_srt` for use within lambdas."""
    return let(millis(c), lambda ms: clock(ms, mark))


def parse_timestamp(c: Column) -> Column:
    """``HH:MM:SS[.m]``, ``MM:SS[.m]`` or seconds, as seconds; null for anything else."""
    parts = F.split(F.trim(c), ":", -1)
    number = lambda k: F.get(parts, F.lit(k)).cast("double")
    valid = F.regexp_like(F.trim(c), F.lit(r"^(\d+:){0,2}\d+(\.\d+)?$"))
    total = F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2)).when(F.size(parts) == 2, number(0) * 60 + number(1)).otherwise(number(0))
    return F.when(valid, total)


def short_timestamp(c: Column) -> Column:
    """``M:SS``, or ``H:MM:SS`` from an hour on."""
    s = F.floor(c).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(s % 60))).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(s % 60)))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 3).cast("bigint")


def ends_sentence(c: Column) -> Column:
    return F.regexp_like(c, F.lit(PHRASE_END))


def wrap_mid(c: Column, at: int = 42, reach: int = 10) -> Column:
    """Texts over ``at`` characters get one line break.

    It falls on the last space before middle + ``reach`` or the first from middle - ``reach``, whichever is nearer
    the middle (the former on ties), or in the middle itself without spaces.
    """

    def place(t: Column) -> Column:
        """From ``(c, middle, head, ahead)``, each worked out once."""
        middle, tail = t["middle"], F.length(F.substring_index(t["head"], " ", -1))
        left = F.when(tail < F.length(t["head"]), F.length(t["head"]) - tail - 1).otherwise(middle)
        right = F.when(t["ahead"] > 0, middle - reach + t["ahead"] - 1).otherwise(middle)
        return let(F.struct(left.alias("l"), right.alias("r")), lambda x: F.when(F.abs(x["l"] - middle) <= F.abs(x["r"] - middle), x["l"]).otherwise(x["r"]))

    def asked(m: Column) -> Column:
        return F.struct(m.alias("middle"), F.substring(c, F.lit(1), m + reach).alias("head"), F.instr(F.substring(c, m - reach + 1, F.length(c)), F.lit(" ")).alias("ahead"))

    cut = lambda k: F.concat(strip(F.substring(c, F.lit(1), k)), F.lit("\n"), strip(F.substring(c, k + 1, F.length(c))))
    broken = let(F.floor(F.length(c) / 2).cast("int"), lambda m: let(let(asked(m), place), cut))
    return F.when(F.length(c) > at, broken).otherwise(c)


def starts_rtl(c: Column) -> Column:
    return F.regexp_like(c, F.lit(rf"^[^\p{{L}}]*[{_ARABIC}]"))


def mark_rtl(c: Column) -> Column:
    """Right-to-left embedding marks round texts that begin in an Arabic block."""
    return F.when(starts_rtl(c), F.concat(F.lit(RTL_OPEN), c, F.lit(RTL_CLOSE))).otherwise(c)


def space_lines(c: Column, spacing: int, spacer: str = "\u00a0") -> Column:
    """A spacer row between text lines when ``spacing`` is over 0."""
    return F.array_join(F.split(c, "\n", -1), f"\n{spacer}\n") if spacing > 0 else c


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def strip_playlist_params(url: Column) -> Column:
    """Playlist parameters leave the query of video-site addresses."""
    query, base = F.regexp_extract(url, r"\?([^#]*)", 1), F.regexp_replace(url, r"\?[^#]*", "")
    kept = F.array_join(F.filter(F.split(query, "&", -1), lambda p: ~F.regexp_like(p, F.lit(r"^(list|index|start_radio)(=|$)")) & (p != "")), "&")
    site = F.regexp_like(url, F.lit(r"(?i)^https?://([a-z0-9-]+\.)*(youtube\.com|youtu\.be)([/?:]|$)"))
    return F.when(site & F.contains(url, F.lit("?")), F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))).otherwise(url)


def cut_text(c: Column, most: int, mark: str = "") -> Column:
    """At most ``most`` characters, with ``mark`` after a cut."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def initial_prompt(title: Column, description: Column, tags: Column) -> Column:
    """Title, first paragraph up to 200 characters and up to 15 tags; at most 800 characters, null when empty."""
    first = F.substring(strip(F.get(F.split(description, r"\n\s*\n"), F.lit(0))), 1, 200)
    listed = F.array_join(F.slice(tags, 1, 15), ", ")
    said = F.filter(F.array(title, first, listed), lambda x: x.isNotNull() & (strip(x) != ""))
    return F.when(F.size(said) > 0, F.substring(F.array_join(said, ". "), 1, 800))


def keyterms(c: Column, most: int = 100) -> Column:
    return F.slice(F.filter(F.transform(F.split(c, r"[.,;|]+", -1), strip), lambda x: x != ""), 1, most)


def range_index(c: Column) -> Column:
    """``a-b`` (hyphen or en dash) as ``(a, b)``; null otherwise."""
    # Fixed value: how models write a range of numbers.
    pattern = r"^(\d+)\s*[-–]\s*(\d+)$"
    return F.when(F.regexp_like(c, F.lit(pattern)), F.struct(F.regexp_extract(c, pattern, 1).cast("bigint").alias("a"), F.regexp_extract(c, pattern, 2).cast("bigint").alias("b")))


def db_to_amp(c: Column) -> Column:
    return F.pow(F.lit(10.0), c / 20.0)


def artifact_name(idx: Column) -> Column:
    """``seg_<label>.wav``, labels filled to 4 places and never cut."""
    return F.concat(F.lit("seg_"), F.when(F.length(idx) < 4, F.lpad(idx, 4, "0")).otherwise(idx), F.lit(".wav"))


def thumb_name(n: Column, seconds: Column) -> Column:
    return F.concat(F.lit("thumb_"), F.lpad(n.cast("string"), 3, "0"), F.lit("_"), F.format_string("%.1f", seconds), F.lit("s.jpg"))


def effective_source_language(source: Column, dialect: Column) -> Column:
    return F.when((source == "auto") & (F.coalesce(dialect, F.lit("")) != ""), dialect).otherwise(source)


def loose_json(c: Column) -> Column:
    """The outermost JSON array in a model's answer, code fences gone; null where there is none."""
    body = F.regexp_replace(c, r"(?m)^\s*```[a-z]*\s*$", "")
    found = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


#: A word, or the end of one from a word boundary on, said three times or more; the last time may go on after a word
#: boundary.  Words that end in a letter have a boundary after each time, others only after the last one.
_REPEATED_WORD = r"(?U)\b(?=\S{1,1000}+(?!\S))(\S++)(?:(?:\s++\1\b){2,}+|(?:\s++\1(?=\s))++\s++\1\b)"


def clean_asr_text(c: Column, collapse_digits: bool = True) -> Column:
    """Phantom captions out; a character or word said three times or more, once; white space to one space.

    A run of repeats is folded as it is read, however long: nothing once taken is given back.  Repeated words of more than a
    thousand signs stay.
    """
    out = F.regexp_replace(c, PHANTOM, "")
    # Fixed value: a sign said three times or more.
    out = F.regexp_replace(out, r"(.)\1{2,}" if collapse_digits else r"(\D)\1{2,}", "$1")
    out = F.regexp_replace(out, _REPEATED_WORD, "$1")
    return strip(F.regexp_replace(out, rf"{WS}{{2,}}", " "))


def clean_llm_text(c: Column) -> Column:
    """Time tags, length hints, arrows, wrapper tags, code fences and a leading number out of a model's line."""
    # The patterns that are taken out of a line, in order.
    out = F.regexp_replace(c, r"\[\d{1,2}(?::\d{2}){1,2}(?:[.,]\d+)?\]", "")
    out = F.regexp_replace(out, r"(?i)\[duration:\s*[\d.]+s?\s*\|\s*target:\s*~?\d+\s*words?\]", "")
    out = F.regexp_replace(out, r"\d{2}:\d{2}:\d{2},\d{3}\s*-->\s*\d{2}:\d{2}:\d{2},\d{3}", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{TAGS})>", "")
    out = F.regexp_replace(out, r"```(?:json|srt|text)?", "")
    out = strip(F.regexp_replace(out, rf"{WS}{{2,}}", " "))
    return strip(F.regexp_replace(out, r"^\d+[.:]\s+", ""))


def clean_llm_text_within(c: Column) -> Column:
    """:func:`clean_llm_text` for use within lambdas, where every pattern costs: one tells whether a line has anything to take out."""
    marked = rf"[\[<]|-->|```|{WS}{{2}}|^{WS}*\d+[.:]"
    return F.when(F.regexp_like(c, F.lit(marked)), clean_llm_text(c)).otherwise(strip(c))


def safe_edit(original: Column, corrected: Column) -> Column:
    """Whether a correction may stand: not blank, and of like length (up to 30 for originals of 5 or fewer)."""
    a, b = F.length(original), F.length(corrected)
    return F.coalesce((strip(corrected) != "") & F.when(a <= 5, b <= 30).otherwise((b * 3 >= a) & (b <= a * 3)), F.lit(False))


def word_budget(seconds: Column, rate: Column, share: float = 0.85, least: int = 4) -> Column:
    return F.greatest(F.lit(least), F.bround(seconds * rate * share, 0).cast("int"))
