"""Ordered folds: scans whose state depends on what they kept before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CAPTION_MARKS, DISPLAY_MARKS, LONG_END, strip, word_count, words
from ..functions.text import let as _let
from ..runtime import ship_package
from .intervals import timed_pieces
from .ranges import WIDTH, entries, range_of, with_entries, with_neighbours

_MARK = "\x01"


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[object], object], step: Callable, column: str, kind: str) -> DataFrame:
    """``df`` with ``column``: what ``step(state, row) -> (state, value)`` gives along ``order`` within ``keys``, from ``start(first row)`` on.

    Rows are sorted in each task and streamed through the fold, so a very long group needs no more memory than a batch.
    """
    ship_package(df.sparkSession)
    plain = {c: c.lstrip("_") for c in df.columns}
    by = [plain[k] for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = None, None
        for batch in batches:
            out = []
            for row in batch.rename(columns=plain).itertuples(index=False):
                here = tuple(getattr(row, k) for k in by)
                if here != at:
                    state, at = start(row), here
                state, value = step(state, row)
                out.append(value)
            yield batch.assign(**{column: out})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{names}, `{column}` {kind}")


def merge_long(cues: DataFrame, least: float = 8.0, most: float = 30.0, pause: float = 0.3, keys: tuple[str, ...] = ("media_id", "track"), width: int = WIDTH) -> DataFrame:
    """Chunks of ``least`` to ``most`` seconds that end at sentence ends or pauses.

    Blank cues are left out but still count as the next cue; ``quiet_after`` (boolean, optional) marks cues followed by silence.
    A long medium is folded in ranges of ``width`` cue numbers, each in a task of its own that knows which chunk is open where it begins.
    """
    keys = list(keys)
    silent = F.col("quiet_after") if "quiet_after" in cues.columns else F.lit(False)
    closes = F.col("__ends") | F.coalesce(F.round(F.col("after.start") - F.col("end"), 6) >= pause, F.lit(False)) | F.coalesce(silent, F.lit(False))
    # What is asked of texts is asked before the windows: entries are found without carrying them.
    asked = cues.withColumns({"__ends": F.right(strip(F.col("text")), F.lit(1)).isin(*LONG_END), "__said": strip(F.col("text")) != ""})
    near = with_neighbours(asked, keys, "seq", lead=["start"], width=width)
    rows = near.withColumn("closes", closes).where("__said").select(*keys, "__b", "seq", "start", "end", "text", "closes")

    def follow(cols, value, at, own):
        end, ends = cols["end"], cols["closes"]
        for j in range(at, len(end)):
            length = round(end[j] - value, 6)
            if length > most and not (own and j == at):
                return j
            if length >= least and ends[j]:
                return j + 1
        return None

    def reach(cols, begins):
        return next((j + 1 for j, e in enumerate(cols["end"]) if round(e - begins[0], 6) > most), len(begins))

    rows = with_entries(rows, keys, entries(rows, keys, ["seq"], "start", ["end", "closes"], follow, reach))

    def step(state, row):
        begun, number = state
        if begun is not None and round(row.end - begun, 6) > most:
            begun = None
        if begun is None:
            begun, number = row.start, number + 1
        done = round(row.end - begun, 6) >= least and row.closes
        return (None if done else begun, number), number

    entered = lambda row: (None if row.begun is None or row.begun != row.begun else row.begun, int(row.items) - 1)
    numbered = ordered_fold(rows, [*keys, "__b"], ["seq"], entered, step, "chunk_no", "bigint")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", strip(F.col("text")).alias("t")))), lambda x: x["t"]), " ")
    return numbered.groupBy(*keys, "chunk_no").agg(F.count("*").alias("n_cues"), F.min_by("start", "seq").alias("start"), F.max_by("end", "seq").alias("end"), texts.alias("text"))


def dedup_min_gap(picks: DataFrame, gap: float = 5.0, keys: tuple[str, ...] = ("media_id",), column: str = "seconds", tie: str = "i", seconds: float = 36_000.0) -> DataFrame:
    """Picks at least ``gap`` seconds after the last one kept; a long medium in ranges of ``seconds``, each in a task of its own."""
    keys = list(keys)

    def step(last, row):
        at = getattr(row, column)
        keep = last is None or at - last >= gap
        return (at if keep else last), keep

    def follow(cols, value, at, own):
        return next((j for j in range(at + own, len(cols[column])) if cols[column][j] - value >= gap), None)

    def reach(cols, begins):
        return next((j + 1 for j, x in enumerate(begins) if x - begins[0] >= gap), len(begins))

    ranged = picks.withColumn("__b", range_of(column, seconds))
    rows = with_entries(ranged, keys, entries(ranged, keys, [column, tie], column, [column], follow, reach))
    entered = lambda row: None if row.begun is None or row.begun != row.begun else row.begun
    kept = ordered_fold(rows, [*keys, "__b"], [column, tie], entered, step, "__keep", "boolean")
    return kept.where("__keep").select(*picks.columns)


def pack(parts: Column, most: int | Column) -> Column:
    """Parts joined by spaces as long as a piece has at most ``most`` characters; a longer part is a piece alone."""
    limit = F.lit(most) if isinstance(most, int) else most
    full = lambda a, x: F.length(a["buf"]) + 1 + F.length(x) > limit
    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("buf"))
    step = lambda a, x: F.when(a["buf"].isNull(), F.struct(a["out"].alias("out"), x.alias("buf"))).when(full(a, x), F.struct(F.concat(a["out"], F.array(a["buf"])).alias("out"), x.alias("buf"))).otherwise(F.struct(a["out"].alias("out"), F.concat(a["buf"], F.lit(" "), x).alias("buf")))
    return F.aggregate(F.filter(parts, lambda x: x != ""), none, step, lambda a: F.when(a["buf"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["buf"]))))


def pack_words(text: Column, most: int | Column) -> Column:
    return pack(words(text), most)


def _marked(text: Column, patterns: list[tuple[str, str]]) -> Column:
    for pattern, put in patterns:
        text = F.regexp_replace(text, pattern, put)
    return F.transform(F.split(text, _MARK, -1), strip)


def _sentences(text: Column, marks: str) -> Column:
    return _marked(text, [(marks, f"$1{_MARK}")])


def _clauses(text: Column, marks: str) -> Column:
    return _marked(text, [(rf"([{marks}])\s+", f"$1{_MARK}"), (r"\s+—", f"{_MARK}—"), (r"—\s*", f"—{_MARK}")])


def pack_sentences(text: Column, most: int = 300) -> Column:
    """Whole sentences packed; one that is too long alone is packed by clauses."""
    again = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(pack(_clauses(s, ";"), most))
    return F.flatten(F.transform(pack(_sentences(text, CAPTION_MARKS), most), again))


def pack_display(text: Column, most: int = 120) -> Column:
    """Sentences, then clauses, then words, packed; texts that fit stay whole."""
    by_words = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(pack_words(s, most))
    by_clause = lambda s: F.when(F.length(s) <= most, F.array(s)).otherwise(F.flatten(F.transform(pack(_clauses(s, ",;،"), most), by_words)))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.flatten(F.transform(pack(_sentences(text, DISPLAY_MARKS), most), by_clause)))


def shared_seconds(counts: list[int], total: float, least: float = 1.0, most: float = 30.0) -> list[float]:
    """Seconds of pieces by their words, held between ``least`` and ``most`` over up to five rounds, then scaled to ``total``: the plain form of :func:`share_seconds`."""
    weight = [max(1, int(n)) for n in counts]
    out, fixed = [total * w / sum(weight) for w in weight], [False] * len(weight)
    for _ in range(5):
        excess, free = 0.0, 0
        for k, seconds in enumerate(out):
            if fixed[k]:
                continue
            held = min(max(seconds, least), most)
            if held != seconds:
                excess, out[k], fixed[k] = excess + seconds - held, held, True
            else:
                free += weight[k]
        if abs(excess) < 0.001 or not free:
            break
        out = [s if f else s + excess * w / free for s, f, w in zip(out, fixed, weight, strict=True)]
    if abs(sum(out) - total) > 0.001 and sum(out) > 0:
        out = [s * total / sum(out) for s in out]
    return out


def share_seconds(counts: Column, total: Column, least: float = 1.0, most: float = 30.0) -> Column:
    """:func:`shared_seconds` of a column of counts: five rounds over an array of (seconds, weight, fixed).

    Where the first shares lie within the bounds no round changes them.
    """
    row = lambda s, w, f: F.struct(s.alias("s"), w.alias("w"), f.alias("f"))
    add = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda a, x: a + f(x))

    def spread(marked: Column) -> Column:
        excess, free = add(marked, lambda x: x["over"]), add(marked, lambda x: F.when(x["f"], 0.0).otherwise(x["w"]))
        both = _let(F.struct(excess.alias("e"), free.alias("w")), lambda t: F.transform(marked, lambda x: row(F.when(~x["f"] & (F.abs(t["e"]) >= 0.001) & (t["w"] > 0), x["s"] + t["e"] * x["w"] / t["w"]).otherwise(x["s"]), x["w"], x["f"])))
        return both

    def round_of(rows: Column) -> Column:
        held = lambda x: F.when(x["f"], x["s"]).otherwise(F.least(F.greatest(x["s"], F.lit(least)), F.lit(most)))
        marked = F.transform(rows, lambda x: F.struct(held(x).alias("s"), x["w"].alias("w"), (x["f"] | (held(x) != x["s"])).alias("f"), (x["s"] - held(x)).alias("over")))
        return _let(marked, spread)

    weights = F.transform(counts, lambda n: F.greatest(n.cast("double"), F.lit(1.0)))
    begun = _let(weights, lambda w: _let(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), lambda all_: F.transform(w, lambda x: row(total * x / all_, x, F.lit(False)))))
    rounds = lambda rows: F.aggregate(F.sequence(F.lit(1), F.lit(5)), rows, lambda rows, _: round_of(rows))
    within = lambda rows: F.coalesce(F.forall(rows, lambda x: (x["s"] >= least) & (x["s"] <= most)), F.lit(False))
    done = F.transform(_let(begun, lambda rows: F.when(within(rows), rows).otherwise(rounds(rows))), lambda x: x["s"])
    scaled = lambda out: _let(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), lambda sum_: F.when((F.abs(sum_ - total) > 0.001) & (sum_ > 0), F.transform(out, lambda x: x * total / sum_)).otherwise(out))
    return F.when(F.size(counts) > 0, _let(done, scaled)).otherwise(F.array().cast("array<double>"))


def distribute_words(parents: DataFrame, pieces: str = "pieces", least: float = 1.0, most: float = 30.0) -> DataFrame:
    """Parents ``(…, start, end, pieces array<string>)`` to pieces with ``piece_no, piece, piece_start, piece_end``; a single piece keeps the span."""
    total = F.col("end") - F.col("start")
    # Most parents are a piece alone, whose words needn't be counted; of others they are counted once.
    shared = _let(F.transform(pieces, word_count), lambda counts: share_seconds(counts, total, least, most))
    seconds = F.when((F.size(pieces) == 1) & total.isNotNull(), F.array(total.cast("double"))).otherwise(shared)
    timed = parents.withColumn("__s", seconds).select(*[c for c in parents.columns if c != pieces], F.posexplode(F.arrays_zip(F.col(pieces).alias("p"), F.col("__s").alias("d"))).alias("piece_no", "__x"), "__s")
    upto = F.aggregate(F.slice("__s", F.lit(1), F.col("piece_no") + 1), F.lit(0.0), lambda a, x: a + x)
    last = F.col("piece_no") == F.size("__s") - 1
    return timed.withColumns({"piece": F.col("__x.p"), "piece_start": F.col("start") + upto - F.col("__x.d"), "piece_end": F.when(last, F.col("end")).otherwise(F.col("start") + upto)}).drop("__x", "__s")


def word_chunks(spoken: list, most_chars: int, most_seconds: float) -> list[tuple[float, float, str]]:
    """``(start, end, text)`` of timed words, cut at the widest pause seen before a limit is passed.

    A pause counts once two words stand before it; words kept after such a cut are not weighed again.  Untimed words join
    those before them and never cause a cut; a chunk that ends in one ends where it starts if nothing else is known.  The plain form of :func:`spoken_chunks`.
    """
    out, hold, cut, widest = [], [], 0, -1.0
    text_of = lambda part: " ".join(w["word"] or "" for w in part).strip()
    start_of = lambda part: next((w["start"] for w in part if w["start"] is not None), None)

    def put(part):
        begun = start_of(part)
        out.append((begun, part[-1]["end"] if part[-1]["end"] is not None else begun, text_of(part)))

    for word in spoken:
        if word["start"] is None or word["end"] is None:
            hold.append(word)
            continue
        begun = start_of(hold)
        over = text_of(hold) != "" and (len(text_of([*hold, word])) > most_chars or word["end"] - (word["start"] if begun is None else begun) > most_seconds)
        if over:
            stop = cut if cut > 1 else len(hold)
            put(hold[:stop])
            hold, cut, widest = [*hold[stop:], word], 0, -1.0
            continue
        if hold and hold[-1]["end"] is not None and word["start"] - hold[-1]["end"] > widest:
            cut, widest = len(hold), word["start"] - hold[-1]["end"]
        hold.append(word)
    if text_of(hold):
        put(hold)
    return out


_WORD, _CHUNK = "struct<word:string,start:double,end:double>", "struct<a:double,b:double,t:string>"


def spoken_chunks(spoken: Column, most_chars: int = 84, most_seconds: float = 5.0) -> Column:
    """:func:`word_chunks` of ``array<struct<word,start,end>>``, as ``array<struct<a,b,t>>``: a fold whose state is what is out, what is held, and the widest pause."""
    text_of = lambda part: strip(F.array_join(F.transform(part, lambda w: F.coalesce(w["word"], F.lit(""))), " "))
    start_of = lambda part: F.get(F.filter(F.transform(part, lambda w: w["start"]), lambda x: x.isNotNull()), F.lit(0))
    end_of = lambda part: F.get(part, F.size(part) - 1)["end"]
    chunk = lambda part: F.struct(start_of(part).alias("a"), F.coalesce(end_of(part), start_of(part)).alias("b"), text_of(part).alias("t"))
    put = lambda out, part: F.concat(out, F.array(_let(part, chunk)))
    state = lambda out, hold, cut, widest: F.struct(out.alias("out"), hold.alias("hold"), cut.alias("cut"), widest.alias("widest"))
    none = state(F.array().cast(f"array<{_CHUNK}>"), F.array().cast(f"array<{_WORD}>"), F.lit(0), F.lit(-1.0))

    def step(s: Column, w: Column) -> Column:
        both = F.concat(s["hold"], F.array(w))
        over = (text_of(s["hold"]) != "") & ((F.length(text_of(both)) > most_chars) | (w["end"] - F.coalesce(start_of(s["hold"]), w["start"]) > most_seconds))
        stop = F.when(s["cut"] > 1, s["cut"]).otherwise(F.size(s["hold"]))
        rest = F.concat(F.slice(s["hold"], stop + 1, F.size(s["hold"])), F.array(w))
        pause = F.coalesce(w["start"] - end_of(s["hold"]), F.lit(-1.0))
        wider = pause > s["widest"]
        kept = state(s["out"], both, F.when(wider, F.size(s["hold"])).otherwise(s["cut"]), F.when(wider, pause).otherwise(s["widest"]))
        closed = state(put(s["out"], F.slice(s["hold"], F.lit(1), stop)), rest, F.lit(0), F.lit(-1.0))
        untimed = w["start"].isNull() | w["end"].isNull()
        return F.when(untimed, state(s["out"], both, s["cut"], s["widest"])).when(over, closed).otherwise(kept)

    last = lambda s: F.when(text_of(s["hold"]) != "", put(s["out"], s["hold"])).otherwise(s["out"])
    given = F.coalesce(spoken.cast(f"array<{_WORD}>"), F.array().cast(f"array<{_WORD}>"))
    sound = F.forall(given, lambda w: w["start"].isNotNull() & w["end"].isNotNull() & (w["word"] != "") & (strip(w["word"]) == w["word"]))
    return F.when(F.coalesce(sound, F.lit(False)), _let(given, lambda words: _sound_chunks(words, most_chars, most_seconds))).otherwise(F.aggregate(given, none, step, last))


def _sound_chunks(spoken: Column, most_chars: int, most_seconds: float) -> Column:
    """:func:`spoken_chunks` where every word has its times and no white space beside it: lengths add up, so the fold holds numbers in place of words.

    Its state is where the open chunk begins, its characters and start, the end of the last word, and the stops so far.
    """
    plain = F.transform(spoken, lambda w, i: F.struct(i.alias("i"), w["start"].alias("a"), w["end"].alias("b"), F.length(w["word"]).alias("n")))
    join = lambda part: F.array_join(F.transform(part, lambda w: w["word"]), " ")
    chunk = lambda part: F.struct(F.get(part, F.lit(0))["start"].alias("a"), F.get(part, F.size(part) - 1)["end"].alias("b"), join(part).alias("t"))
    state = lambda at, chars, start, end, cut, widest, stops: F.struct(at.alias("at"), chars.alias("chars"), start.alias("start"), end.alias("end"), cut.alias("cut"), widest.alias("widest"), stops.alias("stops"))
    real = F.lit(None).cast("double")
    none = state(F.lit(0), F.lit(-1), real, real, F.lit(0), F.lit(-1.0), F.array().cast("array<int>"))

    def step(s: Column, w: Column) -> Column:
        held, chars = w["i"] - s["at"], s["chars"] + 1 + w["n"]
        over = (held > 0) & ((chars > most_chars) | (w["b"] - s["start"] > most_seconds))
        stop = F.when(s["cut"] > 1, s["at"] + s["cut"]).otherwise(w["i"])
        rest = lambda z: F.aggregate(F.slice(spoken, z + 1, w["i"] - z + 1), F.lit(-1), lambda n, x: n + 1 + F.length(x["word"]))
        closed = _let(stop, lambda z: state(z, rest(z), F.get(spoken, z)["start"], w["b"], F.lit(0), F.lit(-1.0), F.concat(s["stops"], F.array(z))))
        pause = F.coalesce(w["a"] - s["end"], F.lit(-1.0))
        wider = pause > s["widest"]
        kept = state(s["at"], chars, F.coalesce(s["start"], w["a"]), w["b"], F.when(wider, held).otherwise(s["cut"]), F.when(wider, pause).otherwise(s["widest"]), s["stops"])
        return F.when(over, closed).otherwise(kept)

    def cut(stops: Column) -> Column:
        begin = lambda k: F.when(k > 0, F.get(stops, k - 1)).otherwise(F.lit(0))
        return F.transform(stops, lambda z, k: _let(F.slice(spoken, begin(k) + 1, z - begin(k)), chunk))

    stops = F.aggregate(plain, none, step, lambda s: F.concat(s["stops"], F.array(F.size(spoken))))
    first, latest = F.get(spoken, F.lit(0))["start"], F.array_max(F.transform(spoken, lambda w: w["end"]))
    fits = (F.length(join(spoken)) <= most_chars) & (latest - first <= most_seconds)
    # What fits as a whole is one chunk, whatever its pauses.
    return F.when(F.size(spoken) == 0, F.array().cast(f"array<{_CHUNK}>")).when(fits, F.array(chunk(spoken))).otherwise(_let(stops, cut))


def split_by_words(segments: DataFrame, most_chars: int = 84, most_seconds: float = 5.0) -> DataFrame:
    """Segments with ``words array<struct<word,start,end>>`` to rows ``(…, piece_no, piece_start, piece_end, piece)``; segments run apart."""
    keep = [c for c in segments.columns if c != "words"]
    return segments.select(*keep, F.posexplode(spoken_chunks(F.col("words"), most_chars, most_seconds)).alias("piece_no", "x")).select(*keep, "piece_no", F.col("x.a").alias("piece_start"), F.col("x.b").alias("piece_end"), F.col("x.t").alias("piece"))


def split_proportional(segments: DataFrame, keys: list[str], most_chars: int = 84) -> DataFrame:
    """Segments cut by words, pieces timed by their share of the text's characters."""
    parts = segments.select("*", F.posexplode(pack_words(F.col("text"), most_chars)).alias("piece_no", "piece"))
    return timed_pieces(parts, keys, F.length("piece"), F.greatest(F.length("text"), F.lit(1)))


def proportional_chunks(text: Column, start: Column, end: Column, most_chars: int = 84) -> Column:
    """A text cut by words as ``array<struct<a,b,t>>``, pieces timed by their share of its characters; the last ends with it."""
    total = F.greatest(F.length(text), F.lit(1))

    def timed(pieces: Column) -> Column:
        share = lambda p: (end - start) * F.length(p) / total
        upto = lambda i: start + F.aggregate(F.slice(pieces, F.lit(1), i + 1), F.lit(0.0), lambda a, p: a + share(p))
        return F.transform(pieces, lambda p, i: F.struct(F.least(upto(i) - share(p), end).alias("a"), F.when(i == F.size(pieces) - 1, end).otherwise(F.least(upto(i), end)).alias("b"), p.alias("t")))

    return _let(pack_words(text, most_chars), timed)


def resegment_asr(segments: DataFrame, keys: list[str], most_chars: int = 84, most_seconds: float = 5.0) -> DataFrame:
    """Recogniser segments made caption-sized: short ones stay, timed ones split at pauses, others by share of characters.

    Each row picks its rule, so segments are read and taken apart once.
    """
    fits = (F.length(strip(F.col("text"))) <= most_chars) & (F.col("end") - F.col("start") <= most_seconds)
    timed = (F.size("words") > 0) & F.forall("words", lambda x: x["start"].isNotNull() & x["end"].isNotNull())
    start, end = F.col("start").cast("double"), F.col("end").cast("double")
    short = F.array(F.struct(start.alias("a"), end.alias("b"), strip(F.col("text")).alias("t")))
    pieces = F.when(fits, short).when(F.coalesce(timed, F.lit(False)), spoken_chunks(F.col("words"), most_chars, most_seconds)).otherwise(proportional_chunks(F.col("text"), start, end, most_chars))
    return segments.select(*keys, F.posexplode(pieces).alias("piece_no", "x")).select(*keys, "piece_no", F.col("x.a").alias("piece_start"), F.col("x.b").alias("piece_end"), F.col("x.t").alias("piece"))


def resegment_captions(phrases: DataFrame, keys: list[str], most_chars: int = 300, answers: DataFrame | None = None) -> DataFrame:
    """Phrases over ``most_chars`` cut into pieces and timed by words; others stay.

    ``answers (*keys, pieces)`` are used where their joined text is the phrase's, double spaces aside; else the rule is.
    """
    rows = phrases.join(answers.withColumnRenamed("pieces", "__a"), keys, "left") if answers is not None else phrases.withColumn("__a", F.lit(None).cast("array<string>"))
    plain = lambda c: strip(F.regexp_replace(c, r"\s+", " "))
    accepted = F.coalesce(plain(F.array_join("__a", " ")) == plain(F.col("text")), F.lit(False))
    pieces = F.when(F.length("text") <= most_chars, F.array("text")).when(accepted, F.col("__a")).otherwise(pack_sentences(F.col("text"), most_chars))
    return distribute_words(rows.withColumn("pieces", pieces).select(*keys, "start", "end", "pieces"))


def split_for_display(cues: DataFrame, keys: list[str], most: int = 120) -> DataFrame:
    """Captions over ``most`` characters, white space collapsed, cut for display; pieces timed by characters, half a second each at least.

    Captions that fit stay as they are, with their line breaks and times.
    """
    flat = strip(F.regexp_replace("text", r"[\s\p{Z}]+", " "))
    pieces = F.when(F.length("__flat") > most, pack_display(F.col("__flat"), most)).otherwise(F.array("text"))
    parts = cues.withColumn("__flat", flat).select(*keys, "start", "end", F.posexplode(pieces).alias("piece_no", "piece"))
    return timed_pieces(parts, keys, F.length("piece"), least=0.5, force_last=False)
