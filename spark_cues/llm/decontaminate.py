"""Benchmark decontamination by template canonicalisation and slot consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, materialize

WINDOW, SIMILARITY = 5, 0.8
#: Items of fewer words than a window, but at least so many, are looked for as they stand.
SHORT = 4
# Words that are written as a unit.
UNITS = (
    "mm", "cm", "km", "mg", "kg", "ml", "cl", "mph", "kmh", "lb", "lbs", "oz", "ft", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre",
    "kilometres", "gram", "grams", "kilogram", "kilograms", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
)
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
#: Benchmarks of up to this many windows and bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Word pairs that a first look at each text may ask for; a benchmark that needs more does without that look.
PROBES = 20_000
_NONE = -(1 << 63)
#: A capitalised word after a letter, digit, comma or semicolon and one space: inside a sentence.
_NAME = r"(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)"
#: A capitalised word anywhere, also where a text or a sentence begins; and one that only this pattern takes.
_ANY_NAME = r"(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}+)"
_INITIAL = r"(?<![\p{L}\p{N}])(?<![\p{L}\p{N},;] )\p{Lu}\p{Ll}"
#: Between words.  A point or comma between digits is part of a number: 1,500 and 3.5 are one word each.
#: Runs need no group of their own, whose repeats would each take a frame of the stack: empty pieces are dropped.
_APART = r"[^\p{L}\p{N}<>.,]++|(?<![0-9])[.,]|[.,](?![0-9])"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _APART, -1), lambda x: x != "")


def _canonical(words: Column) -> Column:
    """Numbers (words that start with a digit) and units become placeholders; names are marked before."""
    return F.transform(words, lambda x: F.when((x >= "0") & (x < ":"), NUMBER).when(x.isin(*UNITS), UNIT).otherwise(x))


def named_template(text: Column) -> Column:
    """Numbers, units and capitalised words inside sentences as placeholders."""
    return _canonical(_words(F.lower(F.regexp_replace(text, _NAME, NAME))))


def initial_template(text: Column) -> Column:
    """As the named template, with capitalised words that begin a text or a sentence as names too."""
    return _canonical(_words(F.lower(F.regexp_replace(text, _ANY_NAME, NAME))))


_ROW = "struct<h:bigint,slots:array<string>,own:boolean>"


def _windows(template: Column, raw: Column, least: int = WINDOW) -> Column:
    """``(h, slots, own)`` of every window of five template words: its hash, the words behind its placeholders, and whether it has a word of its own.

    ``slots`` has a place for each word of the window, null where the template has the word itself; it is null
    where there is no placeholder at all.  A window of placeholders alone, which any run of numbers would fill, is hashed by
    its own words and has no slots.  A shorter text is one window of what it has.
    """
    hashed = lambda t, i: F.xxhash64(*[F.get(t, i + k) for k in range(WINDOW)])
    none = F.lit(None).cast("array<string>")

    def bound_window(t: Column, r: Column, slots: Column, i: Column) -> Column:
        held, own = (lambda v: F.exists(v, lambda x: x.isNotNull())), (lambda v: F.exists(v, lambda x: x.isNull()))
        row = lambda v: F.when(own(v), F.struct(hashed(t, i).alias("h"), F.when(held(v), v).alias("slots"), F.lit(True).alias("own"))).otherwise(F.struct(hashed(r, i).alias("h"), none.alias("slots"), F.lit(False).alias("own")))
        return F.transform(F.array(F.slice(slots, i + 1, F.lit(WINDOW))), row)[0]

    def rows(x: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(x["t"]) - WINDOW, F.lit(0)))
        plain = F.transform(places, lambda i: F.struct(hashed(x["t"], i).alias("h"), none.alias("slots"), F.lit(True).alias("own")))
        values = F.zip_with(x["t"], x["r"], lambda t, r: F.when(t.isin(NUMBER, UNIT, NAME), r))
        bound = lambda v: F.transform(places, lambda i: bound_window(x["t"], x["r"], v, i))
        slotted = F.transform(F.array(values), bound)[0]
        return F.when(F.size(x["t"]) < least, F.array().cast(f"array<{_ROW}>")).when(F.exists(x["t"], lambda t: t.isin(NUMBER, UNIT, NAME)), slotted).otherwise(plain)

    # The template is bound once, as a lambda's argument, not evaluated again for each window.
    return F.transform(F.array(F.struct(template.alias("t"), raw.alias("r"))), rows)[0]


_PLACED = "struct<pos:int,h:bigint,slots:array<string>,own:boolean>"


def _placed(windows: Column) -> Column:
    """Windows with their places."""
    return F.transform(windows, lambda w, i: F.struct(i.alias("pos"), w["h"].alias("h"), w["slots"].alias("slots"), w["own"].alias("own")))


def _exploded(rows: DataFrame, keep: list[str], lengths: list[int], least: int = 1) -> DataFrame:
    """``(keep, channel, pos, h, slots, own)``: plain templates in channel 0, named ones of texts with names in channel 1, and those with initial names in channel 2.

    Channels 1 and 2 have no windows of placeholders alone.  Further channels, numbered by length, hold
    the runs of so many words that ``lengths`` asks for.
    """
    text, raw = F.col("text"), F.col("__raw")
    nothing = F.array().cast(f"array<{_PLACED}>")
    own = lambda windows: F.filter(_placed(windows), lambda w: w["own"])
    channel = lambda n, w: F.struct(F.lit(n).alias("channel"), w.alias("windows"))
    channels = [
        channel(0, _placed(_windows(_canonical(raw), raw, least))),
        channel(1, F.when(F.regexp_like(text, F.lit(_NAME)), own(_windows(named_template(text), raw, least))).otherwise(nothing)),
        channel(2, F.when(F.regexp_like(text, F.lit(_INITIAL)), own(_windows(initial_template(text), raw, least))).otherwise(nothing)),
    ]
    channels += [channel(n, _placed(_runs(raw, n))) for n in lengths]
    # The words are a column of their own, so that a text is split once for all channels that need them.
    both = rows.withColumn("__raw", _words(F.lower(text))).select(*keep, F.explode(F.array(*channels)).alias("c"))
    return both.select(*keep, F.col("c.channel").alias("channel"), F.explode("c.windows").alias("w")).select(*keep, "channel", "w.pos", "w.h", "w.slots", "w.own")


def _runs(words: Column, n: int) -> Column:
    """Every run of ``n`` words as a window without slots."""
    run = lambda r: lambda i: F.struct(F.xxhash64(*[F.get(r, i + k) for k in range(n)]).alias("h"), F.lit(None).cast("array<string>").alias("slots"), F.lit(True).alias("own"))
    every = lambda r: F.when(F.size(r) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(r) - n, F.lit(0))), run(r))).otherwise(F.array().cast(f"array<{_ROW}>"))
    return F.transform(F.array(words), every)[0]


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, text_hash, item_id, matched, windows, coverage)`` for documents that hold a benchmark item.

    A window of five template words matches by hash; the share of an item's windows found in a document,
    by any of the templates and along alignments whose slots are consistent, must reach ``similarity``.  Slots are consistent
    if, over an alignment, each benchmark value stands for one document value and the other way round: copies
    and re-parameterised questions pass, texts that only share a shape don't.  Windows of placeholders alone don't count, unless
    an item has no others; they then match by their own words.  Items of four words are found wherever these
    words stand in a row; shorter ones only in a text of just these words.
    Null texts and null item ids match nothing; a null doc_id is carried; repeated rows give one result; empty
    tables give no rows.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("k"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    words = F.size(_words(F.lower("text")))
    lengths = sorted(r["n"] for r in items.select(words.alias("n")).where(F.col("n").between(SHORT, WINDOW - 1)).distinct().collect())
    every = _exploded(items.withColumn("__n", words), ["item", "__n"], lengths).where((F.col("channel") < SHORT) | (F.col("channel") == F.col("__n")))
    every = cut(every.select("item", "channel", F.col("pos").alias("b"), "h", F.col("slots").alias("asked"), "own"))
    plain = every.where("own").select("item").distinct()
    grams = cut(every.where("own").unionByName(every.join(plain, "item", "left_anti")).drop("own"))
    sizes = grams.groupBy("item").agg(F.count_distinct("b").alias("windows"))
    slots = F.coalesce(F.aggregate("asked", F.lit(0), lambda n, w: n + 16 + F.coalesce(F.length(w), F.lit(0))), F.lit(0))
    size = grams.agg(F.count("*").alias("rows"), F.sum(64 + 4 * slots).alias("bytes")).first()
    side = F.broadcast(grams) if size["rows"] <= BROADCAST_WINDOWS and (size["bytes"] or 0) <= BROADCAST_BYTES else grams
    probes = _probes(items, similarity)
    near = rows.where("text is not null") if probes is None else rows.where(_holds_a_probe(_words(F.lower("text")), probes))
    told = _exploded(near, ["k", "t"], lengths).drop("own")
    hits = materialize(told.join(side, ["channel", "h"]).select("k", "t", "item", "channel", "pos", "b", "asked", F.col("slots").alias("told")), "window-hits")
    enough = F.col("matched") >= F.lit(similarity) * F.col("windows")
    likely = hits.groupBy("k", "t", "item").agg(F.count_distinct("b").alias("matched")).join(sizes, "item").where(enough).select("k", "t", "item")
    kept = hits.join(likely, ["k", "t", "item"], "left_semi")
    found = kept.withColumn("d", F.col("pos") - F.col("b")).join(_broken(kept), ["k", "t", "item", "channel", "d"], "left_anti")
    out = found.groupBy("k", "t", "item").agg(F.count_distinct("b").alias("matched")).join(sizes, "item").where(enough)
    return out.select(F.when(F.col("k") != _NONE, F.col("k")).alias("doc_id"), F.col("t").alias("text_hash"), F.col("item").alias("item_id"), "matched", "windows", (F.col("matched") / F.col("windows")).alias("coverage"))


def _probes(items: DataFrame, similarity: float) -> list[int] | None:
    """Hashes of adjacent word pairs, at least one of which stands in every text of five words or more that holds an item; None if there is no such list.

    Of an item's windows more than ``1 - similarity`` are given a pair each, of words that no template replaces, so a text
    without any of the pairs lacks too many windows.  Long words are taken first, as they are rarer; the choice affects only
    how many texts are looked at closely.  Of an item id with several texts every window gets a pair.
    """
    words, masked = _words(F.lower("text")), initial_template(F.col("text"))
    texts = items.distinct().withColumn("__w", words).withColumn("__m", masked).where(F.size("__w") >= SHORT)
    n = F.size("__w")
    # Four words are looked for as they stand, and so are texts of placeholders alone.
    bare = (n < WINDOW) | ~F.exists("__m", lambda x: ~x.isin(NUMBER, UNIT, NAME))
    w = Window.partitionBy("item")
    texts = texts.withColumns({"windows": F.greatest(n - WINDOW + 1, F.lit(1)), "bare": bare, "one": F.count("*").over(w) == 1})
    wanted = F.when(F.col("one"), F.floor(F.col("windows") * (1 - similarity) + 1e-9) + 1).otherwise(F.col("windows"))
    texts = texts.withColumn("wanted", F.least(wanted, F.col("windows")))
    one = lambda a, i: F.get(a, i)
    pair = texts.select("item", "text", "windows", "wanted", "bare", "__w", "__m", F.explode(F.sequence(F.lit(0), n - 2)).alias("p"))
    p = F.col("p")
    whole = F.col("bare") | ((one("__w", p) == one("__m", p)) & (one("__w", p + 1) == one("__m", p + 1)))
    placed = pair.where(whole).select("item", "text", "windows", "wanted", F.xxhash64(one("__w", p), one("__w", p + 1)).alias("h"), (F.length(one("__w", p)) + F.length(one("__w", p + 1))).alias("size"), F.explode(F.sequence(F.greatest(p - (WINDOW - 2), F.lit(0)), F.least(p, F.col("windows") - 1))).alias("b"))
    best = placed.groupBy("item", "text", "wanted", "b").agg(F.max_by("h", F.struct("size", "h")).alias("h"), F.max("size").alias("size"))
    taken = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "text").orderBy(F.desc("size"), "b"))).where("rank <= wanted")
    taken = cut(taken.select("item", "text", "wanted", "h"))
    covered = taken.groupBy("item", "text").agg(F.count("*").alias("covered"))
    if not texts.join(covered, ["item", "text"], "left").where("coalesce(covered, 0) < wanted").isEmpty():
        return None
    found = [r["h"] for r in taken.select("h").distinct().limit(PROBES + 1).collect()]
    return found if len(found) <= PROBES else None


def _holds_a_probe(words: Column, probes: list[int]) -> Column:
    """Whether a text has one of the pairs, or is shorter than a window."""
    pairs = lambda w: F.exists(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)).isin(probes))
    known = (lambda w: (F.size(w) < WINDOW) | pairs(w)) if probes else (lambda w: F.size(w) < WINDOW)
    # Bound once, as a lambda's argument, so that the text is split once.
    return F.coalesce(F.transform(F.array(words), known)[0], F.lit(False))


def _broken(hits: DataFrame) -> DataFrame:
    """Alignments ``(k, t, item, channel, d)`` whose slot values don't map one to one."""
    group = ["k", "t", "item", "channel", "d"]
    pairs = hits.where("asked is not null").select("k", "t", "item", "channel", (F.col("pos") - F.col("b")).alias("d"), F.explode(F.arrays_zip("asked", "told")).alias("p"))
    distinct = pairs.where("p.asked is not null").select(*group, "p.asked", "p.told").distinct()
    return distinct.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct("asked").alias("a"), F.count_distinct("told").alias("b")).where("n <> a or n <> b").select(*group)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns unchanged."""
    found = find_contamination(docs, benchmark, similarity, id_col, text_col)
    bad = found.select(F.coalesce("doc_id", F.lit(_NONE)).alias("__k"), F.col("text_hash").alias("__t")).distinct()
    key = (F.coalesce(docs[id_col].cast("long"), F.lit(_NONE)) == bad["__k"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["__t"])
    return docs.join(bad.hint("shuffle_hash"), key, "left_anti")


def op8_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "matched", "windows", "coverage")


def _oracle_windows(table: str, key: str, text: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""select {key}, pos, w from (select {key}, unnest(range(1, greatest(len(t) - {WINDOW - 1}, 1) + 1)) as pos, t from (
        select {key}, list_transform(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}<>]+'), lambda x: x <> ''), lambda x: case when x >= '0' and x < ':' then '{NUMBER}' when x in ({units}) then '{UNIT}' else x end) as t from {table}
      ) where len(t) >= 1), lateral (select array_to_string(t[pos:pos + {WINDOW - 1}], ' ') as w)"""


#: Plain templates only: exact where texts have no names, numbers or units inside benchmark items.
ORACLE_SQL = f"""
with b as ({_oracle_windows('benchmark', 'item_id', 'text')}), d as ({_oracle_windows('documents', 'doc_id', 'text')}),
sizes as (select item_id, count(*) as windows from b group by item_id),
hits as (select doc_id, item_id, count(distinct b.pos) as matched from d join b using (w) group by doc_id, item_id)
select doc_id, item_id, matched, windows, matched / windows as coverage from hits join sizes using (item_id) where matched >= {SIMILARITY} * windows"""
