"""Cross-site boilerplate lines by HyperLogLog spread, with exact counts near the threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, materialize

#: A line on at least this many distinct sites is boilerplate.
SITES = 8
#: Lines of fewer words (gaps between words, plus one) are left alone.
MIN_WORDS = 5
#: The pipeline also takes lines of so many characters as long (scripts without spaces), and shorter ones on at least so many sites as boilerplate.
LONG_CHARS, SHORT_SITES = 20, 16
LOG_K = 12
#: Estimates within this share of the threshold, or one site, are counted exactly.
BAND = 0.15
#: Lines with this fraction of all occurrences, of which there can be no more than so many, are joined by broadcast.
FREQUENT = 1000
_NONE = -(1 << 63)


def _doc_key(id_col: str, text_col: str) -> list[Column]:
    """An id and a text digest: rows that repeat an id with other text don't mix."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("__k"), F.xxhash64(text_col).alias("__t")]


def line_table(docs: DataFrame, min_words: int, id_col: str, text_col: str, site_col: str, counted: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(__k, __t, pos, site, h1, h2)`` of every line long enough: 128 bits of hash, no text."""
    lines = docs.select(*_doc_key(id_col, text_col), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    trimmed = lines.withColumn("line", F.btrim("line", F.lit(" \t\r")))
    spaced = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) >= min_words - 1
    long = trimmed.where(counted(F.col("line")) if counted else spaced)
    return long.select("__k", "__t", "pos", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def _by_line(lines: DataFrame, side: DataFrame, frequent: DataFrame, how: str = "left_semi") -> list[DataFrame]:
    """``lines`` joined to ``side`` by hash, in two parts: frequent lines in the tasks that read them, the others by shuffle."""
    few, key = F.broadcast(frequent), ["h1", "h2"]
    return [lines.join(F.broadcast(side.join(few, key, "left_semi")), key, how), lines.join(few, key, "left_anti").join(side.join(few, key, "left_anti"), key, how)]


def boilerplate_lines(lines: DataFrame, sites: int) -> tuple[DataFrame, DataFrame]:
    """``(h1, h2, first)`` of lines on ``sites`` or more distinct sites, ``first`` the smallest ``(__k, __t, pos)``; and the frequent lines.

    Lines with fewer occurrences than ``sites`` can't qualify and get no sketch.  The others get one sketch per
    line hash.  Frequent lines, each with a thousandth of all occurrences and so at most a thousand, get one in each task, merged by
    aggregation, so that no task reads all occurrences of one line.
    """
    total, key = lines.count(), ["h1", "h2"]
    counts = lines.groupBy(*key).agg(F.count("*").alias("rows"), F.count("site").alias("n"), (F.min("site") != F.max("site")).alias("mixed"))
    spread_out = (F.col("n") >= sites) & (F.col("mixed") if sites > 1 else F.lit(True))
    often = cut(counts.where((F.col("rows") * FREQUENT >= total) | spread_out))
    frequent = often.where(F.col("rows") * FREQUENT >= total).select(*key)
    sketched = lambda rows: rows.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("estimate"), F.min(F.struct("__k", "__t", "pos")).alias("first"))
    few, rest = _by_line(lines, often.where(spread_out).select(*key), frequent)
    spread = materialize(sketched(few).unionByName(sketched(rest)), "line-spread")
    margin = max(1.0, BAND * sites)
    sure = spread.where(F.col("estimate") > sites + margin).select(*key, "first")
    near = spread.where(F.abs(F.col("estimate") - sites) <= margin).select(*key, "first")
    exact = lambda rows: rows.groupBy(*key).agg(F.count_distinct("site").alias("n")).where(F.col("n") >= sites)
    few, rest = _by_line(lines, near.select(*key), frequent)
    return sure.unionByName(near.join(exact(few).unionByName(exact(rest)).select(*key), key, "left_semi")), frequent


def remove_boilerplate(docs: DataFrame, sites: int = SITES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", counted: Callable[[Column], Column] | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``n_removed``.

    Lines are cut at line feeds and compared without outer spaces, tabs and carriage returns.  A line on ``sites``
    or more sites stays once, where (doc_id, text hash, position) is smallest, and goes everywhere else; lines
    under ``min_words`` words stay, or, where ``counted`` is given, those it is false for.  A null site counts as no site.  Null texts stay null; a text may become
    empty, its row stays.  A null id sorts first; repeated rows are treated alike; an empty table stays empty.  A column ``n_removed`` of ``docs`` is replaced.
    """
    docs = docs.drop("n_removed")
    lines = materialize(line_table(docs, min_words, id_col, text_col, site_col, counted), "lines")
    found, frequent = boilerplate_lines(lines, sites)
    few, rest = _by_line(lines, found, frequent, "inner")
    here = F.struct("__k", "__t", "pos")
    gone = few.unionByName(rest).where(here != F.col("first")).groupBy("__k", "__t").agg(F.collect_set("pos").alias("gone"))
    keyed = docs.select("*", *_doc_key(id_col, text_col)).join(gone.hint("shuffle_hash"), ["__k", "__t"], "left")
    parts = F.split(text_col, "\n", -1)
    both = F.array(F.struct(parts.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone").alias("kept")))
    rest = F.transform(both, lambda x: F.array_join(F.transform(x["kept"], lambda i: F.get(x["lines"], i)), "\n"))[0]
    text = F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(rest)
    return keyed.withColumns({text_col: text, "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}).select(*docs.columns, "n_removed")


def is_long(line: Column) -> Column:
    """Five words, whatever space parts them, or ``LONG_CHARS`` characters."""
    return (F.size(F.split(line, r"[\s\p{Z}]+", -1)) >= MIN_WORDS) | (F.length(line) >= LONG_CHARS)


def remove_all_boilerplate(docs: DataFrame) -> DataFrame:
    """As ``remove_boilerplate``, for lines of every length: long ones on ``SITES`` sites, and short ones that hold a letter or digit on ``SHORT_SITES``.

    Columns are those of ``docs``, one named ``n_removed`` included.
    """
    given = "n_removed" in docs.columns
    rest = docs.withColumnRenamed("n_removed", "__given") if given else docs
    rest = remove_boilerplate(rest, counted=is_long).drop("n_removed")
    rest = remove_boilerplate(rest, SHORT_SITES, counted=lambda x: ~is_long(x) & F.regexp_like(x, F.lit(r"[\p{L}\p{N}]"))).drop("n_removed")
    return rest.withColumnRenamed("__given", "n_removed").select(*docs.columns) if given else rest


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "text", "n_removed")


ORACLE_SQL = f"""
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as ln, unnest(range(len(string_split(text, chr(10))))) as pos from documents
), keyed as (
  select *, trim(ln, ' ' || chr(9) || chr(13)) as k from lines
), long as (select * from keyed where length(k) - length(replace(k, ' ', '')) >= {MIN_WORDS - 1}),
found as (select k, min(struct_pack(d := doc_id, p := pos)) as f from long group by k having count(distinct source) >= {SITES}),
gone as (select doc_id, pos from long join found using (k) where not (doc_id = f.d and pos = f.p)),
rest as (
  select l.doc_id, coalesce(string_agg(ln, chr(10) order by l.pos) filter (where g.pos is null), '') as text, count(g.pos) as n_removed
  from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id
)
select d.doc_id, r.text, coalesce(r.n_removed, 0) as n_removed from documents d left join rest r using (doc_id)"""
