"""Secret scans over an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import discard, materialize, scratch_path

# Kinds in order, their patterns and the shortest match (of the group named) that counts.
RULES = {
    "assign": (r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
VERSION = "base-1"
#: Rule sets by version; another version's name stands for the base rules.  A later version adds kinds, its base spans stay.
LATER = "base-2"
VERSIONS = {VERSION: RULES, LATER: RULES | {"pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1), "jwt": (r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 1)}}

#: The same spans with less work: a run of one class is matched whole, so its least length may stand in the pattern.
_RUNS = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
_SPAN = "array<struct<kind:string,start:int,end:int>>"


def _spans(text: Column, kind: str, rules: dict[str, tuple[str, int, int]] = RULES) -> Column:
    """Spans of one kind: pieces between matches and matches in turn give each match's place, in code points."""
    pattern, group, least = rules[kind]
    pattern = _RUNS.get(kind, pattern)
    sizes = F.zip_with(
        F.transform(F.split(text, pattern, -1), F.length),
        F.zip_with(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length), lambda n, g: F.struct(n.alias("n"), g.alias("g"))),
        lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["g"].alias("g")),
    )
    matches = F.filter(sizes, lambda x: x["n"].isNotNull())
    ends = F.aggregate(
        matches,
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"),
            F.when(x["g"] >= least, F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    found = F.regexp_like(text, F.lit(pattern))
    if kind in _HOLDS:
        found = reduce(or_, [F.contains(text, F.lit(part)) for part in _HOLDS[kind]]) & found
    return F.when(found, ends).otherwise(F.expr(f"cast(array() as {_SPAN})"))


#: Signs of which any match of a kind holds one: only texts that have it are matched at all.
_HOLDS = {"assign": (":", "="), "access": ("AKIA",), "pem": ("PRIVATE KEY-----",), "jwt": ("eyJ",)}


def find_spans(text: Column, rules: dict[str, tuple[str, int, int]] = RULES) -> Column:
    """All spans ``(kind, start, end)`` by start, then kind in the order of the rules; end is exclusive."""
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(rules) for x in (kind, k)])
    every = F.concat(*[_spans(text, kind, rules) for kind in rules])
    keyed = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def scan_with_ledger(docs: DataFrame, ledger: str, version: str = VERSION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, blob, spans)`` for every row, scanning only blobs that ``ledger`` lacks for ``version``.

    A blob is the SHA-256 of a text (null: the empty text).  New blobs are scanned once each, by the row with
    the smallest id that holds them, and appended to the ledger (Parquet by rule version, findings and clean blobs alike); findings are then
    joined back to every row with the blob.  A second call with the same rows scans nothing.  Ids may be
    null or repeat; an empty table leaves an empty ledger.
    """
    rows = _rows(docs, id_col, text_col)
    scan_new(rows, _blobs(rows), ledger, version)
    return rows.select("doc_id", F.sha2("text", 256).alias("blob")).join(_ledger(docs.sparkSession, ledger, version), "blob", "left").select("doc_id", "blob", "spans")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _key() -> Column:
    """The id by which a row is found again; null ids have one too."""
    return F.coalesce("doc_id", F.lit(-(1 << 63)))


def _blobs(rows: DataFrame) -> DataFrame:
    """``(blob, at, rows)``: each distinct text's digest, the row that holds it first, and how many do."""
    return rows.groupBy(F.sha2("text", 256).alias("blob")).agg(F.min(_key()).alias("at"), F.count("*").alias("rows"))


def scan_new(rows: DataFrame, blobs: DataFrame, ledger: str, version: str = VERSION) -> None:
    """Scan the blobs that ``ledger`` lacks for ``version`` and append them to it; where it lacks none, no text is read."""
    spark = rows.sparkSession
    first, known = blobs.select("blob", "at"), _ledger(spark, ledger, version)
    if known is not None:
        first = first.join(known.select("blob"), "blob", "left_anti")
        if first.isEmpty():
            return
    fresh = rows.withColumn("at", _key()).join(first, "at").where(F.sha2("text", 256) == F.col("blob"))
    # A repeated (id, blob) would scan twice; the digest of the row decides nothing, so one is taken.
    found = fresh.select("blob", find_spans(F.col("text"), VERSIONS.get(version, RULES)).alias("spans")).groupBy("blob").agg(F.first("spans").alias("spans"))
    found.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").option("compression", "zstd").parquet(ledger)


def _ledger(spark: SparkSession, path: str, version: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    return spark.read.schema(f"blob string, spans {_SPAN}, version string").parquet(path).where(F.col("version") == version).select("blob", "spans")


def scan_history(snapshots: list[tuple[str, DataFrame, str]], ledger: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(step, snapshot, version, n_rows, n_blobs, n_scanned)``: snapshots ``(name, docs, rule version)`` scanned in turn over one ledger.

    ``n_scanned`` counts the blobs that the step had to scan: those that no earlier step has scanned under its version.  An empty
    snapshot scans nothing.
    """
    spark, out = snapshots[0][1].sparkSession, []
    count = lambda version: known.count() if (known := _ledger(spark, ledger, version)) is not None else 0
    for step, (name, docs, version) in enumerate(snapshots):
        # Digests are made once a step, and findings needn't meet the rows to be counted.
        rows, path, before = _rows(docs, id_col, text_col), scratch_path(spark, "blobs"), count(version)
        blobs = materialize(_blobs(rows), "blobs", path)
        scan_new(rows, blobs, ledger, version)
        seen = blobs.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("blobs")).first()
        discard(spark, path)
        out.append((step, name, version, seen["rows"], seen["blobs"], count(version) - before))
    return spark.createDataFrame(out, "step int, snapshot string, version string, n_rows long, n_blobs long, n_scanned long")


def ledger_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of all documents (their first halves), then the documents, then both again, then the documents under a later rule version."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    drafts = docs.withColumn("text", F.expr("substring(text, 1, cast(floor(length(text) / 2) as int))"))
    steps = [("drafts", drafts, VERSION), ("documents", docs, VERSION), ("drafts", drafts, VERSION), ("documents", docs, VERSION), ("documents", docs, LATER)]
    return scan_history(steps, scratch_path(spark, "secret-history"))


HISTORY_SQL = """with d as (select coalesce(text, '') as text, substr(coalesce(text, ''), 1, length(coalesce(text, '')) // 2) as draft from documents), n as (select count(*) as n_rows, count(distinct draft) as drafts, count(distinct text) as texts, (select count(*) from (select distinct text from d except select draft from d)) as fresh from d)
select 0 as step, 'drafts' as snapshot, 'base-1' as version, n_rows, drafts as n_blobs, drafts as n_scanned from n union all select 1, 'documents', 'base-1', n_rows, texts, fresh from n
union all select 2, 'drafts', 'base-1', n_rows, drafts, 0 from n union all select 3, 'documents', 'base-1', n_rows, texts, 0 from n union all select 4, 'documents', 'base-2', n_rows, texts, texts from n"""


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_with_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch_path(spark, "secret-ledger"))
    count = [F.size(F.filter(F.transform("spans", lambda x: x["kind"]), lambda x: x == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in RULES]
    return out.select("doc_id", *count, F.sha2(span_text(F.col("spans")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _oracle(kind: str) -> str:
    pattern, group, least = RULES[kind]
    pattern = _RUNS.get(kind, pattern.replace("((?i)", "((?i:").replace("api_?key)", "api_?key))"))
    text = pattern.replace("'", "''")
    return f"""
      select doc_id, '{kind}' as kind, {list(RULES).index(kind)} as rank, a as s, a + n as e from (
        select doc_id, unnest(range(1, len(m) + 1)) as i, m, g, p,
               list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as a, length(m[i]) as n
        from (select doc_id, regexp_extract_all(text, '{text}', 0) as m, regexp_extract_all(text, '{text}', {group}) as g, string_split_regex(text, '{text}') as p from docs)
      ) where length(g[i]) >= {least}"""


ORACLE_SQL = (
    "with docs as (select doc_id, coalesce(text, '') as text from documents), found as ("
    + " union all ".join(_oracle(k) for k in RULES)
    + """), joined as (select doc_id, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans,
      count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as b, count(*) filter (kind = 'hex') as c from found group by doc_id)
    select d.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
           sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from docs d left join joined using (doc_id)"""
)
