"""Queries over the files of a project: what makes an artefact valid, which ones a track has, and tables by language."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dimensions import values_sql
from ..operators import rollups
from ..runtime import scratch_path
from ..sources import media as sources
from . import fixtures as fx
from .registry import query


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """Four artefacts of each document, of each kind whole and broken ones."""
    doc = F.col("doc_id").cast("string")
    pick = lambda *xs: F.get(F.array(*xs), (F.col("doc_id") % len(xs)).cast("int"))
    srt = pick(F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,000\n"), "text"), F.concat(F.lit("1\n00:00:01,000 -->\n"), "text"), F.col("text"))
    description = pick(F.concat(F.lit('{"title": "'), doc, F.lit('", "summary": ""}')), F.concat(F.lit('{"title": "'), doc, F.lit('"}')), F.lit("[1]"), F.lit("{"))
    thumbs = pick(F.lit("[]"), F.concat(F.lit('[{"path": "gone"}, {"path": "t/'), doc, F.lit('.jpg"}]')), F.concat(F.lit('[{"path": "t/'), doc, F.lit('.jpg"}]')), F.lit('{"path": "t/1.jpg"}'))
    each = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(f).alias("file"), c.alias("content")) for s, f, c in (("audio", "audio.mp3", F.lit("")), ("transcript", "source.srt", srt), ("description", "description.json", description), ("thumbs", "meta.json", thumbs))])
    rows = fx.table(spark, sf, "documents").select("doc_id", F.explode(each).alias("a"))
    return rows.select(F.col("doc_id").alias("media_id"), "a.stage", F.concat(F.col("doc_id").cast("string"), F.lit("/"), "a.file").alias("path"), ((F.col("doc_id") * 97) % 3000).alias("bytes"), "a.content")


_VALID_SQL = """c as (select doc_id, (['1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || text, '1' || chr(10) || '00:00:01,000 -->' || chr(10) || text, text])[doc_id % 3 + 1] as srt,
    (['{"title": "' || doc_id || '", "summary": ""}', '{"title": "' || doc_id || '"}', '[1]', '{'])[doc_id % 4 + 1] as description,
    (['[]', '[{"path": "gone"}, {"path": "t/' || doc_id || '.jpg"}]', '[{"path": "t/' || doc_id || '.jpg"}]', '{"path": "t/1.jpg"}'])[doc_id % 4 + 1] as thumbs from documents),
  files as (select 't/' || doc_id || '.jpg' as path from documents where doc_id % 2 = 1),
  named as (select doc_id, unnest(json_extract_string(thumbs, '$[*].path')) as path from c where json_type(thumbs) = 'ARRAY')"""


@query(
    "p08_validity_by_content",
    f"""with {_VALID_SQL} select doc_id as media_id, 'audio' as stage, (doc_id * 97) % 3000 >= 1024 as valid from c
    union all select doc_id, 'transcript', regexp_matches(srt, '[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}},[0-9]{{3}}\\s*-->\\s*[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}},[0-9]{{3}}') from c
    union all select doc_id, 'description', json_valid(description) and case when json_valid(description) then json_type(description) <> 'OBJECT' or len(list_intersect(json_keys(description), ['title', 'summary'])) = 2 else false end from c
    union all select doc_id, 'thumbs', doc_id in (select doc_id from named join files using (path)) from c""",
)
def validity_by_content(spark, sf):
    files = fx.table(spark, sf, "documents").where("doc_id % 2 = 1").select(F.concat(F.lit("t/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"))
    return rollups.artifact_validity(contents(spark, sf), required={"description": ["title", "summary"]}, listing=files).select("media_id", "stage", "valid")


_NAMES = [s for s, *_ in sources.ARTEFACTS]


@query(
    "p14_project_summary",
    f"""with a(n, stage, scoped, file) as (values {values_sql([(n, *x) for n, x in enumerate(sources.ARTEFACTS)])}), e as (select page_id as media_id, lang, stage, case when scoped then (page_id * 31 + n + length(lang)) % 3 <> 0 and not (lang = 'fr' and n > 9) else (page_id * 31 + n) % 3 <> 0 end as found from pages, a, (values ('en'), ('fr')) l(lang))
    select media_id, lang, {', '.join(f"bool_or(found) filter (stage = '{s}') as {s}" for s in _NAMES)} from e group by media_id, lang""",
)
def project_summary(spark, sf):
    """Which of the thirteen artefacts each track has, against a listing of files."""
    tracks = fx.table(spark, sf, "pages").select(F.col("page_id").alias("media_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("slug"), F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("lang"))
    places = sources.project_artefacts(tracks, "out")
    number = F.array_position(F.array(*map(F.lit, _NAMES)), F.col("stage")) - 1
    scoped = F.col("stage").isin(*[s for s, x, _ in sources.ARTEFACTS if x])
    there = F.when(scoped, ((F.col("media_id") * 31 + number + F.length("lang")) % 3 != 0) & ~((F.col("lang") == "fr") & (number > 9))).otherwise((F.col("media_id") * 31 + number) % 3 != 0)
    files = places.where(there).select("path").distinct().withColumn("valid", F.lit(True))
    return rollups.track_readiness(places.join(files, "path", "left").withColumn("valid", F.coalesce("valid", F.lit(False))), _NAMES)


@query(
    "s10_language_tables",
    f"""with {fx.CUES_SQL}, k as (select media_id, count(*) as n_cues from cues where lang = 'fr' group by media_id) select media_id, n_cues, n_chars from k join documents on media_id = doc_id where documents.lang = 'fr'""",
)
def language_tables(spark, sf):
    """Cues and media as tables by language; those of one language meet without an exchange."""
    tag = uuid.uuid4().hex[:12]
    cues = sources.write_language_table(fx.cues(spark, sf).select("media_id", "lang", "seq", "text"), f"cues_{tag}", scratch_path(spark, "cues"), buckets=8)
    media = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("media_id"), "lang", F.lit(0).alias("seq"), "n_chars")
    media = sources.write_language_table(media, f"media_{tag}", scratch_path(spark, "media"), buckets=8)
    counted = cues.where("lang = 'fr'").groupBy("media_id").agg(F.count("*").alias("n_cues"))
    return counted.join(media.where("lang = 'fr'").select("media_id", "n_chars"), "media_id")
