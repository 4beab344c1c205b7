"""One long run of any sign must not end a job or cost more than its length."""

import time

import pytest
from pyspark.sql import functions as F
from spark_cues.llm import chat, decontaminate, fingerprints, line_dedup, packing, secret_scan, sharding, simhash, stages, surrogates, toxicity

N = 1_000_000
ITEM = "A train leaves the station at 40 km an hour and a second train follows after 3 hours how far is it"
RUNS = {
    "spaces": f"{ITEM}{' ' * N}end mary@site.org",
    "spaces first": f"{' ' * N}User: is it so",
    "dashes": "a " + "-" * N,
    "points": "a." + "." * N + " 3.5",
    "digits": "1" * N,
    "signs": "x " + "!" * N + " $" * 1000,
    "labels": "mail x@" + "a." * (N // 2) + " now",
    "hyphens": "John Smith" + "-Smith" * (N // 6),
    "words": "no " * (N // 3),
    "numbers": "+1" + " 2" * (N // 2),
    "letters": "A" + "a" * N,
    "no space": "ab" * (N // 2) + "日本" * 1000,
}
#: Seconds for all of them together on a busy machine; a quadratic pattern takes hours.
ENOUGH = 240


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(RUNS.values())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def timed(df):
    began = time.monotonic()
    out = df.collect()
    assert time.monotonic() - began < ENOUGH
    return out


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in timed(decontaminate.find_contamination(docs, bench))] == [(0, 1)]


def test_surrogates(spark, docs):
    out = {r["doc_id"]: r["text"] for r in timed(surrogates.replace_personal_data(docs).select("doc_id", "text"))}
    assert "mary@site.org" not in out[0] and "Smith" not in out[7] and out[7].count("-") == RUNS["hyphens"].count("-") and out[8] == RUNS["words"]


def test_toxicity(docs):
    lexicon = toxicity.Lexicon({" idiot": 5.0})
    out = timed(toxicity.toxicity_scores(docs, lexicon))
    assert len(out) == len(RUNS)
    assert toxicity.fold("1d10t x1 1x 11 !a b! ") == " idiot x1 ix 11 ia b "


def test_transcripts(spark, docs):
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text")
    lines = chat.transcript_lines(turns, keep=("role",))
    assert len(timed(chat.parse_transcripts(lines, chat.fit_roles(lines)))) == len(RUNS)
    marks = spark.createDataFrame([("  ### User: a",), ("[user] b",), ("> A: c",), ("**Bot** : d",), ("- e",), (">> f",), ("no mark",)], "line string")
    assert [r["x"] for r in marks.select(chat.bare(F.col("line")).alias("x")).collect()] == ["a", "b", "c", "d", "e", "f", "no mark"]


@pytest.mark.parametrize("run", [
    lambda d: simhash.near_duplicate_components(d), lambda d: line_dedup.remove_boilerplate(d).select("doc_id"), lambda d: d.select("doc_id", secret_scan.find_spans(F.col("text"))),
    lambda d: fingerprints.edited_fingerprints(d).select("doc_id"), lambda d: sharding.shard_by_bytes(d).select("doc_id"), lambda d: packing.pack_documents(d).select("doc_id").distinct(),
])
def test_the_others(docs, run):
    assert len(timed(run(docs))) == len(RUNS)


def test_pipeline_stages(spark, tiny, docs):
    for stage in (stages.toxicity, stages.line_dedup_stage, stages.simhash_dedup, stages.decontamination):
        assert {r["doc_id"] for r in timed(stage(spark, docs, tiny).select("doc_id"))} == set(range(len(RUNS)))


def test_the_line_stage_keeps_a_given_column(spark):
    rows = [(k, "one two three four five six\nall rights reserved", f"s{k}", 7) for k in range(20)]
    got = line_dedup.remove_all_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int"))
    assert got.columns == ["doc_id", "text", "source", "n_removed"]
    assert sorted((r["n_removed"], r["text"]) for r in got.collect()) == [(7, "")] * 19 + [(7, rows[0][1])]
