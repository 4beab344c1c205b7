import os

import pytest
from pyspark.sql import functions as F
from spark_cues.llm import toxicity as tox

LEXICON = tox.Lexicon({" idiot": 5.0, " clown": 4.0, " trash ": 4.0})


@pytest.mark.parametrize("text", ["you IDIOT!", "an 1d10t here", "іdіоt", "ｉｄｉｏｔ", "i​diot", "idiots***"])
def test_disguised_words_are_found(text):
    assert tox.lexicon_hits(tox.fold(text), LEXICON.automaton())


@pytest.mark.parametrize("text", ["a clown fish swims", "the trash can", "trashy", "", None, "12 345 $$$", "candidiot"])
def test_exceptions_and_clean_texts(text):
    assert not tox.lexicon_hits(tox.fold(text), LEXICON.automaton())


def test_a_word_counts_once_at_its_heaviest():
    found = tox.Lexicon({" idio": 1.0, " idiot ": 5.0})
    assert [w for _, w in tox.lexicon_hits(tox.fold("idiot idiom"), found.automaton())] == [5.0, 1.0]


def test_edge_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (1, "you idiot " * 20_000, "x"), (2, "you idiot", "x"), (2, "you idiot", "x")], "doc_id long, text string, score string")
    got = tox.toxicity_scores(docs, LEXICON).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    kept = tox.drop_toxic(docs, LEXICON)
    assert kept.columns == docs.columns and sorted(r["text"] or "-" for r in kept.collect()) == ["-", "-"]
    empty = docs.limit(0)
    assert tox.toxicity_scores(empty, LEXICON).count() == 0
    none = tox.fit_lexicon(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.weights == {}
    assert all(r["score"] < 0.5 for r in tox.toxicity_scores(docs, none).collect())


def test_held_out_rows_decide_nothing(spark):
    docs = spark.createDataFrame([(k, "grimblok words" if k % 3 == 0 else "plain words") for k in range(600)], "doc_id long, text string")
    labels = docs.select("doc_id", F.when(tox.held_out(F.col("doc_id")), 1).otherwise((F.col("doc_id") % 3 == 0).cast("int")).alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 0).otherwise(F.col("toxic")))
    assert tox.fit_lexicon(docs, labels) == tox.fit_lexicon(docs, flipped)
    assert any("grimblok" in w for w in tox.fit_lexicon(docs, labels).weights)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = tox.op9_toxicity_lexicon(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.8
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02


def plain_hits(folded, lexicon):
    """Every word start in turn, all entries and all phrases tried there."""
    spared = [k for phrase in map(tox.fold, lexicon.exceptions) for at in range(len(folded)) if folded.startswith(phrase, at) for k in range(at, at + len(phrase) - 1)]
    found = [(k, max((w for e, w in lexicon.weights.items() if folded.startswith(e, k)), default=0.0)) for k in range(len(folded))]
    return [(k, w) for k, w in found if w > 0 and k not in spared]


def test_hits_and_scores_match_a_plain_version(spark):
    import math
    import random

    rng = random.Random(4)
    lexicon = tox.Lexicon({" idiot": 5.0, " clown": 4.0, " clown ": 4.5, " trash ": 4.0, " fish": 3.0, " stupid ": 2.5, " can": 2.6})
    pool = "clown fish shoes class trash can bin idiot idiots 1diot not stupid pond scum word other".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 40))) for _ in range(200)]
    automaton = lexicon.automaton()
    for t in texts:
        assert tox.lexicon_hits(tox.fold(t), automaton) == plain_hits(tox.fold(t), lexicon)
    got = tox.toxicity_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()
    for r in got:
        folded, b = tox.fold(texts[r["doc_id"]]), lexicon.coefficients
        words, total = len(folded.split()), sum(w for _, w in plain_hits(folded, lexicon))
        logit = b[0] + b[1] * math.log1p(100 * total / max(50, words)) + b[2] * math.log1p(total) + b[3] * math.log1p(words) / 5
        assert abs(r["score"] - 1 / (1 + math.exp(-logit))) < 1e-9


def test_long_texts_with_many_phrases_take_linear_time():
    import time

    automaton, folded = LEXICON.automaton(), tox.fold("trash can idiot " * 100_000)
    began = time.process_time()
    assert len(tox.lexicon_hits(folded, automaton)) == 100_000
    assert time.process_time() - began < 20
