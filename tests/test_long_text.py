"""Text functions on very long runs, and repeats against Python's own pattern engine."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from spark_cues.functions import text as X

N = 1_000_000


def folded(text):
    """The cleaning rules of repeats by a backtracking engine."""
    text = re.sub(r"(.)\1{2,}", r"\1", text)
    return X_space(re.sub(r"\b(\S+)(?:\s+\1){2,}\b", r"\1", text))


def X_space(text):
    return re.sub(r"\s{2,}", " ", text).strip()


def test_repeats_equal_a_backtracking_engine(spark):
    rng = random.Random(7)
    pool = ["no", "no,", "(no", "no.no", "go", "goo", "a-", "a", "-", "ha!", "Ünï", "日本", "x1", "1", "no's", "a-b"]
    rows = [" ".join(rng.choice(pool[: rng.choice((3, 6, 16))]) + rng.choice(("", "", "", " ", "\n")) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    rows += ["no no no, yes", "(so so so) it", "a- a- a-b", "ha! ha! ha!", "go go going", "goo goo goo goose", "so\nso\tso  so", "", " "]
    got = [r["v"] for r in spark.createDataFrame(list(enumerate(rows)), "k int, t string").repartition(4, "k").select("k", X.clean_asr_text(F.col("t")).alias("v")).orderBy("k").collect()]
    assert got == [folded(t) for t in rows]


@pytest.mark.parametrize(("text", "want"), [
    ("word " * N, "word"), ("so it is " + "ha " * N + "end", "so it is ha end"), ("a" * N, "a"), (" " * N + "x" + " " * N + "y", "x y"), ("ab" * N, "ab" * N), ("a-" * (N // 2), "a-" * (N // 2)), ("é!" + "?" * N, "é!?"),
])
def test_long_runs_collapse_in_linear_time(spark, text, want):
    began = time.monotonic()
    assert spark.createDataFrame([(text,)], "t string").select(X.clean_asr_text(F.col("t")).alias("v")).first()["v"] == want
    assert time.monotonic() - began < 60


def test_strip_takes_every_space_and_long_inner_runs(spark):
    spaces = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.match(r"[\t-\r \x85\xa0  -     　]", chr(c)))
    rows = [f"{spaces}a{spaces}b{spaces}", "​x​", "\x1cx", "", None, "a" + " " * N + "b"]
    got = [r["v"] for r in spark.createDataFrame(list(enumerate(rows)), "k int, t string").orderBy("k").select(X.strip(F.col("t")).alias("v")).collect()]
    assert got == [f"a{spaces}b", "​x​", "\x1cx", "", None, rows[-1]]
