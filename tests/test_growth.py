"""What must not grow with the input, or must hold however large it is."""

import json
import random
import re

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from spark_cues.functions import text
from spark_cues.operators import documents, folds, intervals, models, phrases, reconcile
from spark_cues.plans import fixtures, registry
from spark_cues.sources import srt
from spark_cues.streaming import processors


def test_answers_leave_a_task_in_bounded_pieces():
    """Samples of many cues are never held together: at most so many values, or one answer."""
    class Rows:
        """Stands in for a DataFrame: keeps the function that tasks run."""

        sparkSession, schema, columns = None, T.StructType([T.StructField("n", T.LongType())]), ["n"]

        def mapInPandas(self, run, schema):
            return run

    ship, models.ship_package = models.ship_package, lambda spark: None
    try:
        run = models.map_synthesise(Rows(), lambda: lambda row: {"samples": [0.0] * row["n"], "sample_rate": 10})
    finally:
        models.ship_package = ship
    lengths = [400_000] * 40 + [5_000_000, 0, 7] + [1] * 5
    parts = list(run(iter([pd.DataFrame({"n": lengths[:30]}), pd.DataFrame({"n": lengths[30:]})])))
    assert [n for p in parts for n in p["n"]] == lengths and [len(s) for p in parts for s in p["samples"]] == lengths
    assert max(sum(map(len, p["samples"])) for p in parts if len(p) > 1) <= models.HELD + 5_000_000
    assert max(len(p) for p in parts if p["n"].iloc[0] == 400_000) <= 5
    assert [d for p in parts for d in p["actual_dur"]] == [n / 10 for n in lengths]


def test_a_caption_of_digits_makes_a_response_srt(spark):
    """A batch whose one caption is a number was taken for unanswered, since cleaning reads a line of digits as an index."""
    cues = spark.createDataFrame([(1, 0, 0, "1", 0.0, 1.0, "4088495698897153"), (1, 1, 1, "2", 1.0, 2.0, "uno"), (1, 1, 2, "3", 2.0, 3.0, "42"), (1, 2, 3, "4", 3.0, 4.0, "tres")], "media_id long, batch_id long, seq long, idx string, start double, end double, text string")
    block = "{}\n00:00:0{},000 --> 00:00:09,000\n{}\n".format
    said = [(1, 0, block(1, 0, "4088495698897153")), (1, 1, "```srt\n" + block(2, 1, "ONE") + "\n" + block(3, 2, "43") + "```\n"), (1, 2, "4\n00:00:03,000 -->\n7\n")]
    out = reconcile.translated_batches(cues, spark.createDataFrame(said, "media_id long, batch_id long, raw string"), ["media_id", "batch_id"])
    assert sorted((r["idx"], r["text"], r["source"]) for r in out.collect()) == [("1", "4088495698897153", "srt"), ("2", "ONE", "srt"), ("3", "43", "srt"), ("4", "tres", "original")]


def test_tokens_cost_a_call_of_state_a_chunk_not_a_token():
    calls = []

    class State(dict):
        """A value (under no key) or a map, which counts what is asked of it."""

        def get(self):
            return calls.append("get") or dict.get(self, ())

        def update(self, value):
            calls.append("put")
            self[()] = value

        def getValue(self, key):
            return calls.append("get") or dict.get(self, key)

        def updateValue(self, key, value):
            calls.append("put")
            self[key] = value

        def iterator(self):
            return iter(list(self.items()))

    class Handle:
        getValueState = getMapState = lambda self, *a: State()
        registerTimer = deleteTimer = lambda self, *a: calls.append("timer")

    text = processors.TokenText(1000)
    text.init(Handle())
    tokens = [Row(request_id=1, token_no=n, token=f"{n} ", done=n == 999, ms=n) for n in range(1000)]
    assert list(text.handleInputRows((1,), iter(tokens[1::2]), None)) == [] and list(text.handleInputRows((1,), iter(tokens[2::2] + tokens[:500]), None)) != []
    assert len(calls) <= 20
    assert not text.held and not text.further
    assert list(text.handleInputRows((1,), iter(tokens[:3]), None)) == []
    assert [r.text for r in text.handleInputRows((1,), iter([tokens[3], tokens[3].__class__(request_id=1, token_no=4, token=None, done=True, ms=4)]), None)] == ["0 1 2 3 "]


def test_cue_times_follow_from_the_number_alone(spark, tmp_path):
    ids = [None, 0, 1, 2, 9, 10, 123, -1, -7, -30, -1234567]
    path = str(tmp_path)
    spark.createDataFrame([(m, " ".join(["w"] * (9 * 24 + k)), "en") for k, m in enumerate(ids)], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    cues = fixtures.cues(spark, path)
    assert "Exchange" not in cues._jdf.queryExecution().executedPlan().toString() and "Window" not in cues._jdf.queryExecution().executedPlan().toString()
    want, gaps = [], {0: 6000, 1: 2500, 2: 1800, 3: 400}
    for k, m in enumerate(ids):
        end = 0
        for seq in range(24 + (k > 0) + (k > 9)):
            n = min(9, 9 * 24 + k - 9 * seq)
            turn = None if m is None else m * 7 + seq * 13
            end += 300 + 350 * n + (0 if turn is None else gaps.get(turn % 10 if turn >= 0 else -(-turn % 10), 0))
            want.append((m, seq, end - 300 - 350 * n, end))
    got = [(r["media_id"], r["seq"], r["start_ms"], r["end_ms"]) for r in cues.collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert order(got) == order(want)


def test_chunks_of_sound_words_are_those_of_the_plain_loop(spark):
    rng, rows = random.Random(3), []
    for k in range(300):
        at, said = 0.0, []
        for _ in range(rng.choice([0, 1, 3, 12, 60])):
            start, at = at, at + rng.choice([0.2, 0.5, 1.0, 6.0])
            word = "x" * rng.choice([1, 4, 9, 30, 90])
            said.append((rng.choice(["", " a", None]) if k % 7 == 6 and rng.random() < 0.2 else word, start, at - rng.choice([0.0, 0.12])))
        rows.append((k, said))
    df = spark.createDataFrame(rows, "k long, words array<struct<word:string,start:double,end:double>>")
    for chars, seconds in ((84, 5.0), (20, 2.0)):
        want = {k: folds.word_chunks([dict(zip(("word", "start", "end"), w, strict=True)) for w in said], chars, seconds) for k, said in rows}
        got = {r["k"]: [tuple(x) for x in r["c"]] for r in df.select("k", folds.spoken_chunks(F.col("words"), chars, seconds).alias("c")).collect()}
        assert got == want


def test_entries_of_long_media_are_found_without_their_texts(spark, monkeypatch):
    seen, find = [], folds.entries
    monkeypatch.setattr(folds, "entries", lambda rows, *rest: seen.append(rows) or find(rows, *rest))
    cues = spark.createDataFrame([(1, "t", k, float(k), k + 0.9, "a." if k % 3 else " ") for k in range(20)], "media_id long, track string, seq long, start double, end double, text string")
    folds.merge_long(cues, width=5)
    shuffled = seen[0].select("media_id", "__b", "seq", "end", "closes")._jdf.queryExecution().optimizedPlan().toString()
    carried = [line for line in shuffled.splitlines() if "LogicalRDD" not in line and re.search(r"[\[ ]text#", line)]
    assert "Window" in shuffled and not carried


def test_documents_are_cleaned_in_one_order(spark):
    docs = spark.createDataFrame([(1, "3\n00:00:01,000 --> 00:00:02,000\na\n00:00:02,000 --> 00:00:03,000\nb\n00:00:03,000 --> 00:00:04,000\nc\n9\n00:00:05,000 --> 00:00:06,000\nd"), (2, "00:00:01,000 --> 00:00:02,000\nx\n00:00:02,000 --> 00:00:03,000\ny")], "media_id long, text string")
    clean = srt.sanitize_srt(docs, ["media_id"])
    assert {r["media_id"]: [b.split("\n")[0] for b in r["text"].split("\n\n")] for r in clean.collect()} == {1: ["3", "5", "6", "9"], 2: ["1", "2"]}
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", clean._jdf.queryExecution().optimizedPlan().toString())
    assert specs and not any("dgrp" in spec for spec in specs)


def test_gaps_read_cues_once_for_gaps_and_media_without_cues(spark):
    cues = spark.createDataFrame([(1, 0, 7.0, 8.0), (1, 1, 8.5, 9.0), (1, 2, 20.0, 21.0), (2, 0, 0.0, 1.0), (3, 0, 9.0, 9.5)], "media_id long, seq long, start double, end double").where("seq > -12345")
    durations = spark.createDataFrame([(1, 30.0), (2, 2.0), (4, 50.0), (5, 3.0), (None, 6.0)], "media_id long, duration double")
    gaps = intervals.find_gaps(cues, durations)
    assert sorted((r[0] or 0, r[1], r[2]) for r in gaps.collect()) == [(0, 0.0, 6.0), (1, 0.0, 7.0), (1, 9.0, 20.0), (1, 21.0, 30.0), (3, 0.0, 9.0), (4, 0.0, 50.0)]
    assert gaps._jdf.queryExecution().optimizedPlan().toString().count("-12345") <= 2  # rows, and the edges of ranges


def test_values_used_twice_are_worked_out_once(spark):
    """A caption's times were read anew for every use in every piece, and a line break's place for every use of it."""
    made = lambda c, part: spark.range(1).select(F.lit("x").alias("t")).select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count(part)
    assert made(documents.display_text(F.col("t")), "regexp_extract") == 2
    assert made(text.wrap_mid(F.col("t")), "instr(") == 1


def test_srt_texts_come_from_their_documents_without_a_shuffle(spark, tiny):
    texts = fixtures.srt_texts(spark, tiny)
    assert sorted(map(tuple, texts.collect())) == sorted(map(tuple, srt.srt_documents(fixtures.cues(spark, tiny), ["media_id"]).collect()))
    for name in ("s01_parse_srt", "f09_resegment_documents"):
        assert "Exchange" not in registry.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()


def test_documents_within_their_row_are_those_of_the_joined_steps(spark):
    rng, rows = random.Random(5), []
    for k in range(60):
        at, lines = 0.0, []
        for n in range(rng.choice([0, 1, 2, 9, 40])):
            start, at = at + rng.choice([0.0, 0.5, 3.0]), at + rng.choice([0.2, 1.5, 4.0])
            stamp = lambda t: f"00:{int(t) // 60:02}:{int(t) % 60:02},{int(t * 10) % 10}00"
            said = rng.choice(["one", "two.", "three; four", "42", "", "<b>five</b>!", "<text>six", "one two. three; four " * 20, "word " * 90])
            lines += [rng.choice([str(n), "", "x"]), f"{stamp(start)} --> {rng.choice([stamp(at), '0', '99'])}", *rng.choice([[said], [said, " seven　"], [], ["", said]])]
        rows.append((k, rng.choice(["\n", "\r\n", "\n\n"]).join(lines)))
    docs = spark.createDataFrame([*rows, (98, "7\n8"), (99, None)], "media_id long, text string")
    joined = documents.resegment_documents(docs, ["media_id"], answers=spark.createDataFrame([], "media_id long, first_seq long, pieces array<string>"))
    got = {r["media_id"]: r["srt"] for r in documents.resegment_documents(docs, ["media_id"]).collect()}
    assert len(got) > 20 and got == {r["media_id"]: r["srt"] for r in joined.collect()}


def shuffled_with(df, column):
    """Exchanges of a plan without broadcasts whose rows hold the column or, once it is used, what was made of it."""
    conf, name = df.sparkSession.conf, "spark.sql.autoBroadcastJoinThreshold"
    before = conf.get(name)
    conf.set(name, "-1")
    try:
        todo, found = [df.select("*")._jdf.queryExecution().executedPlan().initialPlan()], 0
    finally:
        conf.set(name, before)
    while todo:
        node = todo.pop()
        found += node.nodeName() == "Exchange" and re.search(rf"\b{column}#", node.output().mkString(",")) is not None
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


CAPTIONS = "media_id long, track string, seq long, idx string, start double, end double, text string"


def test_phrases_carry_texts_over_two_shuffles(spark):
    """Texts went to the edges of ranges too, and were shuffled again to meet these."""
    cues = spark.createDataFrame([(1, "t", k, str(k + 1), k * 1.0, k + 0.9, text) for k, text in enumerate(["a", "b. ", None, " ", "c", "d!　", "e"])] + [(None, None, 0, "1", 0.0, 1.0, "x"), (None, None, 1, "2", 4.0, 5.0, "y")], CAPTIONS)
    grouped = phrases.phrase_groups(cues, width=2)
    assert shuffled_with(grouped, "text") == 1 and shuffled_with(phrases.merge_phrases(cues), "text|buf") == 2
    assert {(r["media_id"], r["seq"]): r["phrase_no"] for r in grouped.collect()} == {(1, 0): 1, (1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 4): 3, (1, 5): 3, (1, 6): 4, (None, 0): 1, (None, 1): 2}


def test_words_are_counted_once_and_only_where_seconds_are_shared(spark):
    parents = spark.createDataFrame([(1, 0.0, 90.0, ["a b", "c", "d e f"]), (2, 1.0, 1.0, ["x"]), (3, 5.0, 45.0, ["y"]), (4, 2.0, 8.0, ["a b", "c"]), (5, 0.0, 1.0, [])], "k long, start double, end double, pieces array<string>")
    timed = folds.distribute_words(parents)
    assert timed._jdf.queryExecution().analyzed().toString().count(", -1)") == 1
    got = {k: [] for k in range(1, 6)}
    for r in sorted(timed.collect(), key=lambda r: r["piece_no"]):
        got[r["k"]].append((round(r["piece_start"], 6), round(r["piece_end"], 6)))
    want = {k: [] for k in got}
    for r in parents.collect():
        at = r["start"]
        for seconds in folds.shared_seconds([len(p.split()) for p in r["pieces"]], r["end"] - r["start"]) if r["pieces"] else []:
            want[r["k"]].append((round(at, 6), round(at + seconds, 6)))
            at += seconds
    assert got == want


def test_translations_carry_cues_and_answers_over_one_shuffle_each(spark):
    """Cues were shuffled by number, then by label; numbers written in several ways and labels that are none keep their own answers."""
    labels = ["1", "2", "03", "4", "b", "6", None, "8"]
    cues = spark.createDataFrame([(1, "t", k, x, k * 1.0, k + 0.9, f"c{k}") for k, x in enumerate(labels)] + [(None, "t", 0, "1", 0.0, 0.9, "n")], CAPTIONS)
    said = [(1, "t", 0, "1-2", "one two"), (1, "t", 1, "2", "gone"), (1, "t", 2, "3", "none"), (1, "t", 3, "03", "three"), (1, "t", 4, "b", "bee"), (1, "t", 5, "6-9", "six"), (1, "t", 6, None, "null"), (None, "t", 7, "1", "null"), (1, "t", 8, " 8 ", " ")]
    out = reconcile.apply_translations(cues, spark.createDataFrame(said, "media_id long, track string, pos long, idx string, text string"))
    assert shuffled_with(out, "original") == 1
    assert sorted((r["media_id"] or 0, r["from_seq"], r["idx"] or "", r["end"], r["text"]) for r in out.collect()) == [(0, 0, "1", 0.9, "n"), (1, 0, "1-2", 1.9, "one two"), (1, 2, "03", 2.9, "three"), (1, 3, "4", 3.9, "c3"), (1, 4, "b", 4.9, "bee"), (1, 5, "6", 5.9, "six"), (1, 6, "", 6.9, "c6"), (1, 7, "8", 7.9, "c7")]


def test_cues_meet_their_groups_over_two_shuffles(spark):
    """Texts went to the edges of ranges, to these, to each number's group and to the phrases: five shuffles."""
    cues = spark.createDataFrame([(m, "t", k, str(k + 1), k * 1.0 + (2 if k > 5 else 0), k + 0.9 + (2 if k > 5 else 0), f"w{k}" + ("." if k % 4 == 3 else "")) for m in (1, 2, 3) for k in range(13)] + [(None, "t", 0, "1", 0.0, 0.9, "a."), (None, "t", 1, "2", 1.0, 1.9, "b")], CAPTIONS)
    given = [(1, "t", 0, 0, [2, 3]), (1, "t", 0, 1, [5, 6, 7]), (1, "t", 0, 2, [8]), (1, "t", 1, 0, [1, 2, 3]), (2, "t", 0, 0, [1, 2]), (2, "t", 0, 1, [2, 3]), (2, "t", 1, 0, [1, 4]), (None, "t", 0, 0, [1, 2])]
    merged = phrases.merge_by_groups(cues, spark.createDataFrame(given, "media_id long, track string, batch_id long, group_no long, members array<int>"), batch=10)
    assert shuffled_with(merged, "text|buf") == 2
    got = {(m, b): [] for m in (None, 1, 2, 3) for b in (0, 1)}
    for r in sorted(merged.collect(), key=lambda r: r["first_seq"]):
        got[r["media_id"], r["batch_id"]].append(r["text"])
    rule = {0: ["w0 w1 w2 w3.", "w4 w5", "w6 w7.", "w8 w9"], 1: ["w10 w11.", "w12"]}
    assert got == {(1, 0): ["w0", "w1 w2", "w3.", "w4 w5", "w6", "w7.", "w8", "w9"], (1, 1): ["w10 w11. w12"], **{(m, b): rule[b] for m in (2, 3) for b in (0, 1)}, (None, 0): ["a.", "b"], (None, 1): []}


def test_a_run_costs_two_calls_of_state_and_no_frame():
    calls = []

    class State:
        value = None

        def get(self):
            return calls.append("get") or self.value

        def update(self, value):
            calls.append("put")
            self.value = value

    class Handle:
        getValueState = lambda self, *a: State()

    log = processors.RunLog([(2, "synthesising", "segment"), (1, "failed", "error")], 3)
    log.init(Handle())
    said = lambda *lines: list(log.handleInputRows((7,), iter([Row(run_id=7, line_no=n, line=x) for n, x in lines]), None))
    assert said((2, "segment 1/2"), (0, "error"), (0, "other")) == [Row(run_id=7, version=0, status="synthesising segment 1/2")] and calls == ["get", "put"]
    assert said((4, None), (2, "error")) == [Row(run_id=7, version=1, status="synthesising segment 1/2")]
    assert said((5, "x")) == [Row(run_id=7, version=2, status="processing")] and len(calls) == 6


def batches_by_joins(cues, responses, keys):
    """Translated batches as joined steps over rows."""
    answers = reconcile.answer_rows(responses)
    is_json = F.coalesce(F.size(F.from_json(text.loose_json(F.col("raw")), reconcile.ANSWER)) > 0, F.lit(False))
    other = responses.where(~is_json).select(*keys, F.col("raw").alias("text"))
    at = lambda found, later: found.withColumn("pos", F.col("seq") * 2 + later)
    read = at(srt.parse_srt(srt.sanitize_srt(other, keys)), 0).unionByName(at(srt.digit_captions(other), 1))
    captions = read.select(*keys, "pos", "idx", text.clean_llm_text(F.col("text")).alias("text"))
    kinds = responses.where(is_json).select(*keys, F.lit("json").alias("source")).unionByName(captions.select(*keys, F.lit("srt").alias("source")).distinct())
    known = cues.join(kinds, keys, "left").withColumn("source", F.coalesce("source", F.lit("original")))
    by_json = reconcile.apply_translations(known.where("source = 'json'"), answers, keys).withColumn("source", F.lit("json"))
    by_srt = reconcile.srt_fallback(known.where("source = 'srt'"), captions, keys).withColumn("from_seq", F.col("seq"))
    as_were = known.where("source = 'original'").withColumn("from_seq", F.col("seq"))
    columns = [*keys, "from_seq", "idx", "start", "end", "text", "source"]
    return by_json.select(*columns).unionByName(by_srt.select(*columns)).unionByName(as_were.select(*columns))


def test_batches_meet_their_responses_over_one_shuffle(spark, tiny):
    """Cues, responses, their lines and their captions were shuffled on their own, most of them twice or more."""
    rng, cues, said = random.Random(7), [], []
    for m in range(400):
        n, odd = rng.choice([1, 2, 6, 24]), m % 3 == 0
        labels = [rng.choice([str(k + 1), f"0{k + 1}", f" {k + 1}", "b", "2", "", None]) if odd and rng.random() < 0.3 else str(k + 1) for k in range(n)]
        cues += [(m, m % 2, k, labels[k], k * 1.0, None if odd and rng.random() < 0.1 else k + 0.9, rng.choice([f"t{k}", "", None])) for k in range(n)]
        spoken = lambda: rng.choice(["uno", " dos ", "2. tres", "", " ", "```json", "[00:01] x", "42", "<b>q</b>", "7　"])
        if m % 4 == 0:
            items = [{"index": rng.choice([str(rng.randint(1, n)), f"{rng.randint(0, n)}-{rng.randint(1, n + 1)}", f" {rng.randint(1, n)} ", f"0{rng.randint(1, n)}", "b", "", None]), "text": rng.choice([spoken(), None])} for _ in range(rng.choice([0, 1, n, n + 2]))]
            raw = rng.choice(["", "Here:\n```json\n"]) + json.dumps(items) + rng.choice(["", "\n```\n", "]"])
        elif m % 4 == 3:
            raw = rng.choice([None, "", "no.", "[", "[]", "1\n2", '[{"a": 1}]', "12 --> 13", "00:00:01,000 --> 00:00:02,000"])
        else:
            lines = ["```srt"] if m % 8 == 1 else []
            for k in range(rng.choice([1, n, n + 1])):
                index = str(k + 1) if m % 4 == 1 else rng.choice([str(k + 1), str(rng.randint(0, n)), "", "x", f"00{k + 1}"])
                lines += [index, rng.choice(["00:00:01,000 --> 00:00:02,000", "0 --> 1", "00:00:01,000 -->"]) if odd else "00:00:01,000 --> 00:00:02,000", "x" if m % 4 == 2 and spoken() == "42" else f"{spoken()}{k}", *rng.choice([[], [""], ["", ""], ["more"]]), ""]
            raw = rng.choice(["\n", "\r\n", "\r"]).join(lines)
        said += [(m, m % 2, raw)] if m % 11 else []
    cues += [(None, 1, k, str(k + 1), 0.0, 1.0, "n") for k in range(5)] + [(None, 1, 0, "1", 0.0, 1.0, "n")] + [(1, None, 0, "1", 0.0, 1.0, "o")]
    said += [(None, 1, '[{"index": "1", "text": "never"}]'), (1, None, '[{"index": "1", "text": "never"}]'), (9999, 0, '[{"index": "1", "text": "never"}]')]
    keys = ["media_id", "batch_id"]
    rows = spark.createDataFrame(cues, "media_id long, batch_id long, seq long, idx string, start double, end double, text string")
    responses = spark.createDataFrame(said, "media_id long, batch_id long, raw string")
    out, joined = reconcile.translated_batches(rows, responses, keys), batches_by_joins(rows, responses, keys)
    in_order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    got = in_order(out)
    assert out.schema.simpleString() == joined.schema.simpleString() and got == in_order(joined)
    assert {"json", "srt", "original"} == {r[-1] for r in got} and any("-" in (r[3] or "") for r in got)
    for df in (out, registry.queries()["j05_translated_batches"](spark, tiny)):
        assert shuffled_with(df, ".*") == 1


def test_answers_to_batches_come_from_their_documents(spark, tiny):
    cues, keys = fixtures.cues(spark, tiny).withColumn("batch_id", F.floor(F.col("seq") / 24)).withColumn("text", fixtures.upper("text")), ["media_id", "batch_id"]
    lists = reconcile.entries_json(cues.where("batch_id % 4 in (0, 3) and not (batch_id % 4 = 0 and seq % 24 % 7 = 3)"), keys).select(*keys, F.concat(F.lit("Here it is:\n```json\n"), "entries", F.lit("\n```\n")).alias("raw"))
    texts = srt.srt_documents(cues.where("batch_id % 4 = 1"), keys).withColumnRenamed("srt", "raw")
    refused = cues.where("batch_id % 4 = 2").select(*keys).distinct().withColumn("raw", F.lit("I can't do that."))
    answers = fixtures.batch_answers(spark, tiny)
    assert sorted(map(tuple, answers.collect())) == sorted(map(tuple, lists.unionByName(texts).unionByName(refused).collect()))
    assert "Exchange" not in answers._jdf.queryExecution().executedPlan().toString()


def test_a_long_batch_and_numbers_past_counting(spark):
    """Labels of a long batch aren't compared each with each, and digits past a long are an index or none."""
    n, long = 3000, "9" * 30
    cues = spark.createDataFrame([(m, k, str(k + 1) if m < 3 else long, k * 1.0, k + 0.9, f"t{k}") for m in (1, 2) for k in range(n)] + [(3, 0, long, 0.0, 0.9, "t")], "media_id long, seq long, idx string, start double, end double, text string")
    block = "{}\n00:00:01,000 --> 00:00:02,000\n{}\n".format
    said = [(1, json.dumps([{"index": str(k + 1), "text": f"j{k}"} for k in reversed(range(n)) if k % 3])), (2, "\n".join(block(k + 1, f"s{k}") for k in range(n))), (3, block("0" + long, "s") + "\n" + block("", "u"))]
    got = reconcile.translated_batches(cues, spark.createDataFrame(said, "media_id long, raw string"), ["media_id"]).collect()
    want = [(1, k, f"j{k}" if k % 3 else f"t{k}", "json") for k in range(n)] + [(2, k, f"s{k}", "srt") for k in range(n)] + [(3, 0, "s", "srt")]
    assert sorted((r["media_id"], r["from_seq"], r["text"], r["source"]) for r in got) == want


def test_lines_without_marks_are_cleaned_as_others(spark):
    rng, signs = random.Random(11), ["a", "b c", " ", "  ", "\u3000", "\x85", "\n", "1", "12", ".", ":", "[00:01]", "[", "<text>", "<", "-->", "00:00:01,000 --> 00:00:02,000", "```json", "`", "\x1c"]
    lines = spark.createDataFrame([("".join(rng.choices(signs, k=rng.randint(0, 6))),) for _ in range(3000)] + [(None,)], "t string")
    within = F.get(F.transform(F.array("t"), text.clean_llm_text_within), F.lit(0))
    assert lines.where(~within.eqNullSafe(text.clean_llm_text(F.col("t")))).collect() == []
