import random
import re

import pytest
from pyspark.sql import functions as F
from spark_cues.operators import folds, reconcile

TEXTS = ["", "one", "a b c", "It is done. Is it? Yes! " * 9, "word " * 60, "semi; colon; parts; " * 20, "dash — and — dash " * 20, "x" * 200, "commas, and, more, " * 15 + "." , "多。句！子？ " * 30]


def plain_pack(parts, most):
    out, buf = [], None
    for p in filter(None, parts):
        if buf is None:
            buf = p
        elif len(buf) + 1 + len(p) > most:
            out.append(buf)
            buf = p
        else:
            buf = f"{buf} {p}"
    return out + ([buf] if buf is not None else [])


def plain_sentences(text, most):
    parts = [p.strip() for p in re.split(r"(?<=[.!?…؟])\s+", text)]
    out = []
    for s in plain_pack(parts, most):
        out += [s] if len(s) <= most else plain_pack([p.strip() for p in re.split(r"(?<=;)\s+|(?<=—)\s*|\s+(?=—)", s)], most)
    return out


@pytest.mark.parametrize("most", [20, 60, 300])
def test_packing_matches_a_plain_version(spark, most):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string").select("k", folds.pack_words(F.col("t"), most).alias("w"), folds.pack_sentences(F.col("t"), most).alias("s"), folds.pack_display(F.col("t"), most).alias("d"))
    for r in df.collect():
        text = TEXTS[r["k"]]
        assert r["w"] == plain_pack(text.split(), most)
        assert r["s"] == plain_sentences(text, most)
        assert "".join("".join(r["d"]).split()) == "".join(text.split())
        assert all(len(x) <= most or " " not in x for x in r["d"])


def test_shared_seconds_keep_total_and_bounds():
    rng = random.Random(1)
    for _ in range(200):
        counts, total = [rng.randrange(0, 40) for _ in range(rng.randrange(1, 8))], rng.uniform(1, 200)
        got = folds.shared_seconds(counts, total)
        assert len(got) == len(counts) and abs(sum(got) - total) < 0.002


def word(w, a, b):
    return {"word": w, "start": a, "end": b}


def test_words_are_cut_at_the_widest_pause():
    said = [word("aa", 0, 1), word("bb", 1, 2), word("cc", 3.5, 4), word("dd", 4, 4.5), word("ee", 4.6, 6)]
    assert folds.word_chunks(said, 84, 5.0) == [(0, 2, "aa bb"), (3.5, 6, "cc dd ee")]
    assert folds.word_chunks([word("a" * 90, 0, 1), word("b", 1, 2)], 84, 5.0) == [(0, 1, "a" * 90), (1, 2, "b")]
    assert folds.word_chunks([word("a", None, None), word("b", 1, 2), word("c", None, None)], 84, 5.0) == [(1, 1, "a b c")]
    assert folds.word_chunks([], 84, 5.0) == []


def plain_long(rows, least=8.0, most=30.0, pause=0.3):
    out, begun, number = [], None, -1
    for k, (start, end, text) in enumerate(rows):
        if not text.strip():
            continue
        if begun is not None and round(end - begun, 6) > most:
            begun = None
        if begun is None:
            begun, number = start, number + 1
        out.append(number)
        nxt = rows[k + 1][0] if k + 1 < len(rows) else None
        if round(end - begun, 6) >= least and (text.strip()[-1] in ".!?…؟。！？" or (nxt is not None and round(nxt - end, 6) >= pause)):
            begun = None
    return out


def test_merge_long_and_gaps_match_plain_loops(spark):
    rng, tracks = random.Random(4), {}
    for m in range(30):
        at, rows = 0.0, []
        for _ in range(rng.randrange(1, 40)):
            end = round(at + rng.uniform(0.2, 12), 3)
            rows.append((at, end, rng.choice(["go on", "stop.", " ", "well!"])))
            at = round(end + rng.choice([0, 0, 0.1, 0.3, 4]), 3)
        tracks[m] = rows
    cues = spark.createDataFrame([(m, "t", k, a, b, t) for m, rows in tracks.items() for k, (a, b, t) in enumerate(rows)], "media_id long, track string, seq long, start double, end double, text string").repartition(4)
    got = {(r["media_id"], r["chunk_no"]): r["n_cues"] for r in folds.merge_long(cues).collect()}
    want = {}
    for m, rows in tracks.items():
        for n in plain_long(rows):
            want[m, n] = want.get((m, n), 0) + 1
    assert got == want
    picks = cues.select("media_id", F.col("seq").alias("i"), F.col("start").alias("seconds"))
    kept = {(r["media_id"], r["i"]) for r in folds.dedup_min_gap(picks).collect()}
    for m, rows in tracks.items():
        last = None
        for k, (a, _, _) in enumerate(rows):
            keep = last is None or a - last >= 5
            last = a if keep else last
            assert ((m, k) in kept) == keep


def plain_translate(cues, answers):
    """Cues ``(label, start, end, text)``; answers ``(idx, text)`` in order."""
    by = {c[0]: c for c in cues}
    gone, out, used = set(), [], set()
    for idx, text in answers:
        text = text.strip()
        m = re.fullmatch(r"(\d+)\s*[-–]\s*(\d+)", idx)
        if m and text and int(m[2]) > int(m[1]):
            a, b = m[1], m[2]
            if a not in by:
                continue
            end = by[b][2] if b in by else by[a][2]
            out.append((by[a][1], end, text))
            used.add(a)
            if b in by:
                gone |= {str(n) for n in range(int(a) + 1, int(b) + 1)}
        elif not m and idx in by and idx not in gone:
            out.append((by[idx][1], by[idx][2], text or by[idx][3]))
            used.add(idx)
    return sorted(out + [(s, e, t) for n, s, e, t in cues if n not in used and n not in gone])


def test_translations_match_a_plain_loop(spark):
    rng, cases = random.Random(7), []
    for m in range(60):
        n = rng.randrange(1, 9)
        cues = [(str(k + 1), float(k), k + 0.5, f"old {k}") for k in range(n)]
        answers = [(rng.choice([str(rng.randrange(1, n + 3)), f"{(a := rng.randrange(1, n + 2))}-{a + rng.randrange(1, 4)}"]), rng.choice(["new", "newer", " "])) for _ in range(rng.randrange(0, 8))]
        cases.append((m, cues, answers))
    c = spark.createDataFrame([(m, "t", k, *x) for m, cues, _ in cases for k, x in enumerate(cues)], "media_id long, track string, seq long, idx string, start double, end double, text string")
    a = spark.createDataFrame([(m, "t", k, *x) for m, _, answers in cases for k, x in enumerate(answers)], "media_id long, track string, pos long, idx string, text string")
    got = {}
    for r in reconcile.apply_translations(c, a).collect():
        got.setdefault(r["media_id"], []).append((r["start"], r["end"], r["text"]))
    for m, cues, answers in cases:
        assert sorted(got[m]) == plain_translate(cues, answers), (cues, answers)


def test_captions_that_fit_stay_and_others_are_measured_collapsed(spark):
    long = "  ".join(f"word{k}" for k in range(30))
    rows = spark.createDataFrame([(1, 0, "two\nlines here", 0.0, 0.2), (1, 1, "a" + " " * 200 + "b", 1.0, 2.0), (1, 2, long, 2.0, 8.0)], "media_id long, seq long, text string, start double, end double")
    got = folds.split_for_display(rows, ["media_id", "seq"]).orderBy("seq", "piece_no").collect()
    assert [(r["piece"], r["piece_start"], r["piece_end"]) for r in got[:2]] == [("two\nlines here", 0.0, 0.2), ("a" + " " * 200 + "b", 1.0, 2.0)]
    assert len(got) > 3 and " ".join(r["piece"] for r in got[2:]) == " ".join(long.split()) and got[-1]["piece_end"] <= 8.0


def test_seconds_of_columns_equal_the_plain_form(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([0, 1, 2, 9, 40, 300]) for _ in range(rng.randrange(0, 9))], rng.choice([0.0, 0.5, 7.0, 33.3, 200.0])) for k in range(400)]
    got = spark.createDataFrame(rows, "k int, c array<int>, t double").select("k", folds.share_seconds(F.col("c"), F.col("t")).alias("s")).collect()
    for r in got:
        _, counts, total = rows[r["k"]]
        assert r["s"] == pytest.approx(folds.shared_seconds(counts, total) if counts else [], abs=1e-9)


def test_chunks_of_columns_equal_the_plain_form(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        clock, said = 0.0, []
        for _ in range(rng.randrange(0, 30)):
            length = rng.choice([0.2, 0.5, 2.0, 6.0])
            said.append((rng.choice(["a", "word", "x" * 40, "", None, "end."]), *((None, None) if rng.random() < 0.1 else (round(clock, 2), round(clock + length, 2)))))
            clock += length + rng.choice([0.0, 0.1, 0.8])
        rows.append((k, said))
    df = spark.createDataFrame(rows, "k int, words array<struct<word:string,start:double,end:double>>")
    plan = df.select("k", folds.spoken_chunks(F.col("words"), 60, 5.0).alias("x"))
    assert "Python" not in plan._jdf.queryExecution().toString()
    for r in plan.collect():
        assert [tuple(c) for c in r["x"]] == folds.word_chunks([word(*w) for w in rows[r["k"]][1]], 60, 5.0)
    assert spark.createDataFrame([(None,)], "words array<struct<word:string,start:double,end:double>>").select(folds.spoken_chunks(F.col("words")).alias("x")).first()["x"] == []


def test_segments_pick_their_rule(spark):
    timed = [(f"w{i}", i * 0.4, i * 0.4 + 0.3) for i in range(40)]
    rows = [(1, 0.0, 3.0, " short ", timed), (2, 0.0, 16.0, " ".join(w for w, *_ in timed), timed), (3, 10.0, 30.0, "many words " * 20, [("a", None, None)]), (4, 0.0, 9.0, "", None), (5, 1.0, 9.0, "abc", None)]
    df = spark.createDataFrame(rows, "k int, start double, end double, text string, words array<struct<word:string,start:double,end:double>>")
    got = {}
    for r in folds.resegment_asr(df, ["k"]).orderBy("k", "piece_no").collect():
        got.setdefault(r["k"], []).append((r["piece_start"], r["piece_end"], r["piece"]))
    assert got[1] == [(0.0, 3.0, "short")] and got[5] == [(1.0, 9.0, "abc")] and 4 not in got
    assert got[2] == folds.word_chunks([word(*w) for w in timed], 84, 5.0)
    pieces = plain_pack(rows[2][3].split(), 84)
    at, want = 10.0, []
    for k, p in enumerate(pieces):
        d = 20.0 * len(p) / len(rows[2][3])
        want.append((at, 30.0 if k == len(pieces) - 1 else at + d, p))
        at += d
    assert [p for *_, p in got[3]] == pieces and all(a == pytest.approx(b) for g, w in zip(got[3], want, strict=True) for a, b in zip(g[:2], w[:2], strict=True))
