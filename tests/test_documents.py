import re

import pytest
from pyspark.sql import functions as F
from spark_cues.operators import documents, folds, reconcile
from spark_cues.plans import registry

TIMES = re.compile(r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})[,.](\d{3})")


def seconds(h, m, s, ms):
    return int(h) * 3600 + int(m) * 60 + int(s) + int(ms) / 1000


def stamp(t):
    ms = round(t * 1000)
    return f"{ms // 3600000:02}:{ms // 60000 % 60:02}:{ms // 1000 % 60:02},{ms % 1000:03}"


def plain_display(text, most, cut_of):
    """Block by block; ``cut_of`` gives the pieces of a long text."""
    out, changed = [], False
    for block in re.split(r"\n\n+", text.strip()):
        lines = block.split("\n")
        flat, found = " ".join("\n".join(lines[2:]).split()), TIMES.search(lines[1]) if len(lines) > 2 else None
        if not found or len(flat) <= most:
            out.append(lines[1:])
            continue
        changed = True
        g = found.groups()
        at, end = seconds(*g[:4]), seconds(*g[4:])
        whole, pieces = end - at, cut_of[flat]
        for p in pieces:
            to = min(at + max(0.5, whole * (len(p) / sum(map(len, pieces)))), end)
            out.append([f"{stamp(at)} --> {stamp(to)}", p])
            at = to
    return "\n\n".join("\n".join([str(k), *lines]) for k, lines in enumerate(out, 1)) + "\n" if changed else None


def pieces_of(spark, texts, most):
    flats = sorted({" ".join("\n".join(b.split("\n")[2:]).split()) for t in texts if t for b in re.split(r"\n\n+", t.strip())})
    rows = spark.createDataFrame([(f,) for f in flats], "f string").select("f", folds.pack_display(F.col("f"), most).alias("p")).collect()
    return {r["f"]: r["p"] for r in rows}


def test_display_documents_equal_a_plain_loop(spark):
    long = "One sentence here. Another, with a clause; and more of it! " * 4
    texts = [
        f"7\n00:00:01,000 --> 00:00:09,500\n{long}\n\n9\n00:00:10,000 --> 00:00:12,000\nshort\nlines\n\n\n3\nno times here\n{long}\n\nalone\n\ntwo\n00:00:00,000 --> 00:00:01,000",
        "1\n00:00:01,000 --> 00:00:02,000\nfits", f"1\n00:00:01,000 --> 00:00:01,200\n{long}", "x" * 300, "", None, f"  1\n00:59:59.900 --> 01:00:20.100\n{'word ' * 60}\n{'more ' * 9}\n",
    ]
    cut_of = pieces_of(spark, texts, 60)
    got = documents.split_documents_for_display(spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "k int, text string, display string"), most=60).orderBy("k").collect()
    for r, t in zip(got, texts, strict=True):
        want = plain_display(t, 60, cut_of) if t is not None else None
        assert (r["was_cut"], r["display"]) == (want is not None, want if want is not None else t)


def test_given_documents_for_display(spark, tiny):
    from spark_cues.plans import fixtures as fx
    from spark_cues.sources import srt

    texts = {r["media_id"]: r["srt"] for r in srt.srt_documents(fx.long_cues(spark, tiny), ["media_id"]).collect()}
    cut_of = pieces_of(spark, texts.values(), 120)
    for r in registry.queries()["f10_display_documents"](spark, tiny).collect():
        want = plain_display(texts[r["media_id"]], 120, cut_of)
        assert r["was_cut"] == (want is not None) and r["display"] == (want or texts[r["media_id"]])


def test_resegmented_documents(spark):
    raw = "```srt\n<subtitle>1\n00:00:00,000 --> 00:00:01,000\nIt is\n\n2\n00:00:01,200 --> 00:00:02,000\na phrase.\n\n5\n00:00:02,000 --> 00:00:03,000\nAnd then\n\n6\n00:00:09,000 --> 00:00:10,000\na pause\n```"
    docs = spark.createDataFrame([(1, raw), (2, "nothing"), (3, None)], "media_id long, text string")
    got = {r["media_id"]: r["srt"] for r in documents.resegment_documents(docs, ["media_id"]).collect()}
    assert got == {1: "1\n00:00:00,000 --> 00:00:02,000\nIt is a phrase.\n\n2\n00:00:02,000 --> 00:00:03,000\nAnd then\n\n3\n00:00:09,000 --> 00:00:10,000\na pause\n"}
    long = "First part of it; second part of it; third. " * 9
    one = spark.createDataFrame([(1, f"1\n00:00:00,000 --> 00:00:20,000\n{long}")], "media_id long, text string")
    pieces = folds.shared_seconds([len(p.split()) for p in ("First", "Second")], 20.0)
    assert pieces == [10.0, 10.0]
    said = spark.createDataFrame([(1, 0, [long[:132].strip(), long[132:].strip()])], "media_id long, first_seq long, pieces array<string>")
    srt = documents.resegment_documents(one, ["media_id"], answers=said).first()["srt"]
    assert len(re.findall(" --> ", srt)) == 2 and " ".join(" ".join(b.split("\n")[2:]) for b in srt.strip().split("\n\n")) == long.strip()
    wrong = said.withColumn("pieces", F.array(F.lit("other"), F.lit("words")))
    ruled = documents.resegment_documents(one, ["media_id"], answers=wrong).first()["srt"]
    assert "other" not in ruled and " ".join(" ".join(b.split("\n")[2:]) for b in ruled.strip().split("\n\n")) == long.strip()
    groups = spark.createDataFrame([(1, 0, 0, [1, 2, 3]), (1, 0, 1, [4])], "media_id long, batch_id long, group_no int, members array<int>")
    by_groups = documents.resegment_documents(docs.where("media_id = 1"), ["media_id"], groups=groups).first()["srt"]
    assert by_groups.startswith("1\n00:00:00,000 --> 00:00:03,000\nIt is a phrase. And then\n\n2\n")


def test_batches_by_json_by_srt_or_as_they_were(spark):
    cues = spark.createDataFrame([(m, k, str(k + 1), float(k), k + 0.9, f"t{k}") for m in range(6) for k in range(3)], "media_id long, seq long, idx string, start double, end double, text string")
    answers = [(0, '[{"index": "1-2", "text": "A"}, {"index": "3", "text": ""}]'), (1, "1\n00:00:00,000 --> 00:00:01,000\nB\n\n3\n00:00:02,000 --> 00:00:03,000\n2. C"), (2, "sorry"), (3, "[]"), (4, '[{"other": 1}]'), (4, None)][:5]
    got = {}
    for r in reconcile.translated_batches(cues, spark.createDataFrame(answers, "media_id long, raw string"), ["media_id"]).orderBy("media_id", "start").collect():
        got.setdefault((r["media_id"], r["source"]), []).append((r["idx"], r["start"], r["end"], r["text"]))
    own = [(str(k + 1), float(k), k + 0.9, f"t{k}") for k in range(3)]
    assert got == {(0, "json"): [("1-2", 0.0, 1.9, "A"), own[2]], (1, "srt"): [("1", 0.0, 0.9, "B"), own[1], ("3", 2.0, 2.9, "C")], (2, "original"): own, (3, "original"): own, (4, "json"): own, (5, "original"): own}
