from collections import defaultdict

import pytest
from spark_cues.llm import line_dedup

LINE = "accept all cookies to go on"
SCHEMA = "doc_id long, text string, source string, n_removed string"


def plain(rows, sites, min_words):
    spread, first = defaultdict(set), {}
    for d, t, s, _ in rows:
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            k = line.strip(" \t\r")
            if k.count(" ") >= min_words - 1:
                if s is not None:
                    spread[k].add(s)
                first[k] = min(first.get(k, (1 << 70, 0)), (d, p))
    out = {}
    for d, t, _, _ in rows:
        if t is None:
            out[d] = (None, 0)
            continue
        kept, gone = [], 0
        for p, line in enumerate(t.split("\n")):
            k = line.strip(" \t\r")
            if len(spread.get(k, ())) >= sites and first[k] != (d, p):
                gone += 1
            else:
                kept.append(line)
        out[d] = ("\n".join(kept), gone)
    return out


def rows(spread):
    data = [(k, f"own line number {k} is here\n  {LINE}\t\r\nEr.\n{LINE}", f"s{k % spread}", "x") for k in range(30)]
    return data + [(100, None, "s1", "x"), (101, "", "s1", "x"), (102, "\n\n", None, "x"), (103, "short line", None, "x"), (104, LINE, None, "x"), (105, "\n".join([LINE] * 3000 + ["the last line of this text"]), "s2", "x")]


@pytest.mark.parametrize("spread", [3, 7, 8, 9, 15])
def test_matches_brute_force_round_the_threshold(spark, spread):
    data = rows(spread)
    got = line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA).repartition(4))
    assert got.columns == ["doc_id", "text", "source", "n_removed"]
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()} == plain(data, line_dedup.SITES, line_dedup.MIN_WORDS)


def test_null_ids_repeats_and_empty_tables(spark):
    data = [(None, LINE, "s0", "x"), (1, LINE, "s1", "x"), (1, LINE, "s1", "x"), (1, f"{LINE}\nmore", "s2", "x")]
    got = line_dedup.remove_boilerplate(spark.createDataFrame(data, SCHEMA), sites=3)
    assert sorted((r["doc_id"] or -1, r["text"], r["n_removed"]) for r in got.collect()) == [(-1, LINE, 0), (1, "", 1), (1, "", 1), (1, "more", 1)]
    assert line_dedup.remove_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_stage_takes_short_lines_and_scripts_without_spaces(spark):
    from spark_cues.llm import stages

    tabs, chinese, short, few = "accept\tall\tour\tuses\tnow", "本网站使用小型文本文件以改善您的浏览体验。", "All rights reserved.", "Yes."
    data = [(k, "\n".join([f"own {k}", "", tabs, chinese, short, *([few] if k < 10 else [])]), f"s{k}") for k in range(20)]
    out = stages.line_dedup_stage(spark, spark.createDataFrame(data, "doc_id long, text string, source string"), "")
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {k: t if k == 0 else "\n".join([f"own {k}", "", *([few] if k < 10 else [])]) for k, t, _ in data}
