from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from spark_cues.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, chunk string"


def model(seed=0):
    rng = np.random.default_rng(seed)
    n = len(chat.STATES)
    return chat.RoleModel(np.log(rng.dirichlet(np.ones(n))), np.log(rng.dirichlet(np.ones(n), n)), np.log(rng.dirichlet(np.ones(4), n)))


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_matches_enumeration(seed):
    m, x = model(seed), np.random.default_rng(seed).integers(0, 4, 5)
    score = lambda p: m.start[p[0]] + sum(m.move[a, b] for a, b in zip(p, p[1:])) + sum(m.emit[s, k] for s, k in zip(p, x, strict=True))
    assert tuple(chat.viterbi(m, x, None)) == max(product(range(len(chat.STATES)), repeat=5), key=score)


def test_chunks_scored_apart_join_to_the_whole():
    m, x = model(9), np.random.default_rng(9).integers(0, 4, 9)
    n = len(chat.STATES)
    a, b = chat.chunk_scores(m, x[:4]), chat.chunk_scores(m, x[4:])
    whole = chat.chunk_scores(m, x)
    assert np.allclose((a[n][:, None] + b[:n]).max(axis=0), whole[n])


def turns(n=40, long=0):
    out = []
    for c in range(n):
        for t in range(long or 2 + c % 6):
            role = "user" if t % 2 == 0 else "assistant"
            out.append((c, t, role, "What is it?" if role == "user" else "It is a long answer that goes on.\nAnd has more lines to it.\n\nAnd a last one.", "x"))
    return out


def parsed(spark, rows):
    written = chat.written_transcripts(spark.createDataFrame(rows, SCHEMA))
    lines = chat.transcript_lines(written, keep=("role",)).cache()
    fitted = chat.fit_roles(lines)
    return lines, chat.parse_transcripts(lines, fitted)


def test_roles_are_recovered_and_rendered(spark):
    lines, got = parsed(spark, turns())
    right = lines.alias("a").join(got.alias("b"), ["conv", "turn", "piece", "line_no"]).select(F.avg((F.col("a.role") == F.col("b.role")).cast("int"))).first()[0]
    assert right > 0.97
    out = chat.canonical_turns(lines.drop("role"), got)
    first = out.where("conv_id = 1 and turn_no = 0").first()
    assert first["rendered"] == "<|user|>\nWhat is it?\n<|end|>\n"
    assert out.groupBy("conv_id").agg((F.max("turn_no") + 1 == F.count("*")).alias("gapless")).where("not gapless").count() == 0


def test_long_conversations_are_cut_in_chunks_with_the_same_result(spark, monkeypatch):
    rows = turns(3, 40)
    place = ["conv", "turn", "piece", "line_no", "role", "turn_no"]
    whole = sorted(map(tuple, parsed(spark, rows)[1].select(*place).collect()))
    monkeypatch.setattr(chat, "CHUNK_TURNS", 3)
    assert sorted(map(tuple, parsed(spark, rows)[1].select(*place).collect())) == whole


def test_a_long_turn_is_cut_in_chunks_and_parsed_like_one_pass(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_TURNS", 5)
    text = "\n".join(x for k in range(150) for x in (f"User: what about {k}?", "Assistant: It is long.", "And goes on.", ""))
    rows = [(7, 0, "user", text, "x"), *((8, None, "user", f"Q: one of {k}", "x") for k in range(300)), *turns(4)]
    lines = chat.transcript_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), keep=("role",)).cache()
    sizes = lines.groupBy("conv", "chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 40 and sizes.where("conv = 8").count() >= 8
    fitted = chat.fit_roles(lines)
    got = {tuple(r[:4]): (r["role"], r["turn_no"]) for r in chat.parse_transcripts(lines, fitted).select("conv", "turn", "piece", "line_no", "role", "turn_no").collect()}
    want = {}
    for conv in (7, 8, 0, 3):
        of = lines.where(F.col("conv") == conv).orderBy("turn", "piece", "line_no").collect()
        assert [r["chunk"] for r in of] == sorted(r["chunk"] for r in of)
        turn = -1
        for r, state in zip(of, chat.viterbi(fitted, np.array([r["symbol"] for r in of]), None), strict=True):
            turn += state % 2 == 0
            want[conv, r["turn"], r["piece"], r["line_no"]] = (chat.ROLES[state // 2], turn)
    assert {k: v for k, v in got.items() if k[0] in (7, 8, 0, 3)} == want


def test_fitted_counts_match_plain_loops(spark):
    lines = chat.transcript_lines(spark.createDataFrame(turns(12), SCHEMA), keep=("role",)).cache()
    got, n = chat.fit_roles(lines), len(chat.STATES)
    emit, move, start = np.ones((n, chat.SYMBOLS)), np.full((n, n), 0.5), np.full(n, 0.5)
    before = {}
    for r in lines.orderBy("conv", "turn", "piece", "line_no").collect():
        conv, last = r["conv"], before.get(r["conv"])
        state = chat.ROLES.index(r["role"]) * 2 + (last is not None and last[1] == r["turn"])
        emit[state, r["symbol"]] += 1
        if last is None:
            start[state] += 1
        else:
            move[last[0], state] += 1
        before[conv] = (state, r["turn"])
    for s in range(0, n, 2):
        start[s + 1] = 1e-9
        for b in range(n):
            if b // 2 != s // 2:
                move[b, s + 1] = 1e-9
    for a, b in ((got.start, start), (got.move, move), (got.emit, emit)):
        assert np.allclose(a, np.log(b / b.sum(axis=-1, keepdims=True)))


def test_edges(spark):
    rows = turns(6) + [(None, 0, "user", "Q: hello?", "x"), (90, None, "user", "hi", "x"), (91, 0, None, None, "x"), (92, 0, "user", "", "x"), (93, 0, "user", "same", "x"), (93, 0, "user", "same", "x"), (94, 0, "user", "line\n" * 5000, "x")]
    lines, got = parsed(spark, rows)
    assert got.count() == lines.count()
    assert got.where("conv is null").count() == 1 and got.where("conv = 93").count() == 1 and got.where("conv = 91").count() == 0
    assert chat.canonical_turns(lines.drop("role"), got).where("conv_id is null").count() == 1
    none = chat.transcript_lines(spark.createDataFrame([], SCHEMA), keep=("role",))
    assert chat.parse_transcripts(none, chat.fit_roles(none)).count() == 0


def test_held_out_accuracy(spark, tiny):
    import os

    sf = tiny.replace("0.001", "0.1")
    if not os.path.isdir(sf):
        pytest.skip("no larger tables here")
    written = chat.written_transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    lines = chat.transcript_lines(written, keep=("role",)).cache()
    held = F.pmod(F.xxhash64("conv"), F.lit(5)) == 0
    got = chat.parse_transcripts(lines, chat.fit_roles(lines.where(~held)))
    both = lines.where(held).alias("a").join(got.alias("b"), ["conv", "turn", "piece", "line_no"])
    assert both.select(F.avg((F.col("a.role") == F.col("b.role")).cast("int"))).first()[0] > 0.95
