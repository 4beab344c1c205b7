import zlib

import numpy as np
import pytest
from spark_cues.llm import packing

ODD = ["It's we'll 'tis ''s 12,345 Ⅳ² ΑΣ İx a\x1cb <|endoftext|> é é ́x foo_bar __ --a'S", None, "", " \n", "ǅ ﬁ ß ẞ", "word " * 9000, "x" * 5000, "don't STOP", "don't STOP"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_word_by_word_equals_whole_texts(tokenizer):
    coder = packing.WordEncoder(packing.default_tokenizer())
    texts = [t or "" for t in ODD]
    for text, raw in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_round_trip(spark, tokenizer):
    docs = spark.createDataFrame([(k if k != 3 else None, t, "clash") for k, t in enumerate(ODD)], "doc_id long, text string, offset string").repartition(3)
    got = packing.pack_documents(docs, window=512).orderBy("sequence_id", "offset").collect()
    where, stream = {}, []
    for r in got:
        assert (r["sequence_id"], r["offset"]) == divmod(len(stream), 512)
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and r["offset"] + r["length"] <= 512
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        stream += ids
        where.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
    for k, t in enumerate(ODD):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(where[k if k != 3 else None])
        assert [x for _, ids, _ in pieces for x in ids] == want
        assert {n for _, _, n in pieces} == {len(want)}
        assert [s for s, _, _ in pieces] == list(np.cumsum([0, *[len(ids) for _, ids, _ in pieces]])[:-1])


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wide_ids_survive_storage():
    ids = np.array([1, 70_000], dtype="<u4")
    assert packing.unpack_ids(b"4" + ids.tobytes()).tolist() == [1, 70_000]


def test_every_code_point_has_the_tokenizer_s_ids(tokenizer):
    coder = packing.WordEncoder(packing.default_tokenizer())
    points = [chr(c) for c in range(0x32000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b {c}" for c in points[at : at + 256]) for at in range(0, len(points), 256)]
    want = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [text for text, raw, w in zip(texts, coder.encode(texts), want, strict=True) if np.frombuffer(raw, "<u4").tolist() != w.ids]
    assert not wrong


def test_a_small_table_of_words_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    coder = packing.WordEncoder(packing.default_tokenizer())
    texts = [" ".join(f"word{k % 7} other, {k}" for k in range(j, j + 9)) for j in range(40)]
    for text in texts:
        assert np.frombuffer(next(coder.encode([text])), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
