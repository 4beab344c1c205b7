"""Concatenate-and-cut packing of token streams into fixed windows."""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, ship_package

WINDOW, END_ID = 4096, 2
#: Words and pieces kept with their ids in a Python worker: two generations of so many entries (some 100 MB in all).
CACHE_WORDS = 250_000
#: Python's white space beyond Unicode's White_Space, letters whose lower case depends on others or changes length, special tokens.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\u03a3", "\u0130", "<|")
#: The sign that stands for each byte in the merge model: printable bytes for themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Fixed value: the tokenizer's own pattern.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, word by word.

    The tokenizer composes, lowers and drops white space, then cuts at fixed patterns, so what lies between spaces can be
    encoded alone.  Words are looked up; unknown ones are cut into the tokenizer's own pieces, and unknown pieces go to
    its merge model one by one.  A piece is a word too, so one table holds both.  The table has two generations: what is
    looked up moves to the young one, and when that is full the old one goes, so common words stay and rare ones
    leave.  Texts where Python's white space or lower case could differ go to the tokenizer whole, and so do words with code
    points that are unassigned in Python's tables, as newer tables (or older ones) may class them otherwise.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        #: Two bytes an id where the vocabulary allows.
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece) or self.old.get(piece)
        if found is None:
            written = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTE_SIGNS)
            found = self._packed([t.id for t in self.model.tokenize(written)])
        self.known[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        if word.isascii() or "Cn" not in map(unicodedata.category, word):
            return self._piece(word) if word.isalpha() else b"".join(map(self._piece, _PIECES.findall(word)))
        return self.whole(word)

    def learn(self, words: set[str]) -> None:
        """Make the young generation hold ``words``."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        for word in words.difference(known):
            known[word] = old[word] if word in old else self._word(word)

    def codes(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text in turn, as bytes of ``kind``; texts are taken in groups of some megabytes, each split once."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < 2_000_000):
                size += len(texts[to])
                to += 1
            part, at = texts[at:to], to
            plain = [None if any(x in text for x in _ODD) else (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split() for text in part]
            self.learn(set().union(*filter(None, plain)))
            ids = self.known.__getitem__
            for text, words in zip(part, plain, strict=True):
                yield self.whole(text) if words is None else b"".join(map(ids, words))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """One little-endian unsigned 32-bit string for each text."""
        return (np.frombuffer(x, dtype=self.kind).astype("<u4").tobytes() for x in self.codes(texts))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _slices(batch: pa.RecordBatch, column: int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of one column, a row at least."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _tokenize(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, ids = TaskContext.get().partitionId(), 0, encoder(path)
        tail, mark, width = np.array([end_id], dtype=ids.kind).tobytes(), b"4" if ids.kind.itemsize == 4 else b"", ids.kind.itemsize
        for batch in (x for b in batches for x in _slices(b, 1)):
            codes = [mark + x + tail for x in ids.codes([x or "" for x in batch.column(1).to_pylist()])]
            sizes = np.array([len(x) // width for x in codes], dtype=np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(codes), part)), pa.array(starts), pa.array(sizes), pa.array(codes, pa.binary())], names=["doc_id", "part", "part_start", "doc_tokens", "ids"])

    return run


def unpack_ids(packed: bytes) -> np.ndarray:
    """Ids as stored: two bytes each, or ``b"4"`` and four bytes each (an odd length tells)."""
    return np.frombuffer(packed, dtype="<u4", offset=1) if len(packed) % 2 else np.frombuffer(packed, dtype="<u2")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of ``(doc_id, part, part_start, doc_tokens, ids)``: each text's ids and the end id.

    ``part`` is the writing task's partition and ``part_start`` the ids before the document in it, so the
    table alone fixes the order of the stream; a later rerun of any reading task sees the same numbers.
    """
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(narrow.mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, part long, part_start long, doc_tokens long, ids binary"), "tokens")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, starts, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            out: list[list] = [[] for _ in range(8)]
            for k, doc in enumerate(docs):
                ids = unpack_ids(packed[k].as_py()).astype("<u4")
                raw, first, total, at = ids.tobytes(), starts[k], len(ids), 0
                while at < total:
                    sequence, offset = divmod(first + at, window)
                    length = min(total - at, window - offset)
                    cell = raw[4 * at : 4 * (at + length)]
                    for column, value in zip(out, (doc, at, length, zlib.crc32(cell), total, sequence, offset, cell), strict=True):
                        column.append(value)
                    at += length
                if len(out[0]) > 20_000:
                    yield _pieces(out)
                    out = [[] for _ in range(8)]
            if out[0]:
                yield _pieces(out)

    return run


def _pieces(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:7]] + [pa.array(out[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Boundary records of the concatenated token stream cut into windows of ``window`` ids.

    First pass: tokenize, writing each document with its offset in its partition.  The partitions' token
    totals (one row a partition) become global offsets by a prefix sum.  Second pass: each document's
    span is cut at multiples of ``window``.  Every window but the last is full, so padding is under one window.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids`` (binary,
    little-endian unsigned 32-bit).  Null and empty texts give the end id alone; a document longer than a
    window gives several pieces; repeated rows are packed again; an empty table gives no rows; a null
    doc_id is carried as null.
    """
    table = tokenized(docs, tokenizer or default_tokenizer(), end_id, id_col, text_col)
    spark = docs.sparkSession
    totals = table.groupBy("part").agg(F.max(F.col("part_start") + F.col("doc_tokens")).alias("n")).collect()
    offsets, before = [], 0
    for row in sorted(totals):
        offsets.append((row["part"], before))
        before += row["n"]
    # One row a partition: as small as the driver's own list of tasks.
    base = F.broadcast(spark.createDataFrame(offsets, "part long, base long"))
    placed = table.join(base, "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("first"), "ids")
    return placed.mapInArrow(_cut(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op5_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
