"""Transcript parsing by a hidden Markov model over line features, and canonical turns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut, materialize, ship_package

ROLES = ("system", "user", "assistant")
#: States: a line begins a turn of a role, or goes on with it.
STATES = [(r, part) for r in range(len(ROLES)) for part in ("begin", "inside")]
# Words that name a speaker.
SPEAKERS = {"user": 1, "human": 1, "you": 1, "customer": 1, "question": 1, "q": 1, "prompt": 1, "assistant": 2, "ai": 2, "bot": 2, "agent": 2, "answer": 2, "a": 2, "model": 2, "system": 0, "instruction": 0, "instructions": 0, "context": 0}
#: Marker classes: none, one of each role, a dash or chevron, an unknown name.
NONE, DASH, OTHER = 0, 4, 5
MARKS, LENGTHS = 6, 6
SYMBOLS = MARKS * LENGTHS * 2 * 2
#: A chunk, the unit of work however long a conversation or a turn, holds so many turns of so many lines: it is cut by lines.
CHUNK_TURNS, TURN_LINES = 256, 8
FIT_CONVERSATIONS = 20_000
_NO_CONV = -(1 << 63)
#: Runs of space are taken once and never given back, so a long one costs its length.
_MARK = r"^\s*+(?:#++\s*+|\*\*|<\||\[|>)?+\s*+(\p{L}{1,15})\s*+(?:\*\*|\|>|\])?\s*+[:>\]]\s*+"
_DASH = r"^\s*+(?:[-–—]|>{1,2})\s++"


def _mark(line: Column) -> Column:
    word = F.lower(F.regexp_extract(line, _MARK, 1))
    known = F.create_map(*[F.lit(x) for name, role in SPEAKERS.items() for x in (name, role + 1)])
    return F.when(word != "", F.coalesce(F.get(F.array(F.try_element_at(known, word)), F.lit(0)), F.lit(OTHER))).when(F.regexp_like(line, F.lit(_DASH)), F.lit(DASH)).otherwise(F.lit(NONE))


def symbol(line: Column, gap: Column) -> Column:
    """One of SYMBOLS: marker class, length on a doubling scale, a question mark at the end, a blank line before."""
    size = F.least(F.floor(F.log2(F.length(line) / 16.0 + 1.0)), F.lit(LENGTHS - 1)).cast("int")
    question = F.regexp_like(line, F.lit(r"\?\s*$")).cast("int")
    return ((_mark(line) * LENGTHS + size) * 2 + question) * 2 + gap.cast("int")


def _with_gaps(lines: Column) -> Column:
    """Each line with whether a blank one stands before it."""
    blank = lambda x: ~F.regexp_like(x, F.lit(r"\S"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, 1, F.size(lines) - 1))
    return F.zip_with(lines, before, lambda x, b: F.struct(x.alias("line"), F.coalesce(blank(b), F.lit(False)).alias("gap")))


def bare(line: Column) -> Column:
    """The line without its speaker marker, if the marker names a speaker or is a dash."""
    return F.when(_mark(line).isin(1, 2, 3), F.regexp_replace(line, _MARK, "")).when(_mark(line) == DASH, F.regexp_replace(line, _DASH, "")).otherwise(line)


@dataclass(frozen=True)
class RoleModel:
    """Logarithms of start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _lines_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces with the number of lines that their conversation has before them in this partition."""
    conv, total = None, 0
    for batch in batches:
        ids, sizes = batch.column("c").to_numpy(), batch.column("n").to_numpy()
        sums = np.cumsum(sizes) - sizes
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[: len(ids)]
        before = sums - np.repeat(sums[starts], np.diff(np.append(starts, len(ids))))
        if len(ids):
            if ids[0] == conv:
                before[ids == conv] += total
            conv, total = ids[-1], int(before[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=[*batch.schema.names, "before"])


def transcript_lines(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(conv, chunk, turn, piece, line_no, line, symbol, *keep)``: numbered, non-blank lines of transcript pieces.

    Exact repeats of a row count once; pieces with one place in a conversation are told apart by a digest of their text.
    Null texts have no lines; a null conversation is one of its own; null places come first.  Chunks are cut by lines:
    pieces are dealt by ranges of (conversation, turn, piece), and prefix sums within and over the ranges place each line.
    """
    ship_package(turns.sparkSession)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.coalesce(F.col(order_col).cast("long"), F.lit(-1)).alias("turn"), F.col(text_col).cast("string").alias("text"), *keep).where("text is not null").distinct()
    rows = rows.select("conv", "turn", F.xxhash64("text", *keep).alias("piece"), *keep, "text", F.coalesce("conv", F.lit(_NO_CONV)).alias("c"), F.size(F.split("text", "\n", -1)).cast("long").alias("n"))
    ranged = rows.repartitionByRange("c", "turn", "piece").sortWithinPartitions("c", "turn", "piece")
    # Written once: the ranges, and with them the numbers of the chunks, mustn't change if a task runs again.
    placed = materialize(ranged.mapInArrow(_lines_before, T.StructType([*rows.schema, T.StructField("before", T.LongType())])).withColumn("part", F.spark_partition_id()), "transcript-pieces")
    totals = placed.groupBy("c", "part").agg(F.max(F.col("before") + F.col("n")).alias("total"))
    # Only a conversation that goes over the edge of a range needs a base: two rows a range at most.
    whole = totals.groupBy("c").agg(F.count("*").alias("parts")).where("parts > 1").select("c")
    so_far = Window.partitionBy("c").orderBy("part")
    bases = totals.join(whole, "c", "left_semi").select("c", "part", (F.sum("total").over(so_far) - F.col("total")).alias("base"))
    at = (F.coalesce("base", F.lit(0)) + F.col("before") + F.col("line_no")) / (CHUNK_TURNS * TURN_LINES)
    lines = placed.join(F.broadcast(bases), ["c", "part"], "left").select("conv", "turn", "piece", *keep, "base", "before", F.posexplode(_with_gaps(F.split("text", "\n", -1))).alias("line_no", "x"))
    lines = lines.select("conv", F.floor(at).alias("chunk"), "turn", "piece", *keep, "line_no", "x.line", "x.gap").where(F.regexp_like("line", F.lit(r"\S")))
    return lines.withColumn("symbol", symbol(F.col("line"), F.col("gap"))).drop("gap")


def fit_roles(lines: DataFrame, role_col: str = "role", conversations: int = FIT_CONVERSATIONS) -> RoleModel:
    """Counts with one added, from at most ``conversations`` conversations (smallest hash) with known roles.

    A line begins a turn where it is its piece's first.  Only sums over 6 states and 144 symbols reach the driver.
    """
    chosen = F.broadcast(lines.select("conv").where("conv is not null").distinct().orderBy(F.xxhash64("conv"), "conv").limit(conversations))
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.lower(F.col(role_col))).cast("int") - 1
    first = F.col("line_no") == F.min("line_no").over(Window.partitionBy("conv", "turn", "piece"))
    known = lines.join(chosen, "conv").withColumn("state", role * 2 + F.when(first, 0).otherwise(1)).where("state >= 0")
    # Steps over the edges of chunks are left out, so that no task sorts a whole long conversation.
    w = Window.partitionBy("conv", "chunk").orderBy("turn", "piece", "line_no")
    steps = cut(known.select("state", "symbol", F.lag("state").over(w).alias("before"), (F.col("chunk") <= 0).alias("opening")))
    emit, move, start = np.ones((len(STATES), SYMBOLS)), np.full((len(STATES),) * 2, 0.5), np.full(len(STATES), 0.5)
    for s, x, n in steps.groupBy("state", "symbol").count().collect():
        emit[s, x] += n
    for s, b, opening, n in steps.groupBy("state", "before", "opening").count().collect():
        if b is not None:
            move[b, s] += n
        elif opening:
            start[s] += n
    for r in range(len(ROLES)):  # a line goes on only with the turn of its own role
        move[:, 2 * r + 1][[s for s in range(len(STATES)) if s // 2 != r]] = 1e-9
        start[2 * r + 1] = 1e-9
    return RoleModel(*(np.log(x / x.sum(axis=-1, keepdims=True)) for x in (start, move, emit)))


def viterbi(model: RoleModel, symbols: np.ndarray, before: int | None, after: int | None = None) -> list[int]:
    """The likeliest states of ``symbols``, after state ``before`` (None: at the start), ending in ``after`` if given."""
    score = (model.start if before is None else model.move[before]) + model.emit[:, symbols[0]]
    back = np.zeros((len(symbols), len(score)), dtype=np.int8)
    for t in range(1, len(symbols)):
        every = score[:, None] + model.move
        back[t] = every.argmax(axis=0)
        score = every.max(axis=0) + model.emit[:, symbols[t]]
    state = int(score.argmax()) if after is None else after
    path = [state]
    for t in range(len(symbols) - 1, 0, -1):
        state = int(back[t, state])
        path.append(state)
    return path[::-1]


def chunk_scores(model: RoleModel, symbols: np.ndarray) -> np.ndarray:
    """Best score from each state before the chunk to each state at its end; the last row is for the start."""
    n = len(model.start)
    score = np.vstack([model.move, model.start]) + model.emit[:, symbols[0]]
    for x in symbols[1:]:
        score = (score[:, :, None] + model.move[None]).max(axis=1) + model.emit[:, x]
    return score.reshape(n + 1, n)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Rows of each run of equal first ``keys`` columns, from sorted batches; a run is one chunk."""
    hold: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        hold = table if hold is None else pa.concat_tables([hold, table])
        if hold.num_rows < 50_000:
            continue
        cuts = _cuts(hold, keys)
        for a, b in pairwise(cuts[:-1]):
            yield _columns(hold, a, b)
        hold = hold.slice(cuts[-2])
    if hold is not None and hold.num_rows:
        for a, b in pairwise(_cuts(hold, keys)):
            yield _columns(hold, a, b)


def _cuts(table: pa.Table, keys: int) -> list[int]:
    ids = np.stack([table.column(k).to_numpy() for k in range(keys)])
    return [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]


def _columns(table: pa.Table, a: int, b: int) -> list[np.ndarray]:
    return [c.to_numpy() for c in table.slice(a, b - a).columns]


def _matrices(model: RoleModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, chunk, *_, symbols in _runs(batches, 2):
            yield pa.RecordBatch.from_arrays([pa.array(conv[:1]), pa.array(chunk[:1]), pa.array([chunk_scores(model, symbols).ravel().tolist()], pa.list_(pa.float64()))], names=["c", "chunk", "scores"])

    return run


def _stitch(model: RoleModel):
    """Entry and exit state of each chunk of a conversation, from its chunks' matrices in order.

    Forwards, one matrix at a time, only the best way into each state is kept: six small numbers a chunk.
    """
    n = len(model.start)

    def ends(conv: int, chunks: list[int], back: list[np.ndarray], score: np.ndarray) -> pa.RecordBatch:
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        out.reverse()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([conv] * len(out), chunks, [-1, *out[:-1]], out)], names=["c", "chunk", "before", "after"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chunks, back, score = None, [], [], None
        for batch in batches:
            for c, chunk, flat in zip(*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)), strict=True):
                m = np.asarray(flat).reshape(n + 1, n)
                if c != conv:
                    if chunks:
                        yield ends(conv, chunks, back, score)
                    conv, chunks, back, score = int(c), [], [], m[n]
                else:
                    every = score[:, None] + m[:n]
                    back.append(every.argmax(axis=0).astype(np.int8))
                    score = every.max(axis=0)
                chunks.append(int(chunk))
        if chunks:
            yield ends(conv, chunks, back, score)

    return run


def _decode(model: RoleModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, chunk, turn, piece, line_no, before, after, symbols in _runs(batches, 2):
            path = np.array(viterbi(model, symbols, None if before[0] < 0 else int(before[0]), None if after[0] < 0 else int(after[0])))
            begun = np.cumsum(path % 2 == 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (conv, chunk, turn, piece, line_no, path // 2, begun)], names=["c", "chunk", "turn", "piece", "line_no", "role_no", "begun"])

    return run


def parse_transcripts(lines: DataFrame, model: RoleModel) -> DataFrame:
    """``(conv, chunk, turn, piece, line_no, role, turn_no)`` of every line; ``turn_no`` counts recovered turns from 0.

    Chunks of a conversation are decoded apart: each gives the best scores between its outer states, those
    are joined along the conversation, and each chunk is then decoded between its fixed states.  The result is
    that of one Viterbi pass, and no task holds a whole long conversation.
    """
    ship_package(lines.sparkSession)
    none = F.lit(_NO_CONV)
    named = lines.select(F.coalesce("conv", none).alias("c"), "chunk", "turn", "piece", F.col("line_no").cast("long").alias("line_no"), F.col("symbol").cast("long").alias("symbol"))
    chunks = named.groupBy("c").agg(F.count_distinct("chunk").alias("n")).where("n > 1").select("c")
    place = ["c", "chunk", "turn", "piece", "line_no"]
    ordered = lambda df: df.repartition("c", "chunk").sortWithinPartitions(*place)
    matrices = ordered(named.join(chunks, "c", "left_semi")).select(*place, "symbol").mapInArrow(_matrices(model), "c long, chunk long, scores array<double>")
    ends = matrices.repartition("c").sortWithinPartitions("c", "chunk").mapInArrow(_stitch(model), "c long, chunk long, before long, after long")
    framed = named.join(ends, ["c", "chunk"], "left").select(*place, F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("after", F.lit(-1)).alias("after"), "symbol")
    found = materialize(ordered(framed).mapInArrow(_decode(model), "c long, chunk long, turn long, piece long, line_no long, role_no long, begun long"), "decoded")
    begun = found.groupBy("c", "chunk").agg(F.max("begun").alias("n"))
    base = begun.select("c", "chunk", (F.sum("n").over(Window.partitionBy("c").orderBy("chunk")) - F.col("n")).alias("base"))
    named_role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("role_no").cast("int") + 1)
    return found.join(base, ["c", "chunk"]).select(F.when(F.col("c") != none, F.col("c")).alias("conv"), "chunk", "turn", "piece", "line_no", named_role.alias("role"), (F.col("base") + F.col("begun") - 1).alias("turn_no"))


def canonical_turns(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """``(conv_id, turn_no, role, text, rendered)``: markers cut off, lines of a turn joined, in one canonical form."""
    place = ["conv", "chunk", "turn", "piece", "line_no"]
    same = [lines[c].eqNullSafe(parsed[c]) if c == "conv" else lines[c] == parsed[c] for c in place]
    both = lines.join(parsed, same).select(parsed["conv"].alias("conv_id"), parsed["turn_no"], parsed["role"], F.struct(lines["turn"], lines["piece"], lines["line_no"], bare(F.col("line")).alias("line")).alias("x"))
    turns = both.groupBy("conv_id", "turn_no").agg(F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
    return turns.select("*", F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.trim("text"), F.lit("\n<|end|>\n")).alias("rendered"))


def written_transcripts(turns: DataFrame) -> DataFrame:
    """Conversations as found in raw dumps: each keeps one style of speaker markers, and some turns lack theirs."""
    style, bare_turn = F.pmod(F.xxhash64("conv_id"), F.lit(5)), F.pmod(F.xxhash64(F.lit(3), "conv_id", "turn"), F.lit(8)) == 0
    names = [("User", "Assistant", "System", ": "), ("Human", "AI", "Context", ": "), ("Q", "A", "Instructions", ": "), ("### User", "### Assistant", "### System", ": "), ("[user", "[assistant", "[system", "] ")]
    mark = F.lit("")
    for k, (user, assistant, system, after) in enumerate(names):
        name = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).otherwise(system)
        mark = F.when(style == k, F.concat(name, F.lit(after))).otherwise(mark)
    return turns.withColumn("text", F.when(bare_turn, F.col("text")).otherwise(F.concat(mark, "text")))


def op2_hmm_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles recovered for all of ``conversations`` written as transcripts; roles of a fifth are never fitted on."""
    written = written_transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    lines = materialize(transcript_lines(written, keep=("role",)), "transcript-lines")
    model = fit_roles(lines.where(F.pmod(F.xxhash64("conv"), F.lit(5)) != 0))
    return canonical_turns(lines.drop("role"), parse_transcripts(lines, model))
