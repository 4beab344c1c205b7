"""State of live captions, logs and answers, kept by key: what a trigger doesn't touch isn't read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import LONG_END, SPACES

_SEGMENT = re.compile(r"segment (\d+/\d+)")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names)


def _rows(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches))


def _millis(stamps: pd.Series) -> list[int]:
    return [t.value // 1_000_000 for t in map(pd.Timestamp, stamps)]


def phase_of(lines: list[tuple[int, str]], patterns: list[tuple[int, str, str]]) -> str:
    """Status of the newest line that holds a pattern; the first pattern in priority wins in a line."""
    for _, line in sorted(lines, reverse=True):
        for _, status, pattern in sorted(patterns):
            if pattern in line:
                part = _SEGMENT.search(line) if status == "synthesising" else None
                return f"synthesising segment {part[1]}" if part else status
    return "processing"


class RunLog(StatefulProcessor):
    """A run's last lines; gives ``(run_id, version, status)`` whenever lines of the run arrive.

    Works on rows ``(run_id, line_no, line)``: a pandas form makes frames for every run, which costs more than its lines.
    """

    def __init__(self, patterns: list[tuple[int, str, str]], last: int):
        self.patterns, self.last = sorted(patterns), last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "numbers array<bigint>, lines array<string>, version bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        numbers, lines, version = self.held.get() or ([], [], -1)
        known = dict(zip(numbers, lines, strict=True))
        for _, number, line in rows:
            known.setdefault(number, line or "")
        top = max(known)
        kept = sorted((n, x) for n, x in known.items() if n > top - self.last)
        self.held.update(([n for n, _ in kept], [x for _, x in kept], version + 1))
        yield Row(run_id=key[0], version=version + 1, status=phase_of(kept, self.patterns))


class PhraseMerger(StatefulProcessor):
    """Phrases of a medium's live cues, and late cues apart.

    With ``hold`` (milliseconds) cues wait until the watermark has passed their time, so that they are taken in order of
    (time, number) whatever triggers they came in; a phrase that stays open so long after its last cue is given out by a timer, and the
    medium forgotten.  A cue after so long a silence begins anew, timer or no timer.  Without, they are taken as they come, each trigger's by number.
    """

    NAMES = ["media_id", "first_seq", "start", "end", "text", "late"]

    def __init__(self, gap: float, hold: int | None):
        self.gap, self.hold = gap, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first_seq bigint, start double, text string")
        self.tail = handle.getValueState("tail", "end double, ts bigint")
        if self.hold is not None:
            self.waiting = handle.getMapState("waiting", "ts bigint, seq bigint", "start double, end double, text string")

    def _taken(self, media, cues: list[tuple]) -> list[tuple]:
        """Rows that these cues ``(ts, seq, start, end, text)``, in order, give out."""
        begun, tail, out = self.open.get() if self.open.exists() else None, self.tail.get() if self.tail.exists() else None, []

        def close():
            if begun:
                out.append((media, begun[0], begun[1], tail[0], begun[2].strip(SPACES), False))

        for ts, seq, start, end, text in cues:
            said = (text or "").strip(SPACES)
            if tail and self.hold is not None and ts - tail[1] > self.hold:
                close()
                begun = tail = None
            if tail and start < tail[0]:
                out.append((media, seq, start, end, said, True))
                continue
            if begun and round(start - tail[0], 6) > self.gap:
                close()
                begun = None
            begun, tail = (begun[0], begun[1], f"{begun[2]} {said}") if begun else (seq, start, said), (end, ts)
            if said.endswith(LONG_END):
                close()
                begun = None
        if begun:
            self.open.update(begun)
        else:
            self.open.clear()
        if tail:
            self.tail.update(tail)
        return out

    def _due(self, media, watermark: int) -> list[tuple]:
        """What is due at this watermark: waiting cues in order, then the phrase that has been open too long."""
        waiting = sorted((ts, seq, *cue) for (ts, seq), cue in self.waiting.iterator())
        ready = [c for c in waiting if c[0] <= watermark]
        out = self._taken(media, ready) if ready else []
        for ts, seq, *_ in ready:
            self.waiting.removeKey((ts, seq))
        if len(ready) < len(waiting):
            self.handle.registerTimer(waiting[len(ready)][0])
        elif self.tail.exists():
            end, ts = self.tail.get()
            if ts + self.hold <= watermark:
                if self.open.exists():
                    first, start, text = self.open.get()
                    out.append((media, first, start, end, text.strip(SPACES), False))
                self.open.clear()
                self.tail.clear()
            else:
                self.handle.registerTimer(ts + self.hold)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cues = _rows(rows)
        cues = cues[cues["seq"].notna()]  # a row without a number only moves the time
        if not len(cues):
            return
        if self.hold is None:
            taken = sorted((int(r.seq), r.start, r.end, r.text) for r in cues.itertuples(index=False))
            yield _frame(self._taken(key[0], [(0, *c) for c in taken]), self.NAMES)
            return
        for ts, row in zip(_millis(cues["ts"]), cues.itertuples(index=False), strict=True):
            self.waiting.updateValue((ts, int(row.seq)), (row.start, row.end, row.text or ""))
        yield _frame(self._due(key[0], timerValues.getCurrentWatermarkInMs()), self.NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame(self._due(key[0], timerValues.getCurrentWatermarkInMs()), self.NAMES)


class TokenText(StatefulProcessor):
    """A request's tokens by number until all have come; with ``limit`` (milliseconds) what is unfinished so long after its last token leaves.

    Tokens are kept in chunks of ``CHUNK`` numbers, the first one beside the counters, so a trigger reads and writes what it touches, a chunk a call.
    A request has one timer at most: it is set anew when it fires before the time.  Works on rows ``(request_id, token_no, token, done, ms)``, ``ms``
    with ``limit`` only: what comes out is gathered in batches, where a pandas form makes one of each request.
    """

    CHUNK = 256

    def __init__(self, limit: int | None):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "received bigint, last bigint, ts bigint, due bigint, numbers array<bigint>, tokens array<string>")
        self.further = handle.getMapState("further", "chunk bigint", "numbers array<bigint>, tokens array<string>")

    def _text(self, chunks: dict[int, dict[int, str]], received: int) -> str:
        """All tokens in order: those of ``chunks``, and of the state where that has others."""
        if received > sum(map(len, chunks.values())):
            chunks = {c: dict(zip(*held, strict=True)) for (c,), held in self.further.iterator()} | chunks
        return "".join(chunk[no] for _, chunk in sorted(chunks.items()) for no in sorted(chunk))

    def _gone(self, received: int, first: int) -> None:
        self.held.clear()
        if received > first:
            self.further.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r)[1:] for r in rows if r[1] is not None]  # a row without a number only moves the time
        if not new:
            return
        received, last, ts, due, *first = self.held.get() or (0, -1, 0, -1, [], [])
        chunks, kept = {0: dict(zip(*first, strict=True))}, received - len(first[0])
        for no, token, done, *_ in new:
            at = no // self.CHUNK
            if at not in chunks:
                chunks[at] = dict(zip(*(kept and self.further.getValue((at,)) or ([], [])), strict=True))
            if no not in chunks[at]:
                chunks[at][no] = token or ""
                received += 1
            last = no if done else last
        if last >= 0 and received >= last + 1:
            text = self._text(chunks, received)
            if due >= 0:
                self.handle.deleteTimer(due)
            if len(first[0]) or kept:
                self._gone(kept, 0)
            yield Row(request_id=key[0], text=text) if self.limit is None else Row(request_id=key[0], text=text, complete=True)
            return
        if self.limit is not None:
            ts = max(ts, *(r[3] for r in new))
            if due < 0:
                due = ts + self.limit
                self.handle.registerTimer(due)
        for at in {r[0] // self.CHUNK for r in new} - {0}:
            self.further.updateValue((at,), (list(chunks[at]), list(chunks[at].values())))
        self.held.update((received, last, ts, due, list(chunks[0]), list(chunks[0].values())))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if not held:
            return
        received, last, ts, _, *first = held
        if ts + self.limit > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(ts + self.limit)
            self.held.update((received, last, ts, ts + self.limit, *first))
            return
        text = self._text({0: dict(zip(*first, strict=True))}, received)
        self._gone(received, len(first[0]))
        yield Row(request_id=key[0], text=text, complete=False)
