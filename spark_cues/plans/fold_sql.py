"""DuckDB forms of the text folds: a list reduced to lists of pieces, five rounds over a list, and timings from them."""

from __future__ import annotations

_MARK = "chr(1)"
#: Added to seconds before they are rounded to milliseconds: shares of whole milliseconds often lie half between two, where
#: the engines' last bits would decide.
CLEAR = 0.0000123
CAPTION, DISPLAY = "([.!?…؟])\\s+", "([.!?…؟。！？])\\s*"


def pack(parts: str, most: int) -> str:
    """Parts joined by spaces as long as a piece has at most ``most`` characters."""
    step = f"case when length(a[-1]) + 1 + length(x[1]) > {most} then list_append(a, x[1]) else list_append(a[:-2], a[-1] || ' ' || x[1]) end"
    kept = f"list_filter({parts}, lambda p: p <> '')"
    return f"(case when len({kept}) = 0 then []::varchar[] else list_reduce(list_transform({kept}, lambda p: [p]), lambda a, x: {step}) end)"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def _strips(marked: str) -> str:
    return f"list_transform(string_split({marked}, {_MARK}), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13)))"


def sentences(text: str, marks: str) -> str:
    return _strips(f"regexp_replace({text}, '{marks}', '\\1' || {_MARK}, 'g')")


def clauses(text: str, marks: str) -> str:
    out = f"regexp_replace({text}, '([{marks}])\\s+', '\\1' || {_MARK}, 'g')"
    out = f"regexp_replace({out}, '\\s+—', {_MARK} || '—', 'g')"
    return _strips(f"regexp_replace({out}, '—\\s*', '—' || {_MARK}, 'g')")


def _finer(pieces: str, name: str, most: int, cut: str) -> str:
    """Pieces, those over ``most`` characters cut again."""
    return f"flatten(list_transform({pieces}, lambda {name}: case when length({name}) <= {most} then [{name}] else {cut} end))"


def pack_sentences(text: str, most: int) -> str:
    return _finer(pack(sentences(text, CAPTION), most), "s1", most, pack(clauses("s1", ";"), most))


def pack_display(text: str, most: int) -> str:
    by_words = _finer(pack(clauses("s1", ",;،"), most), "s2", most, pack(words("s2"), most))
    return f"(case when length({text}) <= {most} then [{text}] else {_finer(pack(sentences(text, DISPLAY), most), 's1', most, by_words)} end)"


def distributed(source: str, keys: str, least: float = 1.0, most: float = 30.0, rounds: int = 5, clear: float = 0.0) -> str:
    """CTEs from ``source (keys, start, e, pieces)`` to ``timed (keys, piece_no, piece, start, end)``: seconds by words, held in bounds over rounds."""
    held = f"least(greatest(x.s, {least}), {most})"
    n_words = f"greatest(len({words('p')}), 1)::double"
    out = [f"weights as (select *, list_transform(pieces, lambda p: {n_words}) as w from {source})", "r0 as (select *, list_transform(w, lambda x: {'s': (e - start) * x / list_sum(w), 'w': x, 'f': false}) as r from weights)"]
    for k in range(1, rounds + 1):
        out.append(f"m{k} as (select * exclude (r), list_transform(r, lambda x: {{'s': case when x.f then x.s else {held} end, 'w': x.w, 'f': x.f or {held} <> x.s, 'o': case when x.f then 0.0 else x.s - {held} end}}) as m from r{k - 1})")
        out.append(f"n{k} as (select *, list_sum(list_transform(m, lambda x: x.o)) as over, list_sum(list_transform(m, lambda x: case when x.f then 0.0 else x.w end)) as free from m{k})")
        out.append(f"r{k} as (select * exclude (m, over, free), list_transform(m, lambda x: {{'s': case when not x.f and abs(over) >= 0.001 and free > 0 then x.s + over * x.w / free else x.s end, 'w': x.w, 'f': x.f}}) as r from n{k})")
    out.append(f"sums as (select *, list_transform(r, lambda x: x.s) as d from r{rounds})")
    out.append("scaled as (select * exclude (d), case when abs(list_sum(d) - (e - start)) > 0.001 and list_sum(d) > 0 then list_transform(d, lambda x: x * (e - start) / list_sum(d)) else d end as d from sums)")
    out.append(f"placed as (select {keys}, start, e, d, len(pieces) as n, unnest(pieces) as piece, unnest(range(0, len(pieces))) as piece_no from scaled)")
    out.append(f"""timed as (select {keys}, cast(piece_no as integer) as piece_no, piece, round(start + list_sum(d[1:piece_no + 1]) - d[piece_no + 1] + {clear}, 3) as start, round(case when piece_no = n - 1 then e else start + list_sum(d[1:piece_no + 1]) end + {clear}, 3) as "end" from placed)""")
    return ", ".join(out)


def spoken_chunks(said: str, most_chars: int, most_seconds: float) -> str:
    """Timed words ``said``, a list of (word, a, z), cut at the widest pause seen before a limit is passed, as a list of (a, z, t)."""
    text = lambda part: f"trim(array_to_string(list_transform({part}, lambda v: v.word), ' '))"
    state = "struct(done struct(a double, z double, t varchar)[], hold struct(word varchar, a double, z double)[], cut bigint, widest double)"
    chunk = lambda part: f"{{'a': {part}[1].a, 'z': {part}[-1].z, 't': {text(part)}}}"
    both = "list_concat(s.hold, x.hold)"
    over = f"{text('s.hold')} <> '' and (length({text(both)}) > {most_chars} or x.hold[1].z - s.hold[1].a > {most_seconds})"
    stop = "(case when s.cut > 1 then s.cut else len(s.hold) end)"
    first = f"s.hold[1:{stop}]"
    closed = f"{{'done': list_append(s.done, {chunk(first)}), 'hold': list_concat(s.hold[{stop} + 1:], x.hold), 'cut': 0, 'widest': -1.0}}"
    wider = "x.hold[1].a - s.hold[-1].z > s.widest"
    kept = f"{{'done': s.done, 'hold': {both}, 'cut': case when {wider} then len(s.hold) else s.cut end, 'widest': case when {wider} then x.hold[1].a - s.hold[-1].z else s.widest end}}"
    folded = f"list_reduce(list_transform({said}, lambda v: {{'done': [], 'hold': [v], 'cut': 0, 'widest': -1.0}}::{state}), lambda s, x: case when {over} then {closed}::{state} else {kept}::{state} end)"
    return f"list_transform([{folded}], lambda s: case when {text('s.hold')} <> '' then list_append(s.done, {chunk('s.hold')}) else s.done end)[1]"
