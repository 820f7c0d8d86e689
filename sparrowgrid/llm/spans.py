"""Spans of regular expressions as SQL expressions: no Python on the executors.

Spark has no function for the places of all matches, but `split` by the same pattern gives the pieces between
them; the running lengths of both are the places, in code points. Running sums and maxima are scans by doubled
steps, n log n for n matches, as appending to an array copies it. Patterns are written for Java so that they
take linear time and no stack: possessive loops, and `\\G` or a look-behind where a run may start.

Defined results: an empty text has no spans; a text of any length is read whole.
"""

from __future__ import annotations

SPAN = "struct<start:int,kind:int,end:int,match:string,before:string,after:string>"
EMPTY = f"cast(array() as array<{SPAN}>)"
#: Code points of the parts into which `pieces` cuts a text.
PART = 1024


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """SQL for `body`, in which `name` stands for `value`, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scanned(numbers: str, both: str) -> str:
    """SQL for the running result of `both`, which combines the numbers u (earlier) and v, over an int array."""
    step = "shiftleft(1, d)"
    later = f"transform(a, (v, i) -> case when i >= {step} then {let('u', f'a[i - {step}]', both)} else v end)"
    steps = let("n", f"size({numbers})", f"filter(sequence(0, 30), d -> {step} < n)")
    return f"aggregate({steps}, {numbers}, (a, d) -> {later})"


def found(text: str, kind: int, pattern: str, context: int = 0) -> str:
    """SQL for the array of `pattern`'s matches in column `text`: start, kind, end, match and what surrounds it.

    Without a match the array is empty. `context` characters before and two after are kept.
    """
    p = quoted(pattern)
    before, after = (f"right(x.p[k], {context})", "left(x.p[k + 1], 2)") if context else ("''", "''")
    span = f"named_struct('start', c[k] - length(w), 'kind', {kind}, 'end', c[k], 'match', w, 'before', {before}, 'after', {after})"
    lengths = "transform(x.m, (w, k) -> length(w) + length(x.p[k]))"
    spans = let("c", let("lengths", lengths, scanned("lengths", "u + v")), f"transform(x.m, (w, k) -> {span})")
    both = f"named_struct('m', regexp_extract_all({text}, {p}, 0), 'p', split({text}, {p}, -1))"
    return let("x", both, f"case when size(x.m) = 0 then {EMPTY} else {spans} end")


def apart(spans: str, base: str) -> str:
    """SQL for the array of those spans, by start, that satisfy `base` (SQL over s) or meet no span that does."""
    by_start = f"array_sort({spans})"
    ends = f"transform(o, s -> case when {base} then s.end else 0 end)"
    starts = f"reverse(transform(o, s -> case when {base} then s.start else 2147483647 end))"
    free = f"{base} or (e[i] <= s.start and b[size(b) - 1 - i] >= s.end)"
    kept = f"filter(o, (s, i) -> {free})"
    inner = let("e", let("ends", ends, scanned("ends", "greatest(u, v)")), let("b", let("starts", starts, scanned("starts", "least(u, v)")), kept))
    return let("o", by_start, f"case when size(o) = 0 then o else {inner} end")


def piece(parts: str, start: str, end: str) -> str:
    """SQL for the text from code point `start` to `end` of a text cut into `parts` of PART code points."""
    p = PART
    one, last = f"cast(({start}) div {p} as int)", f"cast(({end}) div {p} as int)"
    left, right = f"substring({parts}[{one}], ({start}) % {p} + 1)", f"case when ({end}) % {p} = 0 then '' else substring({parts}[{last}], 1, ({end}) % {p}) end"
    inside = f"substring({parts}[{one}], ({start}) % {p} + 1, ({end}) - ({start}))"
    return f"case when ({start}) >= ({end}) then '' when {one} = {last} then {inside} else concat({left}, array_join(slice({parts}, {one} + 2, {last} - {one} - 1), ''), {right}) end"


def replaced(text: str, spans: str, names: list[str]) -> str:
    """SQL for column `text` with each of the spans replaced by its kind's name; of spans that meet, the first names all."""
    parts = f"regexp_extract_all({text}, '(?s).{{1,{PART}}}', 0)"
    named = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    done = "case when i = 0 then 0 else c[i - 1] end"  # where the spans before end
    out = f"transform(o, (s, i) -> case when s.start < {done} then '' else concat({piece('q', done, 's.start')}, {named}[s.kind]) end)"
    rest = piece("q", "c[size(c) - 1]", f"length({text})")
    joined_ = f"concat(array_join({out}, ''), {rest})"
    scans = let("c", let("ends", "transform(o, s -> s.end)", scanned("ends", "greatest(u, v)")), let("q", parts, joined_))
    return let("o", f"array_sort({spans})", f"case when size(o) = 0 then {text} else {scans} end")


def joined(column: str, kinds: list[str]) -> str:
    """SQL for kind:start:end of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return f"array_join(transform({column}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"
