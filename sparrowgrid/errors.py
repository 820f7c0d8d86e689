"""Errors raised before any Spark plan is built, and name suggestions."""

from __future__ import annotations

from collections.abc import Iterable


class ExprError(Exception):
    """An expression does not type-check."""


class FrameError(Exception):
    """A frame operation is not possible."""


def distance(a: str, b: str) -> int:
    """Levenshtein's edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(name: str, names: Iterable[str]) -> str | None:
    """The most similar name within a third of the length, two edits at least."""
    best = min(((distance(name, n), n) for n in names), default=None)
    return best[1] if best and best[0] <= max(2, -(-len(name) // 3)) else None


def unknown(name: str, names: Iterable[str]) -> str:
    guess = nearest(name, names)
    return f"unknown column {name!r}" + (f"; did you mean {guess!r}?" if guess else "")
