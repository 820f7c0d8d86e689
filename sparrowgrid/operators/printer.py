"""Cells and tables as text."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

#: Longest cell of text, in UTF-16 code units; digits of a fraction.
WIDEST, DIGITS = 24, 6


def shown(v, dtype: str) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        units = v.encode("utf-16-le")
        return v if len(units) <= 2 * WIDEST else units[: 2 * WIDEST - 2].decode("utf-16-le", "replace") + "…"
    if isinstance(v, dt.datetime):
        return v.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}Z"
    if isinstance(v, dt.date):
        return v.isoformat()
    return number(v) if isinstance(v, float) else str(v)


def number(x: float) -> str:
    """A double with at most DIGITS significant digits; whole numbers in full up to 1e21."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    if x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    mantissa, exponent = (repr(x) if x.is_integer() else f"{x:.{DIGITS - 1}e}").split("e")
    if not x.is_integer() and -7 < int(exponent) < DIGITS:
        text = f"{x:.{DIGITS - 1 - int(exponent)}f}"
        return text.rstrip("0").rstrip(".") if "." in text else text
    return f"{mantissa.removesuffix('.0') if x.is_integer() else mantissa}e{int(exponent):+d}"


def table_of(names: Sequence[str], dtypes: Sequence[str], body: Sequence[Sequence[str]]) -> str:
    """Names, types, a rule and the rows; numbers and instants stand right, text and booleans left."""
    rows = [list(names), list(dtypes), *map(list, body)]
    size = lambda t: len(t.encode("utf-16-le")) // 2
    widths = [max(size(r[i]) for r in rows) for i in range(len(names))]
    lines = ["  ".join(c + " " * (w - size(c)) if d in ("utf8", "bool") else " " * (w - size(c)) + c for c, w, d in zip(r, widths, dtypes, strict=True)) for r in rows]
    return "\n".join([*lines[:2], "  ".join("─" * w for w in widths), *lines[2:]])
