"""The expression tree that users build: immutable nodes, nothing is evaluated here."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

AGGREGATES = ("sum", "mean", "min", "max", "count", "nunique", "std", "var", "first", "last")
FIELDS = ("year", "month", "day", "hour", "minute", "second", "millisecond", "weekday", "day_of_year", "quarter")


@dataclass(frozen=True, eq=False)
class Expr:
    """A node: its kind, what it holds and its operands."""

    kind: str
    value: Any = None
    args: tuple[Expr, ...] = ()
    dtype: str | None = None

    def _two(self, op: str, other) -> Expr:
        return Expr("compare" if op in _COMPARE else "logic" if op in ("and", "or") else "arith", op, (self, to_expr(other)))

    def add(self, other) -> Expr:
        return self._two("add", other)

    def sub(self, other) -> Expr:
        return self._two("sub", other)

    def mul(self, other) -> Expr:
        return self._two("mul", other)

    def div(self, other) -> Expr:
        return self._two("div", other)

    def mod(self, other) -> Expr:
        return self._two("mod", other)

    def neg(self) -> Expr:
        return Expr("neg", None, (self,))

    def gt(self, other) -> Expr:
        return self._two("gt", other)

    def ge(self, other) -> Expr:
        return self._two("ge", other)

    def lt(self, other) -> Expr:
        return self._two("lt", other)

    def le(self, other) -> Expr:
        return self._two("le", other)

    def eq(self, other) -> Expr:
        return self._two("eq", other)

    def ne(self, other) -> Expr:
        return self._two("ne", other)

    def and_(self, other) -> Expr:
        return self._two("and", other)

    def or_(self, other) -> Expr:
        return self._two("or", other)

    def not_(self) -> Expr:
        return Expr("not", None, (self,))

    def is_null(self) -> Expr:
        return Expr("is_null", None, (self,))

    def not_null(self) -> Expr:
        return self.is_null().not_()

    def fill_null(self, value) -> Expr:
        return Expr("fill_null", value, (self,))

    def cast(self, dtype: str) -> Expr:
        return Expr("cast", dtype, (self,))

    def _agg(self, how: str) -> Expr:
        return Expr("agg", how, (self,))

    __add__, __sub__, __mul__, __truediv__, __mod__, __neg__ = add, sub, mul, div, mod, neg
    __gt__, __ge__, __lt__, __le__, __and__, __or__, __invert__ = gt, ge, lt, le, and_, or_, not_

    def __radd__(self, other) -> Expr:
        return to_expr(other).add(self)

    def __rsub__(self, other) -> Expr:
        return to_expr(other).sub(self)

    def __rmul__(self, other) -> Expr:
        return to_expr(other).mul(self)

    @property
    def dt(self) -> Fields:
        return Fields(self)

    @property
    def str(self) -> Strings:
        return Strings(self)

    def __repr__(self) -> str:
        a = [repr(x) for x in self.args]
        match self.kind:
            case "col":
                return f"col({self.value!r})"
            case "lit":
                return f"lit({self.value!r}" + (f", {self.dtype!r})" if self.dtype else ")")
            case "arith" | "compare" | "logic":
                return f"({a[0]} {_SIGNS[self.value]} {a[1]})"
            case "neg" | "not" | "is_null":
                return f"{self.kind}({a[0]})"
            case "slice":
                return f"{a[0]}.str.slice({', '.join(str(x) for x in self.value if x is not None)})"
            case "field":
                return f"{a[0]}.dt.{self.value}()"
            case "agg":
                return f"{a[0]}.{self.value}()"
        return f"{a[0]}.{self.kind}({self.value!r})"

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use and_, or_, not_")


def _aggregate(how: str):
    def method(self: Expr) -> Expr:
        return self._agg(how)

    method.__name__ = how
    method.__doc__ = f"The aggregate `{how}` of this expression."
    return method


for _how in AGGREGATES:
    setattr(Expr, _how, _aggregate(_how))

_COMPARE = ("gt", "ge", "lt", "le", "eq", "ne")
_SIGNS = {"add": "+", "sub": "-", "mul": "*", "div": "/", "mod": "%", "gt": ">", "ge": ">=", "lt": "<", "le": "<=", "eq": "==", "ne": "!=", "and": "&", "or": "|"}


@dataclass(frozen=True)
class Fields:
    """Calendar fields of a date32 or timestamp."""

    of: Expr

    def __getattr__(self, name: str):
        if name not in FIELDS:
            raise AttributeError(name)
        return lambda: Expr("field", name, (self.of,))


@dataclass(frozen=True)
class Strings:
    of: Expr

    def slice(self, start: int, end: int | None = None) -> Expr:
        """Characters start to end, negative ones counted from the end; no error out of range."""
        return Expr("slice", (start, end), (self.of,))


def col(name: str) -> Expr:
    return Expr("col", name)


def lit(value, dtype: str | None = None) -> Expr:
    return Expr("lit", value, (), dtype)


def to_expr(x) -> Expr:
    return x if isinstance(x, Expr) else lit(x)
