"""Entry points for checked expressions: resolve, compile, compile_filter, schema_of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..errors import ExprError
from ..functions.expr import Expr
from ..types import Field
from .lower import Lowering


def schema_of(frame) -> dict[str, str]:
    """The dtype of each column."""
    return frame.dtypes


@dataclass(frozen=True)
class Resolved:
    """What an expression is over a frame: its dtype, and whether it is one value or one for each row."""

    expr: Expr
    dtype: str
    kind: str


def resolve(e: Expr, frame) -> Resolved:
    """Type-check; an ExprError tells what is wrong."""
    if e.kind == "agg":
        return Resolved(e, Lowering(frame._schema, F.lit(0)).aggregate(e)[1].dtype, "scalar")
    return Resolved(e, infer_type(e, frame), "column")


def infer_type(e: Expr, frame) -> str:
    return frame.type_of(e)


@dataclass(frozen=True)
class Compiled:
    """A checked expression that is bound to a frame; nothing runs before `execute`."""

    resolved: Resolved
    frame: object

    @property
    def dtype(self) -> str:
        return self.resolved.dtype

    @property
    def kind(self) -> str:
        return self.resolved.kind

    def execute(self):
        """A Series named `value`, lazy, or for an aggregate its value."""
        if self.kind == "scalar":
            return self.frame.agg({"value": self.resolved.expr}).to_records()[0]["value"]
        from ..operators.frame import Series

        return Series(self.frame.with_column("value", self.resolved.expr), "value", (self.frame, self.resolved.expr))


def compile_expr(e: Expr, frame) -> Compiled:
    return Compiled(resolve(e, frame), frame)


@dataclass(frozen=True)
class Selection:
    """The rows for which a predicate is true."""

    frame: object

    @property
    def count(self) -> int:
        return self.frame.length

    def compact(self, name: str):
        """A column of these rows."""
        return self.frame.col(name)


@dataclass(frozen=True)
class CompiledFilter:
    predicate: Expr
    frame: object
    dtype: Field = Field("bool")

    def execute(self) -> Selection:
        return Selection(self.frame.filter(self.predicate))


def compile_filter(e: Expr, frame) -> CompiledFilter:
    """Type-check a predicate, which must be bool."""
    if (found := resolve(e, frame)).dtype != "bool":
        raise ExprError(f"a filter needs bool, got {found.dtype}")
    return CompiledFilter(e, frame)
