"""Type-checking and lowering of expressions to Spark columns.

Spark coerces types, raises on overflow and orders NaN above all numbers; the engine's rules are stricter on
types and follow IEEE 754 and two's complement. Each rule is emitted as built-in SQL functions, so that it
stays in whole-stage code, and only where its operands need it.
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import lit as spark_lit

from ..errors import ExprError, unknown
from ..functions.expr import Expr
from ..types import FLOATS, INTS, NUMERIC, RANGES, SPARK, TEMPORAL, Field

DAY_MS = 86_400_000


@dataclass(frozen=True)
class Typed:
    """A lowered expression. `value` is set for literals whose type may still adapt to the other operand."""

    column: Column | None
    dtype: str
    tz: str | None = None
    value: object = None
    free: bool = False  # an untyped literal
    direct: bool = False  # a plain column reference


class Lowering:
    """Lowers expressions over one schema; aggregates met on the way are collected in `aggregates`."""

    def __init__(self, schema: dict[str, Field], order: Column | None = None, wide: bool = False):
        self.schema, self.order, self.wide = schema, order, wide
        self.aggregates: dict[str, Column] = {}

    # --- entry ---

    def lower(self, e: Expr) -> Typed:
        out = self.walk(e)
        return self.settle(out) if out.free else out

    def predicate(self, e: Expr) -> Column:
        out = self.lower(e)
        if out.dtype != "bool":
            raise ExprError(f"a filter needs bool, got {out.dtype}")
        return out.column

    # --- literals ---

    def settle(self, x: Typed) -> Typed:
        """A free-standing literal gets its own type."""
        v = x.value
        if v is None:
            raise ExprError("a null literal needs a dtype")
        if isinstance(v, bool):
            return self.literal(v, "bool")
        if isinstance(v, int):
            return self.literal(v, "i32" if RANGES["i32"][0] <= v <= RANGES["i32"][1] else "i64")
        if isinstance(v, float):
            return self.literal(v, "f64")
        if isinstance(v, str):
            return self.literal(v, "utf8")
        if isinstance(v, dt.datetime):
            return self.literal(v, "timestamp")
        if isinstance(v, dt.date):
            return self.literal(v, "date32")
        raise ExprError(f"no literal can be made of {v!r}")

    def literal(self, v, dtype: str) -> Typed:
        if dtype not in SPARK:
            raise ExprError(f"unknown dtype {dtype!r}")
        if v is not None:
            good = {
                "bool": isinstance(v, bool), "utf8": isinstance(v, str), "date32": isinstance(v, (dt.date, int)) and not isinstance(v, (bool, dt.datetime)),
                "timestamp": isinstance(v, (dt.datetime, int)) and not isinstance(v, bool),
            }.get(dtype, isinstance(v, (int, float)) and not isinstance(v, bool))
            if not good:
                raise ExprError(f"literal {v!r} is no {dtype}")
            if dtype in INTS and (v != int(v) if math.isfinite(v) else True):
                raise ExprError(f"literal {v!r} is no {dtype}")
            if dtype in INTS and not RANGES[dtype][0] <= v <= RANGES[dtype][1]:
                raise ExprError(f"literal {v!r} is out of range for {dtype}")
        if v is None:
            column = spark_lit(None).cast(SPARK[dtype])
        elif dtype == "date32" and isinstance(v, int):
            column = F.date_from_unix_date(spark_lit(v))
        elif dtype == "timestamp" and isinstance(v, int):
            column = F.timestamp_millis(spark_lit(v))
        elif dtype == "timestamp":
            v = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
            column = F.timestamp_micros(spark_lit(round((v - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))).cast("long"))
        else:
            column = spark_lit(int(v) if dtype in INTS else float(v) if dtype in FLOATS else v).cast(SPARK[dtype])
        return Typed(column, dtype, None, v)

    # --- walk ---

    def walk(self, e: Expr) -> Typed:
        return getattr(self, f"_{e.kind}")(e)

    def _col(self, e: Expr) -> Typed:
        if e.value not in self.schema:
            raise ExprError(unknown(e.value, self.schema))
        f = self.schema[e.value]
        return Typed(F.col(f"`{e.value}`"), f.dtype, f.tz, direct=True)

    def _lit(self, e: Expr) -> Typed:
        return self.literal(e.value, e.dtype) if e.dtype else Typed(None, "", None, e.value, True)

    def pair(self, e: Expr) -> tuple[Typed, Typed]:
        """Both operands; a free literal adapts to the other's type."""
        a, b = (self.walk(x) for x in e.args)
        if a.free and b.free:
            a, b = self.settle(a), self.settle(b)
            if a.dtype != b.dtype and a.dtype in NUMERIC and b.dtype in NUMERIC:
                wide = "f64" if "f64" in (a.dtype, b.dtype) else "i64"
                a, b = self.literal(a.value, wide), self.literal(b.value, wide)
            return a, b
        if a.free:
            b, a = self.adopt(b, a, e)
        elif b.free:
            a, b = self.adopt(a, b, e)
        return a, b

    def adopt(self, x: Typed, literal: Typed, e: Expr) -> tuple[Typed, Typed]:
        v, name = literal.value, x.dtype
        if v is None:
            return x, self.literal(None, name)
        if e.kind == "arith" and name in TEMPORAL:
            if e.value not in ("add", "sub") or isinstance(v, bool) or not isinstance(v, int):
                raise ExprError(f"{e.value} of {name} takes a whole number, got {v!r}")
            return x, self.literal(v, "i64")
        if name in INTS and isinstance(v, (int, float)) and not isinstance(v, bool):
            if isinstance(v, float) and not v.is_integer() or not RANGES[name][0] <= v <= RANGES[name][1]:
                return self.widened(x, "f64"), self.literal(float(v), "f64")
        return x, self.literal(v, name)

    def widened(self, x: Typed, dtype: str) -> Typed:
        return x if x.dtype == dtype else Typed(x.column.cast(SPARK[dtype]), dtype)

    def common(self, a: Typed, b: Typed, op: str) -> tuple[Typed, Typed]:
        """The arithmetic lattice: only these widenings are implicit."""
        x, y = a.dtype, b.dtype
        if x == y and x in NUMERIC:
            return a, b
        if {x, y} <= set(NUMERIC):
            if "i64" in (x, y):
                other = y if x == "i64" else x
                wide = "f64" if other in FLOATS else "i64"
                return self.widened(a, wide), self.widened(b, wide)
            floats = [t for t in (x, y) if t in FLOATS]
            if len(floats) == 1:
                return self.widened(a, floats[0]), self.widened(b, floats[0])
        raise ExprError(f"{op}: {x} and {y} do not go together; cast one of them")

    def _arith(self, e: Expr) -> Typed:
        a, b = self.pair(e)
        if a.dtype in TEMPORAL or b.dtype in TEMPORAL:
            return self.temporal(e.value, a, b)
        a, b = self.common(a, b, e.value)
        return Typed(arithmetic(e.value, a, b), a.dtype)

    def temporal(self, op: str, a: Typed, b: Typed) -> Typed:
        bad = ExprError(f"{op}: not defined for {a.dtype} and {b.dtype}")
        if op not in ("add", "sub"):
            raise bad
        if a.dtype == b.dtype and op == "sub":
            if a.dtype == "timestamp":
                return Typed(F.unix_millis(a.column) - F.unix_millis(b.column), "i64")
            return Typed(F.datediff(a.column, b.column), "i32")
        if op == "add" and a.dtype in INTS and b.dtype in TEMPORAL:
            a, b = b, a
        if a.dtype not in TEMPORAL or b.dtype not in INTS:
            raise bad
        n = b.column.cast("long") if op == "add" else -b.column.cast("long")
        if a.dtype == "timestamp":
            return Typed(F.timestamp_micros(F.unix_micros(a.column) + n * 1000), "timestamp", a.tz)
        return Typed(F.date_add(a.column, n.cast("int")), "date32")

    def _neg(self, e: Expr) -> Typed:
        x = self.lower(e.args[0])
        if x.dtype not in NUMERIC:
            raise ExprError(f"neg: not defined for {x.dtype}")
        if x.dtype in FLOATS:
            return Typed(-x.column, x.dtype)
        return Typed(arithmetic("sub", self.literal(0, x.dtype), x), x.dtype)

    def _compare(self, e: Expr) -> Typed:
        a, b = self.pair(e)
        if a.dtype != b.dtype:
            raise ExprError(f"{e.value}: {a.dtype} and {b.dtype} cannot be compared; cast one of them")
        if a.dtype in ("utf8", "bool") and e.value not in ("eq", "ne"):
            raise ExprError(f"{e.value}: not defined for {a.dtype}")
        if a.dtype == "other":
            raise ExprError(f"{e.value}: this column's type takes no part in expressions")
        return Typed(comparison(e.value, a, b), "bool")

    def _logic(self, e: Expr) -> Typed:
        a, b = (self.lower(x) for x in e.args)
        if (a.dtype, b.dtype) != ("bool", "bool"):
            raise ExprError(f"{e.value}: needs bool, got {a.dtype} and {b.dtype}")
        return Typed(a.column & b.column if e.value == "and" else a.column | b.column, "bool")

    def _not(self, e: Expr) -> Typed:
        x = self.lower(e.args[0])
        if x.dtype != "bool":
            raise ExprError(f"not: needs bool, got {x.dtype}")
        return Typed(~x.column, "bool")

    def _is_null(self, e: Expr) -> Typed:
        return Typed(self.lower(e.args[0]).column.isNull(), "bool")

    def _fill_null(self, e: Expr) -> Typed:
        x = self.lower(e.args[0])
        return Typed(F.coalesce(x.column, self.literal(e.value, x.dtype).column), x.dtype, x.tz)

    def _cast(self, e: Expr) -> Typed:
        x = self.lower(e.args[0])
        return Typed(cast(x, e.value), e.value, x.tz if e.value == x.dtype else None)

    def _field(self, e: Expr) -> Typed:
        x = self.lower(e.args[0])
        return Typed(calendar_field(e.value, x), "i32")

    def _slice(self, e: Expr) -> Typed:
        x = self.lower(e.args[0])
        if x.dtype != "utf8":
            raise ExprError(f"str.slice: needs utf8, got {x.dtype}")
        return Typed(sliced(x.column, *e.value), "utf8")

    def _agg(self, e: Expr) -> Typed:
        column, f = self.aggregate(e)
        name = f"__sg_agg{len(self.aggregates)}"
        self.aggregates[name] = column
        return Typed(F.col(name), f.dtype, f.tz)

    def aggregate(self, e: Expr) -> tuple[Column, Field]:
        """The Spark aggregate for a top-level aggregation."""
        inner = Lowering(self.schema, self.order)
        x = inner.lower(e.args[0])
        if inner.aggregates:
            raise ExprError("an aggregate inside an aggregate is not possible")
        return aggregate(e.value, x, self.order, self.wide)


def wrap32(x: Column) -> Column:
    """The low 32 bits of a long, signed."""
    low = x.bitwiseAND(spark_lit(0xFFFFFFFF))
    return (low.bitwiseXOR(spark_lit(0x80000000)) - spark_lit(0x80000000)).cast("int")


def wrap64(x: Column) -> Column:
    """A whole decimal modulo 2**64, signed."""
    whole = spark_lit(Decimal(2**64)).cast("decimal(38,0)")
    m = F.pmod(x, whole)
    return F.when(m > spark_lit(2**63 - 1), m - whole).otherwise(m).cast("long")


def arithmetic(op: str, a: Typed, b: Typed) -> Column:
    x, y, dtype = a.column, b.column, a.dtype
    if dtype in FLOATS:
        if op in ("add", "sub", "mul"):
            return {"add": x + y, "sub": x - y, "mul": x * y}[op]
        return float_division(op, x, y, dtype, b.value)
    if op in ("div", "mod"):
        return integer_division(op, x, y, dtype, b.value)
    if dtype == "i32":
        x, y = x.cast("long"), y.cast("long")
        return wrap32({"add": x + y, "sub": x - y, "mul": x * y}[op])
    if dtype == "u32":
        if op != "mul":
            return (x + y if op == "add" else x - y).bitwiseAND(spark_lit(0xFFFFFFFF))
        # Of the factor's two halves the upper one counts with its low 16 bits only, so that nothing overflows.
        high, low = F.shiftright(y, 16).bitwiseAND(spark_lit(0xFFFF)), y.bitwiseAND(spark_lit(0xFFFF))
        return (F.shiftleft((x * high).bitwiseAND(spark_lit(0xFFFF)), 16) + x * low).bitwiseAND(spark_lit(0xFFFFFFFF))
    plain = {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op](x, y)
    dx, dy = x.cast("decimal(20,0)"), y.cast("decimal(20,0)")
    return F.coalesce(plain, wrap64({"add": dx + dy, "sub": dx - dy, "mul": dx * dy}[op].cast("decimal(38,0)")))


def float_division(op: str, x: Column, y: Column, dtype: str, divisor) -> Column:
    kind = SPARK[dtype]
    if divisor:  # a known divisor other than zero
        return ((x / y) if op == "div" else x % y).cast(kind)
    nan = spark_lit(float("nan")).cast(kind)
    null = x.isNull() | y.isNull()
    if op == "mod":
        return F.when(null, None).when(y == 0, nan).otherwise(F.try_mod(x, y)).cast(kind)
    positive = (x > 0) == (y.cast("string") == "0.0")  # the zero's sign decides
    infinite = F.when(positive, spark_lit(float("inf"))).otherwise(spark_lit(float("-inf")))
    return F.when(null, None).when(y != 0, F.try_divide(x, y)).when((x == 0) | F.isnan(x), nan).otherwise(infinite).cast(kind)


def integer_division(op: str, x: Column, y: Column, dtype: str, divisor) -> Column:
    """Truncating; zero divisors give null. The least number by -1: 0 for i32, itself for i64."""
    lx, ly = x.cast("long"), y.cast("long")
    if op == "mod":
        out = F.when(ly == -1, spark_lit(0).cast("long")).otherwise(F.try_mod(lx, ly))
        return F.when(x.isNull(), None).otherwise(out).cast(SPARK[dtype])
    quotient = F.call_function("div", lx, F.when(ly != 0, ly))
    if dtype == "i32" and not (divisor and divisor != -1):
        quotient = F.when((lx == RANGES["i32"][0]) & (ly == -1), spark_lit(0).cast("long")).otherwise(quotient)
    elif dtype == "i64" and not (divisor and divisor != -1):
        quotient = F.when((lx == RANGES["i64"][0]) & (ly == -1), lx).otherwise(quotient)
    return quotient.cast(SPARK[dtype])


def comparison(op: str, a: Typed, b: Typed) -> Column:
    """IEEE comparisons: NaN is unordered and unequal to itself."""
    x, y = a.column, b.column
    plain = {"gt": x > y, "ge": x >= y, "lt": x < y, "le": x <= y, "eq": x == y, "ne": x != y}[op]
    if a.dtype not in FLOATS:
        return plain
    for side, other in ((a, y), (b, x)):  # a NaN literal decides by itself
        if isinstance(side.value, float) and math.isnan(side.value):
            return F.when(other.isNotNull(), spark_lit(op == "ne"))
    x_nan, y_nan = (None if isinstance(s.value, (int, float)) else F.isnan(s.column) for s in (a, b))
    if op in ("gt", "ge"):
        return plain if x_nan is None else plain & ~x_nan if y_nan is None else F.when(y.isNotNull(), plain & ~x_nan)
    if op in ("lt", "le"):
        return plain if y_nan is None else plain & ~y_nan if x_nan is None else F.when(x.isNotNull(), plain & ~y_nan)
    if x_nan is None or y_nan is None:
        return plain
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, plain & ~x_nan) if op == "eq" else F.when(known, plain | x_nan)


def cast(x: Typed, to: str) -> Column:
    """The cast matrix; a pair outside it is an error."""
    c, of = x.column, x.dtype
    if to not in SPARK:
        raise ExprError(f"unknown dtype {to!r}")
    if of == to:
        return c
    if of in FLOATS and to in INTS:
        low, high = RANGES[to]
        # 2.0**63 and the like are exact as doubles: the bounds are those of truncated values.
        d = c.cast("double")
        fits = (d >= 0 if to == "u32" else d >= float(low) if to == "i64" else d > float(low - 1)) & (d < float(high + 1)) & ~F.isnan(d)
        return F.when(fits, d.cast(SPARK[to]))
    if of in FLOATS and to == "bool":
        return F.when(~F.isnan(c), c != 0)
    if of in NUMERIC + ("bool",) and to in FLOATS:
        return c.cast(SPARK[to])
    if of == "i32" and to == "u32":
        return F.when(c >= 0, c.cast("long"))
    if of == "u32" and to == "i32":
        return F.when(c <= RANGES["i32"][1], c.cast("int"))
    if of == "i64" and to == "i32":
        return wrap32(c)
    if of == "i64" and to == "u32":
        return c.bitwiseAND(spark_lit(0xFFFFFFFF))
    if of in INTS + ("bool",) and to in INTS + ("bool",):
        return c != 0 if to == "bool" else c.cast(SPARK[to])
    if of == "date32" and to == "i32":
        return F.unix_date(c)
    if of == "i32" and to == "date32":
        return F.date_from_unix_date(c)
    if of == "timestamp" and to == "i64":
        return F.unix_millis(c)
    if of == "i64" and to == "timestamp":
        return F.timestamp_millis(c)
    if of == "date32" and to == "timestamp":
        return F.timestamp_millis(F.unix_date(c).cast("long") * DAY_MS)
    if of == "timestamp" and to == "date32":
        return F.date_from_unix_date(F.floor(F.unix_millis(c) / DAY_MS).cast("int"))
    raise ExprError(f"cast: no way from {of} to {to}")


def calendar_field(name: str, x: Typed) -> Column:
    """A calendar field as i32; of a plain timestamp column in that column's zone. Times of a date32 are 0."""
    if x.dtype not in TEMPORAL:
        raise ExprError(f"dt.{name}: needs date32 or timestamp, got {x.dtype}")
    c = x.column
    if x.dtype == "date32" and name in ("hour", "minute", "second", "millisecond"):
        return F.when(c.isNotNull(), spark_lit(0))
    if x.dtype == "timestamp" and x.tz and x.direct:
        c = F.from_utc_timestamp(c, x.tz)
    out = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "day_of_year": F.dayofyear,
        "weekday": lambda v: F.weekday(v) + 1, "millisecond": lambda v: F.pmod(F.unix_millis(v), spark_lit(1000)),
    }[name](c)
    return out.cast("int")


def bounds(n: Column, start: int, end: int | None) -> tuple[Column, Column]:
    """(first unit, units) of a slice of n units; negative bounds count from the end."""
    at = lambda i: F.greatest(n + i, spark_lit(0)) if i < 0 else F.least(spark_lit(i), n)
    first = at(start)
    return first, F.greatest((n if end is None else at(end)) - first, spark_lit(0))


def sliced(c: Column, start: int, end: int | None) -> Column:
    """By UTF-16 code units. Where a bound cuts a pair in two, the half that stays becomes U+FFFD."""
    first, size = bounds(F.length(c), start, end)
    plain = F.substr(c, first + 1, size)
    units = F.encode(c, "UTF-16BE")
    first, size = bounds(F.shiftright(F.length(units), 1), start, end)
    cut = F.hex(F.substr(units, first * 2 + 1, size * 2))
    mended = F.regexp_replace(F.regexp_replace(cut, "^D[C-F]..", "FFFD"), "D[89AB]..$", "FFFD")
    # Without characters of several bytes both ways agree, and the plain one is cheaper.
    return F.when(F.octet_length(c) == F.length(c), plain).when(c.isNotNull(), F.decode(F.unhex(mended), "UTF-16BE"))


def utf16_key(c: Column) -> Column:
    """Bytes whose order is that of the UTF-16 code units: UTF-8, but characters beyond U+FFFF as their two surrogates."""
    def unit(x: Column) -> Column:
        byte = lambda v: F.lpad(F.hex(v), 2, "0")
        return F.concat(spark_lit("ED"), byte(F.shiftright(x, 6).bitwiseAND(spark_lit(0x3F)).bitwiseOR(spark_lit(0x80))), byte(x.bitwiseAND(spark_lit(0x3F)).bitwiseOR(spark_lit(0x80))))

    def char(x: Column) -> Column:
        v = F.ascii(x) - spark_lit(0x10000)
        pair = F.concat(unit(F.shiftright(v, 10).bitwiseOR(spark_lit(0xD800))), unit(v.bitwiseAND(spark_lit(0x3FF)).bitwiseOR(spark_lit(0xDC00))))
        return F.when(F.octet_length(x) < 4, F.hex(x.cast("binary"))).otherwise(pair)

    paired = F.unhex(F.array_join(F.transform(F.regexp_extract_all(c, spark_lit("(?s)."), spark_lit(0)), char), ""))
    plain = (F.octet_length(c) == F.length(c)) | ~c.rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.when(plain, c.cast("binary")).otherwise(paired)


def counted(n: Column, wide: bool) -> tuple[Column, Field]:
    return (n, Field("i64")) if wide else (wrap32(n), Field("i32"))


def aggregate(how: str, x: Typed, order: Column | None, wide: bool = False) -> tuple[Column, Field]:
    """(Spark aggregate, result type). Nulls are skipped, NaN are values but for min and max."""
    c, of = x.column, x.dtype
    if how == "count":
        return counted(F.count(c), wide)
    bad = ExprError(f"{how}: not defined for {of}")
    if of in ("bool", "other"):
        raise bad
    if how == "nunique":
        return counted(F.count_distinct(c), wide)
    if how in ("first", "last"):
        if order is None:
            raise ExprError(f"{how}: the frame has no row order")
        pick = F.min_by if how == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), order)), Field(of, x.tz)
    if of == "utf8":
        raise bad
    if how in ("min", "max"):
        if of in FLOATS:  # NaN only if there is nothing else
            return F.coalesce((F.min if how == "min" else F.max)(F.when(~F.isnan(c), c)), F.max(c)), Field(of)
        return (F.min if how == "min" else F.max)(c), Field(of, x.tz)
    if of in TEMPORAL:
        raise bad
    d = c.cast("double")
    if how == "sum":
        if of == "i64":
            return wrap64(F.coalesce(F.sum(c.cast("decimal(28,0)")), spark_lit(0).cast("decimal(38,0)"))), Field("i64")
        total = F.coalesce(F.sum(d), spark_lit(0.0))
        return (total.cast("float"), Field("f32")) if of == "f32" else (total, Field("f64"))
    return {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp}[how](d), Field("f64")
