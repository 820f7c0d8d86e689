"""Type rules and values of expressions; expected values are worked out by hand."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from sparrowgrid import ExprError, Frame, col, lit

NAN, INF = float("nan"), float("inf")
I32, I64 = 2**31, 2**63


def evaluate(spark, expression, dtypes=None, **columns):
    f = Frame.from_columns(columns, dtypes=dtypes or {}, spark=spark)
    return f.with_column("out", expression).to_columns()["out"]


def same(a, b) -> bool:
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or x == y or x != x and y != y) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(
    ("dtype", "a", "b", "op", "want"),
    [
        ("i32", [I32 - 1, -I32, 65536, None], [1, -1, 65536, 1], "add", [-I32, I32 - 1, 131072, None]),
        ("i32", [-I32, I32 - 1], [1, -1], "sub", [I32 - 1, -I32]),
        ("i32", [I32 - 1, 65536, 123456789], [2, 65536, 987654321], "mul", [-2, 0, -67153019]),
        ("i32", [-7, 7, 5, -I32, None], [2, -2, 0, -1, 3], "div", [-3, -3, None, 0, None]),
        ("i32", [-7, 7, 5, -I32], [3, -3, 0, -1], "mod", [-1, 1, None, 0]),
        ("u32", [4294967295, 5], [1, 7], "add", [0, 12]),
        ("u32", [0, 5], [1, 7], "sub", [4294967295, 4294967294]),
        ("u32", [4294967295, 65536, 4000000007], [4294967295, 65537, 4000000009], "mul", [1, 65536, 4000000007 * 4000000009 % 2**32]),
        ("i64", [I64 - 1, -I64], [1, -1], "add", [-I64, I64 - 1]),
        ("i64", [-I64, 5], [1, 7], "sub", [I64 - 1, -2]),
        ("i64", [I64 - 1, 3], [I64 - 1, 4], "mul", [1, 12]),
        ("i64", [-I64, -9, 9], [-1, 2, 0], "div", [-I64, -4, None]),
        ("f64", [1.0, -1.0, 1.0, 0.0, NAN, 7.0, None, 1.0], [0.0, 0.0, -0.0, 0.0, 0.0, 2.0, 1.0, INF], "div", [INF, -INF, -INF, NAN, NAN, 3.5, None, 0.0]),
        ("f64", [7.5, -7.5, 1.0, None], [2.0, 2.0, 0.0, 1.0], "mod", [1.5, -1.5, NAN, None]),
    ],
)
def test_arithmetic(spark, dtype, a, b, op, want):
    assert same(evaluate(spark, getattr(col("a"), op)(col("b")), {"a": dtype, "b": dtype}, a=a, b=b), want)


@pytest.mark.parametrize(("dtype", "v", "want"), [("i32", [-I32, 5, None], [-I32, -5, None]), ("u32", [1, 0], [4294967295, 0]), ("i64", [-I64], [-I64]), ("f64", [1.5, NAN], [-1.5, NAN])])
def test_neg(spark, dtype, v, want):
    assert same(evaluate(spark, col("a").neg(), {"a": dtype}, a=v), want)


A, B = [1.0, NAN, NAN, 1.0, None, 2.0], [NAN, 1.0, NAN, None, 1.0, 2.0]


@pytest.mark.parametrize(
    ("op", "want"),
    [("gt", [False] * 3 + [None, None, False]), ("ge", [False] * 3 + [None, None, True]), ("lt", [False] * 3 + [None, None, False]), ("le", [False] * 3 + [None, None, True]), ("eq", [False] * 3 + [None, None, True]), ("ne", [True] * 3 + [None, None, False])],
)
def test_nan_compares_as_ieee(spark, op, want):
    assert evaluate(spark, getattr(col("a"), op)(col("b")), a=A, b=B) == want
    with_literal = evaluate(spark, getattr(col("a"), op)(1.0), a=A)
    assert with_literal == [{"gt": x > 1, "ge": x >= 1, "lt": x < 1, "le": x <= 1, "eq": x == 1, "ne": x != 1}[op] if x is not None else None for x in A]
    assert evaluate(spark, getattr(col("a"), op)(NAN), a=A) == [None if x is None else op == "ne" for x in A]


def test_kleene(spark):
    t, f, n = True, False, None
    a, b = [t, t, t, f, f, f, n, n, n], [t, f, n] * 3
    assert evaluate(spark, col("a").and_(col("b")), a=a, b=b) == [t, f, n, f, f, f, n, f, n]
    assert evaluate(spark, col("a").or_(col("b")), a=a, b=b) == [t, t, t, t, f, n, t, n, n]
    assert evaluate(spark, ~col("a"), a=[t, f, n]) == [f, t, n]


def test_nulls(spark):
    assert evaluate(spark, col("a").is_null(), a=[1.0, None, NAN]) == [False, True, False]
    assert evaluate(spark, col("a").not_null(), a=[1.0, None, NAN]) == [True, False, True]
    assert same(evaluate(spark, col("a").fill_null(0), a=[1.0, None, NAN]), [1.0, 0.0, NAN])


@pytest.mark.parametrize(
    ("of", "to", "v", "want"),
    [
        ("f64", "i32", [2.9, -2.9, 3e9, NAN, -INF, 2147483647.9, -2147483648.5, None], [2, -2, None, None, None, I32 - 1, -I32, None]),
        ("f64", "u32", [0.0, 2.9, -0.5, 4294967295.5, 4294967296.0, NAN], [0, 2, None, 4294967295, None, None]),
        ("f64", "i64", [9.5, 2.0**63, -(2.0**63), NAN], [9, None, -I64, None]),
        ("f64", "bool", [0.0, -0.0, 0.1, NAN, None], [False, False, True, None, None]),
        ("f64", "f32", [0.5, 1e300, -1e300], [0.5, INF, -INF]),
        ("i32", "u32", [5, -1], [5, None]),
        ("u32", "i32", [5, 4294967295], [5, None]),
        ("i64", "i32", [4294967296 + 7, 2147483648, -1], [7, -I32, -1]),
        ("i64", "u32", [-1, 4294967296 + 7], [4294967295, 7]),
        ("i32", "bool", [0, -3, None], [False, True, None]),
        ("bool", "i32", [True, False, None], [1, 0, None]),
        ("bool", "f64", [True, False], [1.0, 0.0]),
        ("i64", "f64", [2**53], [float(2**53)]),
    ],
)
def test_casts(spark, of, to, v, want):
    assert same(evaluate(spark, col("a").cast(to), {"a": of}, a=v), want)


def test_temporal_casts_floor(spark):
    ms = [0, 86400000, 86400500, 951782400000, -1, -86400001, -86400000, -172800001, -172800000]
    assert evaluate(spark, col("a").cast("date32").cast("i32"), {"a": "timestamp"}, a=ms) == [0, 1, 1, 11016, -1, -2, -1, -3, -2]
    assert evaluate(spark, col("a").cast("timestamp").cast("i64"), {"a": "date32"}, a=[0, -1, 11016]) == [0, -86400000, 951782400000]
    assert evaluate(spark, col("a").cast("date32"), {"a": "i32"}, a=[11016]) == [dt.date(2000, 2, 29)]


def test_calendar_fields(spark):
    ms = [-1, 951782400000]
    want = {"year": [1969, 2000], "month": [12, 2], "day": [31, 29], "hour": [23, 0], "minute": [59, 0], "second": [59, 0], "millisecond": [999, 0], "weekday": [3, 2], "day_of_year": [365, 60], "quarter": [4, 1]}
    for name, values in want.items():
        assert evaluate(spark, getattr(col("a").dt, name)(), {"a": "timestamp"}, a=ms) == values, name
    assert evaluate(spark, col("a").dt.weekday(), {"a": "date32"}, a=[-4, 0, 4]) == [7, 4, 1]
    assert evaluate(spark, col("a").dt.hour(), {"a": "date32"}, a=[5, None]) == [0, None]


def test_fields_follow_the_zone(spark):
    f = Frame.from_columns({"a": [1772956799000, 1772956800000, None]}, dtypes={"a": "timestamp"}, tzs={"a": "America/Chicago"}, spark=spark)
    assert f.with_column("h", col("a").dt.hour()).to_columns()["h"] == [1, 3, None]
    assert f.filter(col("a").not_null()).sort_values("a").with_column("h", col("a").dt.hour()).to_columns()["h"] == [1, 3]
    assert f.with_column("h", col("a").add(0).dt.hour()).to_columns()["h"] == [7, 8, None]  # not a plain column: UTC


def test_temporal_algebra(spark):
    ts = {"a": "timestamp", "b": "timestamp", "d": "date32", "e": "date32", "n": "i32"}
    data = {"a": [5000], "b": [2000], "d": [10], "e": [7], "n": [3]}
    assert evaluate(spark, col("a") - col("b"), ts, **data) == [3000]
    assert evaluate(spark, (col("a") + col("n")).cast("i64"), ts, **data) == [5003]
    assert evaluate(spark, (col("a") - 1500).cast("i64"), ts, **data) == [3500]
    assert evaluate(spark, col("d") - col("e"), ts, **data) == [3]
    assert evaluate(spark, (col("d") + col("n")).cast("i32"), ts, **data) == [13]
    assert evaluate(spark, (col("n") + col("d")).cast("i32"), ts, **data) == [13]
    for bad in (col("a") + col("b"), col("d") + col("e"), col("a") + col("d"), col("d") - col("a"), col("a") * 2, col("a") / 2, col("a") + 1.5, col("d") + col("f")):
        with pytest.raises(ExprError):
            evaluate(spark, bad, ts | {"f": "f64"}, **data, f=[1.0])


@pytest.mark.parametrize(("start", "end"), [(0, None), (1, 3), (-2, None), (1, -1), (-3, -1), (5, 9), (3, 1), (-9, 2)])
def test_slices(spark, start, end):
    """By UTF-16 code units; a cut pair leaves U+FFFD."""
    texts = ["", "a", "abc", "häuser", "a😀b", "😀😀", "漢a😀\uffee", None]
    units = lambda t: [t.encode("utf-16-be")[i : i + 2] for i in range(0, 2 * (len(t.encode("utf-16-be")) // 2), 2)]
    assert evaluate(spark, col("a").str.slice(start, end), a=texts) == [None if t is None else b"".join(units(t)[start:end]).decode("utf-16-be", "replace") for t in texts]


def test_widening(spark):
    kinds = {"i": "i32", "u": "u32", "l": "i64", "s": "f32", "d": "f64"}
    f = Frame.from_columns({"i": [1], "u": [1], "l": [1], "s": [1.0], "d": [1.0]}, dtypes=kinds, spark=spark)
    pairs = {"id": "f64", "us": "f32", "is": "f32", "li": "i64", "lu": "i64", "ls": "f64", "ld": "f64", "ii": "i32", "uu": "u32"}
    for (a, b), want in pairs.items():
        for x, y in ((a, b), (b, a)):
            assert f.with_column("o", col(x) + col(y)).dtype_of("o") == want
    for a, b in ("iu", "sd"):
        with pytest.raises(ExprError, match=f"{kinds[a]}.*{kinds[b]}"):
            f.with_column("o", col(a) + col(b))
    assert f.with_column("o", col("i") + 1.5).dtype_of("o") == "f64"
    assert f.with_column("o", col("i") + 1).dtype_of("o") == "i32"
    assert f.with_column("o", col("i") + 2**40).dtype_of("o") == "f64"
    with pytest.raises(ExprError):
        f.filter(col("i").gt(col("l")))


def test_errors_name_what_is_wrong(spark):
    f = Frame.from_columns({"price": [1.0], "name": ["a"], "ok": [True]}, spark=spark)
    with pytest.raises(ExprError, match="did you mean 'price'"):
        f.filter(col("prise").gt(1))
    for bad in (col("name") + 1, col("ok") + 1, col("name").gt("a"), col("price").and_(True), col("name").cast("f64"), col("price").cast("utf8"), col("price").fill_null("x"), col("price").sum().add(col("price").sum().mean()), col("price").str.slice(1), col("name").dt.year(), lit(None)):
        with pytest.raises(ExprError):
            f.with_column("o", bad)
    with pytest.raises(ExprError, match="bool"):
        f.filter(col("price"))
    with pytest.raises(TypeError):
        bool(col("a"))


def test_expressions_print():
    assert repr((col("a") + 1).gt(col("b")).and_(col("c").is_null())) == "(((col('a') + lit(1)) > col('b')) & is_null(col('c')))"
    assert repr(col("a").str.slice(1, 2)) == "col('a').str.slice(1, 2)"
    assert repr(col("t").dt.year()) == "col('t').dt.year()"
    assert repr(col("a").mul(2).sum()) == "(col('a') * lit(2)).sum()"


def test_floats_stay_floats(spark):
    f = Frame.from_columns({"a": [1.5, 2.5]}, dtypes={"a": "f32"}, spark=spark)
    assert f.with_column("o", col("a").mul(2)).dtype_of("o") == "f32"
    assert f.with_column("o", col("a").div(0)).to_columns()["o"] == [INF, INF]
    assert math.isclose(f.agg({"s": col("a").sum()}).to_columns()["s"][0], 4.0)
