"""Frames: row order, nulls and NaN in sorts, groups and joins, errors, output."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparrowgrid import ExprError, Frame, FrameError, col, lit, read_parquet, scope
from sparrowgrid.operators import frame as frame_module
from sparrowgrid.operators.printer import shown
from sparrowgrid.plans.lower import wrap32
from sparrowgrid.storage import shared_dir

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def make(spark):
    return lambda dtypes=None, **columns: Frame.from_columns(columns, dtypes=dtypes, spark=spark)


def order(f: Frame) -> list:
    return f.to_columns()["i"]


@pytest.mark.parametrize(
    ("values", "descending", "want"),
    [
        ([1, 1, 1, 2, 1], False, [0, 1, 2, 4, 3]),
        ([1, NAN, 2], False, [0, 2, 1]),
        ([1, None, 3, None, 2], False, [0, 4, 2, 1, 3]),
        ([1, None, 3, None, 2], True, [2, 4, 0, 1, 3]),
        ([2, NAN, None, 3, None], False, [0, 3, 1, 2, 4]),
        ([2, NAN, None, INF, -INF], True, [1, 3, 0, 4, 2]),
        ([1, 2, 1, 2], True, [1, 3, 0, 2]),
    ],
)
def test_sorts(make, values, descending, want):
    f = make(x=[None if v is None else float(v) for v in values], i=list(range(len(values))))
    assert order(f.sort_values("x", descending=descending)) == want


def test_sorts_by_many_keys_are_stable(make):
    f = make(a=["x", "y", "x", None, "y"], b=[2, 1, 1, 5, 1], i=[0, 1, 2, 3, 4])
    assert order(f.sort_values(["a", "b"], [True, False])) == [1, 4, 2, 0, 3]
    assert order(f.sort_values("b").sort_values("a")) == [2, 0, 1, 4, 3]
    assert order(f.with_column("t", col("b").gt(1)).sort_values("t")) == [1, 2, 4, 0, 3]


@pytest.mark.parametrize(("values", "k", "largest", "want"), [([3, 1, 4, 1, 5], 2, True, [4, 2]), ([3, 1, 4, 1, 5], 3, False, [1, 3, 0]), ([3, None, 1, None, 2], 2, True, [0, 4]), ([1, NAN, 2], 2, True, [1, 2])])
def test_top_k(make, values, k, largest, want):
    f = make(x=[None if v is None else float(v) for v in values], i=list(range(len(values))))
    assert order(f.top_k("x", k, largest)) == want


def test_argsort(make):
    f = make(x=[2.0, NAN, None, 3.0, None])
    assert f.argsort("x").to_columns() == {"position": [0, 3, 1, 2, 4]}
    assert f.slice(1).argsort("x", descending=True).to_columns()["position"] == [0, 2, 1, 3]
    assert f.type_of(col("x").mul(2).gt(1)) == "bool" and f.type_of(col("x").sum()) == "f64"
    with pytest.raises(FrameError):
        make(position=[1]).argsort("position")


def test_group_order_follows_the_sort(make):
    f = make(g=["a", "b", "a", None, "b"], x=[3, 1, None, 2, 0], i=[0, 1, 2, 3, 4])
    up, down = f.sort_values("x").groupby("g"), f.sort_values("x", descending=True).groupby("g")
    spec = {"first": col("i").first(), "last": col("i").last()}
    assert up.agg(spec).to_columns() == {"g": ["b", None, "a"], "first": [4.0, 3.0, 0.0], "last": [1.0, 3.0, 2.0]}
    assert down.agg(spec).to_columns() == {"g": ["a", None, "b"], "first": [0.0, 3.0, 1.0], "last": [2.0, 3.0, 4.0]}


def test_positions(make):
    f = make(i=list(range(10)))
    assert order(f.head()) == [0, 1, 2, 3, 4]
    assert order(f.tail(3)) == [7, 8, 9]
    assert order(f.slice(2, 4)) == [2, 3]
    assert order(f.slice(-3, 2)) == [0, 1]
    assert order(f.slice(8, 99)) == [8, 9]
    assert order(f.slice(7)) == [7, 8, 9]
    assert order(f.slice(4, 2)) == [] and order(f.head(0)) == [] and order(f.tail(0)) == []
    assert order(f.take([3, 1, 3])) == [3, 1, 3]
    assert order(f.sort_values("i", descending=True).head(3).sort_values("i").tail(2)) == [8, 9]
    assert order(f.filter(col("i").mod(2).eq(1)).slice(1, 3)) == [3, 5]


def test_positions_beyond_a_top_k_plan(spark, make, monkeypatch):
    monkeypatch.setattr("sparrowgrid.operators.frame.MOST_TAKEN", 3)
    f = Frame.from_spark(spark.range(0, 100, 1, 7).withColumnRenamed("id", "i")).sort_values("i", descending=True)
    assert order(f.slice(10, 15)) == [89, 88, 87, 86, 85]
    assert order(f.slice(95)) == [4, 3, 2, 1, 0] and order(f.tail(4)) == [3, 2, 1, 0] and order(f.head(5)) == [99, 98, 97, 96, 95]
    assert order(f.slice(200)) == [] and order(f.tail(200))[0] == 99


def test_projection(make):
    f = make(a=[1.0], b=["x"], c=[True])
    assert f.select("c", "a").columns == ["c", "a"]
    assert f.drop("b").columns == ["a", "c"]
    assert f.with_column("a", col("a").gt(0)).dtypes == {"a": "bool", "b": "utf8", "c": "bool"}
    assert f.with_column("n", [5], "i32").to_records() == [{"a": 1.0, "b": "x", "c": True, "n": 5}]
    for bad in (lambda: f.select("z"), lambda: f.drop("z"), lambda: f.select("a", "a"), lambda: f.with_column("n", [1, 2]), lambda: f.with_column("__sg_x", lit(1)), lambda: f.sort_values(["a", "b"], [True])):
        with pytest.raises(FrameError):
            bad()
    assert f.shape == (1, 3) and len(f) == 1 and f.dtype_of("b") == "utf8"


def test_aggregates(make):
    f = make(g=["a", "b", "a", "b", "c"], v=[1.0, NAN, 3.0, 2.0, None], n=[1, None, 3, 4, None], dtypes={"n": "i32"})
    out = f.groupby("g").agg({"v": ["sum", "mean", "min", "max", "count", "size", "nunique", "first", "last"]})
    assert out.columns == ["g"] + [f"v_{h}" for h in ("sum", "mean", "min", "max", "count", "size", "nunique", "first", "last")]
    rows = {r["g"]: list(r.values())[1:] for r in out.to_records()}
    assert list(rows) == ["a", "b", "c"]
    assert rows["a"] == [4.0, 2.0, 1.0, 3.0, 2, 2, 2, 1.0, 3.0]
    assert math.isnan(rows["b"][0]) and math.isnan(rows["b"][1]) and rows["b"][2:7] == [2.0, 2.0, 2, 2, 2] and math.isnan(rows["b"][7]) and rows["b"][8] == 2.0
    assert rows["c"] == [0.0, None, None, None, 0, 1, 0, None, None]
    assert out.dtypes["v_count"] == "i32" and f.groupby("g").agg({"n": "sum"}).dtypes["n"] == "f64"
    assert f.groupby("g").agg({"x": col("n").mul(2).sum()}).to_columns() == {"g": ["a", "b", "c"], "x": [8.0, 8.0, 0.0]}


@pytest.mark.parametrize(("values", "how", "want"), [([2, 4, 4, 4, 5, 5, 7, 9], "std", 2.138089935299395), ([1, None, 3, None, 5], "std", 2.0), ([5, None], "std", None), ([5, None], "var", None), ([1, None, 2, None, 1], "nunique", 2), ([NAN, NAN, 1], "nunique", 2), ([NAN, NAN], "max", NAN), ([NAN, NAN], "min", NAN), ([None, None], "max", None), ([None, NAN, 1], "first", NAN), ([], "sum", 0.0), ([], "mean", None)])
def test_whole_frame_aggregates(make, values, how, want):
    f = make(x=[None if v is None else float(v) for v in values], dtypes={"x": "f64"})
    got = f.agg({"o": getattr(col("x"), how)()}).to_columns()["o"][0]
    assert got == want or got is not None and want is not None and (got != got and want != want or math.isclose(got, want))


def test_sums_of_i64_wrap(make):
    f = make(x=[2**63 - 1, 1, 5], dtypes={"x": "i64"})
    assert f.agg({"o": col("x").sum()}).to_columns()["o"] == [-(2**63) + 5]


def test_group_keys(make):
    f = make(k=[NAN, None, 0.0, -0.0, NAN, None], i=list(range(6)))
    out = f.groupby("k").agg({"n": "size"})
    assert out.to_columns()["n"] == [2, 2, 2]
    assert [str(k) for k in out.to_columns()["k"]] == ["nan", "None", "0.0"]
    g = make(a=["x", "y", "x", None], b=[1, 1, 1, 1])
    assert g.distinct("a", "b").to_columns() == {"a": ["x", "y", None], "b": [1.0, 1.0, 1.0]}
    assert g.groupby("a").agg({"b": "size"}).to_columns()["b"] == [2, 1, 1]


def test_aggregate_errors(make):
    f = make(k=[1], s=["a"], b=[True], x=[1.0], t=[0], dtypes={"t": "timestamp"})
    for spec in ({"s": "sum"}, {"b": "nunique"}, {"b": "first"}, {"b": "sum"}, {"s": "min"}, {"t": "mean"}):
        with pytest.raises(ExprError):
            f.groupby("k").agg(spec)
    for spec in ({"x": "median"}, {"z": "sum"}, {"o": col("x")}, {"s": col("x").sum()}):
        with pytest.raises(FrameError):
            f.groupby("s").agg(spec)
    assert f.groupby("s").agg({"b": "count"}).to_columns()["b"] == [1]
    assert f.groupby("s").agg({"t": "max"}).dtypes["t"] == "timestamp"


def test_joins(make):
    left = make(k=[100, 200, 300], l=["a", "b", "c"])
    right = make(k=[200, 100, 200], r=[1.0, 2.0, 3.0])
    assert left.join(right, "k").to_columns() == {"k": [100, 200, 200], "l": ["a", "b", "b"], "r": [2.0, 1.0, 3.0]}
    assert left.join(right.slice(0, 1), "k", how="left").to_columns()["r"] == [None, 1.0, None]
    nulls = make(k=[100, None, 200], i=[0, 1, 2])
    assert nulls.join(make(k=[100, None], z=[7, 8]), "k").to_columns()["z"] == [7]
    assert nulls.join(make(k=[100, None], z=[7, 8]), "k", how="left").to_columns()["z"] == [7, None, None]
    nans = make(k=[NAN, 0.0], i=[0, 1])
    assert nans.join(make(k=[-0.0, NAN], z=[1, 2]), "k").to_columns()["z"] == [2, 1]
    two = make(a=["x", "x", None], b=[True, False, True], v=[1, 2, 3])
    assert two.join(make(a=["x", None], b=[False, True], v=[9, 9]), ["a", "b"]).to_columns() == {"a": ["x"], "b": [False], "v": [2], "v_right": [9]}
    with pytest.raises(FrameError, match="f64 on the left and i32 on the right"):
        left.join(make(k=[1], dtypes={"k": "i32"}), "k")
    with pytest.raises(FrameError, match="did you mean 'k'"):
        left.join(right, "kk")
    with pytest.raises(FrameError, match="inner or left"):
        left.join(right, "k", how="outer")
    with pytest.raises(FrameError, match="two columns"):
        make(k=[1], v=[1], v_right=[1]).join(make(k=[1], v=[2]), "k")


def test_describe(make):
    f = make(x=[1.0, 2.0, 3.0, 4.0, NAN, INF, None], s=["a"] * 7, n=[None] * 6 + [5], dtypes={"n": "i32"})
    out = f.describe().to_columns()
    assert out["statistic"] == ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    assert out["x"][0] == 4 and out["x"][1] == 2.5 and math.isclose(out["x"][2], 1.2909944487358056) and out["x"][3:] == [1.0, 1.75, 2.5, 3.25, 4.0]
    assert out["n"] == [1.0, 5.0, None, 5.0, 5.0, 5.0, 5.0, 5.0]
    assert set(out) == {"statistic", "x", "n"}


def test_aggregates_inside_expressions(make):
    f = make(x=[1.0, 2.0, 6.0], i=[0, 1, 2])
    assert f.with_column("d", col("x") - col("x").mean()).to_columns()["d"] == [-2.0, -1.0, 3.0]
    assert f.filter(col("x").gt(col("x").mean())).to_columns()["i"] == [2]
    assert f.with_column("m", col("x").max()).to_columns()["m"] == [6.0] * 3
    assert f.with_column("m", col("x").first()).to_columns()["m"] == [1.0] * 3


def test_row_functions(make):
    f = make(x=[1.0, None, 3.0], s=["a", "b", "c"])
    assert f.filter_fn(lambda r: r["x"] is None or r["s"] == "c").to_columns()["s"] == ["b", "c"]
    assert f.map_fn(lambda r: r["s"] * 2) == ["aa", "bb", "cc"]
    assert f.map_column("n", lambda r: None if r["x"] is None else int(r["x"]), "i32").to_columns()["n"] == [1, None, 3]


def test_output(make):
    f = make(t=[0, None], d=[11016, None], x=[NAN, 1.5], dtypes={"t": "timestamp", "d": "date32"})
    assert f.to_records()[0]["t"] == dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    assert json.loads(f.to_json()) == [{"t": 0, "d": 11016, "x": None}, {"t": None, "d": None, "x": 1.5}]
    s = make(a=[1.0, 2.0], b=["x", None]).to_string()
    assert s.splitlines()[0].split() == ["a", "b"] and s.splitlines()[1].split() == ["f64", "utf8"] and s.endswith("[2 rows × 2 columns]") and "null" in s
    long = make(a=list(range(12))).to_string()
    assert "…" in long and long.endswith("[12 rows × 1 columns]")
    assert repr(f) == "Frame[t: timestamp, d: date32, x: f64]"


def test_series(make):
    f = make(t=[0, 86400000], d=[0, 1], s=["hello", None], dtypes={"t": "timestamp", "d": "date32"})
    assert f.col("s").to_list() == ["hello", None] and list(f.col("s")) == ["hello", None]
    assert f.col("s").get(0) == "hello" and f.col("s").get(9) is None and f.col("s").get(-1) is None
    assert f.col("t").dt.day().to_list() == [1, 2] and f.col("s").str.slice(1, 3).to_list() == ["el", None]
    with pytest.raises(TypeError):
        f.col("d").dt.hour()


def test_construction(make, spark):
    f = Frame.from_records([{"a": 1}, {"b": "x"}, {"a": 2, "b": None}], spark=spark)
    assert f.to_columns() == {"a": [1.0, None, 2.0], "b": [None, "x", None]} and f.dtypes == {"a": "f64", "b": "utf8"}
    assert make(a=[None, True]).dtypes == {"a": "bool"} and make(a=[None]).dtypes == {"a": "f64"}
    for bad in (lambda: make(a=[1], b=[1, 2]), lambda: make(a=[1.5], dtypes={"a": "i32"}), lambda: make(a=[2**31], dtypes={"a": "i32"}), lambda: make(a=[object()]), lambda: Frame.from_columns({"a": [1.0]}, tzs={"a": "UTC"}, spark=spark), lambda: Frame.from_columns({"a": [1]}, dtypes={"a": "timestamp"}, tzs={"a": "Mars/Base"}, spark=spark)):
        with pytest.raises(FrameError):
            bad()
    with pytest.raises(FrameError, match="unique"):
        Frame.from_spark(spark.sql("SELECT 1 AS a, 2 AS A"))


def test_empty_frames(make):
    f = make(x=[], s=[], dtypes={"x": "f64", "s": "utf8"})
    assert f.sort_values("x").head().to_records() == [] and f.shape == (0, 2)
    assert f.groupby("s").agg({"x": "sum"}).to_records() == []
    assert f.describe().to_columns()["x"] == [0.0] + [None] * 7
    assert f.join(make(s=["a"], y=[1]), "s").to_records() == []


def test_scope_releases(make):
    with scope() as track:
        f = track(make(x=[1.0, 2.0]))
        assert f._df.storageLevel.useMemory and f.length == 2
    assert not f._df.storageLevel.useMemory


@pytest.mark.parametrize(("value", "dtype", "want"), [
    (1.0, "f64", "1"), (-0.5, "f64", "-0.5"), (123456.789, "f64", "123457"), (1234567.5, "f64", "1.23457e+6"), (0.1 + 0.2, "f64", "0.3"), (1e-7, "f64", "1.00000e-7"), (0.00001234567, "f64", "0.0000123457"), (1e21, "f64", "1e+21"),
    (float("nan"), "f64", "NaN"), (float("-inf"), "f64", "-inf"), (None, "utf8", "null"), (True, "bool", "true"), ("x" * 24, "utf8", "x" * 24), ("x" * 25, "utf8", "x" * 23 + "…"), (12, "i32", "12"),
])
def test_cells_as_text(value, dtype, want):
    assert shown(value, dtype) == want


def test_quartiles_of_many_rows_are_those_of_few(spark, monkeypatch):
    rng = random.Random(4)
    values = [rng.choice([None, float("nan"), float("inf"), 0.0, 1.5, rng.uniform(-9, 9)]) for _ in range(700)]
    frame = Frame.from_columns({"a": values, "b": [rng.randint(0, 3) for _ in values], "none": [None] * len(values), "text": ["x"] * len(values)}, dtypes={"b": "i32", "none": "f64"}, spark=spark)
    few = frame.describe().to_records()
    monkeypatch.setattr(frame_module, "MOST_MERGED", 10)
    many = frame.describe().to_records()
    assert [r["statistic"] for r in many] == [r["statistic"] for r in few]
    for a, b in zip(many, few, strict=True):
        assert a["none"] == b["none"] and a["b"] == pytest.approx(b["b"]) and a["a"] == pytest.approx(b["a"])


def test_long_heads_and_tails(spark, monkeypatch):
    frame = Frame.from_columns({"a": list(range(300))}, dtypes={"a": "i32"}, spark=spark).sort_values("a", descending=True)
    monkeypatch.setattr(frame_module, "MOST_TAKEN", 20)
    assert frame.head(50).to_columns()["a"] == list(range(299, 249, -1)) and frame.tail(50).to_columns()["a"] == list(range(49, -1, -1))
    assert frame.slice(100, 130).to_columns()["a"] == list(range(199, 169, -1))


def test_writers_sort_only_when_asked(spark, tmp_path):
    frame = Frame.from_columns({"k": [3, 1, 2, 1], "v": [1.0, 2.0, 3.0, 4.0]}, dtypes={"k": "i32"}, spark=spark)
    plan = lambda f: f.to_write()._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan(frame.groupby("k").agg({"v": "sum"})) and "rangepartitioning" in plan(frame.sort_values("v"))
    frame.sort_values("v", descending=True).write_parquet(str(tmp_path / "s"))
    assert [r["v"] for r in read_parquet(str(tmp_path / "s"), spark=spark).to_records()] == [4.0, 3.0, 2.0, 1.0]


def test_counts_wrap_or_are_wide(spark):
    frame = Frame.from_columns({"k": [1, 1, 2], "v": [1.0, None, 3.0]}, dtypes={"k": "i32"}, spark=spark)
    for wide, dtype in ((False, "i32"), (True, "i64")):
        out = frame.groupby("k").agg({"v": ["count", "size", "nunique"]}, wide=wide)
        assert {out.dtype_of(c) for c in ("v_count", "v_size", "v_nunique")} == {dtype} and out.to_records()[0] == {"k": 1, "v_count": 1, "v_size": 2, "v_nunique": 1}
    assert spark.range(1).select(wrap32(F.lit(3_000_000_000))).first()[0] == 3_000_000_000 - 2**32


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    with pytest.raises(ValueError, match="share"):
        shared_dir(type("Session", (), {"conf": Conf(), "sparkContext": Context()})())


def test_a_series_becomes_a_column(make):
    f = make(i=[0, 1, 2, 3], t=[-1, 951782400000, None, 0], s=["xyz", None, "é", ""], dtypes={"i": "i32", "t": "timestamp"})
    assert f.with_column("m", f.col("t").dt.month()).to_columns()["m"] == [12, 2, None, 1]
    out = f.with_zone("t", "America/Chicago").sort_values("i", descending=True)
    out = out.with_column("h", out.col("t").dt.hour())  # in the zone, and in the order of the sort
    assert out.dtypes["h"] == "i32" and out.to_columns()["h"] == [18, None, 18, 17]
    cut = f.col("s").str.slice(0, 2).str.slice(1)
    other = f.sort_values("i", descending=True).with_column("v", cut)  # another frame's: by position
    assert other.dtypes["v"] == "utf8" and other.to_records() == [dict(r, v=v) for r, v in zip(f.to_records()[::-1], cut.to_list(), strict=True)]
    with pytest.raises(FrameError, match="a series of 4 cells"):
        f.head(3).with_column("v", cut)
    for frame in (f, f.head(4)):
        with pytest.raises(FrameError, match="utf8"):
            frame.with_column("v", cut, "i32")
