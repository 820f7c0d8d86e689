"""CSV, JSON, Arrow and Parquet."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pytest

from sparrowgrid import Frame, FrameError, col, from_arrow, read_csv, read_json, read_parquet
from sparrowgrid.sources.read import infer, parse_csv
from sparrowgrid.sources.write import stream_of


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        (["1", "-2147483648"], "i32"), (["1", "2147483648"], "f64"), (["9007199254740992"], "i64"), (["9223372036854775808"], "f64"), (["1", "2.5"], "f64"), (["1e3"], "f64"), (["true", "false"], "bool"),
        (["1", "true"], "bool"), (["1", "x"], "utf8"), ([None, None], "utf8"), ([], "utf8"), ([None, "7"], "i32"), (["-Infinity", "NaN"], "f64"), (["1", "9007199254740992"], "i64"),
    ],
)
def test_inference(cells, want):
    assert infer(cells) == want


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ("a,b\n1,2\n", [["a", "b"], ["1", "2"]]), ("a,b\r\n1,2", [["a", "b"], ["1", "2"]]), ('"a ""q""",b\n', [['a "q"', "b"]]), ('"x\ny",2', [["x\ny", "2"]]), ("a\rb,c", [["a\rb", "c"]]),
        (",\n", [["", ""]]), ("", []), ('""\n', [[""]]), ("a,\n", [["a", ""]]),
    ],
)
def test_rows(text, rows):
    assert parse_csv(text) == rows


def test_an_open_quote_is_an_error():
    with pytest.raises(FrameError):
        parse_csv('a,"b\n')


def test_csv_text(spark):
    f = read_csv("i,x,s,b,e\n1,1.5,hello,true,\n2,NA,null,false,\n", text=True, spark=spark)
    assert f.dtypes == {"i": "i32", "x": "f64", "s": "utf8", "b": "bool", "e": "utf8"}
    assert f.to_records() == [{"i": 1, "x": 1.5, "s": "hello", "b": True, "e": None}, {"i": 2, "x": None, "s": None, "b": False, "e": None}]
    assert read_csv("1||2\n3||4", text=True, delimiter="||", header=False, columns=["p", "q"], spark=spark).to_columns() == {"p": [1, 3], "q": [2, 4]}
    assert read_csv("a\n1\n2\n3\n4", text=True, skip_rows=1, max_rows=2, spark=spark).to_columns() == {"a": [2, 3]}
    assert read_csv("a,b\n", text=True, spark=spark).dtypes == {"a": "utf8", "b": "utf8"}
    assert read_csv("", text=True, spark=spark).columns == []
    with pytest.raises(FrameError, match="row 2"):
        read_csv("a,b\n1,2\n3", text=True, spark=spark)


def test_csv_types_by_name(spark):
    f = read_csv("i,d,t\n9007199254740993,2000-02-29,2020-01-01T00:00:00+01:00", text=True, dtypes={"i": "i64", "d": "date32", "t": "timestamp"}, spark=spark)
    assert f.to_records() == [{"i": 9007199254740993, "d": dt.date(2000, 2, 29), "t": dt.datetime(2019, 12, 31, 23, tzinfo=dt.timezone.utc)}]
    for text, kind in (("a\n2000-2-9", "date32"), ("a\n2000-02-30", "date32"), ("a\n2020-01-01T00:00:00", "timestamp"), ("a\nx", "f64"), ("a\n1.5", "i32"), ("a\n3000000000", "i32"), ("a\n-1", "u32"), ("a\nyes", "bool")):
        with pytest.raises(Exception, match="column a"):
            read_csv(text, text=True, dtypes={"a": kind}, spark=spark).to_records()


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'k,s\r\n1,"x, ""y""\r\nz"\r\n2,NA\r\n')
    f = read_csv(str(tmp_path / "a.csv"), spark=spark)
    assert f.dtypes == {"k": "i32", "s": "utf8"}
    assert f.to_columns()["k"] == [1, 2] and f.to_columns()["s"][1] is None and f.to_columns()["s"][0].startswith('x, "y"')
    (tmp_path / "b.csv").write_text("a\n" + "1\n" * 150 + "x\n")
    with pytest.raises(Exception, match="column a"):
        read_csv(str(tmp_path / "b.csv"), spark=spark).to_records()


def test_json(spark, tmp_path):
    assert read_json('[{"a": 1, "b": null}, {"b": "x"}]', text=True, spark=spark).to_columns() == {"a": [1.0, None], "b": [None, "x"]}
    with pytest.raises(TypeError):
        read_json('{"a": 1}', text=True, spark=spark)
    f = Frame.from_columns({"a": [1.5, None], "s": ["x", "y"]}, spark=spark)
    f.write_json(str(tmp_path / "j"))
    assert read_json(str(tmp_path / "j"), lines=True, schema=f.to_spark().schema, spark=spark).sort_values("s").to_records() == f.to_records()


VALUES = {
    "f64": [1.5, None, -2.5, 0.0], "f32": [0.0, 1.5, -2.5, None, 16777216.0], "i32": [0, 1, -1, 2147483647, -2147483648], "u32": [0, 1, 4294967295, None], "i64": [0, 9007199254740993, None, -(2**63), 2**63 - 1],
    "bool": [True, False, None, True, False], "utf8": ["hello", None, "world", "hello", None], "date32": [-1, 0, 11016, None, 24855], "timestamp": [-86400000, 0, 951782400000, None, 2147483647000],
}


@pytest.mark.parametrize("dtype", list(VALUES))
def test_round_trips(spark, tmp_path, dtype):
    f = Frame.from_columns({"i": range(len(VALUES[dtype])), "v": VALUES[dtype]}, dtypes={"v": dtype}, spark=spark)
    back = from_arrow(f.to_arrow(), spark=spark)
    assert back.dtypes["v"] == dtype and back.to_records() == f.to_records()
    for codec in ("uncompressed", "snappy"):
        f.write_parquet(str(tmp_path / codec), codec)
        back = read_parquet(str(tmp_path / codec), strict=True, order_by="i", spark=spark)
        assert back.dtypes["v"] == dtype and back.to_records() == f.to_records()
    with pytest.raises(FrameError):
        f.write_parquet(str(tmp_path / "z"), "zstd")


def test_zones_travel(spark, tmp_path):
    f = Frame.from_columns({"t": [1772956799000, 1772956800000, None]}, dtypes={"t": "timestamp"}, tzs={"t": "America/Chicago"}, spark=spark)
    f.write_parquet(str(tmp_path / "p"))
    for back in (from_arrow(f.to_arrow(), spark=spark), read_parquet(str(tmp_path / "p"), order_by="t", spark=spark)):
        assert back.with_column("h", col("t").dt.hour()).to_columns()["h"] == [1, 3, None]


def test_arrow_units_and_types(spark):
    t = pa.table({
        "s": pa.array([1, None], pa.timestamp("s")), "n": pa.array([1_500_000, -1_500_000], pa.timestamp("ns")), "small": pa.array([1, 2], pa.int8()), "u": pa.array([1, 2], pa.uint16()), "h": pa.array([1.0, 2.0], pa.float32()),
        "big": pa.array(["a", None], pa.large_string()), "d": pa.array(["x", "y"]).dictionary_encode(),
    })
    f = from_arrow(t, spark=spark)
    assert f.dtypes == {"s": "timestamp", "n": "timestamp", "small": "i32", "u": "u32", "h": "f32", "big": "utf8", "d": "utf8"}
    assert f.with_column("s", col("s").cast("i64")).to_columns()["s"] == [1000, None]
    with pytest.raises(FrameError, match="decimal"):
        from_arrow(pa.table({"x": pa.array([1], pa.decimal128(5, 2))}), spark=spark)


def test_strict_profile(spark, tmp_path):
    spark.sql("SELECT array(1, 2) AS a, 1 AS b").write.parquet(str(tmp_path / "n"))
    with pytest.raises(FrameError, match="'a'"):
        read_parquet(str(tmp_path / "n"), strict=True, spark=spark)
    f = read_parquet(str(tmp_path / "n"), spark=spark)
    assert f.select("b").to_records() == [{"b": 1}] and f.dtypes["a"] == "other"


@pytest.mark.parametrize("multiline", [None, True, False])
def test_plain_csv_files_are_split(spark, tmp_path, multiline):
    """Without fields over several lines a file is read in parts; fields with quotes and delimiters do not matter."""
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f'{i},"x,""{i}"""\n' for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        frame = read_csv(str(tmp_path / "a.csv"), multiline=multiline, spark=spark)
        parts = frame.to_spark(ordered=False).rdd.getNumPartitions()
        assert (parts == 1) if multiline else (parts > 3)
        assert sorted(map(tuple, (r.values() for r in frame.to_records()))) == [(i, f'x,"{i}"') for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quoted_line_ends_are_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert read_csv(str(tmp_path / "a.csv"), spark=spark).to_columns() == {"a": [1, 2], "b": ["x\ny", "z"]}


@pytest.mark.parametrize("dtype", list(VALUES))
def test_arrow_streams_round_trip(spark, dtype):
    """In parts as in one piece; an empty frame keeps its types."""
    f = Frame.from_columns({"i": range(len(VALUES[dtype])), "v": VALUES[dtype]}, dtypes={"v": dtype}, spark=spark)
    back = from_arrow(f.to_arrow_streams())
    assert back.dtypes == f.dtypes and back.sort_values("i").to_records() == f.to_records()
    none = from_arrow(f.filter(col("i").lt(0)).to_arrow_streams())
    assert none.dtypes == f.dtypes and none.to_records() == []


def test_arrow_streams_keep_zones_and_asked_orders(spark):
    f = Frame.from_spark(spark.range(0, 30_000, 1, 7).selectExpr("id AS i", "timestamp_seconds(id - 20000) AS t")).with_zone("t", "America/Chicago")
    streams = f.sort_values("i", descending=True).to_arrow_streams()
    back = from_arrow(streams)
    assert streams.count() > 7 and back._schema == f._schema
    assert back.to_columns() == f.sort_values("i", descending=True).to_columns() and back.head(2).to_columns()["i"] == [29_999, 29_998]


def test_arrow_streams_in_small_batches(spark):
    """A partition's streams don't reach a task in one piece."""
    f = Frame.from_spark(spark.range(0, 100, 1, 1).selectExpr("id AS i", "repeat(chr(97 + id % 26), 1000000) AS s"))
    streams = f.to_arrow_streams()
    sizes = [r[0] for r in streams.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"]) for b in bs), "n long").collect()]
    assert sum(sizes) > 80_000_000 and max(sizes) < 10_000_000
    assert from_arrow(streams).filter(col("s").is_null()).length == 0


def test_arrow_streams_have_one_schema(spark):
    a, b = (pa.table({"x": pa.array([1], t)}) for t in (pa.int32(), pa.int64()))
    both = [(bytearray(stream_of(t)),) for t in (a, b)]
    with pytest.raises(Exception, match="an Arrow stream has columns"):
        from_arrow(spark.createDataFrame(both, "stream binary")).to_records()
    with pytest.raises(FrameError, match="no schema"):
        from_arrow(spark.createDataFrame([], "stream binary"))
    with pytest.raises(FrameError, match="one binary column"):
        from_arrow(spark.range(1))
