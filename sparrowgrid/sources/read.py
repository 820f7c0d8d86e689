"""Sources: CSV, JSON, Arrow streams and Parquet."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FrameError
from ..operators.frame import Frame, session
from ..storage import bound_batches
from ..types import SPARK, Field

NULLS = ("", "null", "NA")
SAMPLE = 100
_INT = re.compile(r"[+-]?\d+")
_FLOAT = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?Infinity|NaN")
_FLOAT_SQL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?Infinity$|^NaN$"
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})$"
_LADDER = ("i32", "i64", "f64", "bool", "utf8")


def cell_dtype(cell: str) -> str:
    """The narrowest rung of the ladder that a cell fits. Whole numbers beyond 32 bits are f64 while that is exact."""
    if _INT.fullmatch(cell):
        n = int(cell)
        if -(2**31) <= n < 2**31:
            return "i32"
        return "f64" if abs(n) <= 2**53 - 1 or not -(2**63) <= n < 2**63 else "i64"
    if _FLOAT.fullmatch(cell):
        return "f64"
    return "bool" if cell in ("true", "false") else "utf8"


def infer(cells: Sequence[str | None]) -> str:
    kinds = {cell_dtype(c) for c in cells if c is not None}
    if not kinds:
        return "utf8"
    return max(kinds, key=_LADDER.index)


def parsed(c: Column, dtype: str, name: str) -> Column:
    """A CSV cell as `dtype`; one that does not fit ends the query with the column's name."""
    fail = lambda why: F.raise_error(F.concat(F.lit(f"column {name}: not a {why}: "), c))
    guarded = lambda ok, value: F.when(c.isNull(), None).when(ok, value).otherwise(fail(dtype).cast(SPARK[dtype]))
    if dtype == "utf8":
        return c
    if dtype == "bool":
        return guarded(c.isin("true", "false"), c == "true")
    if dtype in ("f64", "f32"):
        return guarded(c.rlike(_FLOAT_SQL), c.cast(SPARK[dtype]))
    if dtype in ("i32", "i64", "u32"):
        n = c.try_cast("int" if dtype == "i32" else "long")
        fits = n.isNotNull() & ((n >= 0) & (n < 2**32) if dtype == "u32" else F.lit(True))
        return guarded(c.rlike(r"^[+-]?[0-9]+$") & fits, n)
    if dtype == "date32":
        return guarded(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c.try_cast("date").isNotNull(), c.try_cast("date"))
    return guarded(c.rlike(_STAMP) & c.try_cast("timestamp").isNotNull(), c.try_cast("timestamp"))


def read_csv(source: str, *, text: bool = False, delimiter: str = ",", header: bool = True, columns: Sequence[str] | None = None, dtypes: dict[str, str] | None = None, null_values: Sequence[str] = NULLS, skip_rows: int = 0, max_rows: int | None = None, multiline: bool | None = None, spark: SparkSession | None = None) -> Frame:
    """CSV files by path, or with text=True a CSV text.

    Types come from `dtypes` or from the first 100 rows; a row with another number of cells is an error.
    Quoted fields may hold delimiters, doubled quotes and line ends. A file with `multiline` fields is read as a whole by
    one task, others are split; unless told, a first pass looks for lines with an odd number of quotes.
    """
    spark = session(spark)
    if text:
        rows = parse_csv(source, delimiter)
        names, rows = _named(rows, header, columns)
        rows = rows[skip_rows : None if max_rows is None else skip_rows + max_rows]
        for i, r in enumerate(rows):
            if len(r) != len(names):
                raise FrameError(f"row {i + 1}: {len(r)} cells, but {len(names)} columns")
        nulls = set(null_values)
        cells = [[None if v in nulls else v for v in r] for r in rows]
        kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(cells)], T.StructType([*kind.fields, T.StructField("__sg_rid", T.LongType())]))
        sample, order = cells[:SAMPLE], [("__sg_rid", False)]
    else:
        lines = spark.read.text(source, lineSep="\n")
        if multiline is None:
            quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
            multiline = not lines.where(quotes % 2 == 1).isEmpty()
        reader = spark.read.options(sep=delimiter, quote='"', escape='"', multiLine=multiline, mode="FAILFAST", enforceSchema=False, emptyValue="", nullValue="\x00", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        line = lines.first()
        if line and not line[0].endswith("\r"):  # else the reader takes CRLF as the end of rows
            reader = reader.option("lineSep", "\n")
        head = reader.option("header", header).csv(source)
        names = list(columns or (head.columns if header else [f"column_{i}" for i in range(len(head.columns))]))
        if len(names) != len(head.columns):
            raise FrameError(f"{len(names)} names, but {len(head.columns)} columns")
        df = head.toDF(*names)
        df = df.select(*[F.when(~F.col(f"`{n}`").isin(*null_values), F.col(f"`{n}`")).alias(n) for n in names])
        order = None
        if skip_rows or max_rows is not None:
            df = df.offset(skip_rows) if max_rows is None else df.limit(skip_rows + max_rows).offset(skip_rows)
        sample = [tuple(r) for r in df.limit(SAMPLE).collect()]
    kinds = {n: (dtypes or {}).get(n) or infer([r[i] for r in sample]) for i, n in enumerate(names)}
    if bad := [v for v in kinds.values() if v not in SPARK]:
        raise FrameError(f"unknown dtype {bad[0]!r}")
    hidden = ["__sg_rid"] if order else []
    df = df.select(*[parsed(F.col(f"`{n}`"), k, n).cast(SPARK[k]).alias(n) for n, k in kinds.items()], *hidden)
    frame = Frame.from_spark(df.drop(*hidden), dtypes=kinds) if not order else Frame(df, Frame.from_spark(df.drop(*hidden), dtypes=kinds)._schema, order)
    return frame


def _named(rows: list[list[str]], header: bool, columns: Sequence[str] | None) -> tuple[list[str], list[list[str]]]:
    if not rows:
        return list(columns or []), []
    names = list(columns or (rows[0] if header else [f"column_{i}" for i in range(len(rows[0]))]))
    return names, rows[1:] if header else rows


def parse_csv(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of cells by RFC 4180: LF or CRLF end rows, a lone CR is data, an open quote is an error."""
    rows, row, cell, i, n, quoted, started = [], [], [], 0, len(text), False, False
    while i < n:
        c = text[i]
        if quoted:
            if c == '"':
                if text.startswith('""', i):
                    cell.append('"')
                    i += 2
                    continue
                quoted = False
            else:
                cell.append(c)
            i += 1
        elif c == '"' and not cell:
            quoted = started = True
            i += 1
        elif text.startswith(delimiter, i):
            row.append("".join(cell))
            cell, started = [], True
            i += len(delimiter)
        elif c == "\n" or text.startswith("\r\n", i):
            row.append("".join(cell))
            rows.append(row)
            row, cell, started = [], [], False
            i += 1 if c == "\n" else 2
        else:
            cell.append(c)
            started = True
            i += 1
    if quoted:
        raise FrameError("a quoted field is not closed")
    if started or cell or row:
        rows.append([*row, "".join(cell)])
    return rows


def read_json(source: str, *, text: bool = False, lines: bool = False, dtypes: dict[str, str] | None = None, schema: T.StructType | None = None, spark: SparkSession | None = None) -> Frame:
    """A JSON array of objects: a text, or files by path (with a schema if given); lines=True: files of an object a line."""
    if text:
        data = json.loads(source)
        if not isinstance(data, list):
            raise TypeError("the JSON text is no array")
        return Frame.from_records(data, dtypes=dtypes, spark=spark)
    reader = session(spark).read.option("multiLine", not lines)
    return Frame.from_spark((reader.schema(schema) if schema else reader).json(source), dtypes=dtypes)


def from_arrow(data: bytes | pa.Table | DataFrame, *, spark: SparkSession | None = None) -> Frame:
    """An Arrow IPC stream or a table. Timestamps of any unit become instants; seconds out of range become null.

    A Spark DataFrame with one column of streams, as `to_arrow_streams` gives, is read by tasks; all have the schema of the first.
    """
    if isinstance(data, DataFrame):
        return _from_streams(data)
    table = data if isinstance(data, pa.Table) else pa.ipc.open_stream(data).read_all()
    table, schema = decoded(table)
    df = session(spark).createDataFrame(table.append_column("__sg_rid", pa.array(range(table.num_rows), pa.int64())))
    return Frame(df, schema, [("__sg_rid", False)])


def _from_streams(streams: DataFrame) -> Frame:
    spark = session(streams.sparkSession)
    if len(streams.columns) != 1 or not isinstance(streams.schema[0].dataType, T.BinaryType):
        raise FrameError("Arrow streams are one binary column")
    bound_batches(spark)
    if (first := streams.first()) is None:
        raise FrameError("there is no Arrow stream, so no schema")
    head = pa.ipc.open_stream(first[0]).schema
    schema = decoded(head.empty_table())[1]

    def run(batches):
        for batch in batches:
            for stream in batch.column(0):
                table = pa.ipc.open_stream(stream.as_buffer()).read_all()
                if table.schema != head:
                    raise FrameError(f"an Arrow stream has columns {table.schema.names} of types {[str(t) for t in table.schema.types]}, the first one {head.names} of {[str(t) for t in head.types]}")
                yield from decoded(table)[0].to_batches()

    return Frame(streams.mapInArrow(run, T.StructType([T.StructField(n, SPARK[f.dtype]) for n, f in schema.items()])), schema)


def decoded(table: pa.Table) -> tuple[pa.Table, dict[str, Field]]:
    """An Arrow table in the types that Spark stores for the nine, and its logical types."""
    columns, schema = {}, {}
    for f in table.schema:
        c, t = table[f.name], f.type
        if pa.types.is_dictionary(t):
            c, t = c.cast(t.value_type), t.value_type
        if pa.types.is_timestamp(t):
            # To microseconds; finer units towards zero, instants beyond the range of 64 bits to null.
            raw, per = c.cast(pa.int64()), {"s": 10**6, "ms": 10**3, "us": 1, "ns": None}[t.unit]
            if per is None:
                raw = pc.divide(raw, 1000)
            elif per > 1:
                most = (2**63 - 1) // per
                raw = pc.multiply(pc.if_else(pc.and_(pc.less_equal(raw, most), pc.greater_equal(raw, -most)), raw, pa.scalar(None, pa.int64())), per)
            c = raw.cast(pa.timestamp("us", "UTC"))
            schema[f.name] = Field("timestamp", t.tz or None)
        else:
            schema[f.name] = Field(kind := _arrow_dtype(t, f.name))
            c = c.cast({"i32": pa.int32(), "u32": pa.int64(), "i64": pa.int64(), "f64": pa.float64(), "f32": pa.float32(), "utf8": pa.string()}.get(kind, t))
        columns[f.name] = c
    return pa.table(columns), schema


def _arrow_dtype(t: pa.DataType, name: str) -> str:
    p = pa.types
    for test, dtype in (
        (p.is_boolean, "bool"), (p.is_float64, "f64"), (p.is_floating, "f32"), (p.is_int64, "i64"), (p.is_signed_integer, "i32"),
        (p.is_unsigned_integer, "u32"), (p.is_string, "utf8"), (p.is_large_string, "utf8"), (p.is_date32, "date32"),
    ):
        if test(t) and t != pa.uint64():
            return dtype
    raise FrameError(f"column {name!r}: no dtype for Arrow's {t}")


def read_parquet(path: str, *, order_by: str | Sequence[str] | None = None, strict: bool = False, dtypes: dict[str, str] | None = None, spark: SparkSession | None = None) -> Frame:
    """Parquet by path; with strict=True what lies outside the profile (see `profile_error`) is an error."""
    df: DataFrame = session(spark).read.parquet(path)
    if strict and (why := profile_errors(df)):
        raise FrameError(f"unsupported: {why}")
    frame = Frame.from_spark(df, dtypes=dtypes, order_by=order_by)
    if strict and (bad := [n for n, k in frame.dtypes.items() if k == "other"]):
        raise FrameError(f"column {bad[0]!r} is {df.schema[bad[0]].dataType.simpleString()}, which is outside the profile")
    return frame


def profile_error(footer: pq.FileMetaData) -> str | None:
    """The first feature of a file outside the profile: plain columns of the nine types, timestamps in milliseconds, Snappy or no compression."""
    for i in range(len(footer.schema)):
        c = footer.schema.column(i)
        kind, logical, name = c.physical_type, c.logical_type, c.path.split(".")[0]
        unit = json.loads(logical.to_json()).get("timeUnit") if logical.type == "TIMESTAMP" else None
        if c.max_repetition_level:
            return f"column {name!r}: REPEATED"
        if "." in c.path:
            return f"column {name!r}: nested"
        if kind in ("INT96", "FIXED_LEN_BYTE_ARRAY"):
            return f"column {name!r}: {kind}"
        if logical.type not in ("NONE", "STRING", "DATE", "TIMESTAMP", "INT") or unit and unit != "milliseconds" or kind == "BYTE_ARRAY" and logical.type != "STRING":
            return f"column {name!r}: {kind} as {logical.type}" + (f" in {unit}" if unit else "")
    for g in range(footer.num_row_groups):
        for i in range(footer.num_columns):
            c = footer.row_group(g).column(i)
            if c.compression not in ("SNAPPY", "UNCOMPRESSED"):
                return f"column {c.path_in_schema!r}: codec {c.compression}"
    return None


def profile_errors(df: DataFrame) -> str | None:
    """The first of the files' profile errors, by path; the footers are read on the executors."""

    def run(batches):
        for batch in batches:
            out = []
            for uri in batch.column(0).to_pylist():
                store, path = pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
                with store.open_input_file(path) as f:
                    out.append((uri, profile_error(pq.ParquetFile(f).metadata)))
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.string()), pa.array([w for _, w in out], pa.string())], ["uri", "why"])

    files = [(f.replace("file:///", "file:/").replace("file:/", "file:///"),) for f in df.inputFiles()]
    if not files:
        return None
    paths = df.sparkSession.createDataFrame(files, "uri string")
    found = paths.mapInArrow(run, "uri string, why string").where("why is not null").agg(F.min(F.struct("uri", "why")).alias("x")).first()["x"]
    return found and found["why"]


__all__ = ["from_arrow", "infer", "parse_csv", "read_csv", "read_json", "read_parquet"]
