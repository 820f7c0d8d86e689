"""Sinks: Parquet and Arrow streams."""

from __future__ import annotations

import io
from collections.abc import Callable
from functools import partial
from typing import TYPE_CHECKING

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import FrameError
from ..storage import bound_batches
from ..types import Field

if TYPE_CHECKING:
    from ..operators.frame import Frame

ARROW = {
    "f64": pa.float64(), "f32": pa.float32(), "i32": pa.int32(), "u32": pa.uint32(), "i64": pa.int64(), "bool": pa.bool_(),
    "utf8": pa.string(), "date32": pa.date32(), "timestamp": pa.timestamp("ms"),
}


def write_parquet(frame: Frame, path: str, compression: str = "uncompressed") -> None:
    """Files of a folder; timestamps in milliseconds, zones and u32 in the columns' metadata."""
    if compression not in ("uncompressed", "snappy"):
        raise FrameError(f"compression must be uncompressed or snappy, got {compression!r}")
    df = frame.to_write()
    conf, key = df.sparkSession.conf, "spark.sql.parquet.outputTimestampType"
    old = conf.get(key)
    conf.set(key, "TIMESTAMP_MILLIS")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.set(key, old)


def arrow_bytes(frame: Frame) -> bytes:
    """One Arrow IPC stream, through the driver; strings are dictionary-encoded."""
    return stream_of(encoded(frame.to_spark().toArrow(), frame._schema))


def arrow_streams(frame: Frame, encode: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """A column `stream` of Arrow IPC streams, each of a batch of rows, made by tasks; the first one has no rows, only the schema.

    `encode` makes the tables that are written of those that Spark gives (timestamps in microseconds); if unset, they are as in `to_arrow`.
    """
    df = frame.to_write()
    bound_batches(df.sparkSession)
    encode = encode or partial(encoded, schema=frame._schema)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([stream_of(encode(pa.Table.from_batches([batch])))], pa.binary())], ["stream"])

    none = stream_of(encode(to_arrow_schema(df.schema).empty_table()))
    return df.sparkSession.range(0, 1, 1, 1).select(F.lit(none).alias("stream")).union(df.mapInArrow(run, "stream binary"))


def floored(c: pa.ChunkedArray, per: int) -> pa.ChunkedArray:
    """Whole numbers divided by another, towards minus infinity."""
    whole = pc.divide(c, per)  # truncates
    return pc.if_else(pc.less(c, pc.multiply(whole, per)), pc.subtract(whole, 1), whole)


def encoded(table: pa.Table, schema: dict[str, Field]) -> pa.Table:
    """A table as Spark gives it in Arrow's types for the nine."""
    columns, fields = [], []
    for name, f in schema.items():
        kind = pa.timestamp("ms", f.tz) if f.tz else ARROW.get(f.dtype)
        c = table[name].combine_chunks()
        if f.dtype == "timestamp":
            c = c.cast(pa.timestamp("us", "UTC")).cast(pa.int64())
            c = floored(c, 1000).cast(pa.timestamp("ms")).cast(kind)
        elif kind is not None:
            c = c.cast(kind)
        if f.dtype == "utf8":
            c = c.dictionary_encode()
        columns.append(c)
        fields.append(pa.field(name, c.type))
    return pa.Table.from_arrays(columns, schema=pa.schema(fields))


def stream_of(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()
