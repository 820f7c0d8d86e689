"""The nine logical types and what Spark stores for them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import FrameError

SPARK = {
    "f64": T.DoubleType(), "f32": T.FloatType(), "i32": T.IntegerType(), "u32": T.LongType(), "i64": T.LongType(),
    "bool": T.BooleanType(), "utf8": T.StringType(), "date32": T.DateType(), "timestamp": T.TimestampType(),
}
DTYPES = tuple(SPARK)
FLOATS, INTS, TEMPORAL = ("f64", "f32"), ("i32", "u32", "i64"), ("date32", "timestamp")
NUMERIC = FLOATS + INTS
RANGES = {"i32": (-(2**31), 2**31 - 1), "u32": (0, 2**32 - 1), "i64": (-(2**63), 2**63 - 1)}


@dataclass(frozen=True)
class Field:
    """A column's type; `tz` only for timestamps. Types outside the nine are carried as "other"."""

    dtype: str
    tz: str | None = None

    def metadata(self) -> dict:
        return {"dtype": self.dtype} | ({"tz": self.tz} if self.tz else {})


def field_of(f: T.StructField) -> Field:
    """The logical type of a Spark column; metadata decides between u32 and i64, and gives the zone."""
    if isinstance(f.dataType, T.LongType):
        return Field("u32" if f.metadata.get("dtype") == "u32" else "i64")
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return Field("timestamp", f.metadata.get("tz"))
    if isinstance(f.dataType, (T.ByteType, T.ShortType)):
        return Field("i32")
    for name in ("f64", "f32", "i32", "bool", "utf8", "date32"):
        if f.dataType == SPARK[name] or isinstance(f.dataType, type(SPARK[name])):
            return Field(name)
    return Field("other")


def normalised(df: DataFrame, dtypes: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, Field]]:
    """The frame's columns in Spark's types for the nine, and their logical types.

    Timestamps without a zone are read as UTC, with their microseconds; small integers widen to i32.
    """
    schema = {f.name: field_of(f) for f in df.schema.fields}
    for name, dtype in (dtypes or {}).items():
        if dtype not in SPARK:
            raise FrameError(f"unknown dtype {dtype!r}")
        if name in schema:
            schema[name] = Field(dtype, schema[name].tz if dtype == "timestamp" else None)
    columns = []
    for f in df.schema.fields:
        want = SPARK.get(schema[f.name].dtype)
        same = want is None or f.dataType == want or isinstance(f.dataType, T.StringType) and isinstance(want, T.StringType)
        columns.append(F.col(f"`{f.name}`") if same else F.col(f"`{f.name}`").cast(want).alias(f.name))
    return df.select(*columns), schema
