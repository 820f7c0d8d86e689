"""The frame: a Spark DataFrame, its logical types, and the order of its rows.

Every operation returns a new lazy frame. Row order costs nothing until it is asked for: a frame knows the
columns that order it (hidden, pruned by Catalyst where unused), and only `head`, `tail`, `slice`, output and
order-sensitive aggregates sort. A source's order is attached when first needed.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import FrameError, unknown
from ..functions.expr import AGGREGATES, Expr
from ..plans.lower import Lowering, counted, utf16_key
from ..storage import shared_dir
from ..types import NUMERIC, RANGES, SPARK, Field, normalised
from .printer import shown, table_of

HIDDEN = "__sg_"
RID = "__sg_rid"
#: Rows that a top-k plan takes through one task at most; beyond it rows get positions first.
MOST_TAKEN = 10_000
#: Rows up to which one task may merge the distinct values of a column for its quartiles; beyond it they are range-sorted.
MOST_MERGED = 1_000_000


class Asked(list):
    """An order that was asked for by a sort, not only that in which rows happen to stand: writers keep it."""


def session(spark: SparkSession | None = None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # instants are shown and cast in UTC
    return spark


def q(name: str) -> Column:
    return F.col(f"`{name}`")


class Frame:
    def __init__(self, df: DataFrame, schema: dict[str, Field], order: list[tuple[str, bool]] | None = None):
        """`order`: (column, descending) pairs by which rows stand; None: as the source has them."""
        self._df, self._schema, self._order = df, schema, order

    # --- construction ---

    @classmethod
    def from_spark(cls, df: DataFrame, *, dtypes: dict[str, str] | None = None, order_by: str | Sequence[str] | None = None) -> Frame:
        """Any Spark DataFrame; `order_by` names a key, unique and without nulls, that gives its rows their order."""
        names = [n.lower() for n in df.columns]
        if len(set(names)) < len(names) or any(n.startswith(HIDDEN) for n in names):
            raise FrameError("column names must be unique and not start with " + HIDDEN)
        session(df.sparkSession)
        df, schema = normalised(df, dtypes)
        keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
        cls(df, schema)._check(keys)
        hidden = {f"__sg_o{i}": q(k) for i, k in enumerate(keys)}
        return cls(df.withColumns(hidden), schema, [(c, False) for c in hidden]) if keys else cls(df, schema)

    @classmethod
    def from_columns(cls, columns: dict[str, Iterable], *, dtypes: dict[str, str] | None = None, tzs: dict[str, str] | None = None, spark: SparkSession | None = None) -> Frame:
        """Equal-length columns; types are those of the first cell that is not null (numbers without a fraction too are f64)."""
        data = {k: [_plain(v) for v in c] for k, c in columns.items()}
        if len({len(c) for c in data.values()}) > 1:
            raise FrameError("columns differ in length: " + ", ".join(f"{k} {len(c)}" for k, c in data.items()))
        schema = {k: Field((dtypes or {}).get(k) or inferred(c)) for k, c in data.items()}
        for name, tz in (tzs or {}).items():
            if name not in schema or schema[name].dtype != "timestamp":
                raise FrameError(f"a time zone needs a timestamp column, got {name!r}")
            _zone(tz)
            schema[name] = Field("timestamp", tz)
        cells = [[_cell(v, schema[k]) for v in c] for k, c in data.items()]
        n = len(cells[0]) if cells else 0
        kind = T.StructType([*(T.StructField(k, SPARK[f.dtype]) for k, f in schema.items()), T.StructField(RID, T.LongType())])
        rows = list(zip(*cells, range(n), strict=True)) if cells else []
        return cls(session(spark).createDataFrame(rows, kind), schema, [(RID, False)])

    @classmethod
    def from_records(cls, records: Sequence[dict], **options) -> Frame:
        """The union of all keys in the order of their first appearance; missing cells are null."""
        names = list(dict.fromkeys(k for r in records for k in r))
        return cls.from_columns({k: [r.get(k) for r in records] for k in names}, **options)

    # --- metadata ---

    @property
    def spark(self) -> SparkSession:
        return self._df.sparkSession

    @property
    def columns(self) -> list[str]:
        return list(self._schema)

    @property
    def dtypes(self) -> dict[str, str]:
        return {k: f.dtype for k, f in self._schema.items()}

    def dtype_of(self, name: str) -> str:
        self._check([name])
        return self._schema[name].dtype

    @property
    def length(self) -> int:
        return self._df.count()

    __len__ = length.fget

    @property
    def shape(self) -> tuple[int, int]:
        return self.length, len(self._schema)

    def type_of(self, e: Expr) -> str:
        """The type of an expression over this frame; an ExprError tells why it has none."""
        return Lowering(self._schema, F.lit(0)).lower(e).dtype

    def _check(self, names: Iterable[str]) -> None:
        for n in names:
            if n not in self._schema:
                raise FrameError(unknown(n, self._schema))

    # --- order ---

    def _hidden(self) -> list[str]:
        return [c for c in self._df.columns if c.startswith(HIDDEN)]

    def _ordered(self) -> Frame:
        """With order columns in place."""
        return self if self._order is not None else Frame(self._df.withColumn(RID, F.monotonically_increasing_id()), self._schema, [(RID, False)])

    def _keys(self, reverse: bool = False) -> list[Column]:
        if not reverse:
            return [q(c).desc_nulls_last() if d else q(c).asc_nulls_last() for c, d in self._order]
        return [q(c).asc_nulls_first() if d else q(c).desc_nulls_first() for c, d in self._order]

    def _placed(self) -> tuple[Frame, Column]:
        """A column that grows with the rows' order. Only a descending order needs a range sort for it."""
        f = self._ordered()
        if any(down for _, down in f._order):
            f = f._numbered()
        if len(f._order) == 1:
            return f, q(f._order[0][0])
        return f, F.struct(*[x for i, (c, _) in enumerate(f._order) for x in (q(c).isNull().alias(f"n{i}"), q(c).alias(f"v{i}"))])

    def _numbered(self) -> Frame:
        """With one ascending column that orders the rows; a range sort where the order is a composed one."""
        f = self._ordered()
        if len(f._order) == 1 and not f._order[0][1]:
            return f
        df = f._df.orderBy(*f._keys()).drop(*f._hidden()).withColumn(RID, F.monotonically_increasing_id())
        return Frame(df, f._schema, [(RID, False)])

    def _positions(self) -> DataFrame:
        """With the row's position: rows are range-sorted and stored once, and only partition sizes reach the driver."""
        spark = self.spark
        shared_dir(spark)
        part = F.shiftright("__sg_at", 33)
        df = self._df.orderBy(*self._keys()).withColumn("__sg_at", F.monotonically_increasing_id()).checkpoint()
        first, at = [], 0
        for p, n in sorted(df.groupBy(part.alias("p")).count().collect()):
            first.append((p, at))
            at += n
        starts = F.broadcast(spark.createDataFrame(first, "__sg_part long, __sg_first long"))
        inside = F.col("__sg_at").bitwiseAND(F.lit((1 << 33) - 1))
        return df.join(starts, part == F.col("__sg_part")).withColumn("__sg_pos", F.col("__sg_first") + inside).drop("__sg_at", "__sg_part", "__sg_first")

    # --- projection ---

    def select(self, *names) -> Frame:
        names = _names(names)
        self._check(names)
        if len(set(names)) < len(names):
            raise FrameError("a column is selected twice")
        return self._with(self._df.select(*map(q, names), *self._hidden()), {n: self._schema[n] for n in names})

    def drop(self, *names) -> Frame:
        names = _names(names)
        self._check(names)
        return self.select([n for n in self._schema if n not in names])

    def _with(self, df: DataFrame, schema: dict[str, Field]) -> Frame:
        return Frame(df, schema, self._order)

    def _lowered(self, e: Expr, use: Callable[[Lowering], Column | tuple]) -> tuple[Frame, object]:
        """Lower with aggregates over this frame put in as scalar subqueries."""
        needs = _orders(e)
        frame, place = self._placed() if needs else (self, None)
        low = Lowering(frame._schema, place)
        out = use(low)
        if low.aggregates:
            one = frame._df.agg(*[c.alias(k) for k, c in low.aggregates.items()])
            frame = Frame(frame._df.withColumns({k: one.select(k).scalar() for k in low.aggregates}), frame._schema, frame._order)
        return frame, out

    def with_column(self, name: str, value, dtype: str | None = None) -> Frame:
        """Set a column to an expression, to a Series, or to a list with a cell for each row. A replaced column keeps its place.

        A Series of this frame is computed where the rows are; one of another frame is matched by position. Neither passes the driver.
        """
        if name.startswith(HIDDEN):
            raise FrameError("column names must not start with " + HIDDEN)
        if isinstance(value, Expr):
            frame, x = self._lowered(value, lambda low: low.lower(value))
            if dtype and dtype != x.dtype:
                raise FrameError(f"the expression is {x.dtype}, not {dtype}")
            df = frame._df.withColumn(name, x.column).drop(*[c for c in frame._df.columns if c.startswith("__sg_agg")])
            return Frame(df, frame._schema | {name: Field(x.dtype, x.tz)}, frame._order)
        if isinstance(value, Series):
            base, e = value.source
            return self.with_column(name, e, dtype) if base is self else self._beside(name, value, dtype)
        cells = list(value)
        frame = self._numbered()
        if len(cells) != frame._df.count():
            raise FrameError(f"a list of {len(cells)} cells does not fit the frame")
        field = Field(dtype or inferred([_plain(v) for v in cells]))
        spark = self._df.sparkSession
        placed = frame._positions()
        extra = spark.createDataFrame([(i, _cell(_plain(v), field)) for i, v in enumerate(cells)], T.StructType([T.StructField("__sg_pos", T.LongType()), T.StructField("__sg_new", SPARK[field.dtype])]))
        df = placed.join(extra, "__sg_pos").withColumn(name, F.col("__sg_new")).drop("__sg_new", "__sg_pos")
        return Frame(df, frame._schema | {name: field}, frame._order)

    assign = with_column

    def _beside(self, name: str, series: Series, dtype: str | None) -> Frame:
        """With the cells of another frame's series, which stand in its order."""
        field = series.frame._schema[series.name]
        if dtype and dtype != field.dtype:
            raise FrameError(f"the series is {field.dtype}, not {dtype}")
        frame, other = self._ordered(), series.frame._ordered()
        placed, cells = frame._positions(), other._positions().select("__sg_pos", q(series.name).alias("__sg_new"))
        n, m = placed.count(), cells.count()
        if n != m:
            raise FrameError(f"a series of {m} cells does not fit the frame")
        df = placed.join(cells, "__sg_pos").withColumn(name, F.col("__sg_new")).drop("__sg_new", "__sg_pos")
        return Frame(df, frame._schema | {name: field}, frame._order)

    def with_zone(self, name: str, tz: str | None) -> Frame:
        """The same instants of a timestamp column, whose calendar fields are those of zone `tz`."""
        if self.dtype_of(name) != "timestamp":
            raise FrameError(f"a time zone needs a timestamp column, got {name!r}")
        if tz:
            _zone(tz)
        return self._with(self._df, self._schema | {name: Field("timestamp", tz)})

    # --- rows ---

    def filter(self, predicate: Expr) -> Frame:
        frame, c = self._lowered(predicate, lambda low: low.predicate(predicate))
        df = frame._df.where(c)
        return Frame(df.drop(*[x for x in df.columns if x.startswith("__sg_agg")]), frame._schema, frame._order)

    def filter_fn(self, keep: Callable[[dict], bool]) -> Frame:
        """Rows for which a Python function of the row (a dict) is true; batches of rows pass through Arrow."""
        frame, names = self._ordered(), self.columns
        kind = frame._df.schema

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                rows = batch.select(names).to_pylist()
                yield batch.filter(pa.array([bool(keep(r)) for r in rows], pa.bool_()))

        return Frame(frame._df.mapInArrow(run, kind), frame._schema, frame._order)

    def map_fn(self, function: Callable[[dict], object]) -> list:
        """A Python function of each row (a dict), in order, as a list on the driver."""
        return [function(r) for r in self.iter_records()]

    def map_column(self, name: str, function: Callable[[dict], object], dtype: str) -> Frame:
        """Like `map_fn`, but the results become a column and never leave the executors."""
        frame, names = self._ordered(), self.columns
        field = Field(dtype)
        kind = T.StructType([f for f in frame._df.schema.fields if f.name != name] + [T.StructField(name, SPARK[dtype])])

        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            for batch in batches:
                made = pa.array([_cell(function(r), field) for r in batch.select(names).to_pylist()], to_arrow_type(SPARK[dtype]))
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kind.fields[:-1]), made], kind.names)

        df = frame._df.mapInArrow(run, kind)
        return Frame(df, {k: v for k, v in frame._schema.items() if k != name} | {name: field}, frame._order)

    def sort_values(self, by, descending=False) -> Frame:
        """Stable; nulls last either way, NaN above all numbers, strings by their UTF-16 code units."""
        keys = _names([by])
        self._check(keys)
        if not keys:
            return self
        down = [descending] * len(keys) if isinstance(descending, bool) else list(descending)
        if len(down) != len(keys):
            raise FrameError(f"{len(keys)} keys but {len(down)} directions")
        n = sum(c.startswith("__sg_o") for c in self._df.columns)
        old = self._order or ([] if self._order is None else self._order)
        base = self if self._order is not None else self._ordered()
        df = base._df.withColumns({f"__sg_o{n + i}": utf16_key(q(k)) if self._schema[k].dtype == "utf8" else q(k) for i, k in enumerate(keys)})
        return Frame(df, self._schema, Asked([*((f"__sg_o{n + i}", d) for i, d in enumerate(down)), *(old or base._order)]))

    def argsort(self, by, descending=False) -> Frame:
        """One column `position`: where the rows of the sorted frame stand in this one."""
        if "position" in self._schema:
            raise FrameError("the frame has a column 'position' already")
        f = self._numbered()
        placed = f._positions().withColumnRenamed("__sg_pos", "position")
        return Frame(placed, f._schema | {"position": Field("i64")}, f._order).sort_values(by, descending).select("position")

    def with_position(self, name: str) -> Frame:
        """With each row's position, from 0, as an i64 column."""
        if name in self._schema:
            raise FrameError(f"the frame has a column {name!r} already")
        f = self._ordered()
        return Frame(f._positions().withColumnRenamed("__sg_pos", name), f._schema | {name: Field("i64")}, f._order)

    def head(self, n: int = 5) -> Frame:
        return self.slice(0, max(0, n))

    def tail(self, n: int = 5) -> Frame:
        f, n = self._ordered(), max(0, n)
        if n <= MOST_TAKEN:
            return Frame(f._df.orderBy(*f._keys(reverse=True)).limit(n), f._schema, f._order)
        return self.slice(max(0, self.length - n))

    def slice(self, start: int, end: int | None = None) -> Frame:
        """Rows start to end by position, clamped; a negative start counts as 0."""
        f, start = self._ordered(), max(0, start)
        if end is not None and end <= MOST_TAKEN:
            df = f._df.orderBy(*f._keys()).limit(max(0, end))
            return Frame(df.offset(start) if start else df, f._schema, f._order)
        place = F.col("__sg_pos")
        kept = f._positions().where(place >= start if end is None else (place >= start) & (place < end))
        return Frame(kept.drop("__sg_pos"), f._schema, f._order)

    def top_k(self, by: str, k: int, largest: bool = True) -> Frame:
        """The k rows of largest (or smallest) values; nulls take no part, NaN is the largest, ties by position."""
        self._check([by])
        f = Frame(self._df.where(q(by).isNotNull()), self._schema, self._order)
        return f.sort_values(by, largest).head(k)

    def take(self, positions: Sequence[int]) -> Frame:
        """The rows at these positions, in this order."""
        f = self._numbered()
        spark = self._df.sparkSession
        placed = f._positions().drop(f._order[0][0])
        want = spark.createDataFrame([(int(p), i) for i, p in enumerate(positions)], f"__sg_pos long, {RID} long")
        return Frame(placed.join(want, "__sg_pos").drop("__sg_pos"), f._schema, [(RID, False)])

    # --- aggregation ---

    def groupby(self, *keys) -> GroupBy:
        keys = _names(keys)
        self._check(keys)
        if not keys:
            raise FrameError("groupby needs a key")
        return GroupBy(self, keys)

    def distinct(self, *keys) -> Frame:
        """Distinct key tuples in the order of their first row."""
        return self.groupby(*(keys or self.columns)).agg({})

    def agg(self, spec: dict, wide: bool = False) -> Frame:
        """Aggregates over the whole frame: one row."""
        return GroupBy(self, []).agg(spec, wide)

    def describe(self) -> Frame:
        """count, mean, std, min, quartiles and max of the finite values of each numeric column."""
        names = [k for k, f in self._schema.items() if f.dtype in NUMERIC]
        stats = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]

        def finite(n: str) -> Column:
            c = q(n).cast("double")
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)

        shares, merged = (0.25, 0.5, 0.75), self._df.count() <= MOST_MERGED
        found = {} if merged else self._quantiles({n: finite(n) for n in names}, shares)
        aggs = []
        for n in names:
            c = finite(n)
            if merged:
                quartiles = F.percentile(c, F.array(*map(F.lit, shares)))
                three = [quartiles[i] for i in range(3)]
            else:
                three = [F.lit(v).cast("double") for v in found[n]]
            aggs.append(F.array(F.count(c).cast("double"), F.avg(c), F.stddev_samp(c), F.min(c), *three, F.max(c)).alias(n))
        place = F.array(*map(F.lit, stats))
        one = self._df.agg(*aggs) if aggs else self._df.sparkSession.range(1)
        rows = one.select("*", F.posexplode(place).alias(RID, "__sg_stat")).select(F.col("__sg_stat").alias("statistic"), *[F.get(q(n), F.col(RID)).alias(n) for n in names], F.col(RID).cast("long").alias(RID))
        return Frame(rows, {"statistic": Field("utf8")} | {n: Field("f64") for n in names}, [(RID, False)])

    def _quantiles(self, columns: dict[str, Column], shares: Sequence[float]) -> dict[str, list[float | None]]:
        """Exact quantiles: distinct values are counted, range-sorted and stored; partition sums, one row each, tell where the ranks lie."""
        shared_dir(self.spark)
        names, part = list(columns), F.shiftright("at", 33)
        cells = F.array(*[F.struct(F.lit(i).alias("c"), c.alias("v")) for i, c in enumerate(columns.values())])
        each = self._df.select(F.explode(cells).alias("x")).select("x.*").where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        each = each.orderBy("c", "v").withColumn("at", F.monotonically_increasing_id()).checkpoint()
        sums = sorted(tuple(r) for r in each.groupBy("c", part.alias("p")).agg(F.sum("n")).collect())
        totals = {i: sum(n for c, _, n in sums if c == i) for i in range(len(names))}
        ranks = {i: sorted({r for s in shares for x in [s * (t - 1)] for r in (math.floor(x), math.ceil(x))}) for i, t in totals.items() if t}
        wanted, first = [], {}
        for c, p, n in sums:
            low = first.get(c, 0)
            first[c] = low + n
            wanted += [(c, p, low, r) for r in ranks[c] if low <= r < low + n]
        places = F.broadcast(self.spark.createDataFrame(wanted, "c int, p long, low long, r long"))
        running = F.sum("n").over(Window.partitionBy("c", "p", "r").orderBy("at"))
        held = each.withColumn("p", part).join(places, ["c", "p"]).withColumn("upto", F.col("low") + running)
        values = {(r["c"], r["r"]): r["v"] for r in held.where("r < upto and r >= upto - n").select("c", "r", "v").collect()}

        def at(i: int, x: float) -> float:
            low, high = math.floor(x), math.ceil(x)
            return values[i, low] if low == high else (high - x) * values[i, low] + (x - low) * values[i, high]

        return {n: [at(i, s * (totals[i] - 1)) if totals[i] else None for s in shares] for i, n in enumerate(names)}

    # --- join ---

    def join(self, other: Frame, on, how: str = "inner") -> Frame:
        """Equi-join; null keys never match, NaN does. Rows by the left's order, then the right's."""
        keys = _names([on])
        if how not in ("inner", "left"):
            raise FrameError(f"how must be inner or left, got {how!r}")
        if not keys:
            raise FrameError("a join needs a key")
        self._check(keys)
        other._check(keys)
        for k in keys:
            a, b = self._schema[k].dtype, other._schema[k].dtype
            if a != b:
                raise FrameError(f"join key {k!r} is {a} on the left and {b} on the right; cast one of them")
        names = {n: n if n not in self._schema else f"{n}_right" for n in other._schema if n not in keys}
        if clash := [v for n, v in names.items() if v != n and (v in self._schema or v in other._schema)]:
            raise FrameError(f"the joined frame would have two columns {clash[0]!r}")
        left, right = self._ordered(), other._ordered()
        lo = {c: f"__sg_l{i}" for i, (c, _) in enumerate(left._order)}
        ro = {c: f"__sg_r{i}" for i, (c, _) in enumerate(right._order)}
        l = left._df.select(*map(q, self._schema), *[q(c).alias(n) for c, n in lo.items()])
        r = right._df.select(*[q(k).alias(f"__sg_k{i}") for i, k in enumerate(keys)], *[q(n).alias(v) for n, v in names.items()], *[q(c).alias(n) for c, n in ro.items()])
        match = [q(k) == F.col(f"__sg_k{i}") for i, k in enumerate(keys)]
        df = l.join(r, match, how).drop(*[f"__sg_k{i}" for i in range(len(keys))])
        df = df.withColumnsRenamed({n: f"__sg_o{i}" for i, n in enumerate([*lo.values(), *ro.values()])})
        order = type(left._order)((f"__sg_o{i}", d) for i, (_, d) in enumerate([*left._order, *right._order]))
        return Frame(df, self._schema | {v: other._schema[n] for n, v in names.items()}, order)

    # --- output ---

    def to_spark(self, ordered: bool = True) -> DataFrame:
        """A Spark DataFrame without hidden columns; types that Spark does not tell apart are in the metadata."""
        df = self._df.orderBy(*self._keys()) if ordered and self._order else self._df
        return df.select(*[q(n).alias(n, metadata=f.metadata()) if f.tz or f.dtype == "u32" else q(n) for n, f in self._schema.items()])

    def iter_records(self) -> Iterator[dict]:
        for row in self.to_spark().toLocalIterator(prefetchPartitions=True):
            yield {n: _out(row[n], f) for n, f in self._schema.items()}

    def to_records(self) -> list[dict]:
        return [{n: _out(row[n], f) for n, f in self._schema.items()} for row in self.to_spark().collect()]

    def to_columns(self) -> dict[str, list]:
        rows = self.to_records()
        return {n: [r[n] for r in rows] for n in self._schema}

    def to_json(self) -> str:
        """A JSON array of records; NaN and infinities are null, dates are days and timestamps milliseconds."""
        def plain(v):
            return None if isinstance(v, float) and not math.isfinite(v) else _number(v)

        return json.dumps([{k: plain(v) for k, v in r.items()} for r in self.to_records()], ensure_ascii=False, separators=(",", ":"))

    def to_arrow(self) -> bytes:
        from ..sources.write import arrow_bytes

        return arrow_bytes(self)

    def to_arrow_streams(self, encode: Callable | None = None) -> DataFrame:
        """`to_arrow` in parts that stay on the executors: see `sources.write.arrow_streams`."""
        from ..sources.write import arrow_streams

        return arrow_streams(self, encode)

    def write_parquet(self, path: str, compression: str = "uncompressed") -> None:
        from ..sources.write import write_parquet

        write_parquet(self, path, compression)

    def to_write(self) -> DataFrame:
        """For writers: sorted where a sort was asked for; else rows are written where they are, without a shuffle."""
        return self.to_spark(ordered=isinstance(self._order, Asked))

    def write_json(self, path: str) -> None:
        self.to_write().write.option("ignoreNullFields", "false").json(path)

    def write_csv(self, path: str, header: bool = True) -> None:
        self.to_write().write.option("header", header).csv(path)

    def col(self, name: str) -> Series:
        self._check([name])
        return Series(self, name)

    def to_string(self) -> str:
        """Names, types, the first and last five rows, and the size."""
        n, fields = self.length, self._schema.values()
        rows = self.to_records() if n <= 10 else self.head(5).to_records() + [None] + self.tail(5).to_records()
        body = [["…"] * len(fields) if r is None else [shown(v, f.dtype) for v, f in zip(r.values(), fields, strict=True)] for r in rows]
        return table_of(self.columns, [f.dtype for f in fields], body) + f"\n[{n} rows × {len(fields)} columns]"

    def compile(self, e: Expr):
        """The checked expression, ready to run: see `plans.compile`."""
        from ..plans.compile import compile_expr

        return compile_expr(e, self)

    def compile_filter(self, e: Expr):
        from ..plans.compile import compile_filter

        return compile_filter(e, self)

    def __repr__(self) -> str:
        return "Frame[" + ", ".join(f"{n}: {f.dtype}" for n, f in self._schema.items()) + "]"

    # --- life ---

    def cache(self) -> Frame:
        return Frame(self._df.persist(), self._schema, self._order)

    def dispose(self) -> None:
        self._df.unpersist()

    def explain(self) -> None:
        self.to_spark().explain("formatted")


class GroupBy:
    def __init__(self, frame: Frame, keys: list[str]):
        self.frame, self.keys = frame, keys

    def agg(self, spec: dict, wide: bool = False) -> Frame:
        """{column: how}, {column: [how, ...]} or {name: expression that ends in an aggregate}.

        Keys come first, then results; groups stand in the order of their first rows. `size` as how counts rows.
        Counts are i32 and wrap beyond it, as all i32 do; with `wide` they are i64.
        """
        frame, keys = self.frame, self.keys
        plans: list[tuple[str, Expr | None]] = []
        for name, how in spec.items():
            if isinstance(how, Expr):
                if how.kind != "agg":
                    raise FrameError(f"{name}: the expression does not end in an aggregate")
                plans.append((name, how))
                continue
            many = not isinstance(how, str)
            for h in how if many else [how]:
                if h != "size" and h not in AGGREGATES:
                    raise FrameError(f"unknown aggregate {h!r}")
                if h != "size":
                    frame._check([name])
                plans.append((f"{name}_{h}" if many else name, None if h == "size" else Expr("agg", h, (Expr("col", name),))))
        names = keys + [n for n, _ in plans]
        if len(set(names)) < len(names):
            raise FrameError("two results have the same name")
        needs = any(e is not None and _orders(e) for _, e in plans)
        frame, rid = frame._placed() if needs or keys else (frame, None)
        low = Lowering(frame._schema, rid, wide)
        columns, schema = [], {k: frame._schema[k] for k in keys}
        for name, e in plans:
            c, field = counted(F.count(F.lit(1)), wide) if e is None else low.aggregate(e)
            columns.append(c.alias(name))
            schema[name] = field
        if not keys:
            return Frame(frame._df.agg(*columns) if columns else frame._df.sparkSession.range(0).select(), schema, [])
        return Frame(frame._df.groupBy(*map(q, keys)).agg(F.min(rid).alias(RID), *columns), schema, [(RID, False)])


class Series:
    """One column of a frame; lists of its cells are made on the driver, `with_column` takes it as it is."""

    def __init__(self, frame: Frame, name: str, source: tuple[Frame, Expr] | None = None):
        """`source`: the frame and the expression over it that gives these cells."""
        self.frame, self.name = frame.select(name), name
        self.source = source or (frame, Expr("col", name))

    @property
    def dtype(self) -> str:
        return self.frame.dtype_of(self.name)

    def to_list(self) -> list:
        return self.frame.to_columns()[self.name]

    values = to_list

    def __iter__(self) -> Iterator:
        return (r[self.name] for r in self.frame.iter_records())

    def get(self, i: int):
        """The cell at a position; null out of range."""
        found = self.frame.slice(i, i + 1).to_records() if i >= 0 else []
        return found[0][self.name] if found else None

    def _apply(self, make: Callable[[Expr], Expr]) -> Series:
        frame, e = self.source
        return Series(self.frame.with_column(self.name, make(Expr("col", self.name))), self.name, (frame, make(e)))

    @property
    def dt(self) -> _SeriesFields:
        return _SeriesFields(self)

    @property
    def str(self) -> _SeriesStrings:
        return _SeriesStrings(self)


class _SeriesFields:
    def __init__(self, of: Series):
        self.of = of

    def __getattr__(self, name: str):
        from ..functions.expr import FIELDS

        if name not in FIELDS:
            raise AttributeError(name)
        if self.of.dtype == "date32" and name in ("hour", "minute", "second", "millisecond"):
            raise TypeError(f"a date32 has no {name}")
        return lambda: self.of._apply(lambda e: getattr(e.dt, name)())


class _SeriesStrings:
    def __init__(self, of: Series):
        self.of = of

    def slice(self, start: int, end: int | None = None) -> Series:
        return self.of._apply(lambda e: e.str.slice(start, end))


@contextlib.contextmanager
def scope():
    """Yields `track`; cached frames passed to it are released at the end."""
    held: list[Frame] = []

    def track(frame: Frame) -> Frame:
        held.append(frame.cache())
        return held[-1]

    try:
        yield track
    finally:
        for f in held:
            f.dispose()


# --- cells ---

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def _plain(v):
    return v.item() if type(v).__module__ == "numpy" else v


def inferred(cells: list) -> str:
    first = next((v for v in cells if v is not None), None)
    if isinstance(first, bool):
        return "bool"
    for kind, name in (((int, float), "f64"), (str, "utf8"), (dt.datetime, "timestamp"), (dt.date, "date32")):
        if isinstance(first, kind):
            return name
    if first is not None:
        raise FrameError(f"no dtype for {first!r}")
    return "f64"


def _cell(v, f: Field):
    if v is None:
        return None
    if f.dtype in RANGES:
        if isinstance(v, float) and not v.is_integer():
            raise FrameError(f"{v!r} is no {f.dtype}")
        v = int(v)
        if not RANGES[f.dtype][0] <= v <= RANGES[f.dtype][1]:
            raise FrameError(f"{v!r} is out of range for {f.dtype}")
        return v
    if f.dtype in ("f64", "f32"):
        return float(v)
    if f.dtype == "date32":
        return dt.date(1970, 1, 1) + dt.timedelta(days=v) if isinstance(v, int) else v
    if f.dtype == "timestamp":
        v = _EPOCH + dt.timedelta(milliseconds=v) if isinstance(v, (int, float)) else v
        return v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
    if not isinstance(v, {"bool": bool, "utf8": str}.get(f.dtype, object)):
        raise FrameError(f"{v!r} is no {f.dtype}")
    return v


def _out(v, f: Field):
    """Cells as Python has them; timestamps are instants in UTC."""
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=dt.timezone.utc) if v.tzinfo is None and _local_is_utc() else v.astimezone(dt.timezone.utc)
    return v


def _local_is_utc() -> bool:
    import time

    return time.timezone == 0 and not time.daylight


def _number(v):
    if isinstance(v, dt.datetime):
        return (v - _EPOCH) // dt.timedelta(milliseconds=1)
    return (v - dt.date(1970, 1, 1)).days if isinstance(v, dt.date) else v


def _names(x) -> list[str]:
    out: list[str] = []
    for n in x:
        out += [n] if isinstance(n, str) else _names(n)
    return out


def _orders(e: Expr) -> bool:
    return e.kind == "agg" and e.value in ("first", "last") or any(map(_orders, e.args))


def _zone(tz: str) -> None:
    import zoneinfo

    try:
        zoneinfo.ZoneInfo(tz)
    except (KeyError, ValueError, OSError) as e:
        raise FrameError(f"unknown time zone {tz!r}") from e
