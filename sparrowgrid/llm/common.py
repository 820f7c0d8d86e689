"""What the training-data operators share: shared storage, batch bounds, column handling."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bound_batches, shared_dir  # noqa: F401

def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparrowgrid/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """`df` as a table in the shared folder: its lineage is cut, and a lost executor loses nothing."""
    at = new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_HELD: dict = {}


def held(tag, make: Callable):
    """What this worker process keeps from task to task: one object, that of the last tag."""
    if tag not in _HELD:
        _HELD.clear()
        _HELD[tag] = make()
    return _HELD[tag]


def chunks(values: list, size_of, most: int) -> Iterator[tuple[int, int]]:
    """Cut a list into runs of at most `most` in total size, one element at least."""
    at = total = 0
    for i, v in enumerate(values):
        n = size_of(v)
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(values):
        yield at, len(values)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition that is sorted by its first column, group by group."""
    now, rows = None, []
    for batch in batches:
        name = batch.schema.names[0]
        for row in batch.to_pylist():
            if row[name] != now and rows:
                yield now, rows
                rows = []
            now = row[name]
            rows.append(row)
    if rows:
        yield now, rows


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, which all machines see at that place; None for another store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else os.path.abspath(uri)


def make_folder(uri: str) -> None:
    if path := local_path(uri):
        os.makedirs(path, exist_ok=True)
    else:
        store, path = pa.fs.FileSystem.from_uri(uri)
        store.create_dir(path)


def write_file(uri: str, parts: Iterable[bytes]) -> None:
    """A file of the shared folder that appears whole or not at all, also if a task runs twice."""
    path = local_path(uri)
    store, path = (pa.fs.LocalFileSystem(), path) if path else pa.fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as f:
        for p in parts:
            f.write(p)
    store.move(part, path)


def mapped(uri: str) -> np.ndarray | None:
    """The bytes of a file: mapped into memory where the folder is mounted, else fetched as a whole; None if there is none."""
    try:
        if path := local_path(uri):
            return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        store, path = pa.fs.FileSystem.from_uri(uri)
        with store.open_input_stream(path, compression=None) as f:
            return np.frombuffer(f.read(), np.uint8)
    except FileNotFoundError:
        return None


class Opened:
    """What `open_` makes of each key, the last `most` of them kept: the others are closed."""

    def __init__(self, open_: Callable, most: int):
        self.open, self.most, self.kept = open_, most, OrderedDict()

    def __getitem__(self, key):
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            self.kept[key] = self.open(key)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return self.kept[key]
