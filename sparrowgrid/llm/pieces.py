"""The distinct pieces of a corpus, encoded once each.

Texts are cut into pieces, which are numbered in tables of bounded size, one after the other in each task;
what is stored of the texts are the numbers. The pieces of all tables are dealt into shards by hash, where
equal ones meet, and each shard is encoded as a whole. The ids go back to the tables they came from: one file for
each table in the shared folder, read when its texts are. So every piece is encoded once in the corpus (in one
shard), nothing is looked up at random, and what is shuffled are a table's distinct pieces and their ids.

Defined results: a null text counts as empty and has no ids; each row is encoded by itself, so repeated rows and keys,
null keys and ties give rows alike; texts of any length are cut and encoded whole; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, islice, pairwise
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .eliasfano import read_arrays, write_arrays


class Encoder(Protocol):
    def pieces(self, text: str) -> list[str]:
        """The pieces whose ids, one after the other, are those of the text."""

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and each one's number of ids."""


@dataclass(frozen=True)
class Sizes:
    """Bounds of what a task holds; none changes a result."""

    table: int = 1_000_000  #: pieces of a table, beyond which a new one is begun
    chunk: int = 2_000_000  #: characters of text in a stored row
    shard: int = 8 << 20  #: bytes of pieces in a shard, those of several tables counted several times


class Known(dict):
    """Pieces by number; a new piece gets the next one."""

    def __missing__(self, piece):
        number = self[piece] = len(self)
        return number


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of `pool` one after the other, and where each ends."""
    ends = np.cumsum(lengths)
    return pool[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


def packed(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers plane by plane of their bytes, which the codecs of files and shuffles pack well."""
    return np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


_CODEC = pa.Codec("zstd")


def squeezed(data: bytes) -> bytes:
    """For blobs that a shuffle's own codec packs less well."""
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def released(data: bytes) -> bytes:
    return _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def binary(*values: bytes) -> pa.Array:
    return pa.array(values, pa.binary())


def bytes_of(blob: bytes, lengths: np.ndarray) -> list[bytes]:
    return [blob[a:b] for a, b in pairwise([0, *np.cumsum(lengths, dtype=np.int64).tolist()])]


def cut(docs: DataFrame, encoder: Callable[[], Encoder], sizes: Sizes, *, key: str, text: str) -> DataFrame:
    """Stored rows of many texts: table, keys, pieces of each text, their numbers in the table, and the pieces that are new in it."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, cutter = TaskContext.get().partitionId() << 24, Known(), encoder()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in common.chunks(texts, len, sizes.chunk):
                if len(known) > sizes.table:
                    table, known = table + 1, Known()
                first, per_text = len(known), [cutter.pieces(t) for t in texts[a:b]]
                lengths = np.fromiter(map(len, per_text), np.int64, b - a)
                flat = np.fromiter(map(known.__getitem__, chain.from_iterable(per_text)), np.int64, int(lengths.sum()))
                new = [p.encode() for p in islice(known, first, None)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([table], pa.int64()), pa.array([first], pa.int64()), pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0)[a:b]), binary(packed(lengths)), binary(packed(flat)),
                    binary(packed([len(p) for p in new])), binary(b"".join(new)),
                ], ["table", "first", "keys", "lengths", "flat", "sizes", "pieces"])

    schema = f"table long, first long, keys array<{dict(docs.dtypes)[key]}>, lengths binary, flat binary, sizes binary, pieces binary"
    return common.stored(docs.select(key, common.text_or_empty(text).alias("text")).mapInArrow(run, schema), "pieces-cut", "zstd")


def encoded_tables(rows: DataFrame, encoder: Callable[[], Encoder], sizes: Sizes) -> str:
    """Encode the pieces of all tables of `cut`; the folder with a file of ids for each table."""
    spark = rows.sparkSession
    total = rows.agg(F.coalesce(F.sum(F.length("pieces") + F.length("sizes")), F.lit(0)).alias("n")).first()["n"]
    shards = max(8, -(-total // sizes.shard))
    common.make_folder(folder := common.new_folder(spark, "pieces-ids"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lengths = unpacked(batch.column(2)[i].as_py())
                pieces = bytes_of(batch.column(3)[i].as_py(), lengths)
                if not pieces:
                    continue
                shard = (np.fromiter(map(xxh64_intdigest, pieces), np.uint64, len(pieces)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                names, cuts = np.unique(shard[order], return_index=True)
                first = batch.column(1)[i].as_py()
                parts = [order[a:b] for a, b in pairwise([*cuts.tolist(), len(order)])]
                yield pa.RecordBatch.from_arrays([
                    pa.array(names), pa.array([batch.column(0)[i].as_py()] * len(names), pa.int64()), binary(*(squeezed(packed(np.diff(first + p, prepend=0))) for p in parts)),
                    binary(*(squeezed(packed(lengths[p])) for p in parts)), binary(*(squeezed(b"".join(map(pieces.__getitem__, p.tolist()))) for p in parts)),
                ], ["shard", "table", "numbers", "sizes", "pieces"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        for _, group in common.grouped(batches):
            known = Known()
            places = []
            for r in group:
                lengths = unpacked(released(r.pop("sizes")))
                places.append(np.fromiter(map(known.__getitem__, bytes_of(released(r.pop("pieces")), lengths)), np.int64, len(lengths)))
            ids, counts = coder.learn([p.decode() for p in known])
            starts = np.cumsum(counts) - counts
            for r, at in zip(group, places, strict=True):
                own, _ = gathered(ids, starts[at], counts[at])
                yield pa.RecordBatch.from_arrays([pa.array([r["table"]], pa.int64()), binary(r["numbers"]), binary(squeezed(packed(counts[at]))), binary(squeezed(packed(own)))], ["table", "numbers", "counts", "ids"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in common.grouped(batches):
            numbers = np.concatenate([np.cumsum(unpacked(released(r["numbers"]))) for r in group])
            counts, ids = (np.concatenate([unpacked(released(r[x])) for r in group]) for x in ("counts", "ids"))
            order, starts = np.argsort(numbers), np.cumsum(counts, dtype=np.int64) - counts
            pool, _ = gathered(ids, starts[order], counts[order].astype(np.int64))
            write_arrays(f"{folder}/{table}", {k: np.frombuffer(squeezed(packed(v)), np.uint8) for k, v in (("ids", pool), ("counts", counts[order]))}, {})
            yield pa.RecordBatch.from_arrays([pa.array([table], pa.int64())], ["table"])

    dealt = rows.select("table", "first", "sizes", "pieces").mapInArrow(deal, "shard long, table long, numbers binary, sizes binary, pieces binary")
    back = dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(encode, "table long, numbers binary, counts binary, ids binary")
    common.stored(back.repartition("table").sortWithinPartitions("table").mapInArrow(assemble, "table long"), "pieces-tables")
    return folder


def encode_corpus(docs: DataFrame, encoder: Callable[[], Encoder], sizes: Sizes = Sizes(), *, key: str, text: str) -> tuple[DataFrame, Callable]:
    """(stored rows, read): `read` makes (keys, ids of all their texts, where each text's end) of the batches of rows."""
    rows = cut(docs, encoder, sizes, key=key, text=text)
    folder = encoded_tables(rows, encoder, sizes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        def opened(table: int) -> tuple[np.ndarray, np.ndarray] | None:
            if (found := read_arrays(f"{folder}/{table}")) is None:
                return None  # of empty texts
            ids, counts = (unpacked(released(found[0][x].tobytes())) for x in ("ids", "counts"))
            return ids, np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))

        tables = common.Opened(opened, 2)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, flat = (unpacked(batch.column(x)[i].as_py()).astype(np.int64) for x in (2, 3))
                pool, ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)
                if found := tables[batch.column(0)[i].as_py()]:
                    starts = found[1]
                    pool, ends = gathered(found[0], starts[flat], starts[flat + 1] - starts[flat])
                yield batch.column(1)[i].values, pool, np.concatenate(([0], ends))[np.cumsum(lengths)]

    return rows.select("table", "keys", "lengths", "flat"), read
