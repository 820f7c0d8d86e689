"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short test item inside a long document has a tiny Jaccard similarity, so the sketch must grow with the
document. Documents and items are partitioned by size in powers of two. A sketch has one hash function
and m bins (the smallest hash of each bin is kept); m is chosen for the pair of partitions so that an
item of which 80 % lies in the document misses every bin with a probability of at most MISS. Partitions
of items too short for that take every shingle as its own bin. Candidates are then verified by the exact
share of the item's distinct word shingles that the document has.

Items are dealt into blocks of bounded size, each a file of the shared folder that tasks map: nothing about them
passes through the driver, and documents are read once however many blocks there are. An index holds all shingle hashes of its
partition, each with the widest bins of which it is the smallest: so one index serves every number of bins.

Words are maximal runs of other characters than ASCII white space, A-Z in lower case; a text of fewer
words than a shingle is one shingle. Defined results: null and empty texts have no shingles and take part
in no pair; repeated rows give repeated pairs, null keys are keys like any other; texts and items of any length are read whole; empty tables
give no pairs, and `clean` then keeps every row; further columns of the input are ignored by `contained` and kept as they are by `clean`,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .eliasfano import read_arrays, write_arrays

MISS = 1e-9
#: Bytes of item text in a block, on average; blocks that a worker keeps open; items whose shingles it keeps.
ITEM_BYTES, OPEN, KEPT = 8 << 20, 64, 5_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingles(words: list[bytes], size: int) -> set[bytes]:
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def hashes(words: list[bytes], size: int) -> np.ndarray:
    """One 64-bit hash for each shingle, in order, repeats included."""
    each = np.fromiter(map(crc32, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1) if words else 0
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = (out ^ (each[i : i + n] + _ODD[i % 8])) * _ODD[(i + 3) % 8]
        out ^= out >> np.uint64(29)
    return out * _ODD[1]


def bins_per_shingle(q: int, share: float) -> float:
    """Bins for each shingle of a document so that an item of q shingles is missed at most with MISS; 0: take all."""
    matched = math.ceil(share * q)
    need = 1 - MISS ** (1 / matched)  # a matched shingle must be the smallest of its bin this likely
    if need > 0.9:
        return 0
    low, high = 0.01, 20.0  # shingles for each bin; (1 - exp(-x)) / x falls with x
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 - math.exp(-mid)) / mid > need else (low, mid)
    return 1 / low


def sketch(sorted_hashes: np.ndarray, shift: int) -> np.ndarray:
    """The smallest hash of each bin; shift < 0 keeps all. Bins are the top bits of a hash."""
    if shift < 0 or not len(sorted_hashes):
        return sorted_hashes
    bins = sorted_hashes >> np.uint64(shift)
    return sorted_hashes[np.concatenate(([True], bins[1:] != bins[:-1]))]


class Items:
    """A mapped block of test items by size partition."""

    def __init__(self, arrays: dict[str, np.ndarray], facts: dict):
        self.size, self.share, self.blob, self.ends = facts["size"], facts["share"], arrays["text"], arrays["ends"]
        self.keys = pa.ipc.open_stream(pa.py_buffer(arrays["keys"].tobytes())).read_all().column(0)
        # A partition of sizes 2^(k-1) ... 2^k - 1 is searched as its smallest size needs.
        self.classes = [(1 << (k - 1), bins_per_shingle(1 << (k - 1), self.share), *(arrays[f"{x}.{k}"] for x in ("hashes", "who", "low"))) for k in facts["classes"]]
        self.shingles = common.Opened(lambda i: shingles(words_of(self.blob[self.ends[i] : self.ends[i + 1]].tobytes()), self.size), KEPT)

    @staticmethod
    def build(path: str, keys: pa.Array, texts: list[bytes], size: int, share: float) -> None:
        """Write the file of a block; items without words are in none."""
        parts: dict[int, list] = {}
        for i, text in enumerate(texts):
            if words := words_of(text):
                h = np.unique(hashes(words, size))
                # The smallest of its bin is a hash whose bin differs from the one before it.
                low = np.concatenate(([64], np.bitwise_count(smeared(h[1:] ^ h[:-1])) - 1)).astype(np.uint8)
                parts.setdefault(len(shingles(words, size)).bit_length(), []).append((h, np.full(len(h), i, np.uint32), low))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([pa.field("key", keys.type)])) as out:
            out.write_batch(pa.record_batch([keys], ["key"]))
        arrays = {"text": np.frombuffer(b"".join(texts), np.uint8), "ends": np.cumsum([0, *map(len, texts)]), "keys": np.frombuffer(sink.getvalue(), np.uint8)}
        for k, found in parts.items():
            h, who, low = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            arrays |= {f"hashes.{k}": h[order], f"who.{k}": who[order], f"low.{k}": low[order]}
        write_arrays(path, arrays, {"size": size, "share": share, "classes": sorted(parts)})

    def candidates(self, mine: np.ndarray) -> set[int]:
        """Items that share the smallest hash of a bin with sorted hashes, in a partition where they may lie."""
        out: set[int] = set()
        for least, rate, keys, who, low in self.classes:
            if len(mine) < self.share * least:
                continue  # too few shingles to hold such an item
            size_class = 1 << (len(mine) - 1).bit_length()
            shift = min(63, 64 - max(0, math.ceil(math.log2(max(1.0, size_class * rate))))) if rate else -1
            probe = sketch(mine, shift)
            # The shorter side is looked up in the longer one.
            if len(keys) <= len(probe):
                place = np.minimum(np.searchsorted(probe, keys), len(probe) - 1)
                out.update(who[(probe[place] == keys) & (low.astype(np.int64) >= shift)].tolist())
            else:
                a, b = np.searchsorted(keys, probe), np.searchsorted(keys, probe, side="right")
                for i in np.flatnonzero(b > a).tolist():
                    out.update(who[a[i] : b[i]][low[a[i] : b[i]].astype(np.int64) >= shift].tolist())
        return out


def smeared(x: np.ndarray) -> np.ndarray:
    """All bits set below the highest one."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x | x >> np.uint64(k)
    return x


class Search:
    """All blocks of a folder."""

    def __init__(self, folder: str, blocks: int, size: int, share: float):
        self.size, self.share, self.blocks = size, share, range(blocks)
        self.items = common.Opened(lambda b: (found := read_arrays(f"{folder}/items-{b}")) and Items(*found), OPEN)

    def __call__(self, text: bytes) -> Iterator[tuple[object, int, int]]:
        """(key of the item, its shingles that the text has, its shingles) of each item found."""
        words = words_of(text)
        if not words:
            return
        mine, held = np.sort(hashes(words, self.size)), None
        for b in self.blocks:
            if (items := self.items[b]) is None:
                continue
            for i in sorted(items.candidates(mine)):
                held = held or shingles(words, self.size)
                wanted = items.shingles[i]
                shared = len(wanted & held)
                if shared >= self.share * len(wanted):
                    yield items.keys[i].as_py(), shared, len(wanted)


def searcher(items: DataFrame, size: int, share: float, key: str, text: str) -> Callable[[], Search]:
    """Write the blocks; what makes a worker's search of them."""
    spark = items.sparkSession
    common.bound_batches(spark)
    items = items.select(F.col(key).alias("item"), common.text_bytes(text).alias("text")).where(F.length("text") > 0)
    blocks = math.ceil(items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0)).alias("n")).first()["n"] / ITEM_BYTES)
    common.make_folder(folder := common.new_folder(spark, "decontaminate"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, group in common.grouped(batches):
            Items.build(f"{folder}/items-{block}", pa.array([r["item"] for r in group], key_type), [r["text"] for r in group], size, share)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], ["block"])

    key_type = to_arrow_type(items.schema["item"].dataType)
    if blocks:
        dealt = items.select(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).alias("block"), "item", "text")
        common.stored(dealt.repartition("block").sortWithinPartitions("block", "item", "text").mapInArrow(build, "block long"), "decontaminate-blocks")
    return lambda: common.held(folder, lambda: Search(folder, blocks, size, share))


def contained(docs: DataFrame, items: DataFrame, *, shingle: int = 5, share: float = 0.8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item of whose distinct shingles the document has at least `share`."""
    search = searcher(items, shingle, share, item_key, item_text)
    item_type = to_arrow_type(items.schema[item_key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = search()
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for x in find(t):
                    rows.append(i)
                    found.append(x)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array([x[0] for x in found], item_type), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()),
                pa.array([x[1] / x[2] for x in found], pa.float64()),
            ], [key, item_key, "n_shared", "n_shingles", "containment"])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, `{item_key}` {dict(items.dtypes)[item_key]}, n_shared long, n_shingles long, containment double"
    return docs.select(key, common.text_bytes(text).alias("text")).mapInArrow(run, schema)


def clean(docs: DataFrame, items: DataFrame, *, shingle: int = 5, share: float = 0.8, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns kept, that hold no test item."""
    search, place = searcher(items, shingle, share, item_key, item_text), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = search()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            yield batch.filter(pa.array([not t or next(find(t.encode()), None) is None for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_WORDS = r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"
SQL = f"""
WITH d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
     i AS (SELECT item_id, {_SHINGLES} AS a FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
     e AS (SELECT item_id, len(a) AS n, unnest(a) AS s FROM i),
     p AS (SELECT doc_id, item_id, count(*) AS n_shared, any_value(n) AS n_shingles FROM d JOIN e USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(n_shared AS BIGINT) AS n_shared, CAST(n_shingles AS BIGINT) AS n_shingles, n_shared / n_shingles AS containment
FROM p WHERE n_shared >= 0.8 * n_shingles
"""
