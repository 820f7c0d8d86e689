"""URL filters by a sorted digest array.

The file holds sorted 64-bit xxhash keys, the place of each entry's full string, its verdict, and the
strings. Workers map it into memory, probe it with one vectorised binary search for a whole batch, and
confirm every hit by comparing the stored string, so that colliding digests decide nothing.

An entry is host + path, such as `example.net/en/`; it fits its host and all subdomains if the url's path
starts with the entry's. The longest entry wins, of equally long ones that with the longer host. A url that
no entry fits gets the default verdict (`allow`).

Defined results: a null url, or one without `://`, has an empty host and path, no rule and the default
verdict; urls of any length are judged whole; repeated rows and null keys are judged alike; an empty table gives an empty result, an
empty list leaves every url to the default; further columns of the input are ignored, whatever their names. The file is
mapped where the shared folder is mounted, and fetched as a whole from other stores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

VERDICTS = ("allow", "block")
MAGIC = b"SGURL1\0\0"


def pack(entries: Iterable[tuple[str, str]]) -> bytes:
    """The file for (verdict, entry) pairs; of a repeated entry the last verdict holds."""
    verdicts = {entry.encode(): VERDICTS.index(verdict) for verdict, entry in entries}
    rows = sorted((xxh64_intdigest(e), e, v) for e, v in verdicts.items())
    ends = np.cumsum([0] + [len(e) for _, e, _ in rows]).astype("<u8")
    splits = [e.index(b"/") if b"/" in e else len(e) for _, e, _ in rows]
    return b"".join((
        MAGIC, np.array([len(rows)], "<u8").tobytes(), np.array([d for d, _, _ in rows], "<u8").tobytes(), ends.tobytes(),
        np.array(splits, "<u4").tobytes(), np.array([v for _, _, v in rows], "u1").tobytes(), b"".join(e for _, e, _ in rows),
    ))


class DigestArray:
    """A mapped file of `pack`."""

    def __init__(self, path: str):
        data = common.mapped(path)
        if data is None or bytes(data[:8]) != MAGIC:
            raise ValueError(f"{path} is no digest array")
        n = int(data[8:16].view("<u8")[0])
        at = 16
        self.keys = data[at : (at := at + 8 * n)].view("<u8")
        self.ends = data[at : (at := at + 8 * (n + 1))].view("<u8")
        self.splits = data[at : (at := at + 4 * n)].view("<u4")
        self.verdicts = data[at : (at := at + n)]
        self.strings = data[at:]
        self.host_lengths = np.unique(self.splits).tolist()
        self.path_lengths = np.unique(np.diff(self.ends).astype(np.int64) - self.splits).tolist()

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """The number of the entry that equals each string, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys) or not wanted:
            return out
        digests = np.fromiter(map(xxh64_intdigest, wanted), np.uint64, len(wanted))
        low, high = np.searchsorted(self.keys, digests), np.searchsorted(self.keys, digests, side="right")
        for i in np.flatnonzero(high > low).tolist():
            for k in range(int(low[i]), int(high[i])):
                if self.strings[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == wanted[i]:
                    out[i] = k
        return out

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[bytes | None, int | None]]:
        """(entry, verdict) that decides each url, or (None, None)."""
        wanted, owner, rank = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for h in self.host_lengths:
                if len(host) == h or len(host) > h and host[-h - 1 : -h if h else None] == b".":
                    for p in self.path_lengths:
                        if len(path) >= p:
                            wanted.append(host[len(host) - h :] + path[:p])
                            owner.append(i)
                            rank.append((h + p, h))
        best: list[tuple] = [((-1, -1), None)] * len(hosts)
        for i, r, k in zip(owner, rank, self.find(wanted).tolist(), strict=True):
            if k >= 0 and int(self.splits[k]) == r[1] and r > best[i][0]:
                best[i] = (r, k)
        return [(None, None) if k is None else (self.strings[int(self.ends[k]) : int(self.ends[k + 1])].tobytes(), int(self.verdicts[k])) for _, k in best]


def publish(spark: SparkSession, entries: Iterable[tuple[str, str]]) -> str:
    """Write the file into the shared folder; returns its path there.

    The list itself passes through the driver and takes some 30 bytes an entry besides its string.
    """
    folder = common.new_folder(spark, "urls")
    common.make_folder(folder)
    common.write_file(path := f"{folder}/filter.bin", [pack(entries)])
    return path


def filter_urls(pages: DataFrame, entries: Iterable[tuple[str, str]], *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) of each row."""
    spark = pages.sparkSession
    common.bound_batches(spark)
    path = publish(spark, entries)
    has = F.instr(F.col(url), "://")
    rest = F.when(has > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    parts = pages.select(key, F.coalesce(rest, F.lit("")).alias("rest")).select(
        key,
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = common.held(path, lambda: DigestArray(path))
        for batch in batches:
            found = array.judge([x.encode() for x in batch.column(1).to_pylist()], [x.encode() for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([
                *batch.columns,
                pa.array([None if e is None else e.decode() for e, _ in found], pa.string()),
                pa.array([default if v is None else VERDICTS[v] for _, v in found], pa.string()),
            ], [key, "host", "path", "rule", "verdict"])

    return parts.mapInArrow(run, f"`{key}` {dict(pages.dtypes)[key]}, host string, path string, rule string, verdict string")


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
     t(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
     f AS (SELECT page_id, host, path, h || q AS rule, verdict,
                  row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC NULLS LAST, length(h) DESC) AS n
           FROM p LEFT JOIN t ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
