"""SimHash fingerprints and their links by a Gray-order hierarchical index.

Upper nodes of the index are (mask, value) pairs: the fingerprints that share these masked bits. Two
fingerprints that differ in at most d bits agree on at least one of d + 1 parts of the bits that
their node leaves open, so each node is split that way as long as it holds more than LEAF members.
A leaf is one sorted run in Gray order; runs of it are factored into (shared bits, pattern) nodes, and
a pair of nodes is left as soon as the differences in the bits that both share exceed d. So the Gray order works inside of
leaves, which fit a task; what divides a table into leaves are the masks.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a bit that is set in exactly half of the
hashes is 0; equal fingerprints are one vertex, however many documents have them; repeated ids fall into one component
if their fingerprints link, and are returned as often as they stand in the input; a null key is no smallest key where there is
another; texts of any length are read whole; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected

BITS = 64
#: Members of a node that one task takes; larger nodes are split further.
LEAF = 2048
FANOUT = 8
ALL = (1 << BITS) - 1


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bit i is set if more than half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = [xxh64_intdigest(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))]
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 65536):
        part = np.array(hashes[a : a + 65536], np.uint64).astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp long): the fingerprint's 64 bits as a signed number."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.lower().split(), shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], [key, "fp"])

    return docs.select(key, common.text_bytes(text).alias("text")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray sequence."""
    out = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def gray_tree(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shared mask, pattern) of the nodes, level by level; fps are in Gray order; level 0 are the fps."""
    levels = [(np.full(len(fps), ALL, np.uint64), fps)]
    ones, zeros = fps, ~fps
    while len(ones) > 1:
        cuts = np.arange(0, len(ones), FANOUT)
        ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
        levels.append((ones | zeros, ones))
    return levels


def gray_links(fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of distinct values in Gray order that differ in at most `most` bits, in blocks."""
    levels = gray_tree(fps)
    steps = np.arange(FANOUT)
    todo = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, a, b = todo.pop()
        mask, pattern = levels[level]
        held = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= most
        a, b = a[held], b[held]
        if not level:
            if len(a := a[(apart := a < b)]):
                yield a, b[apart]
            continue
        size = len(levels[level - 1][0])
        for cut in range(0, len(a), 4096):
            below_a = (a[cut : cut + 4096, None] * FANOUT + steps)[:, :, None]
            below_b = (b[cut : cut + 4096, None] * FANOUT + steps)[:, None, :]
            below_a, below_b = np.broadcast_arrays(below_a, below_b)
            fits = (below_a <= below_b) & (below_b < size)
            if fits.any():
                todo.append((level - 1, below_a[fits], below_b[fits]))


def forest(fps: np.ndarray, reps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(representative, smallest representative it is linked to in this leaf), without self-links."""
    order = np.argsort(gray_rank(fps), kind="stable")
    fps, reps = fps[order], reps[order]
    label = np.arange(len(fps))
    order = np.argsort(reps, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    label = place.copy()  # labels are places in the order of representatives
    links = list(gray_links(fps, most))
    changed = bool(links)
    while changed:
        old = label.copy()
        for a, b in links:
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = np.minimum(label, label[order[label]])
        changed = bool((old != label).any())
    linked = label != place
    return reps[linked], reps[order[label[linked]]]


def split(mask: int, parts: int) -> list[int]:
    """Masks of a node's children: each fixes one more part of the bits that `mask` leaves open."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [mask | sum(1 << free[i] for i in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(vertices: DataFrame, most: int = 2, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) of a forest with the components of "fp differs in at most `most` bits".

    `vertices` (fp, rep) has distinct fp. No key is gathered beyond `leaf` members: a node with
    more is split again until it has few or no more than 2**free bits can be distinct.
    """
    spark = vertices.sparkSession
    masks, members, out = [0], vertices.withColumn("mask", F.lit(0).cast("long")), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = pd.concat([rest, frame]) if rest is not None else frame
            key = frame[["mask", "value"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if not len(cut):
                rest = frame
                continue
            rest = frame.iloc[cut[-1] :]
            yield leaves(frame.iloc[: cut[-1]], cut[:-1])
        if rest is not None and len(rest):
            yield leaves(rest, np.zeros(0, np.int64))

    def leaves(frame: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        fps, reps = frame["fp"].to_numpy().view(np.uint64), frame["rep"].to_numpy()
        bounds = np.concatenate(([0], cuts, [len(frame)]))
        found = [forest(fps[a:b], reps[a:b], most) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1]
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.concatenate([none, *(x[0] for x in found)]), "b": np.concatenate([none, *(x[1] for x in found)])})

    while True:
        children = {m: split(m, most + 1) for m in masks}
        choice = F.array(*[F.lit(signed(c)) for c in children[masks[0]]])
        for m in masks[1:]:
            choice = F.when(F.col("mask") == F.lit(signed(m)), F.array(*[F.lit(signed(c)) for c in children[m]])).otherwise(choice)
        nodes = members.select("fp", "rep", F.explode(choice).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({c for cs in children.values() for c in cs})
        last = all(2 ** (BITS - bin(m).count("1")) <= leaf for m in masks)
        hot = None
        if not last:
            hot = common.stored(nodes.groupBy("mask", "value").count().where(F.col("count") > leaf).select("mask", "value"), "simhash-hot")
            n = hot.count()
            if n:
                # A few keys: at most one for each `leaf` members. Broadcast only while they are few.
                hot = F.broadcast(hot) if n <= 100_000 else hot
                nodes_small = nodes.join(hot, ["mask", "value"], "left_anti")
            else:
                hot, nodes_small = None, nodes
        else:
            nodes_small = nodes
        part = nodes_small.repartition("mask", "value").sortWithinPartitions("mask", "value").select("mask", "value", "fp", "rep").mapInPandas(run, "a long, b long")
        out = part if out is None else out.union(part)
        if hot is None:
            return out
        members = common.stored(nodes.join(hot, ["mask", "value"], "left_semi").select("fp", "rep", "mask"), "simhash-members")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """(key, fp long, component_id): component_id is the smallest key reachable by links of fingerprints."""
    prints = common.stored(fingerprints(docs, key=key, text=text, shingle=shingle), "simhash-fp")
    vertices = common.stored(prints.groupBy("fp").agg(F.min(key).alias("rep")), "simhash-vertices")
    labels = connected(links(vertices, most))
    named = vertices.join(labels, vertices["rep"] == labels["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = common.stored(named, "simhash-named")
    return prints.join(named, "fp").select(key, "fp", "component_id")
