"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a bounded sample, by k-means whose overfull clusters are halved. A vector goes to its
nearest list and, where it lies near a boundary, to further ones (distance ratio at most 1 + COPY, and no
chosen centroid nearer to the new centroid than the vector is). Centroids are searched by an in-memory
neighbour graph (or compared outright, if asked for); a query reads the lists whose centroids are at most
a certain ratio as far as the nearest. That ratio is measured: for TRIALS queries the exact neighbours are found by
brute force over all rows, and the ratio is the smallest that reaches the share `recall` of them.
Largest inner product is nearest distance once each vector gets one more component that lifts all to the
same norm, so lists are built in that space; scores are inner products of the original vectors.

Bounds: SAMPLE_BYTES of sample, MOST_LISTS centroids and TRIALS * k neighbours are held on the driver; every row is
indexed. Lists are put together to shards of about PART rows, longer ones are dealt over several by vec_id, and a
shard that more than PART queries ask is dealt out by query; all of it is searched.

`exact_search` gives the same by brute force. With more than MOST_LISTS * LIST_ROWS rows lists grow with the table.

Defined results: vectors that are null, empty, zero, of another length than the one of the smallest id, or have null or non-finite
components take no part, nor do null ids; of rows with one id the best score counts, and a row is no neighbour of another with its id;
ties go to smaller ids; with fewer than k candidates all are returned; an empty table, or one without queries, gives an empty result;
further columns are ignored, whatever their names (`is_query` may use them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SAMPLE_BYTES = 32 << 20
MOST_LISTS = 16384
LIST_ROWS = 256
COPIES = 6
COPY = 0.2
PART = 4096
TRIALS = 128
#: Shards whose counts are broadcast at most.
BROADCAST_ROWS = 500_000


def centroids_of(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Balanced k-means: clusters above twice the mean are halved after some Lloyd rounds."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(8):
        label = nearest(sample, centres)
        centres = means(sample, label, centres)
    most = max(2, 2 * len(sample) // lists)
    out, todo = [], [np.flatnonzero(label == c) for c in range(len(centres))]
    while todo:
        members = todo.pop()
        if not len(members):
            continue
        part = sample[members]
        middle = part.mean(axis=0)
        if len(members) > most and len(out) + len(todo) < 2 * lists:
            axis = part[((part - middle) ** 2).sum(axis=1).argmax()] - middle
            side = (part - middle) @ axis > 0
            if side.any() and not side.all():
                todo += [members[side], members[~side]]
                continue
        out.append(middle)
    return np.array(out)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(half - x[a : a + 4096] @ centres.T).argmin(axis=1) for a in range(0, len(x), 4096)])


def means(x: np.ndarray, label: np.ndarray, old: np.ndarray) -> np.ndarray:
    n = np.bincount(label, minlength=len(old))
    total = np.zeros_like(old)
    np.add.at(total, label, x)
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], old)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T))


class Graph:
    """Centroids with links to their near neighbours and some far ones; batches are searched in step."""

    def __init__(self, centres: np.ndarray, links: int = 16, seed: int = 7):
        self.centres, n = centres, len(centres)
        links = min(links, max(1, n - 1))
        near = []
        for a in range(0, n, 1024):
            d = ((centres**2).sum(axis=1)[None, :] / 2 - centres[a : a + 1024] @ centres.T)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near.append(np.argpartition(d, links - 1, axis=1)[:, :links] if n > 1 else np.zeros((len(d), 1), np.int64))
        rng = np.random.default_rng(seed)
        self.links = np.concatenate((np.concatenate(near), rng.integers(0, n, (n, 4))), axis=1)
        self.entries = np.arange(0, n, max(1, n // 64))

    def search(self, x: np.ndarray, beam: int, outright: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The beam nearest centroids found for each row, nearest first: numbers and distances (-1, inf: none). `outright` compares all."""
        beam = min(beam, len(self.centres))
        if not outright:
            return self.walk(x, beam)
        far = distances(x, self.centres)
        near = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        order = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
        return order, np.take_along_axis(far, order, 1)

    def walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The same by the graph: always the nearest centroid not yet seen from is looked around."""
        centres, rows = self.centres, np.arange(len(x))[:, None]
        beam = min(beam, len(centres))
        gap = lambda ids: np.sqrt(np.maximum(0, ((x[:, None, :] - centres[ids]) ** 2).sum(axis=2)))
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        far = np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (centres[self.entries] ** 2).sum(axis=1) - 2 * x @ centres[self.entries].T))
        seen = np.zeros((len(x), len(centres)), bool)
        seen[rows, ids] = True
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :beam]
            ids, far, done = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(done, order, 1)
            open_ = ~done & np.isfinite(far)
            if not open_.any():
                return np.where(np.isfinite(far), ids, -1), far
            first = open_.argmax(axis=1)
            any_ = open_.any(axis=1)
            done[rows[:, 0], first] = True
            more = self.links[ids[rows[:, 0], first]]
            new = ~seen[rows, more] & any_[:, None]
            new &= ~np.triu(more[:, :, None] == more[:, None, :], 1).any(axis=1)  # a link named twice
            gaps = np.where(new, gap(more), np.inf)
            seen[rows, more] |= any_[:, None]
            ids, far, done = np.concatenate((ids, more), 1), np.concatenate((far, gaps), 1), np.concatenate((done, np.zeros(more.shape, bool)), 1)


def lists_of(graph: Graph, x: np.ndarray, outright: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each copy of the vectors."""
    found, far = graph.search(x, 4 * COPIES, outright)
    chosen = np.zeros(found.shape, bool)
    chosen[:, 0] = True
    for j in range(1, found.shape[1]):
        fits = (far[:, j] <= (1 + COPY) * far[:, 0]) & (found[:, j] >= 0) & (chosen.sum(axis=1) < COPIES)
        apart = np.sqrt(((graph.centres[found[:, : j]] - graph.centres[found[:, j : j + 1]]) ** 2).sum(axis=2))
        chosen[:, j] = fits & ~((apart < far[:, j : j + 1]) & chosen[:, :j]).any(axis=1)
    return np.nonzero(chosen)[0], found[chosen]


def usable(column: str) -> Column:
    x = F.col(column)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Which cells are among the k largest of their row, equal ones included; -inf is none."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return (scores >= np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), least)[:, None]) & np.isfinite(scores)


def nearest_of_shard(base: tuple, queries: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k nearest rows of a shard for each query, of the lists that it asks.

    `base`: list, id and vector of each row, by list; `queries`: id, vector and lists of each.
    """
    lists, ids, v = base
    asking, q, asked = queries
    names, most = np.unique(lists), int(np.unique(ids, return_counts=True)[1].max())
    starts = np.append(np.searchsorted(lists, names), len(lists))
    owner, flat = np.repeat(np.arange(len(asking)), [len(x) for x in asked]), np.concatenate(asked)
    place = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    asks = np.zeros((len(asking), len(names)), bool)
    asks[owner[names[place] == flat], place[names[place] == flat]] = True
    out = []
    for a in range(0, len(asking), 128):
        score = np.full((len(asking[a : a + 128]), len(ids)), -np.inf)
        for j, (s, e) in enumerate(zip(starts, starts[1:], strict=False)):
            rows = np.flatnonzero(asks[a : a + 128, j])
            if len(rows):
                score[rows, s:e] = q[a + rows] @ v[s:e].T
        score[asking[a : a + 128, None] == ids] = -np.inf
        r, c = np.nonzero(top(score, k * most))
        exact = np.zeros(len(r))
        for d in range(q.shape[1]):  # the same order of sums for every pair, so that equal vectors tie
            exact += q[a + r, d] * v[c, d]
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (ids[c[1:]] != ids[c[:-1]])  # copies of a row stand in several lists
        r, c, exact = r[new], c[new], exact[new]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((asking[a + r[kept]], ids[c[kept]], exact[kept]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def taking_part(vectors: DataFrame, is_query: Column, key: str, vector: str) -> tuple[DataFrame, int | None]:
    """(id, v, q) of the rows that take part, and their length; None: there are none."""
    common.bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("id").isNotNull() & usable("v"))
    dims = rows.agg(F.min_by(F.size("v"), "id").alias("d")).first()["d"]
    return rows.where(F.size("v") == dims) if dims else rows, dims


def exact_search(vectors: DataFrame, is_query: Column, *, k: int = 20, key: str = "vec_id", vector: str = "embedding", block_bytes: int = 4 << 20) -> DataFrame:
    """What `search` approximates: the k nearest of all other rows, by brute force.

    Queries are broadcast in blocks of bounded size; each block reads all rows once, and each task keeps k for each query.
    """
    spark = vectors.sparkSession
    rows, dims = taking_part(vectors, is_query, key, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    out = spark.createDataFrame([], schema)
    asking = rows.where("q").dropDuplicates(["id", "v"]) if dims else rows
    blocks = -(-asking.count() * 8 * (dims or 0) // block_bytes)
    for i in range(blocks):
        block = asking.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect()  # some block_bytes
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in block], np.int64), np.array([r["v"] for r in block], float).reshape(-1, dims)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            for batch in batches:
                for a in range(0, batch.num_rows, PART):
                    part = batch.slice(a, PART)
                    ids, v = part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    order = np.argsort(ids, kind="stable")
                    lists = [np.zeros(1, np.int64)] * len(own)
                    found = nearest_of_shard((np.zeros(len(ids), np.int64), ids[order], v[order]), (own, q, lists), k) if len(own) and len(ids) else ()
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

        near = rows.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score double")
        out = out.union(common.stored(ranked(near, k), "ann-exact"))
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each query; of rows with one id the best score counts."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = 0.95, outright: bool = False) -> DataFrame:
    """The k nearest other rows found for each row where `is_query`: query_id, rank, vec_id, score.

    Centroids are searched by the graph; with `outright` each is compared instead. `exact_search` has no index.
    """
    spark = vectors.sparkSession
    rows, first = taking_part(vectors, is_query, key, vector)
    schema = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return spark.createDataFrame([], schema)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v)).alias("norm")).first()
    n, norm = facts["n"], facts["norm"]
    dims = first
    step = max(1, -(-n * 8 * dims // SAMPLE_BYTES))
    sample = np.array([r["v"] for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("v").toLocalIterator()] or [[1.0] * dims], float).reshape(-1, dims)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(0, norm - (x**2).sum(axis=1)))[:, None]), axis=1)

    centres = centroids_of(lifted(sample), int(min(MOST_LISTS, -(-n // LIST_ROWS))))
    graph = Graph(centres)
    shared = spark.sparkContext.broadcast(graph)

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def pieces(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        most = max(1, (8 << 20) // (len(shared.value.centres) + 32 * 8 * dims))
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                part = batch.slice(a, most)
                yield part, matrix(part.column(place))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in pieces(batches, 1):
            row, listed = lists_of(shared.value, lifted(x), outright)
            yield pa.RecordBatch.from_arrays([pa.array(listed, pa.int32()), part.column(0).take(pa.array(row)), pa.array([x[i].tobytes() for i in row], pa.binary())], ["list", "id", "v"])

    postings = common.stored(rows.select("id", "v").mapInArrow(assign, "list int, id long, v binary"), "ann-lists")
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # MOST_LISTS * 2 rows at most
    held = np.array([sizes.get(i, 0) for i in range(len(centres))])
    # Lists in order fill shards of PART rows; a longer list has several to itself.
    parts = np.maximum(1, -(-held // PART))
    first, shard, filled = np.zeros(len(held), np.int64), -1, PART
    for i, n in enumerate(held.tolist()):
        if parts[i] > 1 or filled + n > PART:
            shard, filled = shard + 1, 0
        first[i], shard = shard, shard + int(parts[i]) - 1
        filled = PART if parts[i] > 1 else filled + n

    def level(x: np.ndarray) -> np.ndarray:
        """Queries in the lifted space; a query's own norm changes no order."""
        return np.concatenate((x * np.sqrt(norm / (x**2).sum(axis=1, keepdims=True)), np.zeros((len(x), 1))), axis=1)

    trials = rows.where("q").orderBy(F.xxhash64("id"), "id").limit(TRIALS).select("id", "v").collect()
    if not trials:
        return spark.createDataFrame([], schema)
    tried, trial = np.array([r["id"] for r in trials]), np.array([r["v"] for r in trials], float)
    asked_first = spark.sparkContext.broadcast((tried, trial))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = asked_first.value
        best, ids = np.full((len(own), 0), -np.inf), np.zeros((len(own), 0), np.int64)
        for part, x in pieces(batches, 1):
            now = np.broadcast_to(part.column(0).to_numpy(), (len(own), len(x)))
            score = q @ x.T
            score[own[:, None] == now] = -np.inf
            best, ids = np.concatenate((best, score), axis=1), np.concatenate((ids, now), axis=1)
            if best.shape[1] > k:
                keep = np.argpartition(-best, k - 1, axis=1)[:, :k]
                best, ids = np.take_along_axis(best, keep, 1), np.take_along_axis(ids, keep, 1)
        r, c = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(ids[r, c]), pa.array(best[r, c])], ["i", "id", "s"])

    order = Window.partitionBy("i").orderBy(F.desc("s"), "id")
    true = rows.select("id", "v").mapInArrow(exact, "i int, id long, s double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("i", "id")
    # A row for each trial, neighbour and copy: TRIALS * k * COPIES at most.
    needed = postings.select("id", "list").join(F.broadcast(true), "id").groupBy("i", "id").agg(F.collect_set("list").alias("lists")).collect()
    ratio, beam = 1.0, 1
    if needed:
        far = distances(level(trial), centres)
        far /= np.maximum(far.min(axis=1, keepdims=True), 1e-12)
        ratio = float(np.quantile([far[r["i"], r["lists"]].min() for r in needed], recall, method="higher")) + 1e-9
        beam = min(len(centres), int(1.1 * (far <= ratio).sum(axis=1).max()) + 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in pieces(batches, 1):
            x = np.array(x)
            found, far = shared.value.search(level(x), max(beam, min(len(held), 8)), outright)
            size = np.where(found >= 0, held[found], 0)
            probe = (found >= 0) & ((far <= ratio * far[:, :1]) | (np.cumsum(size, axis=1) - size < COPIES * (k + 1)))
            row, col = np.nonzero(probe)
            listed = found[row, col]
            many = parts[listed]
            row, listed = np.repeat(row, many), np.repeat(listed, many)
            to = first[listed] + np.arange(len(listed)) - np.repeat(np.cumsum(many) - many, many)
            order = np.lexsort((listed, to, row))
            row, listed, to = row[order], listed[order], to[order]
            heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (to[1:] != to[:-1]))))
            ends = pa.array(np.append(heads, len(row)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(to[heads], pa.int64()), part.column(0).take(pa.array(row[heads])), pa.array([x[i].tobytes() for i in row[heads]], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(listed, pa.int32())),
            ], ["shard", "id", "v", "lists"])

    asked = common.stored(rows.where("q").select("id", "v").mapInArrow(ask, "shard long, id long, v binary, lists array<int>"), "ann-asked")
    deal = common.stored(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("nq")), "ann-deal")
    deal = F.broadcast(deal) if deal.count() <= BROADCAST_ROWS else deal
    places = F.broadcast(spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(len(held))], "list int, first long, np int"))
    left = postings.join(places, "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id"), "np")).join(deal, "shard")
    left = left.select("shard", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("r"), "list", "id", "v")
    right = asked.join(deal, "shard").select("shard", F.pmod(F.xxhash64("id"), "nq").cast("int").alias("r"), "id", "v", "lists")

    def best(_, base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(base) and len(queries):
            base = base.sort_values(["list", "id"])
            vectors_of = lambda t: np.frombuffer(b"".join(t["v"]), float).reshape(-1, dims)
            found = nearest_of_shard((base["list"].to_numpy(), base["id"].to_numpy(), vectors_of(base)), (queries["id"].to_numpy(), vectors_of(queries), queries["lists"].tolist()), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["shard", "r"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "query_id long, vec_id long, score double")
    return ranked(found, k)
