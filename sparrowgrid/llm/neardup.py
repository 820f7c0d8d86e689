"""Near copies of documents, one of each group kept: SimHash links, and a verified similarity of word shingles.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 lie some five to fourteen of 64
fingerprint bits apart, which no search by shared bits can cover at scale. SimHash links (three words, two bits)
therefore find exact copies and the closest ones, and a second route finds the rest: bands of minima of
the shingles' hashes propose pairs, whose exact similarity of the shingle sets decides. A member of a band is first judged
with three nodes of it: those of the smallest and the largest key, and the hub that shares most bands with others. Bands whose
members are not connected by then are judged in full: dealt over cells of bounded size so that all pairs of members of different
components meet. No pair of a band goes unjudged unless its members are connected. Nodes are distinct texts (as words);
those of one fingerprint are linked. All links make the groups.

Defined results: null and empty texts have fingerprint zero, and one of them is kept; of a group the row with
the smallest key stays, as often as it stands there; of rows that share a key each is judged by its own text; rows
with a null key stay; an empty table gives an empty result. Of nodes that share equally many bands the one of the larger number is the
hub, which changes no group; a text of fewer than five words is one shingle, and one without words has none. Texts of any length are read
whole; further columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .components import connected
from .decontaminate import hashes, words_of
from .simhash import fingerprint, links

#: Bands and minima in each: at a similarity of 0.8 all bands differ once in 10,000 times.
BANDS, MINIMA = 14, 3
#: Members of a band, and bytes of their shingle sets, on each side of a cell on average.
SIDE, SIDE_BYTES = 512, 8 << 20
#: Keys that are broadcast at most (some 20 MB).
BROADCAST_ROWS = 500_000
_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, BANDS * MINIMA, np.uint64) << np.uint64(1) | np.uint64(1)
_TERMS = _RNG.integers(1, 1 << 63, BANDS * MINIMA, np.uint64)


def bands(words: list[bytes], shingle: int) -> np.ndarray:
    """The keys of a text's bands; none for a text without words."""
    h = np.unique(hashes(words, shingle)) if words else np.zeros(0, np.uint64)
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for a in range(0, len(h), 4096):
        mixed = h[None, a : a + 4096] * _FACTORS[:, None] + _TERMS[:, None]
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, (mixed * _FACTORS[:1, None]).min(axis=1))
    least = least.reshape(BANDS, MINIMA)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(MINIMA):
        key = (key ^ least[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def few(df: DataFrame) -> DataFrame:
    """Broadcast a stored table of keys if it is small enough, else let the join shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sets_of(docs: DataFrame, pairs: DataFrame, rows: DataFrame, *, key: str, text: str, shingle: int) -> DataFrame:
    """(node, s): the shingle sets of the nodes in `pairs` (a, b), as sorted hashes.

    `rows` (node, k, h) tells the key and the text's hash of each node.
    """
    wanted = common.stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(rows, "node"), "neardup-nodes")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(hashes(w, shingle)).tobytes() if (w := words_of(t)) else b"" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "s"])

    texts = texts_of(docs, key, text).join(few(wanted), ["k", "h"]).select("node", "t")
    return common.stored(texts.mapInArrow(sets, "node long, s binary").dropDuplicates(["node"]), "neardup-sets")


def similar(pairs: DataFrame, found: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets, `found` (node, s), have a Jaccard similarity of at least `share`."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= share * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = found.select(F.col("node").alias("a"), F.col("s").alias("x")), found.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def cell_links(c: np.ndarray, side: np.ndarray, sets: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """Edges of a forest that joins the components c of similar sets: those of side 0 against side 1, or all if there is no side 1."""
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if side.any() else np.arange(len(sets))
    if not len(left):
        return []
    theirs = np.concatenate([ids[ends[i] - sizes[i] : ends[i]] for i in right])
    starts = np.cumsum(sizes[right]) - sizes[right]
    labels, place = np.unique(c, return_inverse=True)
    label, seen, out = np.arange(len(labels)), np.zeros(ids.max() + 1, bool), []
    for i in left:
        own = ids[ends[i] - sizes[i] : ends[i]]
        seen[own] = True
        both = np.add.reduceat(seen[theirs], starts, dtype=np.int64)
        seen[own] = False
        close = both >= share * (sizes[i] + sizes[right] - both)
        for other in np.unique(label[place[right[close]]]):
            if other != (mine := label[place[i]]):
                out.append((int(labels[mine]), int(labels[other])))
                label[label == other] = mine
    return out


def remaining(shared: DataFrame, placed: DataFrame, found: DataFrame, share: float) -> DataFrame:
    """Edges (a, b) between components: of all pairs of a band that `placed` (node, c) has in different components, the similar ones.

    Within a band the members of the largest component meet the others, and the others each other. Each side is dealt into
    parts, and a cell is a part met by a part: (i, j) of the others and the largest, (i, -1 - j) of the others with i <= j.
    """
    sized = common.stored(placed.join(found.select("node", F.length("s").alias("size")), "node"), "neardup-sized")
    members = common.stored(shared.select("band", "node").join(sized, "node"), "neardup-members")
    parts = members.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    parts = parts.groupBy("band").agg(F.max(F.struct("n", "c", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("cs")).where("cs > 1")

    def dealt(n, size):
        return F.ceil(F.greatest(n / SIDE, size / SIDE_BYTES)).cast("int")

    bands = common.stored(parts.select("band", F.col("main.c").alias("main"), dealt(F.col("main.n"), F.col("main.size")).alias("js"), dealt(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("is")), "neardup-open")
    members = members.join(few(bands), "band")
    largest, at = F.col("c") == F.col("main"), F.xxhash64("node", "band")
    i, j, upto = F.pmod(at, F.col("is")).cast("int"), F.pmod(at, F.col("js")).cast("int"), F.sequence(F.lit(0), F.col("is") - 1)
    with_main = F.transform(F.sequence(F.lit(0), F.col("js") - 1), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(0).alias("side")))
    with_others = F.transform(upto, lambda x: F.struct(F.least(i, x).alias("i"), (-1 - F.greatest(i, x)).alias("j"), (i > x).cast("int").alias("side")))
    of_main = F.transform(upto, lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(1).alias("side")))
    cells = members.select("node", "c", "band", F.explode(F.when(largest, of_main).otherwise(F.concat(with_main, with_others))).alias("x")).select("node", "c", "band", "x.*")
    cells = common.stored(cells, "neardup-cells").join(found, "node")

    def judge(cell: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s, np.uint64) for s in cell["s"].to_pylist()]
        out = cell_links(cell["c"].to_numpy(), cell["side"].to_numpy(), sets, share)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return cells.select("band", "i", "j", "side", "c", "s").groupBy("band", "i", "j").applyInArrow(judge, "a long, b long")


def texts_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, h): key, text and the text's hash of the rows that have a key."""
    t = common.text_bytes(text)
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), t.alias("t"), F.xxhash64(t).alias("h"))


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 3, most: int = 2, shingle: int = 5, share: float = 0.8) -> DataFrame:
    """(key, h, component_id) of the rows that have a key: h is the text's hash, component_id the smallest key reachable by either kind of link."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    kind = dict(docs.dtypes)[key]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            prints = np.array([fingerprint(w, words) for w in texts], np.uint64).view(np.int64)
            same = np.array([xxh64_intdigest(b" ".join(w)) for w in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints), pa.array(same), pa.array([bands(w, shingle) for w in texts], pa.list_(pa.int64()))], ["k", "h", "fp", "node", "bands"])

    prints = common.stored(texts_of(docs, key, text).mapInArrow(read, f"k {kind}, h long, fp long, node long, bands array<long>"), "neardup-prints")
    # One node for each distinct text, and for each fingerprint one of its nodes.
    nodes = common.stored(prints.groupBy("node").agg(F.min(F.struct("k", "h", "fp", "bands")).alias("x")).select("node", "x.*"), "neardup-nodes")
    vertices = common.stored(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "neardup-vertices")
    equal = nodes.select("node", "fp").join(vertices, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    each = nodes.select("node", "k", F.explode("bands").alias("band"))
    # Counts and ends are stored before they are joined: both sides of a join are then plain, and its hot bands can be split.
    counts = common.stored(each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "neardup-bands")
    shared = common.stored(each.join(few(counts), "band"), "neardup-shared")
    # The node of a band that meets others most often is its hub: of an original and its edited copies, the original.
    weights = common.stored(shared.groupBy("node").agg(F.sum("n").alias("weight")), "neardup-weights")
    weighed = common.stored(shared.join(few(weights), "node").select("band", "node", "k", "weight"), "neardup-weighed")
    first, last, hub = F.min(F.struct("k", "node")), F.max(F.struct("k", "node")), F.max(F.struct("weight", "node"))
    ends = common.stored(weighed.groupBy("band").agg(F.array(first["node"], last["node"], hub["node"]).alias("ends")), "neardup-ends")
    met = weighed.join(few(ends), "band").select("node", F.explode("ends").alias("b"))
    pairs = common.stored(met.where("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "neardup-pairs")
    found = sets_of(docs, pairs, nodes.select("node", "k", "h"), key=key, text=text, shingle=shingle)
    labels = connected(links(vertices, most).union(equal).union(similar(pairs, found, share)))
    placed = common.stored(nodes.select("node", "k").join(labels, "node", "left").select("node", "k", F.coalesce("component", "node").alias("c")), "neardup-placed")
    more = connected(remaining(shared, placed.select("node", "c"), found, share)).withColumnRenamed("node", "c")
    placed = common.stored(placed.join(more, "c", "left").select("node", "k", F.coalesce("component", "c").alias("c")), "neardup-placed")
    named = common.stored(placed.join(placed.groupBy("c").agg(F.min("k").alias("component_id")), "c").select("node", "component_id"), "neardup-named")
    return prints.select("k", "h", "node").join(named, "node").select(F.col("k").alias(key), "h", "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns kept, but for near copies of a row with a smaller key."""
    k, h = common.fresh(docs, "lost_key"), common.fresh(docs, "lost_text")
    lost = groups(docs, key=key, text=text).where(F.col(key) != F.col("component_id")).select(F.col(key).alias(k), F.col("h").alias(h)).distinct()
    return docs.join(few(common.stored(lost, "neardup-lost")), (F.col(key) == F.col(k)) & (F.xxhash64(common.text_bytes(text)) == F.col(h)), "left_anti")
