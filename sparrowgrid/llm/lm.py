"""LM scoring by an Elias-Fano n-gram trie.

Texts are read once, into stored chunks of word numbers and word hashes; all later passes read those. Chunks send their
distinct n-grams to the cells, with how often each occurs in training texts; a cell is built from these, opened once, answers
all chunks, and is done. So the cost of a text does not grow with the number of cells. Words are counted in shards by hash; a word's id is its rank by hash. Contexts w2 are cut into bands of about `Sizes.band` tokens, a band
into as many cells by w3 as its tokens need, so that a frequent context is spread over many cells; the trigrams of a pair that may
itself be too frequent for a cell (as both its words are) are dealt over further cells by w1. A cell is a trie in
memory-mapped levels: monotone pointers from each context w2 to its successors w3, pointers from those to the words
w1 before them, and both kinds of ids relative to their context (running sums keep the sequence increasing, so
that one search of the whole sequence finds a successor of one context). Probabilities are Dirichlet-smoothed,

    P(w3 | w2) = (c(w2 w3) + M2 P(w3)) / (c(w2) + M2),  P(w3 | w1 w2) = b(w1 w2) (c(w1 w2 w3) / M3 + P(w3 | w2)),
    b(w1 w2) = M3 / (c(w1 w2) + M3),  P(w) = (c(w) + 1) / (N + V + 1),

and stored in one byte each: P(w3 | w2) by 256 bins of equal width, b and c(w1 w2 w3) / M3 by a fixed code of counts. Where that
is exact, a chunk gets P(w3 | w2) from the count, so that cells need not send it.
All counts are over all training texts, none is pruned.

Defined results: null and empty texts are one end token; texts of any length are scored whole; a null key counts as the text ""
in the fold; repeated rows count and are scored as often as they stand there; an empty table gives an empty result; without training
rows every probability is that of an empty model; further columns are ignored, whatever their names. Words are told apart by
64-bit hashes. Shards of words and the answers are mapped where the shared folder is mounted, and fetched from other stores; a
worker keeps the last `Sizes.open` shards open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common
from .eliasfano import EliasFano, read_arrays, write_arrays
from .pieces import Known, released, squeezed
from .toxicity import crc_of

M2, M3 = 4.0, 2.0
#: Cells by w1 of one pair at most, as they are numbered within a base cell.
SUBS = 1 << 20


@dataclass(frozen=True)
class Sizes:
    """Bounds of what a task holds; none changes a score beyond its rounding."""

    cell: int = 1_500_000  #: n-grams of a cell, on average
    band: int = 6_000_000  #: tokens of a band of contexts
    batch: int = 1_500_000  #: not used any more, kept for callers: a chunk's n-grams are sorted at once
    words: int = 1_000_000  #: words that a task counts before they are sent on
    chunk: int = 8_000_000  #: bytes of text in a chunk, which asks each cell at most once
    shard: int = 32 << 20  #: bytes of text for each shard of words
    open: int = 1024  #: shards of words that a worker keeps open


END = xxh64_intdigest(b"")  # no word is empty
#: Counts behind a one-byte code: exact to 160, then by a constant factor.
COUNTS = np.concatenate((np.arange(160), np.round(160 * (2**40 / 160) ** (np.arange(96) / 95)))).astype(float)
#: The first code that may stand for several counts.
ROUNDED = 160


def count_code(c: np.ndarray) -> np.ndarray:
    """The code of the nearest count."""
    return np.searchsorted((COUNTS[1:] + COUNTS[:-1]) / 2, c).astype(np.uint8)


def read_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, number of each word of the texts among them, words of each text)."""
    known = Known()
    per_text = [t.lower().split() for t in texts]
    lengths = np.fromiter(map(len, per_text), np.int64, len(per_text))
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(per_text)), np.int64, int(lengths.sum()))
    return np.fromiter(map(xxh64_intdigest, known), np.uint64, len(known)), flat, lengths


def with_ends(flat: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids with an end id after each text, and where each text ends."""
    ends = np.cumsum(lengths + 1)
    out = np.empty(len(flat) + len(lengths), np.int64)
    last = np.zeros(len(out), bool)
    last[ends - 1] = True
    out[last], out[~last] = end, flat
    return out, ends


class Vocabulary:
    """The mapped shards of words: hash -> id, and counts by id."""

    def __init__(self, folder: str, shards: int, sizes: list[int], open_: int):
        self.bits = shards.bit_length() - 1
        empty = {"hash": np.zeros(0, np.uint64), "count": np.zeros(0, np.int64)}
        self.parts = common.Opened(lambda s: read_arrays(f"{folder}/words-{s}")[0] if sizes[s] else empty, open_)
        self.shards, self.offsets = shards, np.concatenate(([0], np.cumsum(sizes)))

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each hash."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        sorted_ = hashes[order]
        shard = (sorted_ >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(hashes) else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            s = int(shard[a])
            part, rows, own = self.parts[s], order[a:b], sorted_[a:b]
            if not len(part["hash"]):
                continue
            at = np.minimum(np.searchsorted(part["hash"], own), len(part["hash"]) - 1)
            hit = part["hash"][at] == own
            ids[rows[hit]] = self.offsets[s] + at[hit]
            counts[rows[hit]] = part["count"][at[hit]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted, known ids."""
        cuts = np.searchsorted(ids, self.offsets)
        some = np.flatnonzero(np.diff(cuts)).tolist()
        return np.concatenate([self.parts[s]["count"][ids[cuts[s] : cuts[s + 1]] - self.offsets[s]] for s in some] or [np.zeros(0, np.int64)])


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte plane by byte plane, which the shuffle's codec packs well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def tokenised(docs: DataFrame, held: Column, *, key: str, text: str, sizes: Sizes = Sizes()) -> DataFrame:
    """The texts as stored chunks: keys, whether each is held out, words of each text, hashes of the chunk's distinct words, numbers of all its words, and the chunk's own."""
    common.bound_batches(docs.sparkSession, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in common.chunks(texts, len, sizes.chunk):
                hashes, flat, lengths = read_words(texts[a:b])
                cut, place = pa.array([0, b - a], pa.int32()), slice(a, b)
                yield pa.RecordBatch.from_arrays([
                    *(pa.ListArray.from_arrays(cut, batch.column(i)[place]) for i in (0, 1)), pa.array([lengths.astype("<u4").tobytes()], pa.binary()),
                    pa.array([hashes.astype("<u8").tobytes()], pa.binary()), pa.array([planes(flat)], pa.binary()), pa.array([chunk], pa.int64()),
                ], ["keys", "held", "lengths", "hashes", "flat", "chunk"])
                chunk += 1

    schema = f"keys array<{dict(docs.dtypes)[key]}>, held array<boolean>, lengths binary, hashes binary, flat binary, chunk long"
    return common.stored(docs.select(key, held.alias("held"), common.text_bytes(text).alias("t")).mapInArrow(run, schema), "lm-tokens", "zstd")


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(keys, held out, words of each text, hashes, numbers, chunk) of the rows of `tokenised`."""
    for batch in batches:
        for i in range(batch.num_rows):
            lengths, hashes = np.frombuffer(batch.column(2)[i].as_py(), "<u4").astype(np.int64), np.frombuffer(batch.column(3)[i].as_py(), "<u8")
            yield batch.column(0)[i].values, batch.column(1)[i].values.to_numpy(zero_copy_only=False).astype(bool), lengths, hashes, unplanes(batch.column(4)[i].as_py()), batch.column(5)[i].as_py()


def trained_on(held: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and lengths of the texts that are not held out."""
    return flat[np.repeat(~held, lengths)], lengths[~held]


def count_words(tokens: DataFrame, folder: str, shards: int, sizes: Sizes) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Write the shards of words; (distinct words, tokens, first words of its bands, tokens of those) of each."""
    bits = shards.bit_length() - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, ends = [], 0, 0

        def flush() -> pa.RecordBatch:
            hashes, at = np.unique(np.concatenate([np.array([END], np.uint64), *(h for h, _ in parts)]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([[ends], *(n for _, n in parts)])).astype(np.int64)
            shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            rows = [(s, hashes[a:b].tobytes(), counts[a:b].tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["part", "h", "n"])

        for _, held, lengths, hashes, flat, _ in chunks_of(batches):
            own, texts = trained_on(held, lengths, flat)
            n = np.bincount(own, minlength=len(hashes))
            met = np.flatnonzero(n)
            parts.append((hashes[met], n[met]))
            size, ends = size + len(met), ends + len(texts)
            if size > sizes.words:
                yield flush()
                parts, size, ends = [], 0, 0
        if ends:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in common.grouped(batches):
            hashes = np.concatenate([np.frombuffer(r["h"], np.uint64) for r in rows])
            counts = np.concatenate([np.frombuffer(r["n"], np.int64) for r in rows])
            hashes, at = np.unique(hashes, return_inverse=True)
            counts = np.bincount(at, counts).astype(np.int64)
            write_arrays(f"{folder}/words-{shard}", {"hash": hashes, "count": counts}, {})
            band = (np.cumsum(counts) - counts) // sizes.band
            first = np.flatnonzero(np.concatenate(([True], band[1:] != band[:-1])))
            sums = np.add.reduceat(counts, first)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(hashes)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([first.tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], ["part", "words", "tokens", "first", "sums"])

    parts = tokens.mapInArrow(count, "part int, h binary, n binary").repartition("part").sortWithinPartitions("part")
    # A row for each shard; of bands there are one for each shard and one for each band.
    found = {r["part"]: r for r in common.stored(parts.mapInArrow(merge, "part int, words long, tokens long, first binary, sums binary"), "lm-words").collect()}
    none = np.zeros(0, np.int64)
    return [(r["words"], r["tokens"], np.frombuffer(r["first"], np.int64), np.frombuffer(r["sums"], np.int64)) if (r := found.get(s)) else (0, 0, none, none) for s in range(shards)]


class Model:
    """Where the levels are and what they count; opened once by each worker."""

    def __init__(self, folder: str, shards: list[tuple[int, int, np.ndarray, np.ndarray]], texts: int, sizes: Sizes):
        self.folder, self.shards, self.texts, self.sizes = folder, [s[0] for s in shards], texts, sizes
        self.words, self.tokens = sum(self.shards), sum(s[1] for s in shards)
        if self.words > (1 << 32) - 4:
            raise ValueError("word ids have 32 bits in files and shuffles")
        self.floor = self.tokens + self.words + 1  # P(w) = (c + 1) / floor
        offsets = np.cumsum([0, *self.shards])
        # Contexts are words and, last, the start, which has a band to itself; the last entry bounds it.
        self.bands = np.concatenate([s[2] + o for s, o in zip(shards, offsets, strict=False)] + [[self.words, self.words + 1]]).astype(np.int64)
        self.columns = np.maximum(1, -(-np.concatenate([s[3] for s in shards] + [[texts]]) // sizes.cell)).astype(np.int64)
        self.first = np.cumsum(self.columns) - self.columns

    def cells(self, w2: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, w2 and w3 as the cell has them) of each pair."""
        band = np.searchsorted(self.bands, w2, side="right") - 1
        columns = self.columns[band]
        inner = w3 // columns
        return self.first[band] + w3 - inner * columns, w2 - self.bands[band], inner

    def band_of(self, cell: int) -> int:
        return int(np.searchsorted(self.first, cell, side="right")) - 1

    def parts(self, c2: np.ndarray, c3: np.ndarray) -> np.ndarray:
        """Cells for the trigrams of pairs, given both words' counts; 1: they stand in the pair's own."""
        return np.minimum(-(-np.minimum(c2, c3) // self.sizes.cell), SUBS - 1)


def histories(ids: np.ndarray, ends: np.ndarray, start: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each id and that before it; `start` before a text, `none` before that."""
    before, two = np.concatenate(([start], ids[:-1])), np.concatenate(([none, start], ids[:-2]))[: len(ids)]
    firsts = np.concatenate(([0], ends[:-1]))
    before[firsts], two[firsts] = start, none
    seconds = firsts[firsts + 1 < ends] + 1
    two[seconds] = start
    return before, two


def opened(model: Model) -> tuple[Vocabulary, common.Opened]:
    """The words, and of each cell what its codes of P(w3 | w2) stand for (2 KB)."""

    def book(cell: int) -> np.ndarray:
        return np.array(read_arrays(f"{model.folder}/book-{cell}")[0]["book"])

    return common.held(model.folder, lambda: (Vocabulary(model.folder, len(model.shards), model.shards, model.sizes.open), common.Opened(book, 1 << 14)))


def steps(w2: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs in order as steps from one to the next, mostly small: from a new w2 on, w3 starts at zero."""
    second = np.diff(w3, prepend=0)
    new = heads_of(w2)
    second[new] = w3[new]
    return np.diff(w2, prepend=0), second


def walked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of such steps."""
    new = first > 0
    new[0] = True
    at = np.cumsum(second, dtype=np.int64)
    return np.cumsum(first, dtype=np.uint32), (at - (at - second)[new][np.cumsum(new) - 1]).astype(np.uint32)


def heads_of(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def order_of(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, then by the next: as one number, of which the part before is ranked where it gets too long."""
    key, used = np.zeros(len(keys[0]), np.int64), 0
    for k in keys:
        b = int(k.max(initial=0)).bit_length()
        if used + b > 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            used = int(key.max(initial=0)).bit_length()
        key <<= b
        key |= k.astype(np.int64, copy=False)
        used += b
    return np.argsort(key)


def by_cell(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by cell, in which rows of one keep theirs; where each cell begins and, last, where all end)."""
    low = cell - cell.min(initial=1 << 62)
    order = np.argsort(low.astype(np.uint16) if low.max(initial=0) < 1 << 16 else low, kind="stable")
    return order, np.append(np.flatnonzero(heads_of(cell[order])), len(cell))


class Ngrams:
    """The tokens of a chunk, and the distinct n-grams (w1 w2 w3) that they ask the cells for.

    Of a token whose word or word before is unknown nothing is asked; w1 is `none` where it is unknown or there is none.
    """

    def __init__(self, model: Model, vocabulary: Vocabulary, lengths: np.ndarray, hashes: np.ndarray, flat: np.ndarray):
        # Words by their number in the chunk; after them the end, the start and none.
        self.start, none = len(hashes) + 1, len(hashes) + 2
        ids, counts = vocabulary.ids(np.append(hashes, np.uint64(END)))
        ids, self.counts = np.concatenate((ids, [model.words, model.words + 1])), np.concatenate((counts, [model.texts, 0]))
        self.at, self.ends = with_ends(flat, lengths, len(hashes))
        self.before, two = histories(self.at, self.ends, self.start, none)
        ranked = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[ranked] = np.arange(len(ids))
        known = ids >= 0
        self.asking = np.flatnonzero(known[self.at] & known[self.before])
        w2, w3, w1 = rank[self.before[self.asking]], rank[self.at[self.asking]], np.where(known, rank, rank[none])[two[self.asking]]
        order = order_of(w2, w3, w1)
        w2, w3, w1 = w2[order], w3[order], w1[order]
        new = heads_of(w2, w3, w1)
        self.heads, self.order = np.flatnonzero(new), order
        #: The distinct n-gram of each token that asks.
        self.who = np.empty(len(order), np.int64)
        self.who[order] = np.cumsum(new) - 1
        local = [ranked[x[self.heads]] for x in (w2, w3, w1)]
        self.w2, self.w3, self.w1 = (ids[x] for x in local)
        self.c2, self.c3 = self.counts[local[0]], self.counts[local[1]]
        # A pair that may be too frequent stands in its cell by itself, its trigrams in further ones.
        cell, subs = model.cells(self.w2, self.w3)[0] * SUBS, model.parts(self.c2, self.c3)
        hot = np.flatnonzero((subs > 1) & (self.w1 <= model.words))
        self.asked = np.concatenate((np.arange(len(cell)), hot))
        cell = np.concatenate((cell, cell[hot] + 1 + self.w1[hot] % subs[hot]))
        first = self.w1.copy()
        first[hot] = model.words + 1
        first = np.concatenate((first, self.w1[hot]))
        #: What is asked, in the order of the cells: the n-gram, its cell, its w1 there; and where each cell begins.
        place, self.cuts = by_cell(cell)
        self.asked, self.cell, self.first = self.asked[place], cell[place], first[place]

    def occurrences(self, trained: np.ndarray) -> np.ndarray:
        """How often each distinct n-gram occurs at tokens of training texts."""
        return np.add.reduceat(trained[self.asking][self.order].astype(np.int64), self.heads)

    def pairs(self) -> np.ndarray:
        """Where the pair of what is asked differs from the one before, or the cell does."""
        return heads_of(self.cell, self.w2[self.asked], self.w3[self.asked])


def count_ngrams(tokens: DataFrame, model: Model) -> None:
    """Count all trigrams in cells, write each cell's trie, and for each chunk a file of what the cells say of its n-grams."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = opened(model)[0]
        for _, held, lengths, hashes, flat, chunk in chunks_of(batches):
            grams = Ngrams(model, vocabulary, lengths, hashes, flat)
            if not len(grams.asked):
                continue
            n = grams.occurrences(np.repeat(~held, lengths + 1))[grams.asked]
            w2, w3, w1 = grams.w2[grams.asked], grams.w3[grams.asked], grams.first
            cuts = grams.cuts.tolist()
            data = [squeezed(planes(np.concatenate((*steps(w2[a:b], w3[a:b]), w1[a:b], n[a:b])))) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(grams.cell[grams.cuts[:-1]]), pa.array(np.full(len(data), chunk)), pa.array(data, pa.binary())], ["part", "chunk", "asked"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = opened(model)[0]
        for cell, rows in common.grouped(batches):
            asked = [unplanes(released(r.pop("asked"))).reshape(4, -1) for r in rows]
            ends = np.cumsum([x.shape[1] for x in asked])
            w2, w3 = (np.concatenate(x) for x in zip(*(walked(x[0], x[1]) for x in asked), strict=True))
            w1, n = (np.concatenate([x[i] for x in asked]) for i in (2, 3))
            del asked
            firsts = np.zeros(len(w2), bool)
            firsts[np.concatenate(([0], ends[:-1]))] = True
            firsts |= heads_of(w2, w3)
            order = order_of(w2 - w2.min(), w3, w1)
            w1, w2, w3, n = w1[order], w2[order], w3[order], n[order]
            new = heads_of(w2, w3, w1)
            who = np.empty(len(order), np.int32)
            who[order] = np.cumsum(new, dtype=np.int32) - 1
            n = np.add.reduceat(n, np.flatnonzero(new), dtype=np.int64)
            w1, w2, w3 = (x[new].astype(np.int64) for x in (w1, w2, w3))
            del order, new
            p2, b2, q3 = answers(model, vocabulary, cell, w1, w2, w3, n)
            q3, firsts = q3[who], np.flatnonzero(firsts)
            p2, b2 = p2[who[firsts]], b2[who[firsts]]
            cuts = np.concatenate(([0], np.searchsorted(firsts, ends))).tolist()
            ends = [0, *ends.tolist()]
            said = [squeezed(b2[a:b].tobytes() + q3[c:d].tobytes() + p2[a:b][b2[a:b] >= ROUNDED].tobytes()) for a, b, c, d in zip(cuts, cuts[1:], ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([cell] * len(rows), pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(said, pa.binary()),
            ], ["chunk", "part", "pairs", "said"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in common.grouped(batches):
            said = [(r["pairs"], np.frombuffer(released(r.pop("said")), np.uint8)) for r in rows]
            ends = [len(x) - np.count_nonzero(x[:n] >= ROUNDED) for n, x in said]
            arrays = {
                "b2": [x[:n] for n, x in said], "q3": [x[n:end] for (n, x), end in zip(said, ends, strict=True)], "p2": [x[end:] for (_, x), end in zip(said, ends, strict=True)],
            }
            write_arrays(f"{model.folder}/said-{chunk}", {k: np.frombuffer(squeezed(np.concatenate(v).tobytes()), np.uint8) for k, v in arrays.items()}, {})
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64())], ["chunk"])

    asked = tokens.mapInArrow(ask, "part long, chunk long, asked binary").repartition("part").sortWithinPartitions("part")
    said = asked.mapInArrow(build, "chunk long, part long, pairs long, said binary").repartition("chunk").sortWithinPartitions("chunk", "part")
    common.stored(said.mapInArrow(assemble, "chunk long"), "lm-cells")


def answers(model: Model, vocabulary: Vocabulary, cell: int, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Write the trie of a cell's distinct n-grams in order; for each the codes of (P(w3 | w2), c(w2 w3), c(w1 w2 w3)) as the trie has them.

    A count of zero, which has the code 0, says that the trie has none.
    """
    met = n > 0  # the others are asked for only
    if not met.any():
        return *np.zeros((3, len(n)), np.uint8),
    trie = write_cell(model, vocabulary, cell, w1[met], w2[met], w3[met], n[met])
    band = model.band_of(cell // SUBS)
    new = heads_of(w2, w3)
    back = np.cumsum(new) - 1
    place, p2, b2 = trie.pairs(w2[new] - model.bands[band], w3[new] // model.columns[band])
    q3 = trie.triples(place[back], np.where(w1 <= model.words, w1, -1))
    if cell % SUBS:  # it holds a part of each pair
        return *np.zeros((2, len(n)), np.uint8), q3
    return p2[back], b2[back], q3


def relative(context: np.ndarray, ids: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """(pointers of the contexts, increasing sequence of their ids) for rows sorted by context and id.

    Each id + 1 is added to the last value of the context before.
    """
    pointers = np.searchsorted(context, np.arange(contexts + 1))
    top = np.zeros(contexts, np.int64)
    full = pointers[1:] > pointers[:-1]
    top[full] = ids[pointers[1:][full] - 1] + 1
    base = np.cumsum(top) - top
    return pointers, base[context] + ids + 1


def write_cell(model: Model, vocabulary: Vocabulary, cell: int, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray) -> Cell:
    """The trie of distinct n-grams that are in order, with their counts."""
    heads = np.flatnonzero(np.concatenate(([True], (w3[1:] != w3[:-1]) | (w2[1:] != w2[:-1]))))
    pairs, c2, c3 = np.add.reduceat(n, heads), w2[heads], w3[heads]
    entry = np.cumsum(np.concatenate(([0], (w3[1:] != w3[:-1]) | (w2[1:] != w2[:-1]))))
    kept = w1 <= model.words  # not those without a word before the context
    band = model.band_of(cell // SUBS)
    low = model.bands[band]
    contexts = model.bands[band + 1] - low
    pointers2, sequence2 = relative(c2 - low, c3 // model.columns[band], contexts)
    pointers3, sequence3 = relative(entry[kept], w1[kept], len(heads))
    context_counts = np.where(c2 < model.words, 0, model.texts)
    known = c2 < model.words
    context_counts[known] = vocabulary.counts(c2[known])
    by_word = np.argsort(c3, kind="stable")
    word_counts = np.empty(len(c3), np.int64)
    word_counts[by_word] = vocabulary.counts(c3[by_word])
    p = np.log10((pairs + M2 * (word_counts + 1) / model.floor) / (context_counts + M2))
    # 256 bins of equal width, each with the mean of its values: no value is off by more than that width.
    edges = np.linspace(p.min(), p.max(), 257)[1:-1]
    code = np.searchsorted(edges, p, side="right")
    book = np.bincount(code, p, 256) / np.maximum(np.bincount(code, minlength=256), 1)
    arrays: dict[str, np.ndarray] = {"book": book, "p2": code.astype(np.uint8), "b2": count_code(pairs), "q3": count_code(n[kept])}
    facts = {}
    for name, values in (("pointers2", pointers2), ("sequence2", sequence2), ("pointers3", pointers3), ("sequence3", sequence3)):
        parts, facts[name] = EliasFano.build(values)
        arrays |= {f"{name}.{k}": v for k, v in parts.items()}
    write_arrays(f"{model.folder}/cell-{cell}", arrays, facts)
    write_arrays(f"{model.folder}/book-{cell}", {"book": book}, {})  # which all chunks read
    return Cell(arrays, facts)


class Cell:
    """One trie."""

    def __init__(self, a: dict[str, np.ndarray], facts: dict):
        self.p2, self.b2, self.q3 = a["p2"], a["b2"], a["q3"]
        self.pointers2, self.sequence2, self.pointers3, self.sequence3 = (EliasFano(a, x, *facts[x]) for x in ("pointers2", "sequence2", "pointers3", "sequence3"))

    @staticmethod
    def successor(pointers: EliasFano, sequence: EliasFano, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The place of each id among the successors of its context, or -1; contexts are in order."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        some, back = context[new], np.cumsum(new) - 1
        first, last = pointers.access_pairs(some)
        base = np.zeros(len(some), np.int64)
        later = first > 0
        base[later] = sequence.access(first[later] - 1)
        place = sequence.find(base[back] + ids + 1)
        return np.where((place >= first[back]) & (place < last[back]), place, -1)

    def pairs(self, w2: np.ndarray, w3: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, codes of P(w3 | w2) and c(w2 w3)) of distinct pairs in order, as the cell has them."""
        at = self.successor(self.pointers2, self.sequence2, w2, w3)
        hit = np.flatnonzero(at >= 0)
        p2, b2 = np.zeros((2, len(at)), np.uint8)
        p2[hit], b2[hit] = self.p2[at[hit]], self.b2[at[hit]]
        return at, p2, b2

    def triples(self, at: np.ndarray, w1: np.ndarray) -> np.ndarray:
        """The code of c(w1 w2 w3) for places of pairs, in order, and the words before them."""
        out = np.zeros(len(at), np.uint8)
        some = np.flatnonzero((at >= 0) & (w1 >= 0))
        below = self.successor(self.pointers3, self.sequence3, at[some], w1[some])
        out[some[below >= 0]] = self.q3[below[below >= 0]]
        return out


def score_chunk(model: Model, vocabulary: Vocabulary, books: common.Opened, lengths: np.ndarray, hashes: np.ndarray, flat: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, known tokens, base score, score) of each text."""
    grams = Ngrams(model, vocabulary, lengths, hashes, flat)
    starts = np.concatenate(([0], grams.ends[:-1]))
    base = np.log10((grams.counts + 1) / model.floor)[grams.at]
    p = np.log10(M2 / (grams.counts + M2))[grams.before] + base  # a pair that was never seen
    pairs, triples = np.zeros(len(base), np.uint8), np.zeros(len(base), np.uint8)
    if len(grams.asked):
        said = {k: np.frombuffer(released(v.tobytes()), np.uint8) for k, v in read_arrays(f"{model.folder}/said-{chunk}")[0].items()}
        own, (seen, three) = np.full(len(grams.heads), np.nan), np.zeros((2, len(grams.heads)), np.uint8)
        pair, base_cells = grams.pairs(), grams.cell % SUBS == 0
        rounded, log_p = np.flatnonzero(said["b2"] >= ROUNDED), np.full(len(said["b2"]), np.nan)
        cell = grams.cell[pair][rounded]
        names, which = np.unique(cell, return_inverse=True)
        if len(names):
            log_p[rounded] = np.stack([books[c] for c in names.tolist()])[which, said["p2"]]
        back, at = (np.cumsum(pair) - 1)[base_cells], grams.asked[base_cells]
        own[at], seen[at], three[at] = log_p[back], said["b2"][back], said["q3"][base_cells]
        exact = np.flatnonzero((seen > 0) & (seen < ROUNDED))
        own[exact] = np.log10((COUNTS[seen[exact]] + M2 / model.floor * (grams.c3[exact] + 1)) / (grams.c2[exact] + M2))
        three[grams.asked[~base_cells]] = said["q3"][~base_cells]  # those of hot pairs, which stand in further cells
        pairs[grams.asking], triples[grams.asking] = seen[grams.who], three[grams.who]
        met = seen[grams.who] > 0
        p[grams.asking[met]] = own[grams.who[met]]
    contexts = np.concatenate((pairs[:1], pairs[:-1]))  # c(w1 w2): that of the token before
    score = np.log10(M3 / (COUNTS + M3))[contexts] + np.log10(COUNTS[triples] / M3 + 10**p)
    score[starts] = p[starts]
    add = lambda x: np.add.reduceat(x, starts)
    return grams.ends - starts, add((grams.counts[grams.at] > 0).astype(np.int64)), add(base), add(score)


def train(tokens: DataFrame, sizes: Sizes = Sizes()) -> Model:
    """Count the texts of `tokenised` that are not held out and write the trie, and what it says of all texts, into the shared folder."""
    spark = tokens.sparkSession
    common.make_folder(folder := common.new_folder(spark, "lm"))
    facts = tokens.agg(F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)).alias("texts"), F.coalesce(F.sum(F.length("flat")), F.lit(0)).alias("bytes")).first()
    shards = 1 << max(4, (facts["bytes"] * 3 // 2 // sizes.shard).bit_length())  # four bytes a word of some six characters
    model = Model(folder, count_words(tokens, folder, shards, sizes), facts["texts"], sizes)
    if model.tokens:
        count_ngrams(tokens, model)
    return model


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, sizes: Sizes = Sizes()) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score); learnt from rows outside the fold."""
    tokens = tokenised(docs, crc_of(key) % folds == fold, key=key, text=text, sizes=sizes)
    model = train(tokens, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, books = opened(model)
        for keys, held, lengths, hashes, flat, chunk in chunks_of(batches):
            n, known, base, score = score_chunk(model, vocabulary, books, lengths, hashes, flat, chunk)
            yield pa.RecordBatch.from_arrays([
                keys, pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(keys), model.tokens)), pa.array(base), pa.array(score),
            ], [key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return tokens.mapInArrow(run, schema)
