"""Byte-level BPE by merge replay over the corpus.

The distinct pieces of all texts are found once and dealt into shards by hash (see `pieces`). The words of a
shard lie in one flat symbol array. An inverted index takes each token pair to the positions where it stands; the
merges are applied in rank order, each to all its positions at once, and only the neighbours of a merged pair get new
postings. The ids then go back to the texts.

Defined results: a null text counts as empty (no ids); each row is encoded by itself, so repeated rows, null and
repeated keys give rows alike; where a pair stands twice in overlapping places the leftmost is merged first; texts of any length are
encoded whole; an empty table gives an empty result; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .pieces import Known, Sizes, encode_corpus, gathered

def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a rank file (base64 token, rank), a vocabulary of bounded size."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def direct(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word by the textbook loop: always the leftmost pair of lowest rank."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class MergeReplay:
    """Encodes many words at once; `tokens` are the vocabulary's byte strings by rank."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        keys, merged = [], []
        for i, t in enumerate(tokens):
            for k in range(1, len(t)):
                left, right = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int32)[order]
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, or -1."""
        if not len(self.keys):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one word after the other, and each word's number of ids."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        if not n:
            return symbols, lengths
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        full = lengths > 0
        after[ends[full] - 1] = -1
        before[(ends - lengths)[full]] = -1
        pair = np.full(n, -1, np.int32)  # what the pair that starts here merges to
        first = np.flatnonzero(after >= 0)
        pair[first] = self.pair_ranks(symbols[first], symbols[first + 1])
        postings: dict[int, list[np.ndarray]] = {}
        ahead: list[int] = []
        odd: list[np.ndarray] = []

        def post(at: np.ndarray, now: int) -> None:
            made = pair[at]
            held = made >= 0
            at, made = at[held], made[held]
            if not len(at):
                return
            early = made <= now
            if early.any():  # a merge that should have come before: such words are done one by one
                odd.append(at[early])
            order = np.argsort(made, kind="stable")
            at, made = at[order], made[order]
            cuts = np.flatnonzero(np.diff(made)) + 1
            for rank, part in zip(made[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if rank in postings:
                    postings[rank].append(part)
                else:
                    postings[rank] = [part]
                    heapq.heappush(ahead, rank)

        post(first, -1)
        while ahead:
            rank = heapq.heappop(ahead)
            lists = postings.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[pair[at] == rank]
            if not len(at):
                continue
            at.sort()
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            right = after[at]
            chained = right[:-1] == at[1:]
            if chained.any():  # as in "aaa": of overlapping pairs the leftmost goes first
                start = np.concatenate(([True], ~chained))
                index = np.arange(len(at))
                keep = (index - np.maximum.accumulate(np.where(start, index, 0))) % 2 == 0
                at, right = at[keep], right[keep]
            following = after[right]
            symbols[at] = rank
            symbols[right] = -1
            pair[right] = -1
            after[at] = following
            inner = following >= 0
            before[following[inner]] = at[inner]
            pair[at] = -1
            left, at = before[at], at[inner]
            left = left[left >= 0]
            pair[left] = -1
            touched = np.concatenate((left, at))
            if len(touched):
                pair[touched] = self.pair_ranks(symbols[touched], symbols[after[touched]])
                post(touched, rank)
        kept = symbols >= 0
        counts = np.zeros(len(words), np.int64)
        counts[full] = np.add.reduceat(kept, (ends - lengths)[full], dtype=np.int64)
        ids = symbols[kept]
        if odd:
            parts, at = [], np.cumsum(counts) - counts
            last = 0
            for w in np.unique(np.searchsorted(ends, np.concatenate(odd), side="right")).tolist():
                parts += [ids[last : at[w]], np.array(direct(words[w], self.ranks), np.int32)]
                last = at[w] + counts[w]
                counts[w] = len(parts[-1])
            ids = np.concatenate([*parts, ids[last:]])
        return ids, counts


#: How a piece begins that is as it stands in the text; others lack the space before them.
RAW = "  "


def pieces_of(text: str, cut: Callable[[str], list[str]]) -> list[str]:
    """Cut before single spaces between other characters; only a text with other white space, or runs of it, needs the pattern `cut` for that."""
    if not text:
        return []
    if len(text.split()) == text.count(" ") + text.count("\n") + 1 and text.replace("\n", "").isprintable():
        out = text.split(" ")
        out[0] = RAW + out[0]
        return out
    return [RAW + x for x in cut(text)]


class Encoder:
    """Texts to pieces, and pieces to ids.

    A single space between two other characters always starts a new match of the split pattern, so a text is first cut there.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.replay, self.split, self.cut = MergeReplay(tokens), regex.compile(pattern).findall, regex.compile(r"(?<=\S)(?= \S)", regex.V1).split

    def pieces(self, text: str) -> list[str]:
        return pieces_of(text, self.cut)

    def words(self, piece: str) -> list[str]:
        """The pattern's matches; a space and Latin letters, perhaps with a full stop or comma, need no search."""
        if piece[0] == " " and max(piece) < "\u0250":
            if piece[1:].isalpha():
                return [piece]
            if piece[-1] in ".," and piece[1:-1].isalpha():
                return [piece[:-1], piece[-1]]
        return self.split(piece)

    def learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and each one's number of ids."""
        per_piece = [self.words(p[2:] if p[:2] == RAW else " " + p) for p in pieces]
        words = Known()
        at = np.fromiter((words[w] for ws in per_piece for w in ws), np.int64)
        ids, counts = self.replay.encode([w.encode() for w in words])
        ids, ends = gathered(ids, (np.cumsum(counts) - counts)[at], counts[at])
        return ids, np.diff(np.concatenate(([0], ends))[np.cumsum([0, *map(len, per_piece)])])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """Per row: the key, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if asked for.

    `vocabulary` is read on the driver and broadcast: its size is bounded by the file (under 2 MB).
    """
    tokens = read_ranks(vocabulary)
    tag, shared = hashlib.sha256(repr(tokens).encode()).hexdigest(), docs.sparkSession.sparkContext.broadcast(tokens)
    rows, read = encode_corpus(docs, lambda: common.held((tag, pattern), lambda: Encoder(shared.value, pattern)), sizes, key=key, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for keys, pool, ends in read(batches):
            data, found = pool.astype("<u4"), list(pairwise([0, *ends.tolist()]))
            columns = [
                keys, pa.array(np.diff(ends, prepend=0)),
                pa.array([hashlib.sha256(data[a:b].tobytes()).hexdigest() for a, b in found], pa.string()),
                pa.array([hashlib.sha256(b"".join(map(names.__getitem__, data[a:b].tolist()))).hexdigest() for a, b in found], pa.string()),
            ]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(pool.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
