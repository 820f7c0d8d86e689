"""Documents to files of token ids, and back.

Documents are dealt into ranges of their key and sorted, so that file after file holds them in ascending
order; each range becomes rows of whole documents: their keys and lengths, the number of ids before the row
in its range, and the ids as blocks of `idcodec`. The rows stand in Parquet, written by Spark's committer:
any store that Spark can write serves, and a lost executor's part is written again.

Defined results: a null or empty text has the end id only; texts of any length are encoded whole; rows with one key are ordered
by their text's hash, equal rows arbitrarily, which changes nothing; a null key comes first; an empty table gives files without
rows; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, idcodec
from .pieces import gathered

#: Bytes of text that make up a row of a file, and of those that are tokenised together.
ROW_CHARS, BATCH_CHARS = 2_400_000, 4_800_000
#: Pieces kept with their ids in a worker; beyond it those met only once go. Bytes that the library gets at once.
KEPT, JOINED = 400_000, 50_000
#: What a byte is to GPT-2's split pattern. UNSURE: perhaps white space; OTHER: not white space, but perhaps a letter, or an apostrophe.
UNSURE, LETTER, DIGIT, SIGN, OTHER, SPACE, BREAK = range(7)
_CLEAR = LETTER, DIGIT, SIGN
#: By the kinds of two neighbouring bytes: 1 if a match of the pattern always ends between them, 2 if it does behind a single BREAK.
BETWEEN = np.zeros((8, 8), np.uint8)
BETWEEN[[*_CLEAR, OTHER], SPACE] = BETWEEN[[*_CLEAR, OTHER], BREAK] = 1
for _kind in _CLEAR:
    BETWEEN[_kind, [k for k in _CLEAR if k != _kind]] = 1
    BETWEEN[BREAK, _kind] = 2
BETWEEN = BETWEEN.ravel()


def kind_of(c: str) -> int:
    """Beyond ASCII only what Unicode 3.2 and Python's tables agree on, so that the library's version of Unicode makes no difference."""
    if c in " '" or c in "\t\n\v\f\r":
        return {" ": SPACE, "'": OTHER}.get(c, BREAK)
    found = {unicodedata.category(c)[0], unicodedata.ucd_3_2_0.category(c)[0]}
    if "Z" in found or unicodedata.category(c)[0] == "C" or unicodedata.ucd_3_2_0.category(c) in ("Cc", "Cf"):
        return UNSURE
    return LETTER if found == {"L"} else DIGIT if found == {"N"} else SIGN if found <= {"M", "P", "S"} else OTHER


@cache
def kinds_by_code() -> np.ndarray:
    """The kinds of the characters below U+10000, and OTHER for those beyond."""
    return np.array([kind_of(chr(i)) for i in range(1 << 16)] + [OTHER], np.uint8)


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8; all bytes of a character have one."""
    table = kinds_by_code()
    kinds = np.concatenate((table[:128], np.full(128, OTHER, np.uint8)))[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        one, two, three = (data[np.minimum(lead + i, len(data) - 1)].astype(np.int32) for i in range(3))
        kind = table[np.where(one < 0xE0, (one & 31) << 6 | two & 63, np.where(one < 0xF0, (one & 15) << 12 | (two & 63) << 6 | three & 63, 1 << 16))]
        kinds[lead], kinds[lead + 1] = kind, kind
        long = np.flatnonzero(one >= 0xE0)
        kinds[lead[long] + 2] = kind[long]
    return kinds


def places_of(data: bytes, strings: list[bytes]) -> np.ndarray:
    """Where any of the strings begins, overlapping ones too."""
    out = []
    for x in strings:
        at = data.find(x)
        while at >= 0:
            out.append(at)
            at = data.find(x, at + 1)
    return np.array(out, np.int64)


class LibraryEncoder:
    """Texts to ids by the tokenizers library, which sees each distinct piece of text once while a bounded table holds it.

    Holds for tokenizers that, like GPT-2's, split by its pattern; `fits` tells, and others get whole texts. Texts are cut
    where a match of the pattern ends whatever stands around (`BETWEEN`).
    A piece that is a single match by its kinds goes to the library's model as it is, without the library's split, which takes
    longer than the merges; all others get the split too. Strings of added tokens become those tokens, as the library has it.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.library, parts = Tokenizer.from_str(definition), json.loads(definition)
        self.fits = self.cuts_at_spaces(parts)
        self.added = [t["content"].encode() for t in parts.get("added_tokens") or []]
        # A byte-level token has a sign for each byte; an added one is its own text.
        self.bytes = np.array([len(t or "") for t in map(self.library.id_to_token, range(self.library.get_vocab_size()))], np.int64)
        for i, t in self.library.get_added_tokens_decoder().items():
            self.bytes[i] = len(t.content.encode())
        if self.fits:
            # The same model for matches written in the signs of bytes; a space, which is no such sign, parts them.
            self.model = Tokenizer.from_str(json.dumps(parts | {"added_tokens": [], "post_processor": None, "decoder": None, "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}}))
            self.signs = byte_signs()
        self.forget()

    @staticmethod
    def cuts_at_spaces(definition: dict) -> bool:
        """Only a byte-level split without a normaliser or a prefix space, a model of merges that knows all bytes, and added tokens that no cut can touch."""
        split, model = definition.get("pre_tokenizer") or {}, definition["model"]
        if model.get("type") != "BPE" or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            return False
        if definition.get("truncation") or definition.get("padding") or not all(chr(x) in model["vocab"] for x in byte_signs().tolist()):
            return False
        added = definition.get("added_tokens") or []
        if any(len(t["content"].split()) != 1 or t["content"] != t["content"].strip() or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            return False
        return split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not definition.get("normalizer")

    def forget(self) -> None:
        self.known, self.uses = {}, np.zeros(0, np.int64)
        self.pool, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def trim(self) -> None:
        """Keep the pieces that were met more than once, at most half of the table."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > KEPT // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: KEPT // 2]])
        names = list(self.known)
        self.known = dict(zip(map(names.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        self.lengths, old = self.lengths[kept], self.starts[kept]
        self.pool, ends = gathered(self.pool, old, self.lengths)
        self.starts, self.uses = ends - self.lengths, np.zeros(len(kept), np.int64)

    def cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin in texts that stand one after the other."""
        begins = np.concatenate(([0], ends[:-1]))
        mark = np.zeros(len(data), np.uint8)
        if self.fits:
            kinds = kinds_of(data)
            mark[1:] = BETWEEN[kinds[:-1] << 3 | kinds[1:]]
            after = np.flatnonzero(mark == 2)
            mark[after] = (after > 1) & np.isin(kinds[after - 2], _CLEAR)
            for t in np.unique(np.searchsorted(ends, places_of(data.tobytes(), self.added), side="right")).tolist():
                mark[begins[t] : ends[t]] &= kinds[begins[t] : ends[t]] == SPACE  # cuts that no added token can hold
        mark[begins[begins < len(data)]] = 1
        return np.flatnonzero(mark.view(np.bool_))

    def matches(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which pieces are one match of the pattern by their kinds: a run of one clear kind, perhaps behind a space, or one white space."""
        kinds, begins = kinds_of(data), np.concatenate(([0], ends[:-1]))
        odd = np.ones(len(data), bool)
        odd[1:] = kinds[1:] != kinds[:-1]
        spaced = begins[kinds[begins] == SPACE]
        odd[begins] = odd[np.minimum(spaced + 1, len(data) - 1)] = False
        odd |= (kinds == UNSURE) | (kinds == OTHER)
        blank = kinds >= SPACE
        blank[begins] = False
        odd |= blank
        out = np.ones(len(ends), bool)
        out[np.searchsorted(ends, np.concatenate((np.flatnonzero(odd), places_of(data.tobytes(), self.added))), side="right")] = False
        return out

    def learn(self, pieces: list[bytes]) -> None:
        """Take up new pieces: single matches joined for the model, the others one by one with the library's split."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        plain = self.matches(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes)) if self.fits else np.zeros(len(pieces), bool)
        together, alone = np.flatnonzero(plain).tolist(), np.flatnonzero(~plain).tolist()
        order, ids, counts = np.array(together + alone, np.int64), [np.zeros(0, np.int32)], []
        for a, b in common.chunks(together, lambda i: len(pieces[i]), JOINED):
            own = np.frombuffer(b"".join([pieces[i] for i in together[a:b]]), np.uint8)
            ends = np.cumsum(sizes[together[a:b]])
            joined = np.insert(self.signs[own], ends[:-1], ord(" ")).astype("<u4").tobytes().decode("utf-32-le")
            found = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            counts.append(np.diff(np.searchsorted(np.cumsum(self.bytes[found]), ends) + 1, prepend=0))
            ids.append(found)
        for a, b in common.chunks(alone, lambda i: len(pieces[i]), JOINED):
            found = [e.ids for e in self.library.encode_batch_fast([pieces[i].decode() for i in alone[a:b]], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), np.int32, int(counts[-1].sum())))
        lengths = np.zeros(len(pieces), np.int64)
        lengths[order] = got = np.concatenate([np.zeros(0, np.int64), *counts])
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(got) - got
        self.starts, self.lengths = np.concatenate((self.starts, len(self.pool) + starts)), np.concatenate((self.lengths, lengths))
        self.pool = np.concatenate((self.pool, *ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's end."""
        if len(self.known) > KEPT:
            self.trim()
        texts.validate(full=True)  # raises if a text is not UTF-8
        held = texts.cast(pa.large_binary())
        ends = np.frombuffer(held.buffers()[1], np.int64, len(held) + 1, held.offset * 8)
        first, ends = int(ends[0]), ends[1:] - ends[0]
        if not len(ends) or not ends[-1]:
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        data = np.frombuffer(held.buffers()[2], np.uint8, int(ends[-1]), first)
        cuts = self.cuts(data, ends)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        if len(new := np.flatnonzero(number < 0)):
            number[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip(fresh := names[new].tolist(), number[new].tolist(), strict=True))
            self.learn(fresh)
        at = pieces.indices.to_numpy()
        uses = np.zeros(len(self.known), np.int64)
        uses[: len(self.uses)] = self.uses
        uses[number] += np.bincount(at, minlength=len(number))
        self.uses = uses
        ids, done = gathered(self.pool, self.starts[number][at], self.lengths[number][at])
        return ids, np.concatenate(([0], done))[np.searchsorted(cuts, ends)]


def byte_signs() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one of those from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = np.zeros(256, np.uint32)
    signs[seen] = seen
    signs[[b for b in range(256) if b not in seen]] = 256 + np.arange(256 - len(seen))
    return signs


def write(docs: DataFrame, vocabulary: str, folder: str, *, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, each followed by `end_id`. The tokenizer's file (a few MB) is broadcast."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    tag, shared = crc32(definition.encode()), spark.sparkContext.broadcast(definition)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = common.held(("idfiles", tag), lambda: LibraryEncoder(shared.value))
        size = max(tok.library.get_vocab_size(), end_id + 1)
        shard, sequence, before = TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size_of_row = 0

        def row() -> pa.RecordBatch:
            nonlocal sequence, before, keys, ids, lengths, size_of_row
            flat, names, counts = np.concatenate(ids), pa.concat_arrays(keys), np.concatenate(lengths)
            whole = pa.array([0, len(names)], pa.int32())
            out = pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([sequence], pa.int32()), pa.array([before], pa.int64()), pa.array([len(flat)], pa.int64()),
                pa.ListArray.from_arrays(whole, names), pa.ListArray.from_arrays(whole, pa.array(counts, pa.int64())), pa.array([idcodec.encode(flat, size)], pa.binary()),
            ], ["shard", "sequence", "before", "n_ids", "keys", "lengths", "blocks"])
            sequence, before, keys, ids, lengths, size_of_row = sequence + 1, before + len(flat), [], [], [], 0
            return out

        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for a, b in common.chunks(sizes, int, BATCH_CHARS):
                found, ends = tok.encode(batch.column(1)[a:b])
                ids.append(np.insert(found, ends, np.int32(end_id)))
                lengths.append(np.diff(ends, prepend=0) + 1)
                keys.append(batch.column(0)[a:b])
                size_of_row += sum(sizes[a:b])
                if size_of_row >= ROW_CHARS:
                    yield row()
        if keys:
            yield row()

    text_column = common.text_or_empty(text).alias("text")
    ranged = docs.select(key, text_column, F.xxhash64(text_column).alias("h")).repartitionByRange(key, "h").sortWithinPartitions(F.col(key).asc_nulls_first(), "h")
    schema = f"shard int, sequence int, before long, n_ids long, keys array<{kind}>, lengths array<long>, blocks binary"
    ranged.select(key, "text").mapInArrow(run, schema).write.option("compression", "none").parquet(folder)


def read(spark, folder: str, *, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of each document, from the files alone."""
    common.bound_batches(spark)
    files = spark.read.parquet(folder)
    kind = dict(files.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # a row for each range
    starts, at = {}, 0
    for r in totals:
        starts[r["shard"]] = at
        at += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = idcodec.decode(batch.column(4)[i].as_py()).astype("<u4")
                lengths = batch.column(3)[i].values.to_numpy()
                ends = np.cumsum(lengths)
                cuts = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                columns = [
                    batch.column(2)[i].values,
                    pa.array(starts[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py() + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([crc32(ids[a:b].tobytes()) for a, b in cuts], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int32) for a, b in cuts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [key, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.select("shard", "before", "keys", "lengths", "blocks").mapInArrow(run, schema)
