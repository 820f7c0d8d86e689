from __future__ import annotations

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparrowgrid.llm import idcodec, tokenfiles

from .conftest import SCHEMA, prose

PATH = P.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60) | st.integers(0, 50256), max_size=700))
def test_any_ids_come_back(ids):
    data = idcodec.encode_block(np.array(ids, np.int64), 50257)
    assert idcodec.decode_block(data).tolist() == ids


@pytest.mark.parametrize("n", [1, 63, 64, 65, 4095, 70_001, 300_000])
def test_lengths_around_the_lanes(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50256)
    data = idcodec.encode(ids, 50257)
    assert np.array_equal(idcodec.decode(data), ids)


def test_constant_and_extreme_ids():
    for ids in ([50256] * 9000, [0] * 9000, [0, 50256] * 4000, list(range(5000))):
        assert idcodec.decode(idcodec.encode(np.array(ids), 50257)).tolist() == ids
    assert idcodec.decode(idcodec.encode(np.zeros(0, np.int64), 10)).tolist() == []
    assert len(idcodec.encode(np.full(100_000, 7), 50257)) < 30_000


def test_many_blocks(monkeypatch):
    monkeypatch.setattr(idcodec, "BLOCK", 1000)
    ids = np.random.default_rng(0).integers(0, 90, 4321)
    assert np.array_equal(idcodec.decode(idcodec.encode(ids, 90)), ids)


def test_damage_is_told():
    data = bytearray(idcodec.encode_block(np.arange(3000) % 77, 100))
    with pytest.raises(ValueError, match="cut short"):
        idcodec.decode_block(bytes(data[:-2]))
    data[-40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        idcodec.decode_block(bytes(data))
    with pytest.raises(ValueError, match="not a block"):
        idcodec.decode_block(b"nothing of the kind")
    with pytest.raises(ValueError, match="too large"):
        idcodec.encode_block(np.zeros(4, np.int64), 1 << 23)


def expected(pairs, end: int) -> list[tuple]:
    library = Tokenizer.from_file(PATH)
    out, at = [], 0
    for key, text in pairs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((key, at, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_of_unique_keys(spark, tmp_path):
    rng = random.Random(2)
    pairs = [(k, prose(rng, rng.choice([0, 1, 50, 900]))) for k in range(-5, 120)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rng.sample(pairs, len(pairs))], SCHEMA).repartition(5)
    tokenfiles.write(docs, PATH, str(tmp_path / "f"), end_id=2)
    out = tokenfiles.read(spark, str(tmp_path / "f"), with_ids=True).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out) == expected(pairs, 2)
    assert all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in out)


def test_files_of_odd_documents(odd_docs, odd_texts, spark, tmp_path):
    tokenfiles.write(odd_docs, PATH, str(tmp_path / "f"), end_id=2)
    out = tokenfiles.read(spark, str(tmp_path / "f")).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))  # no gap
    order = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda k: (k is not None, k or 0))
    assert sorted((r["doc_id"] or -9, r["n_tokens"], r["ids_crc32"]) for r in out) == sorted((k or -9, n, c) for k, _, n, c in expected(odd_texts, 2))


def test_strings_of_added_tokens_are_those_tokens(spark, tmp_path):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>  <|endoftext|>\n x", " <|endoftext|> ", "<|endof text|> <|ENDOFTEXT|>"]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)
    tokenfiles.write(docs, PATH, str(tmp_path / "f"), end_id=2)
    out = sorted(tuple(r) for r in tokenfiles.read(spark, str(tmp_path / "f")).collect())
    assert out == expected(list(enumerate(texts)), 2) and out[0][2:] == (5, 1604150396)


def test_rows_are_cut(monkeypatch, odd_docs, spark, tmp_path):
    monkeypatch.setattr(tokenfiles, "ROW_CHARS", 10)
    tokenfiles.write(odd_docs.coalesce(1), PATH, str(tmp_path / "f"), end_id=2)
    assert tokenfiles.read(spark, str(tmp_path / "f")).count() == odd_docs.count()


def test_no_documents(no_docs, spark, tmp_path):
    tokenfiles.write(no_docs, PATH, str(tmp_path / "f"), end_id=2)
    assert tokenfiles.read(spark, str(tmp_path / "f")).count() == 0


PARTS = [*"abZ\u00e9\u00d7\u00aa\u00b0\u0101\u024f\u0250\u0436\u4e2d\u3042\u00a0\u0085\u2003\u2028\u200b\u3000\u0301\u0e33\x00\x1c\x1f09\u0663\u2167'\u2019\u201c.,;!-|<>\t\r\v\f", " ", " ", " ", "\n", "  ", "\r\n", "'s", "'re", " '", " word", "Hello", "<|endoftext|>", "<|endof", "text|>", "\U0001f600"]
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return tokenfiles.LibraryEncoder(f.read())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join) | st.text(max_size=12), max_size=8), st.sampled_from([pa.string(), pa.large_string()]), st.integers(0, 2))
def test_cut_texts_have_the_ids_of_whole_ones(encoder, texts, kind, first):
    ids, ends = encoder.encode(pa.array(texts, kind)[first:])
    assert [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts[first:]]


def test_a_table_that_is_trimmed(encoder, monkeypatch):
    monkeypatch.setattr(tokenfiles, "KEPT", 40)
    rng = random.Random(4)
    for _ in range(12):
        texts = [prose(rng, 60), "", "\n\n x " + prose(rng, 5)]
        ids, ends = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_plain_words_skip_the_split():
    """The library's split takes longer than its merges; words of prose are single matches, which its model takes as they are."""
    with open(PATH, encoding="utf-8") as f:
        watched = tokenfiles.LibraryEncoder(f.read())
    split = []

    class Library:
        def encode_batch_fast(self, texts, **options):
            split.extend(texts)
            return LIBRARY.encode_batch_fast(texts, **options)

    watched.library = Library()
    texts = ["Some words, \u00e9t\u00e9 and words.\nMore (12) words; the last.", "It's so", "\u0441\u043b\u043e\u0432\u0430, \u03ba\u03b1\u03b9 \u8a9e\u3002"]
    assert watched.encode(pa.array(texts))[0].tolist() == [i for t in texts for i in LIBRARY.encode(t, add_special_tokens=False).ids]
    assert split == ["It's"]


def test_blocks_stay_as_they_were():
    ids = np.minimum(np.random.default_rng(7).zipf(1.3, 90_001), 50256)
    assert crc32(idcodec.encode(ids, 50257)) == 3785674306
