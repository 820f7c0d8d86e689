from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowgrid.llm import bpe, pieces

from .conftest import SCHEMA

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(PATH), P.PATTERN)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_documents_as_the_library_encodes_them(spark, odd_docs, odd_texts, library):
    want = []
    for k, t in odd_texts:
        ids = library.encode_ordinary(t or "")
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(bpe.encode_documents(odd_docs, PATH, P.PATTERN)) == sorted(want, key=repr)


def test_no_documents(no_docs):
    out = bpe.encode_documents(no_docs, PATH, P.PATTERN, with_ids=True)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\tab'sßé漢😀.,!19")), max_size=60), max_size=6))
def test_any_texts(library, encoder, texts):
    for text in texts:
        ids, counts = encoder.learn(encoder.pieces(text))
        assert ids.tolist() == library.encode_ordinary(text) and counts.sum() == len(ids)
        assert encoder.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdeinorst", max_size=30), max_size=20))
def test_replay_equals_the_textbook_loop(encoder, words):
    data = [w.encode() for w in words]
    ids, counts = encoder.replay.encode(data)
    assert counts.tolist() == [len(bpe.direct(w, encoder.replay.ranks)) for w in data]
    assert ids.tolist() == [i for w in data for i in bpe.direct(w, encoder.replay.ranks)]


def test_a_vocabulary_with_ranks_out_of_order():
    """Here "abc" must come before "ab" by rank, yet is made of it."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ab", b"abab"]
    replay = bpe.MergeReplay(tokens)
    for w in (b"abc", b"abab", b"ababc", b"abcabab", b"aabbcc"):
        ids, _ = replay.encode([w, w])
        assert ids.tolist() == bpe.direct(w, replay.ranks) * 2


def test_many_tables_chunks_and_shards(spark, odd_docs, odd_texts, library):
    """Small tables and shards: the same ids; each distinct piece of the corpus is encoded once."""
    out = bpe.encode_documents(odd_docs, PATH, P.PATTERN, with_ids=True, sizes=pieces.Sizes(table=40, chunk=300, shard=2000))
    want = [(k, library.encode_ordinary(t or "")) for k, t in odd_texts]
    assert sorted(((r["doc_id"], r["ids"]) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_a_piece_is_encoded_once_in_the_corpus(spark, library):
    docs = [(k, f"shared words here {k % 7} number{k}") for k in range(200)]
    table = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in docs], SCHEMA).repartition(5)
    seen = spark.sparkContext.accumulator(0)
    tokens = bpe.read_ranks(PATH)

    class Counted(bpe.Encoder):
        def learn(self, found):
            seen.add(len(found))
            return super().learn(found)

    rows, read = pieces.encode_corpus(table, lambda: Counted(tokens, P.PATTERN), pieces.Sizes(table=30, chunk=500), key="doc_id", text="text")
    assert rows.count() > 10 and seen.value == len({p for _, t in docs for p in Counted(tokens, P.PATTERN).pieces(t)})
