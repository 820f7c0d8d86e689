from __future__ import annotations

import glob
import math
import os
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowgrid import storage
from sparrowgrid.llm import common, eliasfano, lm

from .conftest import SCHEMA, prose, words_of

END = "\0end"


def held_out(k) -> bool:
    return crc32(("" if k is None else str(k)).encode()) % 7 == 2


def brute(docs) -> dict:
    """Exact counts and the same smoothing, without quantisation."""
    one, two, three, texts = Counter(), Counter(), Counter(), 0
    for k, t in docs:
        if not held_out(k):
            w = [*words_of(t), END]
            texts += 1
            one.update(w)
            two.update(zip(["<s>", *w], w, strict=False))
            three.update(zip(["<s>", *w], w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    context = Counter({**one, "<s>": texts})
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    p2 = lambda b, w: (two[b, w] + lm.M2 * p1(w)) / (context[b] + lm.M2)
    out = []
    for k, t in docs:
        w = [*words_of(t), END]
        total = 0.0
        for i, x in enumerate(w):
            b = w[i - 1] if i else "<s>"
            p = p2(b, x)
            if i:
                a = w[i - 2] if i > 1 else "<s>"
                p = (three[a, b, x] + lm.M3 * p) / (two[a, b] + lm.M3)
            total += math.log10(p)
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        out.append((k, held_out(k), len(w), sum(one[x] > 0 for x in w), n, base, total))
    return out


def check(df, docs):
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: (repr(r[:5]), r[5]))
    want = sorted(brute(docs), key=lambda r: (repr(r[:5]), r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=0.02, atol=0.1)  # one byte for each probability


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    vocabulary = prose(rng, 300).split()
    docs = []
    for k in range(700):
        words = [rng.choice(vocabulary)]
        for _ in range(rng.randint(0, 60)):
            words.append(vocabulary[(vocabulary.index(words[-1]) * 7 + rng.randint(0, 3)) % len(vocabulary)])
        docs.append((k, " ".join(words)))
    return docs


def table(spark, docs):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in docs], SCHEMA).repartition(4)


def test_scores(spark, corpus):
    check(lm.report(table(spark, corpus)), corpus)


def test_many_cells_and_batches(spark, corpus):
    check(lm.report(table(spark, corpus), sizes=lm.Sizes(cell=200, band=500, batch=300, words=60, chunk=400, open=5)), corpus)


def test_cells_answer_once(spark, corpus):
    """Texts are scored by what the cells said when they were built: no chunk opens a cell, however many there are."""
    folder = storage.shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/sparrowgrid/lm-*/cell-*"))
    df = lm.report(table(spark, corpus), sizes=lm.Sizes(cell=200, band=500, words=60, chunk=4000))
    cells = set(glob.glob(f"{folder}/sparrowgrid/lm-*/cell-*")) - before
    assert len(cells) > 50
    for path in cells:
        os.remove(path)
    check(df, corpus)


def test_a_hot_pair_is_dealt_over_cells(spark):
    """A context with a third of all tokens, and a pair in it: no cell gets more than a few times its share of n-grams."""
    rng, sizes = random.Random(12), lm.Sizes(cell=100, band=400, batch=5000)
    words = prose(rng, 500).lower().split()
    docs = [(k, " ".join(x for _ in range(rng.randint(1, 12)) for x in (rng.choice(words), "the", rng.choice(["of", *words[:40]])))) for k in range(600)]
    check(lm.report(table(spark, docs), sizes=sizes), docs)
    tokens = lm.tokenised(table(spark, docs), lm.crc_of("doc_id") % 7 == 2, key="doc_id", text="text", sizes=sizes)
    model = lm.train(tokens, sizes)
    cells = {int(n[5:]): lm.read_arrays(f"{model.folder}/{n}")[0] for n in os.listdir(model.folder) if n.startswith("cell-")}
    assert sum(c % lm.SUBS > 0 for c in cells) > 10 and model.columns.max() > 10
    # Pairs of one context in a cell cannot be split further; n-grams of one pair are.
    assert max(len(a["q3"]) for c, a in cells.items() if c % lm.SUBS) <= 3 * sizes.cell


def test_a_store_that_is_not_mounted(spark, corpus, monkeypatch):
    """Files are then written and fetched through the store's own interface."""
    monkeypatch.setattr(common, "local_path", lambda uri: None)
    monkeypatch.setattr(common, "new_folder", lambda spark, name, plain=common.new_folder: "file://" + plain(spark, name).removeprefix("file:"))
    check(lm.report(table(spark, corpus)), corpus)


def test_context_helps_on_held_out_texts(spark, corpus):
    rows = [r for r in lm.report(table(spark, corpus)).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.75 * sum(r["base_score"] for r in rows)


def test_odd_documents(spark, odd_docs, odd_texts, no_docs):
    check(lm.report(odd_docs), odd_texts)
    assert lm.report(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    """All rows are held out."""
    docs = [(k, "a b c") for k in range(200) if held_out(k)]
    rows = lm.report(table(spark, docs)).collect()
    assert len(rows) == len(docs) and {(r["n_known"], r["train_tokens"], r["base_score"]) for r in rows} == {(0, 0, 0.0)}
    assert all(math.isfinite(r["score"]) for r in rows)


def sequence(values):
    arrays, facts = eliasfano.EliasFano.build(np.array(values, np.int64))
    return eliasfano.EliasFano({f"x.{k}": v for k, v in arrays.items()}, "x", *facts)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 5000) | st.integers(0, 2**40), min_size=1, max_size=300), st.lists(st.integers(0, 6000) | st.integers(0, 2**41), max_size=50))
def test_elias_fano(values, probes):
    values = sorted(values)
    ef = sequence(values)
    assert ef.access(np.arange(len(values))).tolist() == values
    want = {v: i for i, v in enumerate(values)}
    probes = probes + values
    assert ef.find(np.array(probes, np.int64)).tolist() == [want.get(p, -1) for p in probes]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=200))
def test_pointers_may_repeat(values):
    values = sorted(values)
    assert sequence(values).access(np.arange(len(values))).tolist() == values


def test_array_files(tmp_path):
    arrays = {"a": np.arange(5, dtype="<u4"), "empty": np.zeros(0, "<f8"), "b": np.ones(3)}
    eliasfano.write_arrays(str(tmp_path / "x"), arrays, {"n": 3})
    back, facts = eliasfano.read_arrays(str(tmp_path / "x"))
    assert facts == {"n": 3} and all(np.array_equal(back[k], v) for k, v in arrays.items())
    (tmp_path / "y").write_bytes(b"0123456789abcdef0000")
    with pytest.raises(ValueError):
        eliasfano.read_arrays(str(tmp_path / "y"))
