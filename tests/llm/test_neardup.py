from __future__ import annotations

import random

import numpy as np
import pytest

from sparrowgrid.llm import neardup
from sparrowgrid.llm.decontaminate import hashes, words_of
from sparrowgrid.llm.simhash import fingerprint

from .conftest import SCHEMA


def own_words(rng: random.Random, n: int) -> list[str]:
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def jaccard(a: str, b: str) -> float:
    x, y = (set(hashes(words_of(t.encode()), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def groups(spark, texts: list[str]) -> list[int]:
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], SCHEMA)
    found = {r["doc_id"]: r["component_id"] for r in neardup.groups(docs).collect()}
    return [found[k] for k in range(len(texts))]


def test_pairs_under_a_common_passage(spark):
    """Documents that share bands with many others by a licence passage, and are near copies of one only."""
    rng = random.Random(12)
    passage, texts = own_words(rng, 120), []
    for _ in range(500):
        own = own_words(rng, 40)
        copy = list(own)
        for at in (9, 20, 31):
            copy[at] = own_words(rng, 1)[0]
        texts += [" ".join(passage + own), " ".join(passage + copy)]
    assert all(jaccard(texts[k], texts[k + 1]) >= 0.8 > jaccard(texts[k], texts[k - 1]) for k in range(0, len(texts), 2))
    found = groups(spark, texts)
    assert [k for k in range(0, len(texts), 2) if found[k] != found[k + 1]] == []
    assert len(set(found)) > 480  # SimHash may link a few more


def test_texts_of_one_fingerprint_are_searched_each(spark):
    """Texts under one repeated line share a fingerprint; a near copy of the second is no near copy of the first."""
    rng = random.Random(6)
    line = own_words(rng, 5) * 400
    first, second = own_words(rng, 60), own_words(rng, 60)
    third = " ".join(second + ["end"])
    texts = [" ".join(first + line), " ".join(second + line), third]
    assert jaccard(texts[1], third) >= 0.8 > jaccard(texts[0], third)
    assert len({fingerprint(words_of(t.encode()), 3) for t in texts[:2]}) == 1
    assert groups(spark, texts) == [0, 0, 0]


@pytest.mark.parametrize("sides", [(512, 8 << 20), (3, 8 << 20), (512, 2000)])
def test_all_cells_of_a_band_are_met(spark, monkeypatch, sides):
    """Against all pairs, with cells of a few members: one band of two chains of revisions and further members."""
    monkeypatch.setattr(neardup, "SIDE", sides[0])
    monkeypatch.setattr(neardup, "SIDE_BYTES", sides[1])
    rng = random.Random(3)
    sets = [np.unique(np.array(rng.sample(range(100), 40), np.uint64)) for _ in range(8)]
    for k in range(30):
        new = sets[k].copy()
        new[rng.randrange(len(new))] = 1000 + k
        sets.append(np.unique(new))
    close = [(a, b) for a in range(len(sets)) for b in range(a) if len(both := np.intersect1d(sets[a], sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(both))]
    nodes = list(range(len(sets)))
    c = [0 if k in (0, 8, 16, 24) else k for k in nodes]
    shared = spark.createDataFrame([(7, k) for k in nodes] + [(9, k) for k in nodes[:5]], "band long, node long")
    found = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "node long, s binary")
    edges = neardup.remaining(shared, spark.createDataFrame(list(zip(nodes, c, strict=True)), "node long, c long"), found, 0.8)

    def components(pairs) -> list[int]:
        label = list(c)
        for a, b in pairs:
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
        return label

    assert components([(r["a"], r["b"]) for r in edges.collect()]) == components(close)
