from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from sparrowgrid.llm import components, neardup, simhash

from .conftest import SCHEMA, prose, words_of


def brute_fingerprint(text: str | None) -> int:
    w = words_of(text)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    counts = [0] * 64
    for x in s:
        h = xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(s))


def brute_components(edges, nodes) -> dict:
    low = {n: n for n in nodes}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def linked(prints: dict, most: int = 2) -> dict:
    keys = sorted(prints)
    return brute_components([(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= most], keys)


def test_odd_documents(odd_docs, odd_texts):
    got = sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(odd_docs).where("doc_id is not null").collect())
    prints = [(k, brute_fingerprint(t)) for k, t in odd_texts if k is not None]
    nodes = {i: fp for i, (_, fp) in enumerate(prints)}
    groups = linked(nodes)
    least = defaultdict(lambda: 2**60)
    for i, (k, _) in enumerate(prints):
        least[groups[i]] = min(least[groups[i]], k)
    assert got == sorted((k, fp, least[groups[i]]) for i, (k, fp) in enumerate(prints))


def test_null_keys_keep_their_rows(odd_docs, odd_texts):
    out = simhash.near_duplicates(odd_docs)
    assert out.count() == len(odd_texts)
    assert sorted(r["fp"] % 2**64 for r in out.where("doc_id is null").collect()) == sorted(brute_fingerprint(t) for k, t in odd_texts if k is None)


def test_no_documents(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert neardup.keep_one(no_docs).count() == 0


def close_values(rng: random.Random, n: int) -> list[int]:
    """Dense clusters: many values that share most of their bits."""
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))] + [0]
    out = set()
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize(("n", "leaf", "most"), [(300, 16, 2), (400, 8, 2), (250, 32, 3), (300, 4, 1)])
def test_links_of_dense_clusters(spark, n, leaf, most):
    """Small leaves force many levels of splits; components must still be exact."""
    values = close_values(random.Random(n + leaf), n)
    signed = [v - (v >> 63 << 64) for v in values]
    edges = [tuple(r) for r in simhash.links(spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, rep long"), most, leaf).collect()]
    assert all((values[a] ^ values[b]).bit_count() >= 0 for a, b in edges)
    want = linked(dict(enumerate(values)), most)
    assert brute_components(edges, range(n)) == want


def test_gray_links_are_all_pairs():
    values = np.array(close_values(random.Random(1), 500), np.uint64)
    values = values[np.argsort(simhash.gray_rank(values), kind="stable")]
    got = {(int(x), int(y)) for a, b in simhash.gray_links(values, 2) for x, y in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(500) for j in range(i + 1, 500) if (int(values[i]) ^ int(values[j])).bit_count() <= 2}


def test_gray_rank_is_the_reflected_sequence():
    order = np.array([i ^ i >> 1 for i in range(64)], np.uint64)
    assert simhash.gray_rank(order).tolist() == list(range(64))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute_components(edges, {x for e in edges for x in e})
    assert got == {n: c for n, c in want.items() if n in got} and {n for n, c in want.items() if n != c} <= set(got)
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a: str, b: str) -> float:
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words_of(a), words_of(b)))
    return len(x & y) / len(x | y)


def test_near_copies_are_found_and_others_stay(spark):
    rng = random.Random(11)
    texts = {}
    for g in range(40):
        base = prose(rng, rng.randint(60, 400)).split()
        texts[100 * g] = " ".join(base)
        for c in range(1, rng.randint(2, 6)):
            copy = list(base)
            for _ in range(len(base) // 120 + (c > 2)):
                copy[rng.randrange(len(copy))] = "changed"
            texts[100 * g + c] = " ".join(copy)
    keys = sorted(texts)
    prints = {k: brute_fingerprint(texts[k]) for k in keys}
    edges = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2 or jaccard(texts[a], texts[b]) >= 0.8]
    want = brute_components(edges, keys)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], SCHEMA)
    assert {r["doc_id"]: r["component_id"] for r in neardup.groups(docs).collect()} == want
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, c in want.items() if k == c)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(12)
    base = prose(rng, 200).split()
    texts = []
    for i in range(600):
        copy = list(base)
        copy[i % 200] = f"w{i}"
        texts.append((i, " ".join(copy), "en", "s", 0))
    assert [r["doc_id"] for r in neardup.keep_one(spark.createDataFrame(texts, SCHEMA)).collect()] == [0]


def test_copies_that_are_close_to_the_original_only(spark):
    rng = random.Random(14)
    base = prose(rng, 200).split()
    texts = {7: " ".join(base)}
    for i in range(40):
        copy = list(base)
        for at in rng.sample(range(0, 200, 6), 3):
            copy[at] = f"edit{i}"
        texts[100 + i if i % 2 else -100 - i] = " ".join(copy)
    assert sum(jaccard(texts[101], t) >= 0.8 for t in texts.values()) < 20 and all(jaccard(texts[7], t) >= 0.8 for t in texts.values())
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], SCHEMA)
    assert [r["doc_id"] for r in neardup.keep_one(docs).collect()] == [min(texts)]


def test_keep_one_of_odd_documents(odd_docs, odd_texts):
    kept = neardup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(None) == 2  # rows without a key stay
    assert {4, 5, 6, 11, 12, 13, 15, -3, 2**40, 16, 17} <= set(ids)
    assert sorted({1, 2, 3, 7, 9, 10} & set(ids)) == [1, 10]  # of the two rows with key 10 one is a copy
    assert {4, 5, 6, 8} <= set(ids) and ids.count(10) == 1
