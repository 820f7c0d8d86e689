from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowgrid.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k: int = 20) -> dict:
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    d = len(good[0][1])
    good = [(i, v) for i, v in good if len(v) == d]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = np.zeros(len(x))
            for c in range(d):
                s += x[:, c] * v[c]
            best = sorted((-s[j], int(ids[j])) for j in range(len(x)) if ids[j] != i)[:k]
            out[i] = [(r + 1, j, -t) for r, (t, j) in enumerate(best)]
    return out


def found(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("n", "d", "spread"), [(3000, 24, 0.3), (3000, 24, 3.0), (2000, 8, 1.0), (6000, 64, 30.0)])
def test_recall(spark, n, d, spread):
    rng = np.random.default_rng(n + d)
    centres = rng.normal(size=(25, d))
    x = (centres[rng.integers(0, 25, n)] + spread * rng.normal(size=(n, d))) * rng.uniform(0.5, 1.5, (n, 1))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    got, want = found(ann.search(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0)), brute(rows)
    assert set(got) == set(want) and all([r for r, *_ in got[q]] == list(range(1, 21)) for q in got)
    hits = sum(len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    scores = {(q, j): s for q in want for _, j, s in want[q]}
    assert all(scores.get((q, j), s) == s for q in got for _, j, s in got[q])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [1.0, 1.0]), (9, [1.0, 1.0]), (10, [1.0, -1.0]), (20, [0.5, 0.5]), (40, [0.0, 0.0]), (None, [1.0, 1.0]), (-20, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "q", "list", "n", "d", "score", "rank")})
    assert found(ann.search(df, F.col("vec_id") % 20 == 0, recall=1.0)) == brute(rows)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ann.search(empty, F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0, 2.0], 0)], SCHEMA)
    assert ann.search(one, F.col("vec_id") % 20 == 0).count() == 0


def test_one_vector_many_times(spark, monkeypatch):
    """A list far beyond PART is dealt out, and all of it is searched."""
    monkeypatch.setattr(ann, "PART", 100)
    rows = [(i, [1.0, 1.0, 0.0]) for i in range(1500)] + [(1500 + i, [float(i % 7), 1.0, 2.0]) for i in range(500)]
    got = found(ann.search(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0, recall=1.0))
    assert got == brute(rows)


def test_the_graph_finds_the_nearest():
    rng = np.random.default_rng(0)
    centres, x = rng.normal(size=(900, 12)), rng.normal(size=(200, 12))
    ids, far = ann.Graph(centres).walk(x, 64)
    exact = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(axis=2))
    assert (ids[:, 0] == exact.argmin(axis=1)).mean() >= 0.95
    assert np.allclose(np.take_along_axis(exact, ids, 1), far) and (np.diff(far, axis=1) >= 0).all()
    assert all(len(set(r)) == len(r) for r in ids.tolist())


def test_many_lists_by_the_graph_and_outright(spark, monkeypatch):
    """Some 700 lists: the graph's walk loses little against comparing every centroid."""
    monkeypatch.setattr(ann, "LIST_ROWS", 8)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 16))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df, want = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), brute(rows)
    for outright in (False, True):
        got = found(ann.search(df, F.col("vec_id") % 20 == 0, outright=outright))
        hits = sum(len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want)
        assert set(got) == set(want) and hits / (20 * len(want)) >= 0.9


def test_exact_search(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(1500, 7)))] + [(20, [9.0] * 7), (20, [1.0] * 7), (1600, [9.0] * 7), (1601, [9.0] * 7), (1602, None), (None, [1.0] * 7), (1620, [0.0] * 7)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows[:1500] + rows[1502:]], SCHEMA)
    assert found(ann.exact_search(df, F.col("vec_id") % 20 == 0, block_bytes=500)) == brute(rows[:1500] + rows[1502:])
    repeated = found(ann.exact_search(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), F.col("vec_id") % 20 == 0))
    assert repeated.keys() == brute(rows).keys() and len(repeated[20]) == 20 and all(len({j for _, j, _ in r}) == len(r) for r in repeated.values())
    assert ann.exact_search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
