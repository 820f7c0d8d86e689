"""Random chains of operations against plain Python."""

from __future__ import annotations

import random

import pytest

from sparrowgrid import Frame, col

NAN, INF = float("nan"), float("inf")


def rows_of(rng: random.Random) -> list[dict]:
    pick = lambda values: None if rng.random() < 0.15 else rng.choice(values)
    return [{"a": pick([rng.uniform(-9, 9), 0.0, NAN, INF, -INF]), "b": pick(range(-30, 31)), "g": pick(["alpha", "beta", "gamma", "delta"]), "flag": pick([True, False])} for _ in range(rng.randint(0, 50))]


def step(rng: random.Random, f: Frame, rows: list[dict]) -> tuple[Frame, list[dict]]:
    kind, k = rng.randrange(9), rng.randint(-20, 20)
    known = lambda c: [r for r in rows if r[c] is not None]
    if kind == 0:
        return f.filter(col("a").gt(k / 4)), [r for r in known("a") if r["a"] > k / 4]
    if kind == 1:
        return f.filter(col("b").lt(k)), [r for r in known("b") if r["b"] < k]
    if kind == 2:
        return f.filter(col("g").eq("beta").or_(col("flag"))), [r for r in rows if r["g"] == "beta" or r["flag"]]
    if kind == 3:
        return f.with_column("a", col("a").mul(k)), [r | {"a": None if r["a"] is None else r["a"] * k} for r in rows]
    if kind == 4:
        return f.with_column("b", col("b").add(k)), [r | {"b": None if r["b"] is None else r["b"] + k} for r in rows]
    if kind in (5, 6):
        c, down = ("b", "g")[kind - 5], rng.random() < 0.5
        return f.sort_values(c, descending=down), sorted(known(c), key=lambda r: r[c], reverse=False) + [r for r in rows if r[c] is None] if not down else stable_down(known(c), c) + [r for r in rows if r[c] is None]
    if kind == 7:
        return f.head(abs(k)), rows[: abs(k)]
    return f.slice(abs(k) // 2, abs(k)), rows[abs(k) // 2 : abs(k)]


def stable_down(rows: list[dict], c: str) -> list[dict]:
    return [r for v in sorted({r[c] for r in rows}, reverse=True) for r in rows if r[c] == v]


@pytest.mark.parametrize("seed", range(25))
def test_chain(spark, seed):
    rng = random.Random(seed)
    rows = rows_of(rng)
    names = ("a", "b", "g", "flag")
    f = Frame.from_columns({c: [r[c] for r in rows] for c in names}, dtypes={"a": "f64", "b": "i32", "g": "utf8", "flag": "bool"}, spark=spark)
    for _ in range(rng.randint(0, 6)):
        f, rows = step(rng, f, rows)
    assert [tuple(map(repr, r.values())) for r in f.to_records()] == [tuple(repr(r[c]) for c in names) for r in rows]
    want: dict = {}
    for r in rows:
        want[r["g"]] = want.get(r["g"], 0) + (r["b"] or 0)
    assert f.groupby("g").agg({"b": "sum"}).to_columns() == {"g": list(want), "b": [float(v) for v in want.values()]}
