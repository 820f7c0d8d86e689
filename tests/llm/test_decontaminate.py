from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from sparrowgrid.llm import decontaminate

from .conftest import SCHEMA, prose, words_of

ITEM = "item_id long, text string"


def shingles(text: str | None) -> set[str]:
    w = words_of(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items) -> list[tuple]:
    out = []
    for k, t in docs:
        have = shingles(t)
        for i, u in items:
            want = shingles(u)
            if want and len(want & have) >= 0.8 * len(want):
                out.append((k, i, len(want & have), len(want)))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    rows = df.collect()
    assert all(r["containment"] == r["n_shared"] / r["n_shingles"] for r in rows)
    return sorted(((r["doc_id"], r["item_id"], r["n_shared"], r["n_shingles"]) for r in rows), key=repr)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(21)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 4, 5, 6, 7, 9, 12, 17, 30, 33, 64, 100, 200, 900])] + [(50, None), (51, ""), (52, "Of The Thing"), (53, "of the thing")]
    docs = []
    for k in range(150):
        words = prose(rng, rng.choice([3, 40, 400, 5000])).split()
        if k % 2:
            i, text = rng.choice(items[:15])
            piece = text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                piece[rng.randrange(len(piece))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = piece
        docs.append((k, " ".join(words).upper() if k % 5 == 0 and words[0].isascii() else " ".join(words)))
    docs.append((900, items[12][1] + " " + items[11][1]))
    return docs, items


def test_planted_items(spark, planted):
    docs, items = planted
    got = decontaminate.contained(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in docs], SCHEMA), spark.createDataFrame(items, ITEM))
    want = brute(docs, items)
    assert len(want) > 25 and found(got) == want


def test_many_blocks_of_items(spark, planted, monkeypatch):
    docs, items = planted
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 2000)
    got = decontaminate.contained(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in docs], SCHEMA), spark.createDataFrame(items, ITEM))
    assert found(got) == brute(docs, items)


def test_stage(spark, planted):
    docs, items = planted
    table = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in docs], SCHEMA)
    kept = decontaminate.clean(table, spark.createDataFrame(items, ITEM))
    assert kept.columns == table.columns
    bad = {r[0] for r in brute(docs, items)}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _ in docs if k not in bad)


def test_odd_documents(spark, odd_docs, odd_texts, no_docs):
    items = [(1, odd_texts[5][1][:200]), (1, odd_texts[5][1][:200]), (None, "naïve café 漢字"), (3, None), (4, " "), (5, "a")]
    extra = spark.createDataFrame([(*i, "x", "y") for i in items], f"{ITEM}, doc_id string, item string")
    assert found(decontaminate.contained(odd_docs, extra)) == brute(odd_texts, items)
    kept = decontaminate.clean(odd_docs, extra)
    bad = [k for k, t in odd_texts if brute([(k, t)], items)]
    assert kept.columns == odd_docs.columns and kept.count() == len(odd_texts) - len(bad)
    assert decontaminate.contained(no_docs, extra).count() == 0 and decontaminate.contained(odd_docs, extra.limit(0)).count() == 0
    assert decontaminate.clean(odd_docs, extra.limit(0)).count() == len(odd_texts)


def test_the_sql(planted):
    docs, items = planted
    documents, benchmark = pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"])  # noqa: F841
    rows = duckdb.sql(decontaminate.SQL).fetchall()
    assert sorted((r[:4] for r in rows), key=repr) == brute(docs, items)
