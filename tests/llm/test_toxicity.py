from __future__ import annotations

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from sparrowgrid.llm import toxicity

from .conftest import SCHEMA, prose

INSULTS = ["idiot", "moron", "clown", "pathetic", "worthless"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(1200):
        words = prose(rng, rng.randint(20, 120)).split()
        toxic = k % 8 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(toxic)))
    return spark.createDataFrame(docs, SCHEMA).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    rows = toxicity.report(docs, labels).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150 and sum(r["predicted"] == (r["doc_id"] % 8 == 0) for r in held) >= 0.99 * len(held)


def test_hidden_words_are_read(spark, corpus):
    docs, labels = corpus
    hidden = ["you 1d10t there", "such an i d i o t here", "what a m.o.r.o.n is", "a cl0wn came", "p@th3t1c and", "woooorthlesssss and", "IDIOT!!!", "you -idiot- you"]
    clean = ["the thing is", "an er on 123 45", "", None, "st 4 ti 2 re"]
    more = spark.createDataFrame([(10_000 + i, t, "en", "s", 0) for i, t in enumerate(hidden + clean)], SCHEMA)
    found = {r["doc_id"] - 10_000: r["predicted"] for r in toxicity.report(docs.union(more), labels).where("doc_id >= 10000").collect()}
    assert [found[i] for i in range(len(hidden))] == [1] * len(hidden)
    assert [found[i + len(hidden)] for i in range(len(clean))] == [0] * len(clean)


def test_words_inside_of_runs_and_long_tokens(spark, corpus):
    docs, labels = corpus
    run = " ".join("thethingerontistoerblelomaka" "idiot" "reonstanthelomakablerererti")
    hidden = ["you are a i d i o t", "w h a t a n i d i o t", run, "idi" + "o" * 50 + "t", "the-thing-is-an-er-on-the-maka-lo-1d10t-there", "the_er_an_m.o.r.o.n_thing_is_an_er_on_the_maka_lo"]
    clean = [run.replace("i d i o t", "s t"), "t h e e r o n", "the-thing-is-an-er-on-the-maka-lo-and-more-there", "1 0 1 0 7 " * 30, "x" * 5000, "- " * 500]
    more = spark.createDataFrame([(10_000 + i, t, "en", "s", 0) for i, t in enumerate(hidden + clean)], SCHEMA)
    found = {r["doc_id"] - 10_000: r["predicted"] for r in toxicity.report(docs.union(more), labels).where("doc_id >= 10000").collect()}
    assert len(run) > 80 and [found[i] for i in range(len(hidden))] == [1] * len(hidden)
    assert [found[i + len(hidden)] for i in range(len(clean))] == [0] * len(clean)


def test_the_table_has_no_bound(spark, corpus, monkeypatch):
    """Words of few toxic rows are learnt though filler words are more frequent in these; the table may be large."""
    for name in ("FEATURES", "DICT_ROWS"):
        monkeypatch.setattr(toxicity, name, 4, raising=False)
    docs, labels = corpus
    more = spark.createDataFrame([(10_000 + i, f"the {w} thing", "en", "s", 0) for i, w in enumerate([*INSULTS, "table"])], SCHEMA)
    found = {r["doc_id"] - 10_000: r["predicted"] for r in toxicity.report(docs.union(more), labels).where("doc_id >= 10000").collect()}
    assert [found[i] for i in range(len(INSULTS) + 1)] == [1] * len(INSULTS) + [0]


def test_the_sorted_table():
    f = np.array([-5, 3, 9], np.int64)
    table = toxicity.Table(f, np.array([0.1, 0.2, 0.3]))
    assert [table.get(x) for x in (-6, -5, 3, 4, 9, 10)] == [None, 0.1, 0.2, None, 0.3, None]


def test_copies_are_one_witness(spark):
    """A word that stands in one toxic text, copied often, is no evidence."""
    rng = random.Random(4)
    texts = [prose(rng, 60) for _ in range(200)]
    docs = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(1000 + k, "harmlessword " + texts[0], "en", "s", 0) for k in range(100)]
    labels = [(k, 0, int(k >= 1000 or k % 10 == 0)) for k, *_ in docs]
    out = toxicity.report(spark.createDataFrame([*docs, (5000, "harmlessword alone", "en", "s", 0)], SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.where("doc_id = 5000").first()["predicted"] == 0


def test_edited_copies_are_few_witnesses(spark):
    """Forty revisions of one toxic text, too different for verified copies: its other words, found in clean texts too, are no evidence; the insult is."""
    rng = random.Random(14)
    plain = sorted({"".join(rng.choices("abcdefghilmnorstu", k=rng.randint(4, 8))) for _ in range(600)})
    say = lambda n: [rng.choice(plain) for _ in range(n)]
    docs, labels = [(k, say(80)) for k in range(900)], {k: 0 for k in range(900)}
    for k in range(60):
        docs.append((1000 + k, [*say(30), rng.choice(INSULTS), *say(30)]))
    first = [*say(60), "idiot", *say(60)]
    for k in range(40):
        docs.append((2000 + k, [w if rng.random() < 0.95 else rng.choice(plain) for w in first]))
    labels |= {k: 1 for k, _ in docs if k >= 1000}
    frame = spark.createDataFrame([(k, " ".join(w), "en", "s", 0) for k, w in docs], SCHEMA)
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.report(frame, spark.createDataFrame([(k, 1, y) for k, y in labels.items()], "doc_id long, quality int, toxic int")).collect()}
    assert sum(scores[k] for k in range(900)) <= 2
    assert sum(scores[k] for k in scores if 1000 <= k < 2000) >= 58


def test_texts_with_a_common_passage_are_no_copies(spark):
    """Only equal texts and those with verified similarity are left out of the labelled rows."""
    rng = random.Random(9)
    passage = prose(rng, 60)
    texts = [f"{passage} {prose(rng, 40)}" for _ in range(100)]
    near = [f"{t} end" for t in texts[:10]]
    docs = list(enumerate([*texts, *texts[:20], *near]))
    marks = spark.createDataFrame([(k, k % 2) for k, _ in docs] + [(1000, 1)], "k long, y int")
    frame = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in docs], SCHEMA)
    kept = {r["k"] for r in toxicity.representatives(frame, marks, key="doc_id", text="text").collect()}
    assert set(range(100)) <= kept and not kept & set(range(100, 120))
    copies = [(0, "a b c d e f g h i j k l m n o p q r"), (1, "a b c d e f g h i j k l m n o p q r s"), (2, "A b c d e f g h i j k l m n o p q r"), (3, ""), (4, ""), (5, None)]
    frame = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in copies], SCHEMA)
    marks = spark.createDataFrame([(k, 1) for k, _ in copies], "k long, y int")
    assert sorted(r["k"] for r in toxicity.representatives(frame, marks, key="doc_id", text="text").collect()) in ([0, 3], [0, 1, 3])


def test_rows_of_the_pipeline_stage(corpus):
    docs, labels = corpus
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {k for k in range(1200) if k % 8} <= ids and len(ids) <= 1050 + 5


def test_odd_documents(spark, odd_docs, odd_texts, no_docs, corpus):
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (5, None, None), (None, 1, 1), (6, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.report(odd_docs, labels)
    rows = out.collect()
    assert len(rows) == len(odd_texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in rows)
    none = toxicity.report(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {toxicity.BASE} and len(none) == len(odd_texts)
    assert toxicity.report(no_docs, labels).count() == 0 and toxicity.report(no_docs, labels.limit(0)).count() == 0
    assert toxicity.keep_clean(odd_docs, labels).columns == odd_docs.columns


def test_the_lattice_restores_words():
    counts = np.zeros(toxicity._N**3)
    for w in INSULTS * 40 + ["the", "thing", "hello"] * 100:
        codes = [0, 0] + [toxicity._code(c) for c in w] + [0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            counts[(a * toxicity._N + b) * toxicity._N + c] += 1
    model = toxicity.CharacterModel(counts)
    for seen, word in (("1d10t", "idiot"), ("m 0 r 0 n", "moron"), ("hellllooo", "hello"), ("w-o-r-t-h-l-e-s-s", "worthless"), ("??%%", "??%%")):
        assert model.restore(seen) == word


def test_words_without_letters_are_read_and_numbers_are_not(spark):
    """Insults made of signs alone, beside amounts, dates, times and numbers that would read as letters."""
    rng, vile = random.Random(8), ["ass", "shit", "slob", "loser"]
    docs, labels = [], []
    for k in range(1200):
        words = prose(rng, rng.randint(20, 120)).split()
        if k % 8 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(vile))
        docs.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, 1, int(k % 8 == 0)))
    hidden = ["you @$$ there", "the 5#!7 is", "a $|0b on", "an 5|0b!", "the |0$3r!"]
    clean = ["the 5417 thing", "on 51.08", "a $10.8 an", "10:53 on 2024-10-05", "+1 555 105 3412", "80085 er", "3,5/8 the", "455 an er", "#51 on", "50% 1,055.00€"]
    frame = spark.createDataFrame(docs + [(10_000 + i, t, "en", "s", 0) for i, t in enumerate(hidden + clean)], SCHEMA)
    found = {r["doc_id"] - 10_000: r["predicted"] for r in toxicity.report(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("doc_id >= 10000").collect()}
    assert [found[i] for i in range(len(hidden))] == [1] * len(hidden)
    assert [found[i + len(hidden)] for i in range(len(clean))] == [0] * len(clean)


def brute_scores(docs: list[tuple[int, str]], labels: dict[int, int]) -> dict[int, float]:
    """Plain words only: shares of all features of the labelled rows, and each text's strongest one."""
    held = {k: crc32(str(k).encode()) % 5 == 0 for k, _ in docs}
    parts = lambda w: [("w", w), *([("4", w[:4])] if len(w) > 3 else []), *([("5", w[:5])] if len(w) > 4 else [])] if len(w) > 2 else []
    seen, rows = set(), []
    for k, t in sorted(docs):
        if not held[k] and k in labels and (labels[k], t) not in seen:
            seen.add((labels[k], t))
            rows.append((labels[k], t.split(), {f for w in t.split() for f in parts(w)}))
    prior = sum(y for y, *_ in rows) / len(rows)
    toxic, clean = (Counter(f for y, _, fs in rows if y == side for f in fs) for side in (1, 0))
    tried = [f for f, n in toxic.items() if n >= toxicity.LEAST]

    def judged(t: int, c: int) -> float | None:
        share, rate = (t + toxicity.PRIOR * prior) / (t + c + toxicity.PRIOR), min(t / max(1, t + c), 1 - 1e-12)
        if t >= toxicity.LEAST and share > 2 * toxicity.BASE and rate > prior and len(tried) * math.exp(-(t + c) * (rate * math.log(rate / prior) + (1 - rate) * math.log((1 - rate) / (1 - prior)))) < 1:
            return share
        return None

    table = {f: share for f in tried if (share := judged(toxic[f], clean[f]))}

    def evidence(w: str) -> float:
        if len(w) < 3:
            return toxicity.BASE
        if ("w", w) in table:
            return table["w", w]
        if len(w) < 4 or ("4", w[:4]) not in table:
            return toxicity.BASE
        return table["4", w[:4]] if len(w) == 4 else min(table["4", w[:4]], table.get(("5", w[:5]), toxicity.BASE))

    witnessed = {f: ([set(), set()], [set(), set()]) for f in table}
    for y, words in [(y, w) for y, w, _ in rows]:
        best: dict = {}
        for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
            a, b = xxh64_intdigest(before) >> 1, xxh64_intdigest(after) >> 1
            for f in set(parts(w)) & table.keys():
                best[f] = min(best.get(f, (1 << 62, 0, 0)), ((a * 3 + b) % (1 << 61), a, b))
        for f, (_, a, b) in best.items():
            witnessed[f][y][0].add(a)
            witnessed[f][y][1].add(b)
    low = {f: share for f, share in table.items() if share < 0.5}
    table = low | {f: share for f, (c, t) in witnessed.items() if f not in low and (share := judged(min(map(len, t)), min(map(len, c))))}
    return {k: max(map(evidence, t.split()), default=toxicity.BASE) for k, t in docs}


def test_scores_are_those_of_brute_force(spark):
    """Every score of a corpus of plain words, from counts made anew in Python."""
    rng = random.Random(21)
    words = sorted({"".join(rng.choices("abcdefghilmnorstu", k=rng.randint(1, 8))) for _ in range(900)})
    words = [w for w in words if not any(w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2))]
    bad, docs, labels = words[::30], [], {}
    for k in range(1500):
        toxic = rng.random() < 0.15
        own = [rng.choice(words) for _ in range(rng.randint(0, 40))] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(own)
        docs.append((k, " ".join(own)))
        if rng.random() < 0.8:
            labels[k] = int(toxic)
    docs += [(2000 + k, docs[k][1]) for k in range(0, 60, 3)]
    labels |= {2000 + k: labels[k] for k in range(0, 60, 3) if k in labels}
    got = {r["doc_id"]: r["score"] for r in toxicity.report(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in docs], SCHEMA), spark.createDataFrame([(k, 1, y) for k, y in labels.items()], "doc_id long, quality int, toxic int")).collect()}
    want = brute_scores(docs, labels)
    assert got.keys() == want.keys() and max(want.values()) > 0.5 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
