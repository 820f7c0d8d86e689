from __future__ import annotations

import base64
import os
import random
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

import __spark_entry__
import corpus_pipeline
from sparrowgrid.llm import bpe, common, decontaminate, neardup, pii, toxicity

from .conftest import CLASHING, SCHEMA, words_of
from .test_decontaminate import brute as brute_leaks
from .test_decontaminate import shingles
from .test_spans import brute_mask
from .test_toxicity import brute_scores

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_each_stage_keeps_what_its_operator_keeps(spark):
    """Stage by stage against the operators' reports on the same rows."""
    docs = common.documents(spark, DATA)
    columns, start = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = common.stored(stage(spark, docs, DATA), "test-stage")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            want = {r["doc_id"] for r in toxicity.report(docs, common.documents(spark, DATA, "labels")).collect() if not r["predicted"]}
        elif name == "simhash near-dedup":
            want = {r["component_id"] for r in neardup.groups(docs).collect()}
        elif name == "benchmark decontamination":
            want = set(before) - {r["doc_id"] for r in decontaminate.contained(docs, common.documents(spark, DATA, "benchmark")).collect()}
        else:
            want = set(before)
        assert ids == want, name
        if name == "pii":
            spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
            assert {r["doc_id"] for r in out.collect() if r["text"] != before[r["doc_id"]]} == {k for k, s in spans.items() if s}
        if name == "byte-level bpe":
            tokens = {r["doc_id"]: r["ids"] for r in out.collect()}
            data = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
            assert all(b"".join(data[i] for i in tokens[k]).decode() == (t or "") for k, t in before.items())
        else:
            assert out.columns == columns
        docs = out
    assert 0 < docs.count() < start


def test_run_and_registry(spark):
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == [] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    out = names["pipeline"](spark, DATA)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 0


def links_of(texts: dict[int, str]) -> dict[int, int]:
    """Smallest key reachable by fingerprints two bits apart at most or a Jaccard similarity of 0.8, over all pairs."""
    keys = sorted(texts)
    prints = {k: fingerprint(words_of(texts[k]), 3) for k in keys}
    sets = {k: shingles(texts[k]) for k in keys}
    label = {k: k for k in keys}
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if bin(prints[a] ^ prints[b]).count("1") <= 2 or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def fingerprint(words: list[str], size: int) -> int:
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashed = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def test_the_pipeline_against_brute_force(spark, tmp_path):
    """All five stages made anew in plain Python over planted documents: the same rows and ids come out."""
    rng = random.Random(31)
    vocabulary = sorted({"".join(rng.choices("abcdefghilmnorstu", k=rng.randint(3, 8))) for _ in range(700)})
    vocabulary = [w for w in vocabulary if not any(w[i] == w[i + 1] == w[i + 2] for i in range(len(w) - 2))]
    bad, plain = vocabulary[::40], [w for i, w in enumerate(vocabulary) if i % 40]
    say = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    items = [(i, say(30)) for i in range(8)]
    docs, labels = [], {}
    for k in range(420):
        text = say(rng.randint(30, 90))
        if k % 6 == 0:
            text = f"{say(5)} {rng.choice(bad)} {rng.choice(bad)} {text}"
        elif k % 6 == 1 and k > 60:
            words = docs[k - 3][1].split()
            text = " ".join(words[: len(words) - rng.choice([0, 1, 2])])
        elif k % 6 == 2:
            text = f"{text} {items[k % 8][1]}"
        elif k % 6 == 3:
            text = f"{text} write to {rng.choice(plain)}@mail{k}.org or +49 30 {1000000 + k} from 10.0.{k % 256}.7 now"
        docs.append((k, text))
        if rng.random() < 0.85:
            labels[k] = int(k % 6 == 0)
    docs += [(1000, ""), (1001, None)]
    at = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], SCHEMA).withColumns({c: F.lit(c) for c in CLASHING}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, at).collect()}

    scores = brute_scores([(k, (t or "").lower()) for k, t in docs if k % 6 != 3 or k >= 1000], labels)
    texts = {k: t or "" for k, t in docs}
    # Words with marks are no plain words: such documents hold no toxic word, as planted.
    kept = {k: t for k, t in texts.items() if k % 6 == 3 and k < 1000 or scores[k] < 0.5}
    label = links_of(kept)
    kept = {k: t for k, t in kept.items() if label[k] == k}
    leaked = {r[0] for r in brute_leaks(kept.items(), items)}
    kept = {k: t for k, t in kept.items() if k not in leaked}
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    names = ["email", "ip", "card", "phone"]
    masked = {}
    for k, t in kept.items():
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", t)]
        masked[k] = brute_mask(t, spans, [n.upper() for n in names])
    assert got.keys() == masked.keys() and 100 < len(got) < 330
    for k, t in masked.items():
        assert got[k] == (len(ids := library.encode_ordinary(t)), ids), (k, t)


def test_empty_tables_with_clashing_columns(spark, tmp_path):
    """Every stage, and the whole pipeline, on no rows and on further columns named as operators name theirs."""
    docs = spark.createDataFrame([], SCHEMA).withColumns({c: F.lit(c) for c in CLASHING})
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int").withColumns({c: F.lit(c) for c in ("k", "y", "f", "t")})
    items = spark.createDataFrame([], "item_id long, text string").withColumns({c: F.lit(c) for c in ("item", "block", "key")})
    for name, frame in (("documents", docs), ("labels", labels), ("benchmark", items)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    for out in (toxicity.keep_clean(docs, labels), neardup.keep_one(docs), decontaminate.clean(docs, items), pii.redact(docs)):
        assert out.columns == docs.columns and out.count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(1, "a few words", "en", "s", 11), (None, None, None, None, None)], SCHEMA).withColumns({c: F.lit(c) for c in CLASHING})
    for out in (toxicity.keep_clean(some, labels), neardup.keep_one(some), decontaminate.clean(some, items), pii.redact(some)):
        assert out.columns == docs.columns and out.count() == 2
