from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = ["the", "an", "er", "ing", "ou", "st", "re", "on", "ti", "ble", "ñ", "ü", "é", "lo", "ma", "ka"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = ("k", "t", "h", "s", "fp", "rep", "mask", "value", "key", "id", "low", "rules", "part", "_pii_spans", "_pii_text", "__lost", "held_out", "score", "n_tokens", "bands", "component_id", "spans", "rest", "y", "item", "node")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) + rng.choice(["", "", "", ".", ",", "\n", "!"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, repeats, ties, odd characters, null and repeated keys."""
    rng = random.Random(5)
    base = prose(rng, 120)
    return [
        (1, None), (2, ""), (3, " \t\r\n "), (4, "a"), (5, "one two"), (6, base), (7, base), (8, base.upper()), (9, base + " tail"), (10, prose(rng, 40_000)), (10, base), (11, "x" * 50_000),
        (12, "naïve café 漢字 \U0001f600 ​ \x0b\x0c\x1c\x85\xa0 İSTANBUL"), (13, "\0null\0"), (14, "aaaa" * 30 + "  \n\n  aaaa"), (None, base), (None, None), (15, prose(rng, 300)), (-3, prose(rng, 60)), (2**40, "ids are long"),
        (16, "don't DON'T they'll  we're\tı'm 12345 3.14 <|endoftext|> <|endoftext|>\r\n"), (17, "1.1.1.1 a@b.co +12345678901"), (18, "0" * 3000), (19, "- " * 2000), (20, "﻿bom‍́ é"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    df = spark.createDataFrame([(k, t, None if i % 3 else "en", "s", None) for i, (k, t) in enumerate(odd_texts)], SCHEMA)
    return df.withColumns({c: F.lit(f"{c}!") for c in CLASHING}).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
