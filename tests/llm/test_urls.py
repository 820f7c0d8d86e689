from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest

from sparrowgrid.llm import urls

SCHEMA = "page_id long, url string, html string"


def split(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
    return host, rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]


def brute(url: str | None, rules) -> tuple:
    host, path = split(url)
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(rule), len(h)) > (len(best[0]), len(best[1]))):
            best = rule, h, verdict
    return host, path, best and best[0], best[2] if best else "allow"


ODD = [
    None, "", "no scheme", "http://", "://", "http://net/", "http://NET", "http://net", "http://a.net/x?y#z", "https://example.net/en/a", "https://www.Example.NET/en/", "https://example.net/EN/a", "https://badexample.net/en/x", "ftp://example.com/de/?q", "http://example.com/de",
    "http://x.example.com/de/y", "http://example.com?/de/", "http://example.com#/de/", "http://a.org/fr/", "http://org/fr/x", "http://.org/fr/", "http://a.org.uk/fr/", "x://a://net/", "http://net//", "http://ÄB.net/ß", "http://net:80/", "http://a.net\n/b", "http://user@a.net/", "http://" + "a." * 3000 + "net/" + "b/" * 3000,
]


def check(spark, pairs, rules):
    df = spark.createDataFrame([(k, u, None, "x", "y") for k, u in pairs], f"{SCHEMA}, host string, rest string")
    got = sorted((tuple(r) for r in urls.filter_urls(df, rules).collect()), key=repr)
    assert got == sorted(((k, *brute(u, rules)) for k, u in pairs), key=repr)


def test_odd_urls(spark):
    pairs = [(k, u) for k, u in enumerate(ODD)] + [(None, ODD[8]), (3, ODD[9]), (3, ODD[9])]
    check(spark, pairs, urls.RULES)


def test_the_sql():
    pages = pd.DataFrame([(k, u, "") for k, u in enumerate(ODD)], columns=["page_id", "url", "html"])  # noqa: F841
    got = sorted(duckdb.sql(f"SELECT page_id, host, path, rule, verdict FROM ({urls.SQL})").fetchall())
    assert got == [(k, *brute(u, urls.RULES)) for k, u in enumerate(ODD)]


def test_many_rules(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abc") * rng.randint(1, 2)
    rules = {f"{'.'.join(word() for _ in range(rng.randint(1, 3)))}/{''.join(word() + '/' for _ in range(rng.randint(0, 2)))}": rng.choice(["allow", "block"]) for _ in range(150)}
    pairs = [(k, f"http://{'.'.join(word() for _ in range(rng.randint(1, 4)))}/{''.join(word() + '/' for _ in range(rng.randint(0, 3)))}{rng.choice(['', '?x', '#y'])}") for k in range(1500)]
    check(spark, pairs, [(v, r) for r, v in rules.items()])


def test_no_rules_and_no_pages(spark):
    check(spark, [(1, ODD[8])], [])
    assert urls.filter_urls(spark.createDataFrame([], SCHEMA), urls.RULES).count() == 0


def test_equal_digests_decide_nothing(tmp_path, monkeypatch):
    """All keys collide: only the stored strings tell the entries apart."""
    monkeypatch.setattr(urls, "xxh64_intdigest", lambda s: 7)
    path = tmp_path / "filter.bin"
    path.write_bytes(urls.pack(urls.RULES))
    array = urls.DigestArray(str(path))
    assert array.find([b"net/", b"nit/", b"org/fr/"]).tolist().count(-1) == 1
    assert array.judge([b"a.org", b"b.com"], [b"/fr/x", b"/fr/x"])[0][0] == b"org/fr/" and array.judge([b"b.com"], [b"/"]) == [(None, None)]


def test_damaged_files_are_told(tmp_path):
    (tmp_path / "x").write_bytes(b"something else entirely")
    with pytest.raises(ValueError):
        urls.DigestArray(str(tmp_path / "x"))
