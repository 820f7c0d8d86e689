"""Secret scans by a trigram inverted index, with DataFrame and SQL functions only.

A Boolean trigram query is derived from each rule's regex: every text that matches holds all trigrams of one
of its clauses. The index has a posting (trigram, key) for each indexed trigram that a document holds, in lower
case; one pass over a text finds its indexed trigrams, and the index is a stored table that later scans reuse
(`build_index`, `open_index`). The postings of a clause are intersected by counting them per key, clauses are
united, and only the candidates are verified by the regex. Rules without a mandatory trigram (such as runs of
hexadecimal digits), or with one that the index lacks, scan every text.

Defined results: null and empty texts have no spans; texts of any length are read whole, and the work grows with their
length and matches; a null key is a key like any other; rows that share a key are candidates together, and each is
verified by its own text; repeated rows give repeated rows; spans that start together stand in the rules' order; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .spans import EMPTY, found, joined, quoted

#: Clauses of a derived query, and strings of an exact set, at most; beyond it a part of the query is left out.
MOST = 64
#: Candidate keys that are broadcast at most (some 40 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
ANY = frozenset({frozenset()})


@dataclass(frozen=True)
class Rule:
    """`pattern` must be read alike by Java and Python; `least` is the second group's least length, if any."""

    kind: str
    pattern: str
    least: int = 0
    base: bool = False


#: Stands for a rule that the postings do not serve.
HIDDEN = Rule("", "")
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, base=True),
    # As long as AKIA[A-Z0-9]+ and [0-9a-f]+ with their least lengths: runs are taken whole, so shorter ones hide nothing.
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def absorbed(clauses) -> frozenset:
    """Without clauses that hold another one; one empty clause is true for all texts."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def both(a: frozenset, b: frozenset) -> frozenset:
    return absorbed({x | y for x in a for y in b}) if len(a) * len(b) <= MOST else a


def query_of(strings) -> frozenset:
    return absorbed({trigrams(s) for s in strings})


def analysed(tree) -> tuple[set[str] | None, frozenset]:
    """(all strings that match, or None if too many; clauses of trigrams), in lower case."""
    exact, query = {""}, ANY

    def flush() -> None:
        nonlocal exact, query
        query, exact = both(query, query_of(exact)), {""}

    closed = True
    for op, value in tree:
        part, clauses = None, ANY
        if op is C.LITERAL:
            part = {chr(value).lower()}
        elif op is C.IN:
            if all(o is C.LITERAL for o, _ in value) and len(value) <= 8:
                part = {chr(v).lower() for _, v in value}
        elif op is C.SUBPATTERN:
            part, clauses = analysed(value[3])
        elif op is C.BRANCH:
            sides = [analysed(t) for t in value[1]]
            if all(s[0] is not None for s in sides):
                part = set().union(*(s[0] for s in sides))
            else:
                clauses = absorbed(set().union(*(query_of(e) if e is not None else q for e, q in sides)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = value
            e, q = analysed(inner)
            if e is not None and (least, most) == (0, 1):
                part = e | {""}
            elif e is not None and least == most and len(e) ** least <= MOST:
                part = {""}
                for _ in range(least):
                    part = {a + b for a in part for b in e}
            elif least:
                clauses = query_of(e) if e is not None else q
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = {""}
        if part is not None and len(part) * len(exact) <= MOST:
            exact = {a + b for a in exact for b in part}
            continue
        flush()
        if part is not None and len(part) <= MOST:
            exact, closed = part, False
        else:
            query, closed = both(query, clauses), False
    if closed:
        return exact, query_of(exact)
    flush()
    return None, query


def trigram_query(pattern: str) -> frozenset:
    """Clauses (sets of lower-case trigrams), one of which every matching text holds; {empty set}: none is mandatory."""
    exact, query = analysed(parser.parse(pattern))
    return query_of(exact) if exact is not None else query


def found_trigrams(text: str, wanted: Iterable[str]) -> Column:
    """The distinct ones of the wanted trigrams that a lower-case text holds, by one pass of a regex: a tree of their signs behind a test of the classes."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in wanted:
        tree.setdefault(a, {}).setdefault(b, []).append(c)

    def signs(cs: Iterable[str]) -> str:
        return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(cs))) + "]"

    first = "".join(map(signs, ((a for a in tree), (b for bs in tree.values() for b in bs), (c for bs in tree.values() for cs in bs.values() for c in cs))))
    branches = "|".join(signs(a) + "(?:" + "|".join(signs(b) + signs(cs) for b, cs in bs.items()) + ")" for a, bs in tree.items())
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({first}))(?={branches})"), F.lit(1)))


@dataclass(frozen=True)
class Index:
    """A stored table (trigram, key) of the postings of all `trigrams`."""

    folder: str
    postings: DataFrame
    trigrams: frozenset[str]


def build_index(docs: DataFrame, trigrams: Iterable[str], *, key: str = "doc_id", text: str = "text") -> Index:
    """Index the texts by these trigrams (in lower case), in the shared folder."""
    spark, wanted = docs.sparkSession, sorted(set(trigrams))
    folder = common.new_folder(spark, "secrets-index")
    spark.range(1).select(F.explode(F.array(*map(F.lit, wanted)).cast("array<string>")).alias("trigram")).write.parquet(f"{folder}/trigrams")
    low = docs.select(F.col(key).alias("key"), F.lower(common.text_or_empty(text)).alias("low"))
    held = found_trigrams("low", wanted) if wanted else F.array().cast("array<string>")
    low.select("key", F.explode(held).alias("trigram")).write.parquet(f"{folder}/postings")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> Index:
    """An index that `build_index` has written; the rows scanned with it must be those it was built of."""
    trigrams = frozenset(r["trigram"] for r in spark.read.parquet(f"{folder}/trigrams").collect())  # bounded by the rules
    return Index(folder, spark.read.parquet(f"{folder}/postings"), trigrams)


def clauses_of(rules: list[Rule]) -> list[tuple[int, frozenset]]:
    """(rule, trigrams) of the clauses of all rules that have a mandatory trigram."""
    queries = [(r, trigram_query(rule.pattern)) for r, rule in enumerate(rules)]
    return [(r, c) for r, q in queries if q != ANY for c in sorted(q, key=sorted)]


def candidates(index: Index, rules: list[Rule]) -> DataFrame:
    """(key, rules long): bit r is set if the postings say that rule r may match in a row of this key."""
    clauses = clauses_of(rules)
    spark, kind = index.postings.sparkSession, dict(index.postings.dtypes)["key"]
    if not clauses:
        return spark.createDataFrame([], f"key {kind}, rules long")
    # One row for each trigram of each clause: bounded by the rules, not by the data.
    asks = F.array(*[F.struct(F.lit(n).alias("clause"), F.lit(t).alias("trigram")) for n, (_, c) in enumerate(clauses) for t in sorted(c)])
    asks = F.broadcast(spark.range(1).select(F.inline(asks)))
    sizes = F.array(*[F.lit(len(c)) for _, c in clauses])
    owners = F.array(*[F.lit(1 << r).cast("long") for r, _ in clauses])
    met = index.postings.join(asks, "trigram").groupBy("key", "clause").agg(F.countDistinct("trigram").alias("n"))
    return met.where(F.col("n") == sizes[F.col("clause")]).groupBy("key").agg(F.bit_or(owners[F.col("clause")]).alias("rules"))


def scan(docs: DataFrame, rules: list[Rule] | None = None, *, key: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """(key, spans array): the spans of all rules by start, then rule, each verified by its regex.

    Without an `index` of these rows one is built for the rules.
    """
    rules = rules or RULES
    if len(rules) > 63:
        raise ValueError("at most 63 rules in one scan")
    index = index or build_index(docs, {t for _, c in clauses_of(rules) for t in c}, key=key, text=text)
    indexed = [i for i, rule in enumerate(rules) if trigram_query(rule.pattern) != ANY and all(c <= index.trigrams for c in trigram_query(rule.pattern))]
    met = common.stored(candidates(index, [r if i in indexed else HIDDEN for i, r in enumerate(rules)]), "secrets-candidates")
    few = met.count() <= BROADCAST_ROWS
    met = F.broadcast(met) if few else met
    base = docs.select(F.col(key).alias("id"), common.text_or_empty(text).alias("t"))
    base = base.join(met, F.col("id").eqNullSafe(F.col("key")), "left")
    columns = []
    for r, rule in enumerate(rules):
        full = r not in indexed
        gate = f"t rlike {quoted(rule.pattern)}" if full else f"(coalesce(rules, 0) & {1 << r}) != 0"
        matches = found("t", r, rule.pattern)
        if rule.least:  # drop matches whose value, the second group, is too short
            values = f"regexp_extract_all(t, {quoted(rule.pattern)}, 2)"
            matches = f"transform(filter(zip_with({matches}, {values}, (s, v) -> named_struct('s', s, 'v', v)), x -> length(x.v) >= {rule.least}), x -> x.s)"
        matches = F.expr(matches)
        columns.append(F.when(F.expr(gate), matches).otherwise(F.expr(EMPTY)))
    return base.select(F.col("id").alias(key), F.array_sort(F.concat(*columns)).alias("spans"))


def report(docs: DataFrame, rules: list[Rule] | None = None, *, key: str = "doc_id", text: str = "text", index: Index | None = None) -> DataFrame:
    """Per row: key, the number of spans of each base rule, base_sha256 and spans as text."""
    rules = rules or RULES
    kinds = [r.kind for r in rules]
    base = [i for i, r in enumerate(rules) if r.base]
    out = scan(docs, rules, key=key, text=text, index=index)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) as bigint)").alias(f"n_{kinds[i]}") for i in base]
    own = f"filter(spans, s -> s.kind in ({', '.join(map(str, base))}))"
    return out.select(key, *counts, F.sha2(F.expr(joined(own, kinds)), 256).alias("base_sha256"), F.expr(joined("spans", kinds)).alias("spans"))
