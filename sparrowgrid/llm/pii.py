"""Personal data by weak supervision, with DataFrame and SQL functions only.

Candidates come from wide regexes. Regex, gazetteer and context labelers vote on each: 1 for, -1 against, 0
no opinion. Expectation-maximisation over the counts of vote patterns, kind by kind, estimates each
labeler's reliability; the posteriors are the soft labels on which a logistic span classifier is trained.
Base spans (strict email, ip, card and phone) always stay; of the other candidates those with a probability of
one half or more do.

What leaves the executors is one row for each (kind, votes, length class) pattern: at most
kinds * 3**labelers * classes rows whatever the input; the model fitted on them is a short SQL expression.

Defined results: null and empty texts have no spans, and `redact` leaves them as they are; texts of any length are read whole, and the
work grows with their length and matches; repeated rows and null keys are treated row by row; of spans that meet, a base one stays, and
`redact` names them by the one that starts first, of several the one of the first kind; without any candidate nothing is trained; an empty
table gives an empty result; further columns are ignored by `report` and kept by `redact`, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .spans import EMPTY, SPAN, apart, found, joined, quoted, replaced

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_FRESH = r"(?:\G|(?<!%s))"
#: kind: (pattern, SQL that keeps a match m, base). Base patterns match what the contract's do; possessive
#: loops and the start conditions only keep them linear.
KINDS = {
    "email": (_FRESH % _LOCAL + rf"{_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++", "true", True),
    "ip": (_FRESH % "[0-9]" + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"m rlike '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'", True),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", "CARD", True),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"length(regexp_replace(m, '[^0-9]', '')) between 8 and 15", True),
    "email_spelled": (rf"(?<!{_LOCAL})[A-Za-z0-9._%+-]{{1,64}}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]{{1,63}}){{1,5}}", "true", False),
    "phone_local": (r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])", "true", False),
    "iban": (r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])", "true", False),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "true", False),
}
NAMES = list(KINDS)
#: A text without one of these has no candidate.
GATE = "[0-9@]|[\\[(]at[\\])]"
#: Text before a candidate that context labelers see.
CONTEXT = 40
_WORDS = {
    "email": "mail|write|contact|correo|courriel", "ip": "ip|host|server|address|addr|from", "card": "card|visa|master|credit|carte|karte|tarjeta|pay",
    "phone": "phone|call|tel|mobile|fax|cell|anruf|llame|appel", "iban": "iban|account|konto|compte|cuenta|bank", "ssn": "ssn|social|security",
}
_FAMILY = {"email_spelled": "email", "phone_local": "phone"}


def _per_kind(parts: dict[str, str], default: str = "0") -> str:
    return "case " + " ".join(f"when s.kind = {NAMES.index(k)} then {v}" for k, v in parts.items()) + f" else {default} end"


def _vote(yes: str, no: str = "false") -> str:
    return f"case when {yes} then 1 when {no} then -1 else 0 end"


#: SQL over a span s: what each labeler says of it.
LABELERS = {
    # regex: a stricter form of the kind
    "form": _per_kind({
        "email": _vote(r"s.match rlike '^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\\.)+[A-Za-z]{2,24}$'", r"s.match rlike '\\.[0-9-]+$'"),
        "ip": _vote(r"s.match rlike '^(?:0|[1-9][0-9]*)(?:\\.(?:0|[1-9][0-9]*)){3}$'", r"s.match rlike '(?:^|\\.)0[0-9]'"),
        "card": _vote(r"s.match rlike '^(?:[0-9]{4}[ -]?){3}[0-9]{4,7}$'", r"s.match rlike '^(.)\\1*$'"),
        "phone": _vote(r"s.match rlike '[ ()-]'", r"s.match rlike '[.-]{3}'"),
        "email_spelled": _vote(r"s.match rlike '[\\[(]dot[\\])]|\\.[A-Za-z]{2,24}$'"),
        "phone_local": _vote("not s.match rlike '^\\\\(?[01]'", "s.match rlike '^\\\\(?[01]'"),
        "iban": _vote("length(replace(s.match, ' ', '')) between 15 and 34", "length(replace(s.match, ' ', '')) < 15"),
        "ssn": _vote("not s.match rlike '^(?:000|666|9)|-00-|0000$'", "s.match rlike '^(?:000|666|9)|-00-|0000$'"),
    }),
    # gazetteer: known endings, country codes, issuers, reserved ranges
    "list": _per_kind({
        "email": _vote(r"lower(s.match) rlike '\\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$'"),
        "email_spelled": _vote(r"lower(s.match) rlike '(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$'", "true"),
        "ip": _vote(r"not s.match rlike '^0*(?:0|127|255)\\.'", r"s.match rlike '^0*(?:0|127|255)\\.'"),
        "card": _vote("s.match rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6)'", "s.match rlike '^[0179]'"),
        "phone": _vote(r"s.match rlike '^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])'", r"s.match rlike '^\\+0'"),
        "iban": _vote("s.match rlike '^(?:DE|FR|ES|IT|NL|BE|AT|CH|GB|IE|PT|PL|SE|NO|DK|FI|CZ|LU)'", "true"),
    }),
    # context: a word that announces the kind, and what stands right beside it
    "words": _per_kind({k: _vote(f"lower(s.before) rlike '\\\\b(?:{_WORDS[_FAMILY.get(k, k)]})'") for k in NAMES}),
    "sides": _vote("right(s.before, 1) in ('', ' ', ':', '(', '<', '\\n', '\\t') and (s.after = '' or s.after rlike '^[ .,;:)>\\n\\t]')", "right(s.before, 1) rlike '[A-Za-z0-9_=/]' or s.after rlike '^[A-Za-z0-9_=/]'"),
}
#: Length classes of a span, a feature of the classifier.
_LENGTH = "case when s.end - s.start < 12 then 0 when s.end - s.start < 18 then 1 when s.end - s.start < 26 then 2 else 3 end"


def _card() -> str:
    """Luhn's test of the digits, and their number."""
    digits = "regexp_replace(m, '[^0-9]', '')"
    return (
        f"(length({digits}) between 16 and 19 and "
        f"aggregate(transform(sequence(1, 19), i -> case when i > length({digits}) then 0 else transform(array(cast(substring({digits}, -i, 1) as int) * (1 + (i + 1) % 2)), d -> case when d > 9 then d - 9 else d end)[0] end), 0, (a, b) -> a + b) % 10 = 0)"
    )


def candidates(docs: DataFrame, *, text: str = "text", into: str = "spans") -> DataFrame:
    """`docs` with the array `into` of all candidates, base kinds first."""
    t = common.fresh(docs, "_pii_text")
    docs = docs.withColumn(t, common.text_or_empty(text))
    parts = []
    for k, (pattern, keep, _) in enumerate(KINDS.values()):
        keep = _card() if keep == "CARD" else keep
        gate = {"email": f"contains({t}, '@')", "card": f"{t} rlike '[0-9](?:[ -]?[0-9]){{15}}'", "phone": f"contains({t}, '+')"}.get(NAMES[k], f"{t} rlike {quoted(pattern)}")
        kept = f"filter({found(t, k, pattern, CONTEXT)}, s -> transform(array(s.match), m -> {keep})[0])"
        parts.append(f"case when {gate} then {kept} else {EMPTY} end")
    spans = f"case when {t} rlike {quoted(GATE)} then concat({', '.join(parts)}) else {EMPTY} end"
    return docs.withColumn(into, F.expr(spans)).drop(t)


def em(patterns: dict[tuple[int, ...], float], prior: float = 0.7, rounds: int = 60) -> dict[tuple[int, ...], float]:
    """The probability that candidates with each vote pattern are right, from the counts of patterns.

    Each labeler has a rate of every vote given right and given wrong; all start as better than chance
    and are smoothed by one count.
    """
    n = len(next(iter(patterns)))
    right = [{1: 0.7, 0: 0.2, -1: 0.1} for _ in range(n)]
    wrong = [{1: 0.2, 0: 0.4, -1: 0.4} for _ in range(n)]
    out: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        for votes in patterns:
            a = math.log(prior) + sum(math.log(right[i][v]) for i, v in enumerate(votes))
            b = math.log(1 - prior) + sum(math.log(wrong[i][v]) for i, v in enumerate(votes))
            out[votes] = 1 / (1 + math.exp(min(700.0, b - a)))
        total = sum(patterns.values())
        mass = sum(c * out[v] for v, c in patterns.items())
        prior = min(0.999, max(0.001, (mass + 0.7) / (total + 1)))
        for i in range(n):
            for side, start, weigh in ((right, {1: 0.7, 0: 0.2, -1: 0.1}, lambda v: out[v]), (wrong, {1: 0.2, 0: 0.4, -1: 0.4}, lambda v: 1 - out[v])):
                sums = {x: 2 * start[x] + sum(c * weigh(v) for v, c in patterns.items() if v[i] == x) for x in (1, 0, -1)}
                side[i] = {x: s / sum(sums.values()) for x, s in sums.items()}
    return out


def _features(kind: int, votes: tuple[int, ...], length: int) -> list[int]:
    """Numbers of the features that are on: kind, each vote, the length class."""
    return [kind, *(len(NAMES) + 3 * i + v + 1 for i, v in enumerate(votes)), len(NAMES) + 3 * len(LABELERS) + length]


def train(rows: list[tuple[int, tuple[int, ...], int, float]], rounds: int = 300) -> list[float]:
    """Weights of a logistic classifier on the EM posteriors of (kind, votes, length class, count) rows."""
    by_kind: dict[int, dict[tuple[int, ...], float]] = {}
    for kind, votes, _, n in rows:
        own = by_kind.setdefault(kind, {})
        own[votes] = own.get(votes, 0) + n
    soft = {kind: em(own) for kind, own in by_kind.items()}
    weights = [0.0] * (len(NAMES) + 3 * len(LABELERS) + 4)
    total = sum(math.log1p(n) for *_, n in rows)
    for _ in range(rounds):
        slope = [0.002 * w for w in weights]
        for kind, votes, length, n in rows:
            on = _features(kind, votes, length)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[i] for i in on)))))
            for i in on:  # a pattern's weight grows with the logarithm of its count, so that rare ones are heard
                slope[i] += math.log1p(n) * (p - soft[kind][votes]) / total
        weights = [w - 2 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def fit(found: DataFrame, column: str) -> list[float] | None:
    """The classifier of all candidates in `column`."""
    votes = [F.expr(v).alias(f"v{i}") for i, v in enumerate(LABELERS.values())]
    names = [f"v{i}" for i in range(len(LABELERS))]
    each = found.select(F.explode(column).alias("s")).select(F.col("s.kind").alias("kind"), *votes, F.expr(_LENGTH).alias("length"))
    rows = each.groupBy("kind", *names, "length").count().collect()
    found = sorted((r["kind"], tuple(r[n] for n in names), r["length"], float(r["count"])) for r in rows)
    return train(found) if found else None


def chosen(weights: list[float] | None, column: str) -> str:
    """SQL for the spans of `column` that stay: base ones, and others that the classifier finds likely."""
    base = ", ".join(str(i) for i, (_, _, own) in enumerate(KINDS.values()) if own)
    if weights is None:
        return f"filter({column}, s -> s.kind in ({base}))"
    w = lambda values: "array(" + ", ".join(f"{x!r}D" for x in values) + ")"
    n = len(NAMES)
    terms = [f"{w(weights[:n])}[s.kind]", *(f"{w(weights[n + 3 * i : n + 3 * i + 3])}[({v}) + 1]" for i, v in enumerate(LABELERS.values())), f"{w(weights[n + 3 * len(LABELERS) :])}[{_LENGTH}]"]
    # A candidate of another kind that meets a base span would say the same twice.
    likely = f"filter({column}, s -> s.kind in ({base}) or {' + '.join(terms)} >= 0)"
    return apart(likely, f"s.kind in ({base})")


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone, base_sha256 and all spans as text, by start."""
    column = common.fresh(docs, "found")
    all_ = common.stored(candidates(docs.select(key, text), text=text, into=column).select(key, column), "pii-candidates")
    base = [i for i, (_, _, own) in enumerate(KINDS.values()) if own]
    out = all_.withColumn("spans", F.expr(chosen(fit(all_, column), column)))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {i})) as bigint)").alias(f"n_{NAMES[i]}") for i in base]
    own = f"array_sort(filter(spans, s -> s.kind in ({', '.join(map(str, base))})), (a, b) -> case when a.kind <> b.kind then a.kind - b.kind else a.start - b.start end)"
    ordered = "array_sort(spans, (a, b) -> case when a.kind <> b.kind then a.kind - b.kind else a.start - b.start end)"
    return out.select(key, *counts, F.sha2(F.expr(joined(own, NAMES)), 256).alias("base_sha256"), F.expr(joined(ordered, NAMES)).alias("spans"))


def redact(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """`docs` with each span that stays replaced by its kind, as in [EMAIL]; `length` is set anew. Overlapping spans become one."""
    columns, column = docs.columns, common.fresh(docs, "found")
    all_ = common.stored(candidates(docs, text=text, into=column), "pii-candidates")
    masked = replaced(f"`{text}`", chosen(fit(all_, column), column), [f"[{k.upper()}]" for k in NAMES])
    clean = F.when(F.size(column) > 0, F.expr(masked)).otherwise(F.col(text))
    out = all_.withColumn(text, clean)
    if length in columns:
        out = out.withColumn(length, F.when(F.size(column) > 0, F.length(text).cast(dict(docs.dtypes)[length])).otherwise(F.col(length)))
    return out.select(*columns)


__all__ = ["SPAN", "candidates", "em", "fit", "redact", "report", "train"]
