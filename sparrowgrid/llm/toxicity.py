"""Toxicity by noisy-channel deobfuscation and word evidence.

Tokens that mix letters with look-alike signs, words spelled out with gaps, and stretched letters are read
through a character lattice: each sign may stand for several letters, a run for one or two, a gap for none. A
Viterbi search under a trigram character model of the whole corpus restores the likeliest word. A gap may also be the
end of a word: beside the reading as one word, all words between gaps count that stand on a way through the letters
not much less likely than the likeliest. Words (restored where need be) give evidence: the word and its beginnings of four and five letters. For each
feature the share of toxic documents among the labelled ones that have it is estimated with a prior, and
features whose share chance explains, given how many were tried, are left out; a text's score is the
strongest share among its features.

The corpus model counts every document. Features are counted over the labelled rows but for verified copies of
others of their class (see `representatives`), toxic and clean ones in one shuffled aggregation, and judged there. Edited copies
of one text are no verified copies, and would witness for each of its words: those whose share would reject a text are therefore counted
again, by the different words that stand before and after them (the fewer of the two; one place in each row, chosen by hash, so that
copies choose alike), and judged by that. Every feature that passes is kept; only these are collected and broadcast.

Defined results: null and empty texts have no evidence and get the lowest score (BASE); a null id counts as the
text ""; of several labels of one id the largest counts; null labels are ignored; repeated rows are scored
alike; of features with one share any decides, as scores are shares; without labels every score is BASE; an empty table gives an
empty result. Texts, tokens and spelled-out runs are read at any length; of a sign repeated more than three times three are read, as more mean no
more to the lattice. What has the form of a number, an amount, a date or a time is one, and is not read as letters; all other
tokens with letters or signs that stand for letters are. A word between gaps has at most LONGEST letters, by
definition. Further columns are ignored by `report` and kept by `keep_clean`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, groupby
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

#: Entries of the classifier's table up to which it is a dict; a larger one is searched as sorted arrays, of 16 bytes an entry.
DICT_ROWS = 1_000_000
#: Prior weight of a feature, in documents; rows that a feature needs; score without evidence.
PRIOR, LEAST, BASE = 4.0, 3, 0.02
LONGEST = 40
#: Score from which a text is toxic.
DECISIVE = 0.5
#: Jaccard similarity of five-word shingles from which a labelled text is a copy.
COPY = 0.8
#: Natural logarithm of how much less likely than the likeliest a way through spelled-out letters may be.
MARGIN = 8.0
#: Labelled keys that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
CACHE = 200_000

LETTERS = " abcdefghijklmnopqrstuvwxyzàáâäæãçèéêëìíîïñòóôöõœùúûüßÿ"
_N = len(LETTERS)
_CODE = np.zeros(0x250, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < 0x250:
        _CODE[ord(_c.upper())] = _i
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il",
    "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "µ": "u", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "і": "i", "у": "y", "х": "x",
}
GAPS = " .-_*~'"
_SPELLED = re.compile(r"(?<![^\s])(?:[^\W_]|[@$!|+(€*])(?:[ .\-_~*](?:[^\W_]|[@$!|+(€*])){2,}(?![^\s.,;:!?])")
_ODD = re.compile(r"(.)\1\1")
_STRETCHED = re.compile(r"(.)\1{3,}", re.S)
#: Numbers, amounts, dates and times, with the signs and units beside them.
_NUMBER = re.compile(r"[#+\-~(]?[$€£]?[+\-]?\d[\d.,:;/+\-()%°$€£x×*=<>]*")
_GAP = re.compile(f"[{re.escape(GAPS)}]")
_EDGES = ".,;:?\"'()[]{}<>«»“”„¿…"


def crc_of(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


class CharacterModel:
    """log P(letter | two letters before), from counts of all trigrams."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(_N, _N, _N).astype(float)
        two, one = c.sum(axis=0), c.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + _N)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        self.log = np.log((c + 5 * p2[None]) / (c.sum(axis=2, keepdims=True) + 5)).tolist()

    def restore(self, token: str) -> str:
        """The likeliest word behind a token, in lower case; the token itself if nothing can be read."""
        found = self._read(token)
        return token if found is None else "".join(letters for letters, _ in found)

    def words(self, token: str) -> list[str]:
        """The readings of a token: as one word, and, where it has gaps, each part and the words that gaps may end."""
        found = self._read(token)
        if found is None:
            return [token]
        text, real, cuts = "".join(letters for letters, _ in found), [], [0]
        for letters, sign in found:
            if letters:
                real += [sign.isalpha()] * len(letters)
            elif cuts[-1] != len(real):
                cuts.append(len(real))
        out = {text: None}
        if len(cuts) > 1:
            for x in _GAP.split(token):
                if len(x) > 2 and legible(x):
                    out[x.lower() if x.isalpha() and not _ODD.search(x) else self.restore(x)] = None
            out |= dict.fromkeys(self._between(text, real, cuts))
        return list(out)

    def _between(self, text: str, real: list[bool], cuts: list[int]) -> Iterator[str]:
        """The words of at most LONGEST letters, or of one part, between two cuts on a way through `text` that is at most MARGIN less likely than the likeliest."""
        n, log = len(text), self.log
        c = [0, 0, *map(_code, text), 0]
        inner = [0.0, *accumulate(log[x][y][z] for x, y, z in zip(c, c[1:], c[2:-1], strict=False))]  # of the first letters
        cuts = cuts if cuts[-1] == n else [*cuts, n]
        # A word from i to j is as likely as start[i] + end[j]; of one letter: lone[i].
        first = [log[0][0][c[i + 2]] for i in cuts[:-1]]
        lone = [x + log[0][c[i + 2]][0] for x, i in zip(first, cuts, strict=False)]
        start = [x + log[0][c[i + 2]][c[i + 3]] - inner[i + 2] if i + 2 <= n else 0.0 for x, i in zip(first, cuts, strict=False)]
        end = [inner[j] + log[c[j]][c[j + 1]][0] for j in cuts]

        def likely(i: int, j: int) -> float:
            return start[i] + end[j] if cuts[j] - cuts[i] > 1 else lone[i]

        m = len(cuts)
        low = [0] * m  # the first cut from which a word may reach this one
        for j in range(1, m):
            i = low[j - 1]
            while i < j - 1 and cuts[j] - cuts[i] > LONGEST:
                i += 1
            low[j] = i
        before = [0.0] * m
        for j in range(1, m):
            before[j] = max(before[i] + likely(i, j) for i in range(low[j], j))
        after = [float("-inf")] * (m - 1) + [0.0]
        for j in range(m - 1, 0, -1):
            for i in range(low[j], j):
                if (s := likely(i, j) + after[j]) > after[i]:
                    after[i] = s
        sure, least = [0, *accumulate(real)], before[-1] - MARGIN
        for j in range(1, m):
            for i in range(low[j], j):
                size = cuts[j] - cuts[i]
                if size > 2 and before[i] + likely(i, j) + after[j] >= least and sure[cuts[j]] > sure[cuts[i]]:
                    yield text[cuts[i] : cuts[j]]

    def _read(self, token: str) -> list[tuple[str, str]] | None:
        """(letters read, sign) of each sign on the likeliest path, in order; None if there is none."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for sign, group in groupby(token.lower()):
            n = len(list(group))
            options: list[tuple[str, float]] = []
            if sign in GAPS:
                options.append(("", 0.0))
            if sign.isalpha() and _code(sign):
                options += [(sign, 0.0 if n == 1 else -0.5 if n > 2 else -2.5)]
                options += [(sign * 2, 0.0 if n == 2 else -1.5)] if n > 1 else []
            for letter in LOOKALIKES.get(sign, ""):
                options += [(letter, -1.5 if n == 1 else -2.5)] + ([(letter * 2, -1.5)] if n > 1 else [])
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for letters, cost in options:
                    x, y, s = a, b, score + cost
                    for letter in letters:
                        k = _code(letter)
                        s += self.log[x][y][k]
                        x, y = y, k
                    if (x, y) not in new or s > new[x, y][0]:
                        new[x, y] = (s, (path, letters, sign))
            if not new:
                return None
            states = new
        # Paths share their beginnings: what is held grows with the token's length only.
        path = max(((score + self.log[a][b][0], path) for (a, b), (score, path) in states.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            path, letters, sign = path
            out.append((letters, sign))
        return out[::-1]


def legible(token: str) -> bool:
    """Whether a token may be a word: not a number, and letters or signs for letters at all."""
    return not _NUMBER.fullmatch(token) and any(c.isalpha() or c in LOOKALIKES and not c.isdigit() for c in token)


def _code(letter: str) -> int:
    return int(_CODE[ord(letter)]) if ord(letter) < 0x250 else 0


class Reader(dict):
    """Piece of a text -> what `value` makes of each of its words; bounded, kept from text to text."""

    def __init__(self, model: CharacterModel, value: Callable[[str], object]):
        super().__init__()
        self.model, self.value = model, value

    def words(self, piece: str) -> list[str]:
        word = piece.strip(_EDGES)
        if word.isalpha() and not _ODD.search(word):
            return [word.lower()]
        bare = _STRETCHED.sub(r"\1\1\1", piece.strip(_EDGES + "!") if any(map(str.isalnum, piece)) else piece.strip(_EDGES))
        if bare.isalpha() and not _ODD.search(bare):
            return [bare.lower()]
        return self.model.words(bare) if len(bare) > 2 and legible(bare) else []

    def __missing__(self, piece: str):
        if piece.isalpha() and not _ODD.search(piece):
            found = (self.value(piece.lower()),)
        else:
            found = tuple(map(self.value, self.words(piece)))
        if len(self) < CACHE:
            self[piece] = found
        return found

    def all(self, text: str) -> Iterator:
        """The values of the words of a text's distinct pieces, and of its spelled-out words."""
        yield from chain.from_iterable(map(self.__getitem__, set(text.split())))
        for m in _SPELLED.finditer(text):
            yield from map(self.value, self.model.words(m[0]))


    def places(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Where values (tuples of features) are not empty: feature -> the smallest (hash, hash of the piece before, of that after)."""
        out: dict[int, tuple[int, int, int]] = {}

        def take(found: Iterator, before: str, after: str) -> None:
            a, b = xxh64_intdigest(before) >> 1, xxh64_intdigest(after) >> 1
            at = ((a * 3 + b) % (1 << 61), a, b)
            for f in found:
                if f not in out or at < out[f]:
                    out[f] = at

        pieces = text.split()
        known = {p: found for p in set(pieces) if (found := tuple(chain.from_iterable(self[p])))}
        if known:
            for before, piece, after in zip(["", *pieces], pieces, [*pieces[1:], ""], strict=False):
                if piece in known:
                    take(known[piece], before, after)
        for m in _SPELLED.finditer(text):
            if found := tuple(chain.from_iterable(map(self.value, self.model.words(m[0])))):
                take(found, *((text[: m.start()].rsplit(None, 1) or [""])[-1:]), *((text[m.end() :].split(None, 1) or [""])[:1]))
        return out


def feature(kind: str, word: str) -> int:
    return xxh64_intdigest(kind + word) >> 1


def features(word: str) -> tuple[int, ...]:
    """Hashes of a word and its beginnings."""
    if len(word) < 3:
        return ()
    if len(word) < 4:
        return (feature("w", word),)
    if len(word) < 5:
        return feature("w", word), feature("4", word)
    return feature("w", word), feature("4", word[:4]), feature("5", word[:5])


def character_model(docs: DataFrame, *, text: str = "text") -> CharacterModel:
    """Counts of letter trigrams over all texts; one small vector for each task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_N**3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in common.chunks(texts, len, 1_000_000):
                points = np.frombuffer("  ".join(["", *texts[a:b], ""]).encode("utf-32-le"), np.uint32)
                code = _CODE[np.where(points < 0x250, points, 0)]
                counts += np.bincount((code[:-2] * _N + code[1:-1]) * _N + code[2:], minlength=_N**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["i", "n"])

    rows = docs.select(common.text_or_empty(text).alias("t")).mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()  # _N ** 3 rows at most
    counts = np.zeros(_N**3)
    for r in rows:
        counts[r["i"]] = r["n"]
    return CharacterModel(counts)


def labelled(docs: DataFrame, marks: DataFrame, *, key: str, text: str) -> DataFrame:
    few = marks.count() <= BROADCAST_ROWS
    return docs.select(F.col(key).alias("k"), common.text_or_empty(text).alias("t")).join(F.broadcast(marks) if few else marks, "k")


def representatives(docs: DataFrame, marks: DataFrame, *, key: str, text: str) -> DataFrame:
    """(k, y) of the labelled rows but for verified copies, as copies of a text are one witness.

    Of rows of a class with equal words the smallest key stays. Of those that share the smallest hash of five-word shingles,
    the ones whose shingle sets have a Jaccard similarity of COPY or more to that of the smallest key are left out.
    """
    from .decontaminate import hashes, words_of

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.encode()) for t in batch.column(1).to_pylist()]
            h = np.array([hashes(w, 5).min() if w else 0 for w in words], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(same(words)), pa.array(h)], ["k", "y", "same", "h"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t.encode()) for t in batch.column(1).to_pylist()]
            mine = pa.array(same(words) == batch.column(3).to_numpy())  # a key may have several texts
            s = pa.array([np.unique(hashes(w, 5)).tobytes() if w else b"" for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), s], ["k", "y", "h", "s"]).filter(mine)

    def same(words: list[list[bytes]]) -> np.ndarray:
        return np.array([xxh64_intdigest(b" ".join(w)) for w in words], np.uint64).view(np.int64)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, first, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(k == first or both < COPY * (len(x) + len(y) - both))
            yield batch.select(["k", "y"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(docs.dtypes)[key]
    each = labelled(docs, marks, key=key, text=text).select("k", "t", "y").mapInArrow(least, f"k {kind}, y int, same long, h long")
    each = common.stored(each.groupBy("same", "y").agg(F.min(F.struct("k", "h")).alias("x")).select("y", "same", "x.*"), "toxicity-texts")
    many = common.stored(each.groupBy("h", "y").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "toxicity-many")
    crowd = common.stored(each.join(many.select("h", "y"), ["h", "y"]), "toxicity-crowd")
    found = labelled(docs, crowd, key=key, text=text).select("k", "t", "y", "same", "h").mapInArrow(sets, f"k {kind}, y int, h long, s binary")
    found = common.stored(found, "toxicity-sets")
    first = many.join(found.withColumnRenamed("k", "first"), ["h", "y", "first"]).groupBy("h", "y").agg(F.min("first").alias("first"), F.min("s").alias("s1"))
    met = found.join(common.stored(first, "toxicity-first"), ["h", "y"]).select("k", "y", "first", "s", "s1").mapInArrow(judge, f"k {kind}, y int")
    alone = each.join(many.select("h", "y"), ["h", "y"], "left_anti").select("k", "y")
    return common.stored(alone.union(met).distinct(), "toxicity-rows")


def learn(docs: DataFrame, labels: DataFrame, model, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """(sorted features, share of toxic documents of each) from the labelled rows."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    marks = representatives(docs, common.stored(marks, "toxicity-labels"), key=key, text=text)
    n = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if not n.get(1):
        return np.zeros(0, np.int64), np.zeros(0)
    rows = labelled(docs, marks, key=key, text=text).select("t", "y")
    prior = n[1] / sum(n.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, parts, held = Reader(model.value, features), ([], []), 0
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.fromiter({f for fs in reader.all(t) for f in fs}, np.int64)
                parts[y == 1].append(own)
                held += len(own)
                if held > 2_000_000:
                    yield summed(parts)
                    parts, held = ([], []), 0
        yield summed(parts)

    def summed(parts: tuple[list[np.ndarray], list[np.ndarray]]) -> pa.RecordBatch:
        clean, toxic = (np.concatenate([np.zeros(0, np.int64), *x]) for x in parts)
        f, at = np.unique(np.concatenate([clean, toxic]), return_inverse=True)
        c, t = np.bincount(at[: len(clean)], minlength=len(f)), np.bincount(at[len(clean) :], minlength=len(f))
        return pa.RecordBatch.from_arrays([pa.array(f), pa.array(t.astype(np.int64)), pa.array(c.astype(np.int64))], ["f", "t", "c"])

    counts = rows.where("y in (0, 1)").mapInArrow(run, "f long, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    tried = common.stored(counts.where(F.col("t") >= LEAST), "toxicity-features")
    n_tried = tried.count()
    first = passed(tried, prior, n_tried).toPandas().sort_values("f")  # those that pass only
    f, share = first["f"].to_numpy(np.int64), first["share"].to_numpy(float)
    high = share >= DECISIVE
    if not high.any():
        return f, share
    asked = docs.sparkSession.sparkContext.broadcast((f[high], share[high]))

    def witness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lookup(*asked.value)
        reader = Reader(model.value, lambda w: tuple(f for f in features(w) if table(f) is not None))
        for batch in batches:
            out = [(f, y, a, b) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f, (_, a, b) in reader.places(t).items()]
            f, y, a, b = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(y, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["f", "y", "a", "b"])

    places = common.stored(rows.where("y in (0, 1)").mapInArrow(witness, "f long, y int, a long, b long").distinct(), "toxicity-places")
    sides = [places.groupBy("f", "y", x).agg(F.lit(1).alias("one")).groupBy("f", "y").agg(F.count("one").alias(f"n{x}")) for x in ("a", "b")]
    seen = sides[0].join(sides[1], ["f", "y"]).withColumn("n", F.least("na", "nb"))
    again = seen.groupBy("f").agg(*(F.coalesce(F.sum(F.when(F.col("y") == v, F.col("n"))), F.lit(0)).alias(x) for x, v in (("t", 1), ("c", 0)))).where(F.col("t") >= LEAST)
    kept = passed(again, prior, n_tried).toPandas()
    f, share = np.concatenate((f[~high], kept["f"].to_numpy(np.int64))), np.concatenate((share[~high], kept["share"].to_numpy(float)))
    order = np.argsort(f)
    return f[order], share[order]


def passed(tried: DataFrame, prior: float, n_tried: int) -> DataFrame:
    """(f, share) of the features (f, t toxic rows, c clean rows) whose share of toxic rows chance does not explain."""
    t, seen = F.col("t"), F.col("t") + F.col("c")
    share, rate = (t + PRIOR * prior) / (seen + PRIOR), F.least(t / seen, F.lit(1 - 1e-12))
    out = tried.withColumn("share", share).where((F.col("share") > 2 * BASE) & (rate > prior))
    if prior < 1:
        # Chernoff's bound of the chance that a feature without meaning looks like this, times the features tried.
        chance = F.exp(-seen * (rate * F.log(rate / prior) + (1 - rate) * F.log((1 - rate) / (1 - prior))))
        out = out.where(chance * n_tried < 1)
    return out.select("f", "share")


class Table:
    """Feature -> share in sorted arrays."""

    def __init__(self, f: np.ndarray, share: np.ndarray):
        self.f, self.share = f, share

    def get(self, x: int) -> float | None:
        at = int(np.searchsorted(self.f, x))
        return float(self.share[at]) if at < len(self.f) and self.f[at] == x else None


def lookup(f: np.ndarray, share: np.ndarray) -> Callable[[int], float | None]:
    """Feature -> share or None: a dict, or beyond DICT_ROWS the sorted arrays."""
    return (dict(zip(f.tolist(), share.tolist(), strict=True)) if len(f) <= DICT_ROWS else Table(f, share)).get


class Scorer:
    """Texts to scores; made once in each task."""

    def __init__(self, model: CharacterModel, f: np.ndarray, share: np.ndarray):
        self.get = lookup(f, share)
        self.reader = Reader(model, self.evidence)

    def evidence(self, word: str) -> float:
        """Of a known word its own share; of another the smaller one of its beginnings'."""
        if len(word) < 3:
            return BASE
        share = self.get(feature("w", word))
        if share is not None:
            return share
        if len(word) < 4 or (share := self.get(feature("4", word[:4]))) is None or len(word) == 4:
            return share or BASE
        return min(share, self.get(feature("5", word[:5])) or BASE)

    def score(self, text: str | None) -> float:
        return max(self.reader.all(text), default=BASE) if text else BASE


def trained(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic"):
    """A broadcast (character model, features, shares)."""
    context = docs.sparkSession.sparkContext
    common.bound_batches(docs.sparkSession)
    model = character_model(docs, text=text)
    f, share = learn(docs, labels, context.broadcast(model), key=key, text=text, label=label)
    return context.broadcast((model, f, share))


def scorer(shared, tag: str) -> Scorer:
    return common.held(tag, lambda: Scorer(*shared.value))


def _tag() -> str:
    import uuid

    return uuid.uuid4().hex


def report(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5) -> DataFrame:
    """(key, held_out, score, predicted); labels are learnt from rows whose crc32(key as text) mod `folds` is not 0."""
    held = (crc_of(key) % folds == 0).alias("held_out")
    shared, tag = trained(docs, labels.where(crc_of(key) % folds != 0), key=key, text=text, label=label), _tag()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([scorer(shared, tag).score(t) for t in batch.column(2).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= DECISIVE).astype(np.int32))], [key, "held_out", "score", "predicted"])

    return docs.select(key, held, common.text_or_empty(text).alias("t")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5) -> DataFrame:
    """The rows of `docs`, all columns kept, whose score is below one half; learnt as in `report`."""
    shared, tag = trained(docs, labels.where(crc_of(key) % folds != 0), key=key, text=text, label=label), _tag()
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([scorer(shared, tag).score(t) < DECISIVE for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
