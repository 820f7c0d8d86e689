"""Token ids to compact blocks: an adaptive context-mixing range coder.

A block is coded by itself: all models start anew and its checksum stands beside it. Inside a block the ids
are cut into equal lanes that advance in step, so that one numpy operation serves thousands of lanes; the
models are shared by the lanes of the block and learn after each step. For each id

* the order-2 table (two ids before) and the order-1 table (one id before) each predict an id, with a
  confidence that rises with hits and falls with misses;
* counters chosen by both confidences and by whether the two agree give the shares of "order 2 is right",
  "order 1 is right" and "neither";
* within the last share the id is coded by its order-0 frequency in the block so far.

Only integers are used, so that any machine decodes what another has coded.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from zlib import crc32

import numpy as np

#: Ids in a block at most.
BLOCK = 1 << 20
LANES = 4096
LEVELS = 8
HASH_BITS = 18
#: Steps between two rebuilds of the order-0 table, and of the shares.
REBUILD, RESHARE = 8, 2
#: Bits of a share; a step divides the range into (1 << SHARE) * sum of counts, which stays below 2**32.
SHARE = 10
WEIGHT = 3
_U = np.uint64
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 32)
_HASH_TWO, _HASH_ONE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
#: An entry of a table is an id above three bits of confidence; what a miss takes off that.
_ID, _TRUST, _MISS = np.uint32(3), np.uint32(7), np.uint32(2)
#: Bits that hold any lane's number.
_LANE = _U(32)
MAGIC = b"IDC1"


class Models:
    """The shared predictions of a block."""

    def __init__(self, lanes: int, vocabulary: int):
        self.one, self.two = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        # Predicted id << 3 | confidence, by one and by two ids before.
        self.tables = [np.zeros(vocabulary, np.uint32), np.zeros(1 << HASH_BITS, np.uint32)]
        self.shares = np.ones((LEVELS * LEVELS * 2, 3), np.int64)
        self.counts, self.sums = np.ones(vocabulary, _U), np.zeros(vocabulary + 1, _U)
        # By slot and outcome (order 2, order 1, neither): where the outcome begins, and how wide it is; of "neither" how wide a count of one is.
        self.begin, self.wide = np.zeros(self.shares.shape, _U), np.zeros(self.shares.shape, _U)
        self.steps = 0
        self.rebuild()
        self.reshare()
        self.respan()

    def rebuild(self) -> None:
        np.cumsum(self.counts, out=self.sums[1:])
        self.all = self.sums[-1]
        self.parts = self.all << _U(SHARE)

    def reshare(self) -> None:
        total, most = self.shares.sum(axis=1), (1 << SHARE) - 2
        first = np.minimum(np.maximum((self.shares[:, 0] << SHARE) // total, 1), most)
        second = np.minimum(np.maximum((self.shares[:, 1] << SHARE) // total, 1), most + 1 - first)
        self.first, self.both = first.astype(_U), (first + second).astype(_U)

    def respan(self) -> None:
        self.begin[:, 1] = self.wide[:, 0] = self.first * self.all
        self.begin[:, 2] = self.both * self.all
        self.wide[:, 1] = self.begin[:, 2] - self.begin[:, 1]
        self.wide[:, 2] = _U(1 << SHARE) - self.both

    def look(self) -> None:
        """Predictions and shares for the next step of all lanes."""
        # Bits 7 to 24 of the sum, which 32 bits hold.
        both = (self.two * _HASH_TWO + self.one * _HASH_ONE) >> np.uint32(7) & np.uint32((1 << HASH_BITS) - 1)
        self.at = self.one.astype(np.intp), both.astype(np.intp)
        self.p1, self.p2 = self.tables[0].take(self.at[0]), self.tables[1].take(self.at[1])
        self.trust1, self.trust2 = self.p1 & _TRUST, self.p2 & _TRUST
        self.g1, self.g2 = self.p1 >> _ID, self.p2 >> _ID
        self.slot = self.trust2 << np.uint32(4) | self.trust1 << np.uint32(1) | (self.g1 == self.g2)

    def narrow(self, lanes: int) -> None:
        """Only the first lanes have an id in this step."""
        self.at = self.at[0][:lanes], self.at[1][:lanes]
        for x in ("p1", "p2", "trust1", "trust2", "g1", "g2", "slot"):
            setattr(self, x, getattr(self, x)[:lanes])

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each lane's id lies in the range, and how wide it is."""
        self.hit2, self.hit1 = ids == self.g2, ids == self.g1
        what = (np.uint8(2) - self.hit1.view(np.uint8)) * (np.uint8(1) - self.hit2.view(np.uint8))
        self.key = (self.slot * np.uint32(3) + what).astype(np.intp)
        self.new = np.flatnonzero(what == 2)
        self.fresh = ids.take(self.new).astype(np.intp)
        start, size = self.begin.take(self.key), self.wide.take(self.key)
        low, one = self.sums.take(self.fresh), size.take(self.new)
        start[self.new] += low * one
        size[self.new] = (self.sums.take(self.fresh + 1) - low) * one
        return start, size

    def learn(self, ids: np.ndarray) -> None:
        """From the ids whose spans were asked for."""
        self.shares += np.bincount(self.key, minlength=self.shares.size).reshape(self.shares.shape) * 24
        named = ids << _ID
        for table, at, p, trust, hit in ((self.tables[0], self.at[0], self.p1, self.trust1, self.hit1), (self.tables[1], self.at[1], self.p2, self.trust2, self.hit2)):
            table[at] = np.where(hit, p + (trust < LEVELS - 1), np.where(trust <= 1, named, p - _MISS))
        np.add.at(self.counts, self.fresh, _U(WEIGHT))
        self.two, self.one = self.one, ids
        self.steps += 1
        if again := self.steps % REBUILD == 0:
            self.rebuild()
        if self.steps % RESHARE == 0:
            full = self.shares.sum(axis=1) > 1 << 16
            if full.any():
                self.shares[full] = (self.shares[full] + 1) // 2
            self.reshare()
            again = True
        if again:
            self.respan()


def renorm(low: np.ndarray, width: np.ndarray, move: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Shift out the upper 16 bits of lanes while they are settled or the range is short; `move` gets the lanes and their lows before each shift."""
    go = np.flatnonzero(((low ^ (low + width)) < _TOP) | (width < _BOTTOM))
    l, w = low.take(go), width.take(go)
    while len(go):
        w = np.where((l ^ (l + w)) < _TOP, w, (~l + _U(1)) & (_BOTTOM - _U(1)))
        move(go, l)
        l, w = l << _U(16), w << _U(16)
        low[go], width[go] = l, w
        more = np.flatnonzero(((l ^ (l + w)) < _TOP) | (w < _BOTTOM))
        go, l, w = go.take(more), l.take(more), w.take(more)


def lanes_of(n: int) -> tuple[int, int]:
    steps = -(-n // max(1, min(LANES, n // 64)))
    return -(-n // steps), steps


def shape(ids: np.ndarray) -> tuple[np.ndarray, int]:
    """Step by lane, and how many lanes have an id in the last step; `spread` says how ids fill the lanes."""
    lanes, steps = lanes_of(len(ids))
    live, last = spread(len(ids), lanes, steps)
    grid = np.zeros((lanes, steps), np.uint32)
    grid[live] = ids
    return np.ascontiguousarray(grid.T), last


def spread(n: int, lanes: int, steps: int) -> tuple[np.ndarray, int]:
    """Lanes are full but for the last step, where the last lanes have none."""
    live, last = np.ones((lanes, steps), bool), lanes - (lanes * steps - n)
    live[last:, -1] = False
    return live, last


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block with its header; `ids` are below `vocabulary`."""
    if vocabulary + WEIGHT * len(ids) > 1 << 32 - SHARE:
        raise ValueError("the vocabulary is too large for the coder's precision")
    ids = np.asarray(ids, np.int64)
    head = MAGIC + struct.pack("<III", len(ids), vocabulary, crc32(ids.astype("<u4").tobytes()))
    if not len(ids):
        return head
    grid, last = shape(ids)
    steps, lanes = grid.shape
    model = Models(lanes, vocabulary)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    where: list[np.ndarray] = []
    words: list[np.ndarray] = []

    def move(go: np.ndarray, l: np.ndarray) -> None:
        where.append(go.astype(np.uint16))
        words.append((l >> _U(48)).astype(np.uint16))

    for s in range(steps):
        now, some = grid[s], slice(last if s == steps - 1 else lanes)
        model.look()
        if s == steps - 1 and last < lanes:
            model.narrow(last)
            now = now[some]
        start, size = model.span(now)
        unit = width[some] // model.parts
        low[some] += start * unit
        width[some] = size * unit
        renorm(low[some], width[some], move)
        model.learn(now)
    for i in range(4):
        move(np.arange(lanes), low << _U(16 * i))
    lane = np.concatenate(where)
    return head + np.bincount(lane, minlength=lanes).astype("<u4").tobytes() + np.concatenate(words)[np.argsort(lane, kind="stable")].astype("<u2").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if they do not fit its checksum."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of ids")
    n, vocabulary, checksum = struct.unpack("<III", data[4:16])
    if not n:
        return np.zeros(0, np.int64)
    lanes, steps = lanes_of(n)
    filled = np.frombuffer(data, "<u4", lanes, 16).astype(np.int64)
    words = np.concatenate((np.frombuffer(data, "<u2", -1, 16 + 4 * lanes), np.zeros(8, np.uint16)))
    if len(words) - 8 != filled.sum():
        raise ValueError("a block of ids is cut short")
    at = np.cumsum(filled) - filled
    code = np.zeros(lanes, _U)
    for _ in range(4):
        code = code << _U(16) | words[at]
        at += 1
    live, last = spread(n, lanes, steps)
    grid = np.zeros((steps, lanes), np.uint32)
    model = Models(lanes, vocabulary)
    low, width = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)

    def move(go: np.ndarray, _: np.ndarray) -> None:
        place = at.take(go)
        code[go] = code.take(go) << _U(16) | words.take(place, mode="clip")
        at[go] = place + 1

    for s in range(steps):
        some = slice(last if s == steps - 1 else lanes)
        model.look()
        if s == steps - 1 and last < lanes:
            model.narrow(last)
        unit = width[some] // model.parts
        place = np.minimum((code[some] - low[some]) // unit, model.parts - _U(1))
        known = model.slot.astype(np.intp) * 3
        now = np.where(place < model.wide.take(known), model.g2, model.g1)
        rest = model.begin.take(known + 2)
        new = np.flatnonzero(place >= rest)
        wanted = (place.take(new) - rest.take(new)) // model.wide.take(known.take(new) + 2)
        wanted = np.sort(wanted << _LANE | np.arange(len(new), dtype=_U))  # neighbours in the table one after the other; a count has 22 bits
        now[new.take((wanted & ((_U(1) << _LANE) - _U(1))).astype(np.intp))] = np.searchsorted(model.sums, wanted >> _LANE, side="right") - 1
        start, size = model.span(now)
        low[some] += start * unit
        width[some] = size * unit
        renorm(low[some], width[some], move)
        grid[s, some] = now
        model.learn(now)
    ids = grid.T[live].astype(np.int64)
    if crc32(ids.astype("<u4").tobytes()) != checksum:
        raise ValueError("a block of ids does not fit its checksum")
    return ids


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """Any number of ids as blocks, each with its length before it."""
    return b"".join(struct.pack("<I", len(b)) + b for b in (encode_block(ids[a : a + BLOCK], vocabulary) for a in range(0, len(ids), BLOCK)))


def decode(data: bytes) -> np.ndarray:
    parts, at = [np.zeros(0, np.int64)], 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        parts.append(decode_block(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return np.concatenate(parts)
