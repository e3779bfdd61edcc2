"""Adaptive context-mixing range coder of token ids.

A block stands alone: its model starts empty and its bytes carry checksums.  Its ids are cut into lanes of equal length that
share one model and each have a range coder of their own, so a step codes one id of every lane with array operations.

Three predictions are mixed for each id: the last id after the same two ids (order 2), the last id after the same id (order 1), and
the frequencies of all ids so far (order 0).  Orders 1 and 2 keep how often in a row they were right; how much of the probability
each of the three gets is learned for each combination of these, in whole numbers, so that any machine decodes what any other
has written.  An id that order 2 or 1 has named is coded as that; any other by its frequency.

The range has 48 bits and moves digits of 16.  A digit leaves a lane's encoder three digits before its decoder needs it, so the
digits are put into the order in which the decoder reads them, all lanes in one stream.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Digits of probability; lanes and ids of a block at most; steps of a lane at least, where there are so many ids.
BITS, LANES, BLOCK, STEPS = 24, 16384, 1 << 22, 256
_HEAD = struct.Struct("<IIIII")  # ids, lanes, digits, crc32 of the ids, crc32 of the digits
_HASH_BITS, _SURE, _GAIN, _MOST = 18, 7, 24, 1 << 18
_HIGH, _DIGIT = np.uint64(1 << 32), np.uint64(16)
_LOW32 = np.uint64(0xFFFFFFFF)


class Damaged(ValueError):
    """A block whose checksum doesn't hold."""


class Model:
    """What all lanes of a block have learned; encoder and decoder tell it the same ids in the same steps."""

    def __init__(self, lanes: int, vocabulary: int):
        self.vocabulary = vocabulary
        self.one = np.zeros(vocabulary, np.int32)  # named id and how often in a row it was right, by the id before
        self.two = np.zeros(1 << _HASH_BITS, np.int32)  # the same, by a hash of the two ids before
        self.last, self.context = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.seen = np.ones(vocabulary, np.int64)
        # prior: sure predictions get more
        sure = np.arange(_SURE + 1)
        self.won = np.empty((_SURE + 1, _SURE + 1, 2, 3), np.int64)
        self.won[..., 0], self.won[..., 1], self.won[..., 2] = 4 + 8 * sure[:, None, None], 2 + 4 * sure[None, :, None], 24
        self.fresh, self.total, self.steps = [], 0, 0
        self.rebuild()

    def rebuild(self) -> None:
        """Shares and frequencies out of the counts; done whenever a quarter more ids have been seen."""
        for ids in self.fresh:
            self.seen += _GAIN * np.bincount(ids, minlength=self.vocabulary)
        self.total += sum(map(len, self.fresh))
        self.fresh, self.waiting = [], 0
        while self.seen.sum() > max(_MOST, 4 * self.vocabulary):
            self.seen = (self.seen + 1) >> 1
        start = np.cumsum(self.seen) - self.seen
        total = int(self.seen.sum())
        whole, won = 1 << BITS, self.won.reshape(-1, 3)
        step = np.clip((won[:, 2] * whole // won.sum(axis=1)) // total, 1, min((whole - 2) // total, 0x7FFF))
        rest = whole - step * total
        second = np.clip(rest * won[:, 0] // (won[:, 0] + won[:, 1]), 1, rest - 1)
        #: By case: the width of one count of order 0, the end of order 1's share, and the end of order 2's, in one number.
        self.cuts = (step << 48) | (rest << 24) | second
        self.starts, self.widths = start.astype(np.uint32), self.seen.astype(np.uint32)
        self.named = None

    def of_count(self, counts: np.ndarray) -> np.ndarray:
        """The ids whose stretches of the frequencies hold the given places."""
        if self.named is None:
            self.named = np.repeat(np.arange(self.vocabulary, dtype=np.int32), self.seen)
        return self.named.take(counts, mode="clip")

    def predict(self) -> None:
        self.a2, self.a1 = self.two.take(self.context, mode="clip"), self.one.take(self.last, mode="clip")
        case = (self.a2 & 7) << 4
        case |= (self.a1 & 7) << 1
        case |= (self.a1 ^ self.a2) < 8
        self.case = case.astype(np.int64)
        cuts = self.cuts.take(self.case, mode="clip")
        self.step = (cuts >> 48).astype(np.uint32)
        self.one_end, self.two_end = (cuts >> 24).astype(np.uint32) & 0xFFFFFF, cuts.astype(np.uint32) & 0xFFFFFF

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """hit2 and hit1: the lanes of which order 2 has named the id, and those of which order 1 has and order 2 hasn't."""
        self.steps += 1
        if self.steps < 16 or self.steps % 4 == 0:  # the shares move slowly
            self.case *= 3
            self.case += 2
            self.case[hit2] -= 2
            self.case[hit1] -= 1
            self.won += 2 * np.bincount(self.case, minlength=self.won.size).reshape(self.won.shape)
        for table, at, old, right in ((self.two, self.context, self.a2, hit2), (self.one, self.last, self.a1, np.flatnonzero((self.a1 >> 3) == ids))):
            fresh = ids << 3
            kept = old[right]
            fresh[right] = kept + ((kept & 7) < _SURE)
            table[at] = fresh  # of lanes in one context the last one counts
        wide = ids.astype(np.int64)
        self.context = ((self.last * 40503) ^ (wide * 10007)) & ((1 << _HASH_BITS) - 1)
        self.last = wide
        self.fresh.append(ids)
        self.waiting += len(ids)
        if 4 * self.waiting >= self.total:
            self.rebuild()

    def stretches(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's share of the range begins, and how wide it is."""
        begin = self.step * self.starts.take(ids, mode="clip")
        begin += self.one_end
        width = self.step * self.widths.take(ids, mode="clip")
        begin[hit2], width[hit2] = 0, self.two_end[hit2]
        begin[hit1] = end = self.two_end[hit1]
        width[hit1] = self.one_end[hit1] - end
        return begin, width


def lanes_of(n: int) -> int:
    return max(1, min(LANES, n // STEPS))


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block."""
    n = len(ids)
    raw = zlib.crc32(np.ascontiguousarray(ids, "<u4"))
    if not n:
        return _HEAD.pack(0, 0, 0, raw, zlib.crc32(b""))
    lanes = lanes_of(n)
    steps = -(-n // lanes)
    table = np.zeros(lanes * steps, np.int32)
    table[:n] = ids
    table = np.ascontiguousarray(table.reshape(lanes, steps).T)
    model = Model(lanes, vocabulary)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    digits, owners = [], []
    for x in table:
        model.predict()
        two = (model.a2 >> 3) == x
        hit2, hit1 = np.flatnonzero(two), np.flatnonzero(((model.a1 >> 3) == x) & ~two)
        begin, width = model.stretches(x, hit2, hit1)
        unit = size >> np.uint64(BITS)
        low += unit * begin
        size = unit * width
        small = np.flatnonzero(size < _HIGH)
        while len(small):
            out = low[small]
            digits.append((out >> np.uint64(32)).astype(np.uint32))
            owners.append(small.astype(np.uint16))
            low[small] = (out & _LOW32) << _DIGIT
            size[small] <<= _DIGIT
            small = small[size[small] < _HIGH]
        model.learn(x, hit2, hit1)
    # one digit more settles a lane: the rest are zeros
    low = (low + _LOW32) >> np.uint64(32)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.uint16)
    held = np.bincount(owner, minlength=lanes)
    begin = np.concatenate([[0], np.cumsum(held + 3)])
    by_lane = np.zeros(begin[-1], np.uint32)
    order = np.argsort(owner, kind="stable")
    place = np.empty(len(owner), np.int64)  # of each digit, in the order of leaving
    place[order] = np.arange(len(owner)) + np.repeat(np.arange(lanes) * 3, held)
    by_lane[place] = np.concatenate(digits) if digits else 0
    by_lane[begin[:-1] + held] = low
    while len(over := np.flatnonzero(by_lane > 0xFFFF)):  # carries
        by_lane[over - 1] += by_lane[over] >> 16
        by_lane[over] &= 0xFFFF
    first = (begin[:-1, None] + np.arange(3)).T.ravel()
    body = by_lane[np.concatenate([first, place + 3])].astype("<u2").tobytes()
    return _HEAD.pack(n, lanes, len(body) // 2, raw, zlib.crc32(body)) + body


def decode(data: memoryview, at: int, vocabulary: int) -> tuple[np.ndarray, int]:
    """The ids of the block that begins at `at`, and where the next one begins."""
    n, lanes, words, raw, packed = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    body = data[at : at + 2 * words]
    if len(body) < 2 * words or zlib.crc32(body) != packed:
        raise Damaged("the digits of a block have another checksum")
    if not n:
        return np.zeros(0, np.uint32), at
    stream = np.frombuffer(body, "<u2").astype(np.uint64)
    steps = -(-n // lanes)
    table = np.empty((steps, lanes), np.int32)
    model = Model(lanes, vocabulary)
    size = np.full(lanes, 1 << 48, np.uint64)
    first = stream[: 3 * lanes].reshape(3, lanes)
    code = (first[0] << np.uint64(32)) | (first[1] << _DIGIT) | first[2]  # above the low end of the range
    used = 3 * lanes
    for t in range(steps):
        model.predict()
        unit = size >> np.uint64(BITS)
        # exact: both numbers are under 2 ** 53
        here = np.minimum(code.astype(np.float64) / unit.astype(np.float64), float((1 << BITS) - 1)).astype(np.uint32)
        two = here < model.two_end
        hit2, hit1 = np.flatnonzero(two), np.flatnonzero((here < model.one_end) & ~two)
        x = model.of_count((here - model.one_end) // model.step)
        x[hit2], x[hit1] = model.a2[hit2] >> 3, model.a1[hit1] >> 3
        begin, width = model.stretches(x, hit2, hit1)
        code -= unit * begin
        size = unit * width
        small = np.flatnonzero(size < _HIGH)
        while len(small):
            code[small] = (code[small] << _DIGIT) | stream[used : used + len(small)]
            used += len(small)
            size[small] <<= _DIGIT
            small = small[size[small] < _HIGH]
        table[t] = x
        model.learn(x, hit2, hit1)
    ids = table.T.ravel()[:n].astype("<u4")
    if zlib.crc32(ids) != raw:
        raise Damaged("the ids of a block have another checksum")
    return ids, at + 2 * words
