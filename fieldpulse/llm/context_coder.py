"""An adaptive context-mixing range coder for token ids, in numpy.

Ids (unsigned, below 65536) are coded in blocks of ``BLOCK`` that are reset
independently.  Within a block three predictors work on what was coded before:

* order 2: the id last seen after the same two ids, with a confidence;
* order 1: the same after the same one id;
* order 0: the distribution of the block's ids so far, renewed each time their
  number has doubled.

A step codes which of them is right (order 2, order 1, order 0, or none: the
id follows as 16 plain bits).  The probabilities of these four outcomes are a
mixture of what the three contexts have seen (by confidence), with weights that
move by how well each one did; then the interval is divided further by order
0's counts.  A carry-less range coder with 64-bit registers takes the intervals.

All blocks of a call advance together, one id of each a step ("lanes"), so a
step is a fixed number of numpy operations on arrays of all lanes.  Only exact
IEEE operations (+ - * /) are used, so every machine makes the same model.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048                          # ids in a block
LANES = 2048                          # blocks that advance together
_FIRST = 64                           # ids after which order 0 is renewed first
_N1, _N2 = 512, 1024                 # contexts of order 1 and 2 (hashed)
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_U16, _U32, _U48, _LOW16 = np.uint64(16), np.uint64(32), np.uint64(48), np.uint64(0xFFFF)
_KEEP, _SHARE = 0.97, 0.01            # weights: what stays, and what each order gets back


class _Mixer:
    """The predictors of all lanes.

    Tables are flat and read with ``take``; what contexts have seen of the four
    outcomes lies outcome by outcome, so that all lanes' numbers of one stand in a row.
    """

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.last, self.before = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        # id << 2 | confidence (0: nothing seen)
        self.seen1, self.seen2 = np.zeros(lanes * _N1, np.uint32), np.zeros(lanes * _N2, np.uint32)
        self.base1, self.base2, self.lane8, self.lane4 = (np.arange(lanes) * k for k in (_N1, _N2, 8, 4))
        first = np.array([[0.4], [0.4], [0.8], [0.4]])
        self.n0, self.n1, self.n2 = (np.repeat(first, lanes * k, axis=1) for k in (1, 8, 4))
        self.t0, self.t1, self.t2 = 2.0, np.full(lanes * 8, 2.0), np.full(lanes * 4, 2.0)
        self.w0, self.w1, self.w2 = np.full(lanes, 0.2), np.full(lanes, 0.3), np.full(lanes, 0.5)
        self.cuts = np.zeros((5, lanes), np.uint64)
        self.cuts[4] = 65536

    def predict(self) -> np.ndarray:
        """[5, lanes]: where each outcome's interval of 2^16 begins, and its end."""
        h = self.last * np.uint32(2654435761)
        self.at1 = (h >> np.uint32(23)) + self.base1
        h ^= self.before * np.uint32(0x85EBCA6B)
        h *= np.uint32(0xC2B2AE35)
        self.at2 = (h >> np.uint32(22)) + self.base2
        self.v1, self.v2 = self.seen1.take(self.at1), self.seen2.take(self.at2)
        self.k1, self.k2 = self.v1 & np.uint32(3), self.v2 & np.uint32(3)
        self.c1, self.c2 = self.v1 >> np.uint32(2), self.v2 >> np.uint32(2)
        self.s1 = self.lane8 + (self.k1 << np.uint32(1))
        self.s1 += self.c1 == self.c2
        self.s2 = self.lane4 + self.k2
        self.p0 = self.n0 * (self.w0 / self.t0)
        self.p1 = self.n1.take(self.s1, axis=1)
        self.p1 *= self.w1 / self.t1.take(self.s1)
        self.p2 = self.n2.take(self.s2, axis=1)
        self.p2 *= self.w2 / self.t2.take(self.s2)
        self.p = self.p2 + self.p1
        self.p += self.p0
        share = (self.p[:3] * 65528.0).astype(np.int32)
        share += 1
        share[1] += share[0]
        share[2] += share[1]
        self.cuts[1:4] = share
        return self.cuts

    def update(self, ids: np.ndarray, outcome: np.ndarray, spot: np.ndarray) -> None:
        """``spot``: where the outcome of each lane stands in an array [outcomes, lanes]."""
        scale = _KEEP / self.p.take(spot)
        self.w0 = self.p0.take(spot) * scale + _SHARE
        self.w1 = self.p1.take(spot) * scale + _SHARE
        self.w2 = self.p2.take(spot) * scale + _SHARE
        self.t0 += 1
        for table, at in ((self.n0, spot), (self.n1, outcome * (8 * self.lanes) + self.s1), (self.t1, self.s1),
                          (self.n2, outcome * (4 * self.lanes) + self.s2), (self.t2, self.s2)):
            table.reshape(-1)[at] = table.take(at) + 1
        fresh = (ids << np.uint32(2)) | np.uint32(1)
        for seen, at, v, c, k in ((self.seen1, self.at1, self.v1, self.c1, self.k1),
                                  (self.seen2, self.at2, self.v2, self.c2, self.k2)):
            # right: surer, 3 at most; wrong: less sure, or the new id if it was not sure
            wrong = np.where(k <= 1, fresh, v - np.uint32(1))
            seen[at] = np.where(c == ids, v + (k < 3), wrong)
        self.before, self.last = self.last, ids


def _epochs():
    """(first step, last step, ids that order 0 knows) of each span between renewals."""
    at, known = 0, 0
    for to in [*(_FIRST << k for k in range(64) if _FIRST << k < BLOCK), BLOCK]:
        yield at, to, known
        at = known = to


def _order0(ids: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the first ``known`` ids of each lane: sorted, and where each run begins in all lanes' places, and its length."""
    if not known:                                         # nothing yet: id 0 alone
        return np.zeros((len(ids), 1), np.uint16), np.arange(len(ids)), np.ones(len(ids), np.int64)
    table = np.sort(ids[:, :known], axis=1, kind="stable")
    head = np.ones(table.shape, bool)
    np.not_equal(table[:, 1:], table[:, :-1], out=head[:, 1:])
    heads = np.flatnonzero(head)
    return table, heads, np.diff(heads, append=table.size)


def _lookup(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[BLOCK, lanes]: start (of an unknown id: itself) and length (0: unknown) of each id in the table that order 0 has at its step."""
    first, length = (np.zeros((BLOCK, len(ids)), np.uint32) for _ in range(2))
    rows = min(16, len(ids))
    dense = np.zeros(rows << 16, np.int32)                # of some lanes at a time; cleared where it was filled
    for lo in range(0, len(ids), rows):
        part = ids[lo:lo + rows]
        row = (np.arange(len(part)) << 16)[:, None]
        spots, hi = part + row, lo + rows
        for at, to, known in _epochs():
            table, heads, run = _order0(part, known)
            lane, start = np.divmod(heads, table.shape[1])
            filled = (lane << 16) + table.take(heads)
            dense[filled] = (start << 16) | run
            found = dense.take(spots[:, at:to])
            dense[filled] = 0
            first[at:to, lo:hi] = np.where(found > 0, found >> 16, part[:, at:to]).T
            length[at:to, lo:hi] = (found & 0xFFFF).T
    return first, length


def _shift(known: int) -> np.uint64:
    return np.uint64(max(0, known.bit_length() - 1))


def encode(ids: np.ndarray) -> list[bytes]:
    """The blocks [n, BLOCK] of unsigned 16-bit ids, each coded on its own."""
    return [b for lo in range(0, len(ids), LANES) for b in _encode(ids[lo:lo + LANES])]


def _renormalise(low: np.ndarray, span: np.ndarray, move) -> None:
    """Shift out the settled upper 16 bits of each lane; ``move(lanes, low)`` writes or reads a word for each."""
    apart = low + span
    apart ^= low
    need = np.flatnonzero((apart < _TOP) | (span < _BOTTOM))
    lo, sp, apart = low.take(need), span.take(need), apart.take(need)
    while len(need):
        narrow = np.flatnonzero(apart >= _TOP)
        if len(narrow):
            sp[narrow] = (~lo[narrow] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
        move(need, lo)
        lo <<= _U16
        sp <<= _U16
        low[need], span[need] = lo, sp
        apart = (lo + sp) ^ lo
        more = np.flatnonzero((apart < _TOP) | (sp < _BOTTOM))
        need, lo, sp, apart = need.take(more), lo.take(more), sp.take(more), apart.take(more)


def _encode(ids: np.ndarray) -> list[bytes]:
    n = len(ids)
    model, lane = _Mixer(n), np.arange(n)
    low, span = np.zeros(n, np.uint64), np.full(n, np.iinfo(np.uint64).max, np.uint64)
    out = np.zeros((n, 3 * BLOCK + 16), "<u2")
    flat, pos = out.reshape(-1), np.arange(n) * out.shape[1]
    begin = pos.copy()

    def write(need, lo):
        at = pos.take(need)
        flat[at] = lo >> _U48
        pos[need] = at + 1

    columns = np.ascontiguousarray(ids.T).astype(np.uint32)
    first, length = _lookup(ids)
    for at, to, known in _epochs():
        shift = np.array([0, 0, _shift(known), 16], np.uint64)
        for t in range(at, to):
            x = columns[t]
            cuts = model.predict()
            s, m = first[t], length[t]
            outcome = np.subtract(3, m > 0, dtype=np.int64)
            outcome = np.where((model.c1 == x) & (model.k1 > 0), 1, outcome)
            outcome = np.where((model.c2 == x) & (model.k2 > 0), 0, outcome)
            # the outcome's interval, and within it the id's
            spot = outcome * n
            spot += lane
            a, unit = cuts.take(spot), span >> _U16
            low += a * unit
            span = (cuts.take(spot + n) - a) * unit
            unit = span >> shift.take(outcome)
            low += s * (outcome >= 2) * unit
            span = np.where(outcome == 2, m, np.uint32(1)) * unit
            _renormalise(low, span, write)
            model.update(x, outcome, spot)
    for _ in range(4):
        flat[pos] = low >> _U48
        pos += 1
        low <<= _U16
    return [flat[a:b].tobytes() for a, b in zip(begin.tolist(), pos.tolist())]


def decode(blocks: list[bytes]) -> np.ndarray:
    """[n, BLOCK] ids of the coded blocks."""
    parts = [_decode(blocks[lo:lo + LANES]) for lo in range(0, len(blocks), LANES)]
    return np.concatenate(parts) if parts else np.zeros((0, BLOCK), np.uint16)


def _decode(blocks: list[bytes]) -> np.ndarray:
    n = len(blocks)
    size = max(map(len, blocks)) // 2 + 8
    words = np.zeros((n, size), "<u2")
    for i, b in enumerate(blocks):
        words[i, :len(b) // 2] = np.frombuffer(b, "<u2")
    flat, pos = words.reshape(-1), np.arange(n) * size
    end = pos + size - 1
    ids = np.zeros((BLOCK, n), np.uint16)
    model, lane = _Mixer(n), np.arange(n)
    low, span = np.zeros(n, np.uint64), np.full(n, np.iinfo(np.uint64).max, np.uint64)
    code = np.zeros(n, np.uint64)
    for _ in range(4):
        code = (code << _U16) | flat[pos]
        pos += 1

    def read(need, _):
        at = pos.take(need)
        code[need] = (code.take(need) << _U16) | flat.take(at)
        pos[need] = np.minimum(at + 1, end.take(need))

    for at, to, known in _epochs():
        table, heads, run = _order0(np.ascontiguousarray(ids[:known].T), known)
        width = table.shape[1]
        row = lane * width
        # id, start and length in one number
        table = np.repeat((table.take(heads) | (heads % width) << 16 | run << 32).astype(np.uint64), run)
        shift = np.array([0, 0, _shift(known), 16], np.uint64)
        for t in range(at, to):
            cuts = model.predict()
            unit = span >> _U16
            v = np.minimum((code - low) // unit, np.uint64(65535))
            outcome = np.add(v >= cuts[1], v >= cuts[2], dtype=np.int64)
            outcome += v >= cuts[3]
            spot = outcome * n
            spot += lane
            a = cuts.take(spot)
            low += a * unit
            span = (cuts.take(spot + n) - a) * unit
            x = np.where(outcome == 0, model.c2, model.c1)
            some, rest = np.flatnonzero(outcome == 2), np.flatnonzero(outcome == 3)
            if len(some):
                unit = span.take(some) >> shift[2]
                inner = (code.take(some) - low.take(some)) // unit
                found = table.take(row.take(some) + np.minimum(inner, np.uint64(width - 1)).astype(np.int64))
                x[some] = found & _LOW16
                low[some] += (found >> _U16 & _LOW16) * unit
                span[some] = (found >> _U32) * unit
            if len(rest):
                unit = span.take(rest) >> shift[3]
                inner = np.minimum((code.take(rest) - low.take(rest)) // unit, np.uint64(65535))
                x[rest] = inner
                low[rest] += inner * unit
                span[rest] = unit
            ids[t] = x
            _renormalise(low, span, read)
            model.update(x, outcome, spot)
    return np.ascontiguousarray(ids.T)
