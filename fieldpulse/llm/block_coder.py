"""The second version of the token ids' coder: ``context_coder``'s three orders, renewed in steps, and an rANS coder.

Blocks of ``BLOCK`` ids (unsigned, below 65536), each coded on its own.  The
predictors are those of ``context_coder``: order 2 and order 1 (the id last
seen after the same two ids or one, with a confidence) and order 0 (the
block's ids so far), and the four outcomes: order 2 right, order 1 right,
found in order 0, or 16 plain bits.  The last ids and confidences move with
each id.  What is renewed at the steps of ``_RENEWED`` only:

* the probabilities of the outcomes in each state (both confidences, and
  whether the orders agree): a mixture of what the three orders' contexts have
  seen, and what the state itself has seen on top of it;
* the mixture's weights, by how well each order did since the last time.

So a step reads a state's intervals from a table instead of making them.  The
coder is range asymmetric numeral systems (rANS): a 64-bit register for each
block, at most one 32-bit word for an id, no division while decoding; blocks
are coded from their last id to the first.

All blocks of a call advance together ("lanes").  Only exact IEEE operations
in a fixed order are used, so every machine makes the same model.
"""

from __future__ import annotations

import numpy as np

from .context_coder import _N1, _N2, BLOCK, _lookup, _order0

LANES = 2048                          # blocks that advance together
_ORDER0 = (64, 128, 256, 512, 1024)   # ids after which order 0 is renewed (powers of two)
_RENEWED = (8, 16, 24, 32, 48, *range(64, 128, 16), *range(128, 256, 32), *range(256, 1024, 64), *range(1024, BLOCK, 128))
_MOST = max(b - a for a, b in zip((0, *_RENEWED), (*_RENEWED, BLOCK)))
_STATES = 32                          # confidences 0 to 3 of order 1 and 2, and whether they agree
_PRIOR = np.float32(16)                        # what the mixture counts for beside a state's own outcomes
_KEEP, _SHARE = 0.97, 0.01            # weights: what stays, and what each order gets back
_FIRST = tuple(np.float32(x) for x in (0.8, 0.4, 0.4))      # counts of order 0, 1 and 2 before anything is seen
_RARELY = np.float32(1e-4)            # what is left of an outcome that a state rules out
_MOVES = np.array([0, 0, -1, -1, 1, 1, 1, 0]).astype(np.uint32)   # of a confidence; from 4: if the id was right
_U16, _U32, _LOW16, _LOW32 = (np.uint64(k) for k in (16, 32, 0xFFFF, 0xFFFFFFFF))
_FULL = np.uint64(1 << 32)


def _sum(x: np.ndarray) -> np.ndarray:
    """The sum over the second axis, in its order (``sum`` may take another one for a single lane)."""
    out = x[:, 0].copy()
    for k in range(1, x.shape[1]):
        out += x[:, k]
    return out


class _Model:
    """The predictors of all lanes; places of a table are [outcome, state, lane]."""

    def __init__(self, lanes: int):
        self.lanes, self.lane = lanes, np.arange(lanes)
        self.last, self.mixed = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        # id << 2 | confidence (0: nothing seen)
        self.seen1, self.seen2 = np.zeros(lanes * _N1, np.uint32), np.zeros(lanes * _N2, np.uint32)
        self.base1, self.base2 = self.lane * _N1, self.lane * _N2
        self.counts = np.zeros((4, _STATES, lanes), np.float32)
        self.weights = [np.full(lanes, w, np.float32) for w in (0.2, 0.3, 0.5)]
        self._tables()

    def _by_context(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums for the contexts of order 0, 1 and 2, added up in a fixed order."""
        by = x.reshape(4, 2, 4, 4, self.lanes)                # outcome, agree, confidence 2, confidence 1, lane
        ones = by[:, :, 0] + by[:, :, 1]
        ones += by[:, :, 2]
        ones += by[:, :, 3]
        twos = by[:, 0] + by[:, 1]
        return _sum(_sum(ones)), ones, _sum(twos.swapaxes(1, 2))

    def _tables(self) -> None:
        """From the counts: each state's intervals."""
        n = self.lanes
        self.parts = []
        for x, first in zip(self._by_context(self.counts), _FIRST):
            x += first
            total = x[0] + x[1]
            total += x[2]
            total += x[3]
            self.parts.append(x / total)
        none, ones, twos = (x * (w * _PRIOR) for x, w in zip(self.parts, self.weights))
        ones += none[:, None, None]
        mix = twos[:, None, :, None] + ones[:, :, None]
        mix[0, :, 0] *= _RARELY                               # an order that has seen nothing, or says the same as another
        mix[1, :, :, 0] *= _RARELY
        mix[1, 1, 1:, 1:] *= _RARELY
        self.mix = mix.reshape(4, _STATES, n)
        p = self.mix + self.counts
        total = p[0] + p[1]
        total += p[2]
        total += p[3]
        share = (p[:3] * (np.float32(65528) / total)).astype(np.uint32)
        share += np.uint32(1)
        a, b, c = share
        b += a
        c += b
        self.cuts = (b.astype(np.uint64) << _U16 | a | c.astype(np.uint64) << _U32).reshape(-1)
        intervals = np.empty((4, _STATES, n, 2), "<u4")       # start, length
        intervals[0, ..., 0] = 0
        intervals[1:, ..., 0] = share
        intervals[0, ..., 1] = a
        np.subtract(share[1:], share[:2], out=intervals[1:3, ..., 1])
        np.subtract(np.uint32(65536), c, out=intervals[3, ..., 1])
        self.intervals = intervals.reshape(-1).view(np.uint64)

    def renew(self, places: np.ndarray) -> None:
        """Take in the outcomes since the last time."""
        new = np.bincount(places.reshape(-1), minlength=4 * _STATES * self.lanes).astype(np.float32).reshape(self.counts.shape)
        for k, (gain, part) in enumerate(zip(self._by_context(new / self.mix), self.parts)):
            gain *= part
            while gain.ndim > 1:
                gain = _sum(gain.swapaxes(0, 1)) if gain.ndim > 2 else gain[0] + gain[1] + gain[2] + gain[3]
            self.weights[k] = self.weights[k] * gain * np.float32(_PRIOR * _KEEP / len(places)) + np.float32(_SHARE)
        self.counts += new
        self._tables()

    def state(self) -> np.ndarray:
        """Where each lane's state stands in the table of cuts."""
        h = self.last * np.uint32(2654435761)
        self.at1 = (h >> np.uint32(23)) + self.base1
        again = self.last * np.uint32(0x85EBCA6B)
        h ^= self.mixed
        self.mixed = again
        h *= np.uint32(0xC2B2AE35)
        self.at2 = (h >> np.uint32(22)) + self.base2
        self.v1, self.v2 = self.seen1.take(self.at1), self.seen2.take(self.at2)
        self.k1, self.k2 = self.v1 & np.uint32(3), self.v2 & np.uint32(3)
        self.c1, self.c2 = self.v1 >> np.uint32(2), self.v2 >> np.uint32(2)
        state = self.k2 << np.uint32(2)
        state += self.k1
        state += (self.c1 == self.c2).view(np.uint8) << np.uint8(4)
        state *= np.uint32(self.lanes)
        return state + self.lane

    def update(self, ids: np.ndarray) -> None:
        fresh = ids << np.uint32(2)
        fresh |= np.uint32(1)
        for seen, at, v, c, k in ((self.seen1, self.at1, self.v1, self.c1, self.k1),
                                  (self.seen2, self.at2, self.v2, self.c2, self.k2)):
            # right: surer, 3 at most; wrong: less sure, or the new id if it was not sure
            right = c == ids
            moved = v + _MOVES.take(k + (right.view(np.uint8) << np.uint8(2)))
            right |= k > 1
            seen[at] = np.where(right, moved, fresh)
        self.last = ids


def _spans():
    """(first step, last step, ids that order 0 knows, whether the model is renewed after them)."""
    at, known = 0, 0
    for to in sorted({*_ORDER0, *_RENEWED, BLOCK}):
        yield at, to, known, to in _RENEWED
        at, known = to, to if to in _ORDER0 else known


def _bits(known: int) -> int:
    return max(0, known.bit_length() - 1)


def encode(ids: np.ndarray) -> list[bytes]:
    """The blocks [n, BLOCK] of unsigned 16-bit ids, each coded on its own."""
    return [b for lo in range(0, len(ids), LANES) for b in _encode(ids[lo:lo + LANES])]


def _encode(ids: np.ndarray) -> list[bytes]:
    n = len(ids)
    model, width = _Model(n), np.int64(_STATES * n)
    columns = np.ascontiguousarray(ids.T).astype(np.uint32)
    first, length = _lookup(ids)
    outcomes = np.empty((BLOCK, n), np.int8)
    outer = np.empty((BLOCK, n), np.uint64)
    begun, places = 0, np.empty((_MOST, n), np.int64)      # since the last renewal
    for at, to, _, renewed in _spans():
        for t in range(at, to):
            x = columns[t]
            place = model.state()
            outcome = np.subtract(3, length[t] > 0, dtype=np.int64)
            outcome = np.where((model.c1 == x) & (model.k1 > 0), 1, outcome)
            outcome = np.where((model.c2 == x) & (model.k2 > 0), 0, outcome)
            outcomes[t] = outcome
            outcome *= width
            np.add(outcome, place, out=places[t - begun])
            model.update(x)
        outer[at:to] = model.intervals.take(places[at - begun:to - begun])
        if renewed:
            model.renew(places[:to - begun])
            begun = to
    # backwards: within the outcome first, then the outcome
    out = np.zeros((n, BLOCK + 2), "<u4")
    flat, pos = out.reshape(-1), np.arange(n) * out.shape[1] + out.shape[1]
    end, state = pos.copy(), np.full(n, _FULL, np.uint64)
    for at, to, known, _ in reversed([*_spans()]):
        bits = np.array([0, 0, _bits(known), 16], np.uint64)
        for t in range(to - 1, at - 1, -1):
            outcome, within = outcomes[t], outcomes[t] >= 2
            shift = bits.take(outcome)
            m = np.where(outcome == 2, length[t], np.uint32(1)).astype(np.uint64)
            start, size = outer[t] & _LOW32, outer[t] >> _U32
            need = np.flatnonzero(state >= (size * m) << (np.uint64(48) - shift))
            if len(need):
                pos[need] -= 1
                x = state.take(need)
                flat[pos.take(need)] = x & _LOW32
                state[need] = x >> _U32
            some = np.flatnonzero(within)
            if len(some):
                x, k = state.take(some), m.take(some)
                q = x // k
                state[some] = (q << shift.take(some)) + (x - q * k) + first[t].take(some)
            q = state // size
            state += (q << _U16) - q * size + start
    for part in (state & _LOW32, state >> _U32):
        pos -= 1
        flat[pos] = part
    return [flat[a:b].tobytes() for a, b in zip(pos.tolist(), end.tolist())]


def decode(blocks: list[bytes]) -> np.ndarray:
    """[n, BLOCK] ids of the coded blocks."""
    parts = [_decode(blocks[lo:lo + LANES]) for lo in range(0, len(blocks), LANES)]
    return np.concatenate(parts) if parts else np.zeros((0, BLOCK), np.uint16)


def _decode(blocks: list[bytes]) -> np.ndarray:
    n = len(blocks)
    size = max(map(len, blocks)) // 4 + 1
    words = np.zeros((n, size), "<u4")
    for i, b in enumerate(blocks):
        words[i, :len(b) // 4] = np.frombuffer(b, "<u4")
    flat, pos = words.reshape(-1), np.arange(n) * size
    end = pos + size - 1
    ids = np.zeros((BLOCK, n), np.uint16)
    model, lane, strides = _Model(n), np.arange(n), np.arange(4) * (_STATES * n)
    state = np.zeros(n, np.uint64)
    for _ in range(2):
        state = state << _U32 | flat[pos]
        pos += 1
    begun, places, held = 0, np.empty((_MOST, n), np.int64), None
    for at, to, known, renewed in _spans():
        if known != held:
            table, heads, run = _order0(np.ascontiguousarray(ids[:known].T), known)
            row, held = lane * table.shape[1], known
            # id, start and length in one number
            table = np.repeat((table.take(heads) | (heads % table.shape[1]) << 16 | run << 32).astype(np.uint64), run)
        bits = np.uint64(_bits(known))
        mask = (np.uint64(1) << bits) - np.uint64(1)
        for t in range(at, to):
            place = model.state()
            cuts, slot = model.cuts.take(place).view("<u2"), state.view("<u2")[::4]
            outcome = (slot >= cuts[::4]).view(np.uint8) + (slot >= cuts[1::4]).view(np.uint8)
            outcome += (slot >= cuts[2::4]).view(np.uint8)
            place += strides.take(outcome)
            places[t - begun] = place
            interval = model.intervals.take(place)
            slot = state & _LOW16
            state >>= _U16
            state *= interval >> _U32
            state += slot
            state -= interval & _LOW32
            x = np.where(outcome == 0, model.c2, model.c1)
            some, rest = np.flatnonzero(outcome == 2), np.flatnonzero(outcome == 3)
            if len(some):
                inner = state.take(some)
                slot = inner & mask
                found = table.take(row.take(some) + slot.astype(np.int64))
                x[some] = found & _LOW16
                inner >>= bits
                inner *= found >> _U32
                inner += slot
                inner -= found >> _U16 & _LOW16
                state[some] = inner
            if len(rest):
                inner = state.take(rest)
                x[rest] = inner & _LOW16
                state[rest] = inner >> _U16
            need = np.flatnonzero(state < _FULL)
            if len(need):
                spot = pos.take(need)
                state[need] = state.take(need) << _U32 | flat.take(spot)
                pos[need] = np.minimum(spot + 1, end.take(need))
            ids[t] = x
            model.update(x)
        if renewed:
            model.renew(places[:to - begun])
            begun = to
    return np.ascontiguousarray(ids.T)
