"""An adaptive range coder for blocks of token ids, which picks one order by an escape flag.

A block is cut into lanes that are coded side by side, each with a range coder of its
own; all lanes of a block share one model, which starts anew with every block:

* order 2 and order 1 each predict the id that last followed their context, with a
  confidence of 0 to 3. The two confidences, and whether the predictions agree, choose
  the adaptive frequencies with which "as order 2", "as order 1" or "neither" is coded;
* order 0 codes the id itself, by its frequency among such ids so far, if neither held.

Decoding repeats the same steps. Layout of a block, little-endian: ``RCM1``, number of
ids (8 bytes), vocabulary (4), lanes (4), crc32 of the ids as 32-bit integers (4),
16-bit words per lane (4 each), words of all lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RCM1"
HEADER = struct.Struct("<4sQIII")
#: Steps that a full lane has, and the most lanes of a block of the usual size.
STEPS = 256
TABLE_BITS = 16
_MASK48 = np.uint64((1 << 48) - 1)
_LOW32 = np.uint64(1 << 32)
_U16, _U32, _U48 = np.uint64(16), np.uint64(32), np.uint64(48)
_FLAG_STEP, _FLAG_LIMIT = 24, 1 << 14
_ID_STEP, _ID_LIMIT = 24, 1 << 22


class _Model:
    """Predictions of the next id of every lane, learnt from all lanes."""

    def __init__(self, vocabulary: int, lanes: int):
        self.size = vocabulary
        self.next1 = np.zeros(vocabulary + 1, dtype=np.int64)
        self.sure1 = np.zeros(vocabulary + 1, dtype=np.int8)
        self.next2 = np.zeros(1 << TABLE_BITS, dtype=np.int64)
        self.sure2 = np.zeros(1 << TABLE_BITS, dtype=np.int8)
        self.flags = np.tile(np.array([2, 1, 3], dtype=np.int64), (32, 1))
        self.counts = np.ones(vocabulary, dtype=np.int64)
        self.pending: list[np.ndarray] = []
        self.refresh()
        # The id "vocabulary" stands before the first of a lane.
        self.last1 = np.full(lanes, vocabulary, dtype=np.int64)
        self.last2 = np.full(lanes, vocabulary, dtype=np.int64)

    def predict(self, n: int) -> None:
        """Look up the first ``n`` lanes."""
        self.at1 = self.last1[:n]
        self.at2 = ((self.last2[:n] * 0x9E3779B1 + self.at1 * 0x85EBCA6B) >> 13) & ((1 << TABLE_BITS) - 1)
        self.guess1, self.conf1 = self.next1[self.at1], self.sure1[self.at1]
        self.guess2, self.conf2 = self.next2[self.at2], self.sure2[self.at2]
        self.context = self.conf2 * 8 + self.conf1 * 2 + (self.guess1 == self.guess2)
        self.table = np.cumsum(self.flags, axis=1).astype(np.uint64)

    def learn(self, ids: np.ndarray, flag: np.ndarray, coded: np.ndarray, step: int) -> None:
        n = len(ids)
        seen = np.bincount(self.context.astype(np.int64) * 3 + flag, minlength=96).reshape(32, 3)
        self.flags += seen * _FLAG_STEP
        full = self.flags.sum(axis=1) > _FLAG_LIMIT
        if full.any():
            self.flags[full] = (self.flags[full] >> 1) + 1
        for at, guess, conf, nexts, sure in (
            (self.at1, self.guess1, self.conf1, self.next1, self.sure1),
            (self.at2, self.guess2, self.conf2, self.next2, self.sure2),
        ):
            held = (guess == ids) & (conf > 0)
            keep = held | (conf > 1)
            nexts[at] = np.where(keep, guess, ids)
            sure[at] = np.where(held, np.minimum(conf + 1, 3), np.where(keep, conf - 1, 1))
        if len(coded):
            self.pending.append(coded)
        self.last2[:n] = self.last1[:n]
        self.last1[:n] = ids
        if step & 15 == 15 or step in (0, 1, 3, 7):
            self.refresh()

    def refresh(self) -> None:
        """Take the ids since the last time into the frequencies of order 0."""
        if self.pending:
            self.counts += np.bincount(np.concatenate(self.pending), minlength=self.size) * _ID_STEP
            self.pending = []
            if self.counts.sum() > _ID_LIMIT + self.size:
                self.counts = np.maximum(self.counts >> 1, 1)
        self.shown = self.counts.astype(np.uint64)
        self.ends = np.cumsum(self.shown)
        self.total = self.ends[-1] if self.size else np.uint64(1)


class _Encoder:
    def __init__(self, lanes: int, capacity: int):
        self.low = np.zeros(lanes, dtype=np.uint64)
        self.range = np.full(lanes, _MASK48, dtype=np.uint64)
        self.words = np.zeros((lanes, capacity), dtype=np.uint16)
        self.used = np.zeros(lanes, dtype=np.int64)

    def put(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        unit = self.range[lanes] // total
        low = self.low[lanes] + unit * start
        span = unit * size
        over = np.flatnonzero(low >> _U48)
        if len(over):
            low[over] &= _MASK48
            self._carry(lanes[over])
        while len(small := np.flatnonzero(span < _LOW32)):
            own = lanes[small]
            value = low[small]
            self.words[own, self.used[own]] = value >> _U32
            self.used[own] += 1
            low[small] = (value << _U16) & _MASK48
            span[small] <<= _U16
        self.low[lanes], self.range[lanes] = low, span

    def _carry(self, lanes: np.ndarray) -> None:
        at = self.used[lanes] - 1
        while len(lanes):
            self.words[lanes, at] += np.uint16(1)
            more = self.words[lanes, at] == 0
            lanes, at = lanes[more], at[more] - 1

    def finish(self) -> None:
        """One more word: the next multiple of 2**32 lies in every lane's range."""
        lanes = np.arange(len(self.low))
        end = self.low + (_LOW32 - np.uint64(1))
        over = np.flatnonzero(end >> _U48)
        if len(over):
            self._carry(lanes[over])
        self.words[lanes, self.used] = (end & _MASK48) >> _U32
        self.used += 1


class _Decoder:
    def __init__(self, words: np.ndarray, used: np.ndarray):
        # Behind each lane's words zeros are read.
        lanes = len(used)
        self.words = np.zeros((lanes, int(used.max(initial=0)) + 6), dtype=np.uint64)
        self.words[np.arange(self.words.shape[1]) < used[:, None]] = words
        self.at = np.full(lanes, 3, dtype=np.int64)
        w = self.words
        self.code = (w[:, 0] << _U32) | (w[:, 1] << _U16) | w[:, 2]
        self.range = np.full(lanes, _MASK48, dtype=np.uint64)

    def peek(self, lanes: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unit = self.range[lanes] // total
        return np.minimum(self.code[lanes] // unit, total - np.uint64(1)), unit

    def take(self, lanes: np.ndarray, unit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        code = self.code[lanes] - unit * start
        span = unit * size
        while len(small := np.flatnonzero(span < _LOW32)):
            own = lanes[small]
            code[small] = (code[small] << _U16) | self.words[own, self.at[own]]
            self.at[own] += 1
            span[small] <<= _U16
        self.code[lanes], self.range[lanes] = code, span


def _shape(n: int) -> tuple[int, int]:
    """Steps and lanes; all lanes but the last are full."""
    steps = max(1, min(STEPS, n))
    return steps, -(-n // steps)


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """The bytes of a block. No ids give a block without lanes."""
    ids = np.asarray(ids, dtype=np.int64)
    n = len(ids)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    steps, lanes = _shape(n)
    head = HEADER.pack(MAGIC, n, vocabulary, lanes, crc)
    if not n:
        return head
    if ids.min() < 0 or ids.max() >= vocabulary:
        raise ValueError("an id lies outside the vocabulary")
    rows = np.zeros(lanes * steps, dtype=np.int64)
    rows[:n] = ids
    columns = np.ascontiguousarray(rows.reshape(lanes, steps).T)
    last = n - (lanes - 1) * steps
    model, out = _Model(vocabulary, lanes), _Encoder(lanes, 4 * steps + 8)
    every = np.arange(lanes)
    for t in range(steps):
        active = lanes if t < last else lanes - 1
        if not active:
            break
        now = columns[t, :active]
        model.predict(active)
        as2 = (model.guess2 == now) & (model.conf2 > 0)
        as1 = (model.guess1 == now) & (model.conf1 > 0)
        flag = np.where(as2, 0, np.where(as1, 1, 2))
        ends = model.table[model.context]
        end = ends[every[:active], flag]
        size = model.flags[model.context, flag].astype(np.uint64)
        out.put(every[:active], end - size, size, ends[:, 2])
        own = np.flatnonzero(flag == 2)
        coded = now[own]
        if len(own):
            size = model.shown[coded]
            out.put(own, model.ends[coded] - size, size, model.total)
        model.learn(now, flag, coded, t)
    out.finish()
    words = out.words[np.arange(out.words.shape[1]) < out.used[:, None]]
    return head + out.used.astype("<u4").tobytes() + words.astype("<u2").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of a block; a damaged one raises an error."""
    magic, n, vocabulary, lanes, crc = HEADER.unpack_from(data)
    steps, expected = _shape(n)
    if magic != MAGIC or lanes != expected:
        raise ValueError("not a block of token ids")
    if not n:
        return np.zeros(0, dtype=np.uint32)
    used = np.frombuffer(data, "<u4", lanes, HEADER.size).astype(np.int64)
    words = np.frombuffer(data, "<u2", int(used.sum()), HEADER.size + 4 * lanes)
    model, source = _Model(vocabulary, lanes), _Decoder(words, used)
    columns = np.zeros((steps, lanes), dtype=np.int64)
    every = np.arange(lanes)
    last = n - (lanes - 1) * steps
    for t in range(steps):
        active = lanes if t < last else lanes - 1
        if not active:
            break
        model.predict(active)
        ends = model.table[model.context]
        value, unit = source.peek(every[:active], ends[:, 2])
        flag = (value >= ends[:, 0]).astype(np.int64) + (value >= ends[:, 1])
        size = model.flags[model.context, flag].astype(np.uint64)
        source.take(every[:active], unit, ends[every[:active], flag] - size, size)
        now = np.where(flag == 0, model.guess2, model.guess1)
        own = np.flatnonzero(flag == 2)
        coded = now[own]
        if len(own):
            value, unit = source.peek(own, model.total)
            coded = np.minimum(np.searchsorted(model.ends, value, side="right"), vocabulary - 1)
            size = model.shown[coded]
            source.take(own, unit, model.ends[coded] - size, size)
            now[own] = coded
        columns[t, :active] = now
        model.learn(now, flag, coded, t)
    ids = columns.T.ravel()[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block of token ids is damaged")
    return ids
