"""An adaptive context-mixing range coder for token ids, many blocks side by side in numpy.

Ids are cut into blocks of about ``BLOCK``. Each block starts from the same reset
state, has a checksum and is decoded without any other one, so all blocks of a
frame are coded in step: one numpy operation works on the same place of each.

Three orders predict the next id:

* order 2 the id that last followed the two before it in this block, with a
  confidence of 0 to 3, and order 1 the one that last followed the id before it;
* order 0 every id by its count in the frame, which the frame's head holds.

The guess g is that of order 2 where it has seen its context, else that of order
1, and the mixture is ``w [x = g] + (1 - w) P0(x)``. The weight w is learned within
the block for each confidence and for whether both orders agree. It is
coded arithmetically: the weight with 16-bit, order 0 with 20-bit frequencies. All
of it is integer arithmetic (quotients of integers below 2**48 are taken in
doubles, where their floor is exact), so any machine decodes the same ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, at most.
BLOCK = 1024
#: Slots of the tables of orders 1 and 2 in a block.
SLOTS = 256
#: Weights are parts of ONE, of which order 0 keeps ``ROOM`` at least; counts of order 0 are parts of ALL.
ONE, ROOM, ALL = 1 << 16, 4096, 1 << 20
#: An entry of order 2 is 4 * id + confidence. What to add to 4 * id after a miss and a hit, for each confidence before.
SURER = np.array([1, 1, 1, 2, 1, 3, 1, 3], dtype=np.int32)
FREQUENCY = (1 << 21) - 1
MAGIC, HEAD = b"LWF1", "<4sIIII"


class Order0:
    """The ids of a frame with their frequencies: where each begins, and whose each of the ALL places is."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids, counts
        share = counts.astype(np.int64) * (ALL - len(ids)) // max(1, int(counts.sum())) + 1
        if len(ids):
            share[int(np.argmax(counts))] += ALL - int(share.sum())
        # Both in one number, so that a step looks up one: places before, then 21 bits of frequency.
        self.both = np.zeros(ONE, np.int64)
        self.both[ids] = (np.cumsum(share) - share) << 21 | share
        self.place = np.repeat(ids, share)

    @classmethod
    def of(cls, ids: np.ndarray) -> "Order0":
        """Counts are halved together until they fit 16 bits."""
        counts = np.bincount(ids, minlength=1)
        found = np.flatnonzero(counts)
        counts = counts[found]
        while len(counts) and counts.max() >= ONE:
            counts = (counts + 1) // 2
        return cls(found.astype(np.uint16), counts.astype(np.uint16))


class Mixer:
    """The state of all blocks of a frame.

    Truth values are 0 and 1 in 32 bits, so that choices are sums of products.
    Places are always within their tables; ``mode="clip"`` only spares their check.
    """

    def __init__(self, blocks: int):
        self.t1, self.t2 = np.zeros(blocks * SLOTS, np.int32), np.zeros(blocks * SLOTS, np.int32)
        self.w = np.full(blocks * 8, ONE // 16, np.int32)
        self.p1, self.p2 = np.zeros(blocks, np.int32), np.zeros(blocks, np.int32)
        lanes = np.arange(blocks, dtype=np.int32)
        self.base, self.base8 = lanes * np.int32(SLOTS), lanes * np.int32(8)

    def narrow(self, blocks: int) -> None:
        """Only the first blocks go on; the others have ended."""
        for name in ("p1", "p2", "base", "base8"):
            setattr(self, name, getattr(self, name)[:blocks])

    def predict(self) -> None:
        """The guess and the frequency f of its weight; ONE - f is at least ``ROOM``."""
        turned = self.p1 * np.int32(25013)
        self.i1 = (turned >> 7 & SLOTS - 1) + self.base
        self.i2 = ((turned ^ self.p2 * np.int32(15269)) >> 6 & SLOTS - 1) + self.base
        one, e2 = self.t1.take(self.i1, mode="clip"), self.t2.take(self.i2, mode="clip")
        self.n, self.two = e2 & 3, e2 >> 2
        self.guess = one + (self.two - one) * (self.n > 0)
        self.at = (self.n << 1) + (one == self.two) + self.base8
        self.weight = self.w.take(self.at, mode="clip")
        self.f = (self.weight * np.int32((ONE - ROOM) >> 2) >> 13) + 16

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """``ids`` were next; hit: as guessed."""
        self.w[self.at] = self.weight + ((hit * np.int32(ONE // 2 - 1) - self.weight) >> 4)
        self.t2[self.i2] = SURER.take((self.n << 1) + (self.two == ids), mode="clip") + (ids << 2)
        self.t1[self.i1] = ids
        self.p2, self.p1 = self.p1, ids


def lengths(n: int) -> np.ndarray:
    """Ids of each block: all alike but for one id, the longer ones first."""
    blocks = max(1, -(-n // BLOCK))
    return np.full(blocks, n // blocks) + (np.arange(blocks) < n % blocks)


def encode_blocks(ids: np.ndarray, order0: Order0) -> tuple[np.ndarray, np.ndarray]:
    """(number of words of each block, all words of one block after the other) for ids below 65536."""
    size = lengths(len(ids))
    starts = np.cumsum(size) - size
    mixer = Mixer(len(size))
    wide = ids.astype(np.int32)
    low, span = np.zeros(len(size), np.int64), np.full(len(size), 1 << 48, np.int64)
    who: list[np.ndarray] = []
    what: list[np.ndarray] = []

    number = np.uint16 if len(size) < ONE else np.int32  # short numbers are sorted by digits

    def put(blocks: np.ndarray, words: np.ndarray) -> None:
        who.append(blocks.astype(number))
        what.append(words.astype(np.int32))

    active, ended = len(size), []
    for t in range(int(size[0])):
        if size[active - 1] <= t:
            left = int(np.count_nonzero(size > t))
            ended.append((np.arange(left, active), low[left:]))
            active, low, span, starts = left, low[:left].copy(), span[:left].copy(), starts[:left]
            mixer.narrow(left)
        now = wide.take(starts + t, mode="clip")
        mixer.predict()
        hit = (mixer.guess == now).astype(np.int32)
        miss = 1 - hit
        part = span >> 16
        low += part * (mixer.f * miss)
        part = part * (mixer.f + (ONE - 2 * mixer.f) * miss) >> 20
        both = order0.both.take(now, mode="clip")
        low += part * ((both >> 21) * miss)
        span = part * (((both & FREQUENCY) - ALL) * miss + ALL)
        full = np.flatnonzero(span < 1 << 32)
        while len(full):
            value = low.take(full)
            put(full, value >> 32)
            low[full] = (value & 0xFFFFFFFF) << 16
            span[full] <<= 16
            full = full[span.take(full) < 1 << 32]
        mixer.learn(now, hit)
    for blocks, rest in [*ended, (np.arange(active), low)]:
        put(blocks, rest >> 32)
        put(blocks, rest >> 16 & 0xFFFF)
        put(blocks, rest & 0xFFFF)
    owner = np.concatenate(who)
    words = np.concatenate(what)[np.argsort(owner, kind="stable")]
    over = np.flatnonzero(words >= ONE)
    while len(over):  # carries; the first word of a block never has one
        words[over] -= ONE
        words[over - 1] += 1
        over = over[words[over - 1] >= ONE] - 1
    return np.bincount(owner, minlength=len(size)), words.astype(np.uint16)


def decode_blocks(n: int, order0: Order0, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The ``n`` ids again, from the words of each block."""
    size = lengths(n)
    starts = np.cumsum(size) - size
    out = np.zeros(n, np.uint16)
    mixer = Mixer(len(size))
    words = np.concatenate([words, np.zeros(3, words.dtype)]).astype(np.int64)
    at = (np.cumsum(counts) - counts).astype(np.int64)
    code = words[at] << 32 | words[at + 1] << 16 | words[at + 2]
    at += 3
    span = np.full(len(size), 1 << 48, np.int64)
    active = len(size)
    for t in range(int(size[0])):
        if size[active - 1] <= t:
            active = int(np.count_nonzero(size > t))
            code, span, at, starts = code[:active].copy(), span[:active].copy(), at[:active].copy(), starts[:active]
            mixer.narrow(active)
        mixer.predict()
        part = span >> 16
        bound = part * mixer.f
        miss = (code >= bound).astype(np.int32)
        code -= bound * miss
        part = part * (mixer.f + (ONE - 2 * mixer.f) * miss) >> 20
        place = np.minimum((code / part).astype(np.int64), ALL - 1)  # both below 2**53 and the quotient below 2**21: its floor is exact
        other = order0.place.take(place, mode="clip").astype(np.int32)
        now = mixer.guess + (other - mixer.guess) * miss
        both = order0.both.take(other, mode="clip")
        code -= part * ((both >> 21) * miss)
        span = part * (((both & FREQUENCY) - ALL) * miss + ALL)
        full = np.flatnonzero(span < 1 << 32)
        while len(full):
            where = at.take(full)
            code[full] = code.take(full) << 16 | words.take(where)
            at[full] = where + 1
            span[full] <<= 16
            full = full[span.take(full) < 1 << 32]
        out[starts + t] = now
        mixer.learn(now, 1 - miss)
    return out


def pack(ids: np.ndarray) -> bytes:
    """A frame: head, ids and counts of order 0, words and checksum of each block, words; all little-endian."""
    order0 = Order0.of(ids)
    counts, words = encode_blocks(ids, order0) if len(ids) else (np.zeros(0, int), np.zeros(0, np.uint16))
    ends = np.cumsum(lengths(len(ids))) if len(ids) else []
    sums = [zlib.crc32(b) for b in (ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends[:-1]], ends))] if len(ids) else []
    side = zlib.compress(order0.ids.astype("<u2").tobytes() + order0.counts.astype("<u2").tobytes() + np.array(counts, "<u4").tobytes() + np.array(sums, "<u4").tobytes(), 6)
    head = struct.pack(HEAD, MAGIC, len(ids), len(order0.ids), len(sums), len(side))
    return head + struct.pack("<I", zlib.crc32(head + side)) + side + words.astype("<u2").tobytes()


def unpack(frame: bytes) -> np.ndarray:
    """The ids of a frame as uint16; ValueError if head or a block is not what was written."""
    at = struct.calcsize(HEAD)
    magic, n, distinct, blocks, side = struct.unpack(HEAD, frame[:at])
    if magic != MAGIC or zlib.crc32(frame[:at] + frame[at + 4 : at + 4 + side]) != struct.unpack("<I", frame[at : at + 4])[0]:
        raise ValueError("not a frame of ids, or its head is damaged")
    if not n:
        return np.zeros(0, np.uint16)
    tables = zlib.decompress(frame[at + 4 : at + 4 + side])
    table, counts, sizes, sums = np.split(np.frombuffer(tables, np.uint8), np.cumsum([2 * distinct, 2 * distinct, 4 * blocks]))
    order0 = Order0(table.view("<u2"), counts.view("<u2"))
    ids = decode_blocks(n, order0, sizes.view("<u4").astype(np.int64), np.frombuffer(frame, "<u2", offset=at + 4 + side))
    ends = np.cumsum(lengths(n))
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
        if zlib.crc32(ids[a:b].astype("<u4").tobytes()) != sums.view("<u4")[k]:
            raise ValueError(f"block {k} of a frame is damaged")
    return ids
