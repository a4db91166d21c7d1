"""Static range asymmetric numeral system over token ids.

A segment holds whole documents and one frequency table that all of its blocks share. A
block is coded alone, by `LANES` interleaved coders whose 64-bit states shed 32-bit words
into one stream: at each step the lanes that must shed or take a word do so in lane order.
All blocks of a segment step together, as rows of one array.

Segment, little-endian:

    magic "SVT1", then 7 uint32: lanes, block length, tokens, blocks, documents,
    bytes of the table, bytes of the document lengths; uint64 crc32 of all that follows
    table: zlib of uint32 pairs (symbol, frequency), frequencies summing to 2**SCALE
    document lengths: zlib of uint32
    a checkpoint for each block: uint64 first word, uint32 words, uint32 crc32 of its ids
    final states: uint64 for each block and lane
    words: uint32
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, SCALE, LANES, BLOCK = b"SVT1", 20, 512, 1 << 17
_HEAD = struct.Struct("<4s7IQ")
_LOW = np.uint64(1 << 31)
_POINT = np.dtype([("first", "<u8"), ("words", "<u4"), ("crc", "<u4")])


class Damaged(ValueError):
    """A checksum or a size does not match."""


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**SCALE, every symbol that occurs getting 1 at least."""
    total, size = int(counts.sum()), 1 << SCALE
    used = counts > 0
    if total == 0:
        return np.zeros(len(counts), np.int64)
    if int(used.sum()) > size:
        raise ValueError("more symbols than slots")
    scaled = np.where(used, np.maximum(1, counts * size // total), 0).astype(np.int64)
    order = np.argsort(-scaled, kind="stable")
    short = size - int(scaled.sum())
    if short > 0:
        scaled[order[0]] += short
    for i in order:  # too many: the most frequent give some up
        if short >= 0:
            break
        give = min(-short, max(0, int(scaled[i]) - max(1, int(scaled[i]) // 2)))
        scaled[i] -= give
        short += give
    return scaled


def _table(freq: np.ndarray) -> bytes:
    own = np.flatnonzero(freq)
    return zlib.compress(np.stack((own, freq[own]), axis=1).astype("<u4").tobytes(), 6)


def encode(docs: list[np.ndarray], lanes: int = LANES, block: int = BLOCK) -> bytes:
    """The segment of these documents' ids."""
    ids = np.concatenate(docs) if docs else np.empty(0, np.int64)
    ids = ids if ids.dtype in (np.uint16, np.uint32) else ids.astype(np.int64)
    block = min(block, max(1, -(-len(ids) // lanes)) * lanes)
    n, n_blocks = len(ids), -(-len(ids) // block)
    freq = frequencies(np.bincount(ids)) if n else np.zeros(1, np.int64)
    start = np.cumsum(freq) - freq
    filled = np.full(n_blocks * block, int(freq.argmax()), ids.dtype)
    filled[:n] = ids
    steps = block // lanes
    rows = filled.reshape(n_blocks, steps, lanes)
    state = np.full((n_blocks, lanes), _LOW, np.uint64)
    shed, out = np.empty((steps, n_blocks, lanes), bool), np.empty((steps, n_blocks, lanes), np.uint32)
    f64, s64, shift = freq.astype(np.uint64), start.astype(np.uint64), np.uint64(SCALE)
    bound = np.uint64(63 - SCALE)
    for k in range(steps - 1, -1, -1):
        symbols = rows[:, k, :]
        f = f64[symbols]
        over = state >= (f << bound)
        shed[k], out[k] = over, state.astype(np.uint32)
        state = np.where(over, state >> np.uint64(32), state)
        whole = state // f
        state = (whole << shift) + (state - whole * f) + s64[symbols]
    shed, out = shed.transpose(1, 0, 2), out.transpose(1, 0, 2)
    words = out[shed]
    per = shed.sum(axis=(1, 2))
    points = np.zeros(n_blocks, _POINT)
    points["words"], points["first"] = per, np.cumsum(per) - per
    points["crc"] = [zlib.crc32(ids[i * block : (i + 1) * block].astype("<u4").tobytes()) for i in range(n_blocks)]
    table = _table(freq)
    lengths = zlib.compress(np.array([len(d) for d in docs], "<u4").tobytes(), 6)
    body = b"".join([table, lengths, points.tobytes(), state.astype("<u8").tobytes(), words.astype("<u4").tobytes()])
    return _HEAD.pack(MAGIC, lanes, block, n, n_blocks, len(docs), len(table), len(lengths), zlib.crc32(body)) + body


class Segment:
    """A coded segment: any of its blocks or documents can be decoded alone."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size:
            raise Damaged("short header")
        magic, self.lanes, self.block, self.n, self.blocks, docs, table, lengths, crc = _HEAD.unpack_from(data)
        body = memoryview(data)[_HEAD.size :]
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise Damaged("magic or checksum")
        pairs = np.frombuffer(zlib.decompress(body[:table]), "<u4").reshape(-1, 2)
        at = table + lengths
        self.lengths = np.frombuffer(zlib.decompress(body[table:at]), "<u4").astype(np.int64)
        self.points = np.frombuffer(body, _POINT, self.blocks, at)
        at += self.blocks * _POINT.itemsize
        self.states = np.frombuffer(body, "<u8", self.blocks * self.lanes, at).reshape(self.blocks, self.lanes)
        self.words = np.frombuffer(body, "<u4", offset=at + self.states.nbytes)
        self.symbols, freq = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) < 1 << 16 else np.uint32), freq)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)

    def decode(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The ids of blocks [first, end), by default of all, as uint32."""
        end = self.blocks if end is None else end
        n, steps = end - first, self.block // self.lanes
        points = self.points[first:end]
        state = self.states[first:end].astype(np.uint64)
        rows = np.empty((n, steps, self.lanes), np.int32)
        at = points["first"].astype(np.int64)
        words = np.concatenate((self.words, [0])).astype(np.uint64)
        mask, shift, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for k in range(steps):
            low = state & mask
            s = self.slot[low.astype(np.int64)]
            rows[:, k, :] = s
            state = self.freq[s] * (state >> shift) + low - self.start[s]
            need = state < _LOW
            place = np.cumsum(need, axis=1)
            got = words[np.minimum(at[:, None] + place - 1, len(words) - 1)]
            state = np.where(need, (state << half) | got, state)
            at = at + place[:, -1]
        ids = self.symbols[rows.reshape(-1)]
        ids = ids[: max(0, min(self.n - first * self.block, n * self.block))]
        for i, p in enumerate(points):
            if zlib.crc32(ids[i * self.block : (i + 1) * self.block].tobytes()) != p["crc"]:
                raise Damaged(f"block {first + i}")
        return ids

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, from the blocks it lies in."""
        a = int(self.lengths[:i].sum())
        b = a + int(self.lengths[i])
        first = a // self.block
        ids = self.decode(first, max(first, -(-b // self.block)))
        return ids[a - first * self.block : b - first * self.block]
