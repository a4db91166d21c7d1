"""Whole texts to token ids with the tokenizers library, each distinct chunk of a batch encoded once.

The regular expression of a byte-level tokenizer never lets a piece go on from other
characters into white space. So a text's ids are those of its chunks: white space (none at the
text's start) with the characters that follow it, signs after ASCII letters apart. A batch is cut by masks over its UTF-8 bytes, Arrow
numbers its distinct chunks, the library encodes those that bounded caches (arrays for short chunks, a
dictionary for the rest) do not hold, and Arrow puts the texts' ids together. Other tokenizers encode texts whole.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .held import held

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
# characters that some rule takes for white space, and as the numbers that their last three UTF-8 bytes make
_BLANK = set(map(chr, (*range(9, 14), 0x20, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_WIDE = np.array(sorted(int.from_bytes(c.encode()[-3:], "big") for c in _BLANK))
_LAST = np.zeros(256, bool)
_LAST[_WIDE & 0xFF] = True
# kinds of bytes: plain white space; a piece ends between the second and the third, whatever stands around
_BLANKS, _WORDS, _SIGNS = 1, 2, 3
_KINDS = np.where(_SPACE, _BLANKS, 0).astype(np.uint8)
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _WORDS
_KINDS[[*b'!"#$%&()*+,-./:;=?@[\\]^_`{}~']] = _SIGNS
_GROUP = 1 << 12
# a short chunk has so many bytes at most, and a place in a table so many ids; more of them are elsewhere
_SHORT, _MANY, _ELSEWHERE = 15, 8, 15
_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(_SHORT + 1)], np.uint64)
_KEY, _COUNT = np.uint64((1 << 60) - 1), np.uint64(60)

# a byte-level vocabulary writes printable bytes as themselves and the others, in order, as the characters from 256
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(_PRINTED)))}


class Cache:
    """Chunk -> ids, at most `most` bytes of both, what came up lately first.

    Half of the room is for the young generation; when it is full it becomes the old
    one, and what the old one held and nobody asked for since is gone.
    """

    def __init__(self, most: int):
        self.most, self.size = most // 2, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def put(self, keys: list[bytes], values: list[bytes]) -> None:
        for at in range(0, len(keys), 1000):
            some = keys[at : at + 1000], values[at : at + 1000]
            size = sum(len(b"".join(x)) for x in some) + 160 * len(some[0])  # two objects' heads and a place in the table
            if self.size + size > self.most:
                self.young, self.old, self.size = {}, self.young, 0
            self.young.update(zip(*some, strict=True))
            self.size += size

    def get(self, keys: list[bytes]) -> list[bytes | None]:
        out = list(map(self.young.get, keys))
        again = [i for i, x in enumerate(out) if x is None and keys[i] in self.old]
        for i in again:
            out[i] = self.old[keys[i]]
        self.put([keys[i] for i in again], [out[i] for i in again])
        return out


class Table:
    """Short chunks and their ids in arrays of at most `most` bytes: a place for each hash, which the chunk that came last has.

    A place holds the chunk's bytes and their number, which are compared whole, the number of ids and up to `_MANY` ids.
    """

    def __init__(self, most: int, dtype: np.dtype):
        entry = np.dtype([("low", "<u8"), ("high", "<u8"), ("ids", dtype, _MANY)])
        self.bits = max(1, (most // entry.itemsize).bit_length() - 1)
        self.rows = np.zeros(1 << self.bits, entry)

    def _places(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = low ^ high * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ids, and how many of a row's are the chunk's: 0 for a chunk that is not held, `_ELSEWHERE` for one with too many."""
        rows = self.rows[self._places(low, high)]
        same = (rows["low"] == low) & (rows["high"] & _KEY == high)
        return rows["ids"], np.where(same, rows["high"] >> _COUNT, 0).astype(np.int64)

    def put(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """ids: of all chunks, one after the other."""
        new = np.zeros(len(low), self.rows.dtype)
        fits = counts <= _MANY
        new["low"], new["high"] = low, high | np.where(fits, counts, _ELSEWHERE).astype(np.uint64) << _COUNT
        own = np.zeros((len(low), _MANY), ids.dtype)
        own[np.arange(_MANY) < np.where(fits, counts, 0)[:, None]] = ids[np.repeat(fits, counts)]
        new["ids"] = own
        self.rows[self._places(low, high)] = new


def _keys(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks as pairs of numbers, their first 8 bytes and 7 more below the length, and whether they are short; others have no such pair."""
    words = np.zeros(len(data) // 8 + 4, "<u8")
    words.view(np.uint8)[: len(data)] = data
    sizes, first = np.diff(ends), ends[:-1]
    short = (sizes > 0) & (sizes <= _SHORT)
    at, shift = first >> 3, (first & 7).astype(np.uint64) << np.uint64(3)
    back, one = np.uint64(63) - shift, np.uint64(1)
    a, b, c = words[at], words[at + 1], words[at + 2]
    n = np.minimum(sizes, _SHORT)
    low = (a >> shift | b << one << back) & _MASK[n]
    high = (b >> shift | c << one << back) & _MASK[np.maximum(n - 8, 0)]
    return low, high | n.astype(np.uint64) << np.uint64(56), short


class Encoder:
    """`controls`: whether a text's own strings of the tokenizer's special tokens give those tokens, as the library's call does."""

    def __init__(self, definition: str, controls: bool = True, cache_bytes: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = not controls
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        d = json.loads(definition)
        pre = d.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        simple = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and len(_cuts(*_bytes(pa.array([t["content"]], pa.large_string())))) == 2 for t in d.get("added_tokens") or [])
        self.chunked = bool(plain and simple and not d.get("normalizer") and not d.get("post_processor") and not d.get("truncation"))
        if self.chunked:
            added = {t["id"]: t["content"].encode() for t in d.get("added_tokens") or []}
            self.bytes = [added[i] if i in added else bytes(map(_BYTES.get, self.tokenizer.id_to_token(i) or "")) for i in range(self.tokenizer.get_vocab_size())]
            self.width = np.array(list(map(len, self.bytes)), np.int64)
        self.known, self.rest = Table(cache_bytes // 4 * 3, self.dtype), Cache(cache_bytes // 4)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks: many to a call, as a text of them all, told apart by the ids' widths. With the chunks' order, and how many each has."""
        data, ends = _bytes(chunks)
        first, last = data[ends[:-1]], ends[1:]
        alone = ~_SPACE[first] | _blank_before(data, last) | _SPACE[data[last - 1]]
        own, joins = np.flatnonzero(alone), np.flatnonzero(~alone)
        ids = self._ids([x.decode() for x in chunks.take(pa.array(own)).to_pylist()])
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        if len(joins):
            data, ends = _bytes(chunks.take(pa.array(joins)))
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], _GROUP)), len(joins)))
            text = data.tobytes()
            more = np.concatenate(self._ids([text[a:b].decode() for a, b in itertools.pairwise(ends[cuts].tolist())]))
            at = np.concatenate(([0], np.cumsum(self.width[more])))
            places = np.searchsorted(at, ends)
            if len(at) == places[-1] or (at[places] != ends).any():
                raise ValueError("the ids' widths do not add up to the text")
            ids.append(more)
            counts = np.append(counts, np.diff(places))
        return np.concatenate([np.empty(0, self.dtype), *ids]), np.append(own, joins), counts

    def _lists(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of distinct chunks as lists, and which of the lists is each chunk's."""
        low, high, short = _keys(*_bytes(chunks))
        rows, n = self.known.get(low, high)
        n[~short] = _ELSEWHERE
        near, far = np.flatnonzero((n > 0) & (n <= _MANY)), np.flatnonzero(n > _MANY)
        ids = self.rest.get(chunks.take(pa.array(far)).to_pylist())
        got = np.array([x is not None for x in ids], bool)
        found = [x for x in ids if x is not None]
        fresh = np.append(np.flatnonzero(n == 0), far[~got])
        learnt, order, counts = self._learn(chunks.take(pa.array(fresh)))
        fresh = fresh[order]
        some = short[fresh]
        self.known.put(low[fresh[some]], high[fresh[some]], learnt[np.repeat(some, counts)], counts[some])
        some = np.flatnonzero(~some | (counts > _MANY))
        ends = np.cumsum(counts)
        self.rest.put(chunks.take(pa.array(fresh[some])).to_pylist(), [learnt[a:b].tobytes() for a, b in zip((ends - counts)[some].tolist(), ends[some].tolist(), strict=True)])
        flat = np.concatenate((rows[near][np.arange(_MANY) < n[near, None]], np.frombuffer(b"".join(found), self.dtype), learnt))
        sizes = np.concatenate((n[near], np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize, counts))
        place = np.empty(len(chunks), np.int64)
        place[np.concatenate((near, far[got], fresh))] = np.arange(len(chunks))
        return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), pa.array(flat)), place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of strings, and where each text's begin, with the end of the last. A null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.chunked:
            own = self._ids(texts.to_pylist())
            return np.concatenate([np.empty(0, self.dtype), *own]), np.cumsum([0, *map(len, own)], dtype=np.int64)
        data, offsets = _bytes(texts)
        cuts = _cuts(data, offsets)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        lists, place = self._lists(coded.dictionary)
        taken = lists.take(pa.array(place[coded.indices.to_numpy()]))
        firsts = np.searchsorted(cuts, offsets)
        places = taken.offsets.to_numpy()
        return taken.flatten().to_numpy(), places[firsts] - places[0]


    def texts(self, ids: np.ndarray) -> Callable[[int, int], str]:
        """A function that gives the text of ids[a:b]. Ids past the vocabulary have none."""
        if not self.chunked:
            return lambda a, b: self.tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False)
        table = pa.array([*self.bytes, b""], pa.large_binary())
        data, ends = _bytes(table.take(pa.array(np.minimum(ids, len(self.bytes)))))
        line = data.tobytes()
        return lambda a, b: line[ends[a] : ends[b]].decode()


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array with 64-bit offsets, and where each value begins, with the end of the last."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether some rule takes the character before a place for white space, beyond the plain ones."""
    out = _LAST[data[at - 1]]
    some = at[out]
    one, two, three = (np.where(some >= n, data[np.maximum(some - n, 0)], 0).astype(np.int64) for n in (1, 2, 3))
    out[out] = np.isin(one, _WIDE) | np.isin(two << 8 | one, _WIDE) | np.isin(three << 16 | two << 8 | one, _WIDE)
    return out


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places at which chunks begin, and the end: texts' starts, white space after what is surely none, signs after letters and digits."""
    kind = np.frombuffer(data.tobytes().translate(_KINDS.tobytes()), np.uint8)
    space = kind == _BLANKS
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = space[1:] > space[:-1]
    at = np.flatnonzero(start)
    start[at[_blank_before(data, at)]] = False
    start[1:-1] |= (kind[1:] == _SIGNS) & (kind[:-1] == _WORDS)
    start[offsets] = True
    start[-1] = True
    return np.flatnonzero(start)


def encoder(definition: str, controls: bool = True) -> Encoder:
    """This process's encoder of a tokenizer definition, with what it has learnt so far."""
    return held(("encoder", hash(definition), controls), lambda: Encoder(definition, controls))
