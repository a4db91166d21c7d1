"""Token counts by rank-synchronous array merging.

A batch of texts is cut into chunks that no pre-token crosses (see encoding.py), and Arrow numbers the
distinct ones. Chunks that a bounded cache lacks go through the tokenizer's normalizer and
pre-tokenizer. Their distinct pre-tokens become ragged arrays of symbols: one flat array and
where each sequence begins. A round looks up all adjacent pairs at once and merges, in every
sequence, all places of its lowest-ranked pair; a sequence without a pair leaves with the
symbols it has left. Sequences of more than `LONG` symbols are linked lists in arrays instead,
merged rank by rank, so that their rounds cost what they merge and not their length.

A merge's parts are always older than itself, so a merge never brings up a pair of
lower rank: taking all places of one rank together is what the library does one by one.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .encoding import Cache, _bytes, _cuts
from .held import held

LONG = 96
_NONE = np.iinfo(np.int64).max


class Merges:
    """Ranks of pairs of symbols in sorted arrays, and the two ways to merge."""

    def __init__(self, pairs: list[tuple[str, str]], ids: dict[str, int]):
        self.size = 1 + max(ids.values(), default=0)
        left, right, made = (np.array([ids[x] for x in column], np.int64) for column in (*zip(*pairs, strict=True), [a + b for a, b in pairs])) if pairs else (np.empty(0, np.int64),) * 3
        rank_of = {a + b: i for i, (a, b) in enumerate(pairs)}
        if len(rank_of) < len(pairs) or any(rank_of.get(x, -1) >= i for i, p in enumerate(pairs) for x in p):
            raise ValueError("merges must make each symbol once, from older ones")
        order = np.argsort(left * self.size + right)
        self.keys, self.ranks = (left * self.size + right)[order], order
        self.left, self.right, self.made = left, right, made

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where there is none."""
        if not len(self.keys):
            return np.full(len(a), _NONE)
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def counts(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols that survive in each sequence of a ragged array; no sequence is empty."""
        out = np.ones(len(lengths), np.int64)
        long = lengths > LONG
        if long.any():
            at = np.repeat(long, lengths)
            out[long] = self._linked(symbols[at], lengths[long])
            symbols, lengths = symbols[~at], lengths[~long]
            out[~long] = self._rounds(symbols, lengths)
            return out
        return self._rounds(symbols, lengths)

    def _rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out, own = np.ones(len(lengths), np.int64), np.arange(len(lengths))
        while len(own):
            ends = np.cumsum(lengths)
            rank = np.full(len(symbols), _NONE)
            rank[:-1] = self.lookup(symbols[:-1], symbols[1:])
            rank[ends - 1] = _NONE  # a sequence's last symbol begins no pair
            low = np.minimum.reduceat(rank, ends - lengths)
            done = low == _NONE
            out[own[done]] = lengths[done]
            keep = np.repeat(~done, lengths)
            symbols, rank, low, lengths, own = symbols[keep], rank[keep], low[~done], lengths[~done], own[~done]
            hit = rank == np.repeat(low, lengths)
            take = hit & ~_odd(hit)
            at = np.flatnonzero(take)
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            lengths = np.add.reduceat(stay, np.cumsum(lengths) - lengths, dtype=np.int64) if len(own) else lengths
            symbols = symbols[stay]
        return out

    def _linked(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        symbols, ends = symbols.copy(), np.cumsum(lengths)
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        after[ends - 1], before[ends - lengths] = -1, -1
        alive = np.ones(len(symbols), bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def note(at: np.ndarray) -> None:
            """File pairs under their ranks by the place of their first symbol."""
            rank = self.lookup(symbols[at], symbols[after[at]])
            at, rank = at[rank < _NONE], rank[rank < _NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, own in zip(rank[cuts].tolist(), np.split(at, cuts[1:]), strict=False):
                if r not in places:
                    places[r] = []
                    heapq.heappush(ranks, r)
                places[r].append(own)

        note(np.flatnonzero(after >= 0))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[alive[at] & (after[at] >= 0)]
            at = at[(symbols[at] == self.left[r]) & (symbols[after[at]] == self.right[r])]
            if not len(at):
                continue
            joined = np.zeros(len(at), bool)  # whether a place's pair begins with the second symbol of the pair before
            joined[1:] = after[at[:-1]] == at[1:]
            at = at[~_odd(joined, first=True)]
            gone = after[at]
            symbols[at], alive[gone] = self.made[r], False
            after[at] = after[gone]
            more = at[after[at] >= 0]
            before[after[more]] = more
            less = before[at]
            note(np.unique(np.concatenate((more, less[less >= 0]))))
        return np.add.reduceat(alive, ends - lengths, dtype=np.int64)


def _odd(flags: np.ndarray, first: bool = False) -> np.ndarray:
    """Every second place of a run of flags, from its second on; `first`: a flag joins a place to the one before, so runs begin one earlier."""
    at = np.arange(len(flags))
    starts = np.maximum.accumulate(np.where(flags & np.concatenate(([False], flags[:-1])), 0, at)) if not first else np.maximum.accumulate(np.where(flags, 0, at))
    return (at - starts) % 2 == 1


class TokenCounter:
    """Counts as the tokenizers library's plain call gives them, for its byte-level BPE definitions.

    Special strings inside a text are its special tokens and no added ones count. A definition that truncates, pads, drops merges at
    random, has a template's tokens, marks continuing pieces or falls back to bytes is refused.
    """

    def __init__(self, definition: str, cache_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        d = json.loads(definition)
        model = d["model"]
        refused = [k for k in ("truncation", "padding", "post_processor") if d.get(k)] + [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token") if model.get(k)]
        self.added = [t["content"] for t in d.get("added_tokens") or []]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and len(_cuts(*_bytes(pa.array([t["content"]], pa.large_string())))) == 2 for t in d.get("added_tokens") or [])
        if model["type"] != "BPE" or '"ByteLevel"' not in json.dumps(d.get("pre_tokenizer")) or refused or not plain:
            raise ValueError(f"not a plain byte-level BPE definition: {refused or model['type']}")
        tool = Tokenizer.from_str(definition)
        self.normalizer, self.cut = tool.normalizer, tool.pre_tokenizer
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.merges = Merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], ids)
        letters = {ord(x): x for x in ids if len(x) == 1}
        self.inner, self.last = (np.full(1 + max(letters), -1, np.int64) for _ in range(2))
        for c, x in letters.items():
            self.inner[c], self.last[c] = ids[x], ids.get(x + suffix, -1)
        self.known = Cache(cache_bytes)

    def _pieces(self, chunk: str) -> tuple[list[str], int]:
        """Pre-tokens of a chunk, and the special tokens in it."""
        parts = self.specials.split(chunk) if self.specials else [chunk]
        out: list[str] = []
        for part in parts:
            if part:
                text = self.normalizer.normalize_str(part) if self.normalizer else part
                out += [x for x, _ in self.cut.pre_tokenize_str(text)]
        return out, len(parts) - 1

    def words(self, words: list[str]) -> np.ndarray:
        """Tokens of pre-tokens, in the vocabulary's letters for bytes; an empty one has none."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out, own = np.zeros(len(words), np.int64), lengths > 0
        letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        symbols, lengths = self.inner[letters], lengths[own]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[letters[ends]]
        if (symbols < 0).any():
            raise ValueError("a letter that the vocabulary lacks")
        out[own] = self.merges.counts(symbols, lengths)
        return out

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        number: dict[str, int] = {}
        codes: list[int] = []
        sizes, extra = [], []
        for chunk in chunks:
            own, specials = self._pieces(chunk.decode())
            codes += [number.setdefault(x, len(number)) for x in own]
            sizes.append(len(own))
            extra.append(specials)
        each = self.words(list(number))
        total = np.bincount(np.repeat(np.arange(len(chunks)), sizes), each[np.array(codes, np.int64)], len(chunks)).astype(np.int64) + extra
        data = total.astype("<i8").tobytes()
        return [data[i : i + 8] for i in range(0, len(data), 8)]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of an array; a null one is empty."""
        data, offsets = _bytes(texts.cast(pa.large_string()).fill_null(""))
        cuts = _cuts(data, offsets)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        keys = chunks.dictionary.to_pylist()
        counts = self.known.get(keys)
        fresh = [i for i, x in enumerate(counts) if x is None]
        learnt = self._learn([keys[i] for i in fresh])
        self.known.put([keys[i] for i in fresh], learnt)
        for i, x in zip(fresh, learnt, strict=True):
            counts[i] = x
        each = np.frombuffer(b"".join(counts), "<i8")[chunks.indices.to_numpy()]
        sums = np.concatenate(([0], np.cumsum(each)))
        return np.diff(sums[np.searchsorted(cuts, offsets)])


def _count(definition):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tool = held(("counter", hash(definition.value)), lambda: TokenCounter(definition.value))
            columns = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tool.count(batch.column("text")), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs (doc_id, text), whatever else docs has.

    `tokenizer` is a definition file of the tokenizers library, read on the driver; see TokenCounter for those it takes. A null text
    is empty: no bytes, no tokens. Null and repeated doc_ids stay as they are. No shuffle: rows are counted where they are read.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(_count(definition), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
