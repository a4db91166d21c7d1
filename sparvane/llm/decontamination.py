"""Benchmark decontamination: an FM-index per training shard, searched for test phrases.

A shard is a bounded run of a partition's documents. Words that no phrase has can't be in
an occurrence; each stretch of them becomes one separator, and stretches of phrase words
shorter than the shortest phrase go too, which leaves every occurrence in place. The rest
of the shard is indexed. Phrases are searched backwards through wavelet-tree ranks,
occurrences are located by sampled suffix positions, and overlapping ones merge to spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import copies_of, guarded, materialize, ship
from .fmindex import FMIndex
from .words import ALNUM, pieces, words

_SPANS = "array<struct<start:int,end:int>>"
_FOUND = f"doc_id long, digest string, n_words long, spans {_SPANS}, items array<string>"


class Phrases:
    """Windows of some benchmark items: `window` consecutive words, or all words of a shorter item.

    All in arrays: a row of word numbers for each different window, its length, and the items that have it as a
    stretch of one list. A million windows of ten words take about 60 MB.
    """

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        names: dict[str, int] = {}
        patterns, lengths, owners = [np.empty((0, window), np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for item, text in rows:
            own = words(text, ALNUM)
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own), np.int32, len(own))
            if not len(ids):
                continue
            own = np.lib.stride_tricks.sliding_window_view(ids, window) if len(ids) >= window else np.pad(ids, (0, window - len(ids)))[None]
            patterns.append(own)
            lengths.append(np.full(len(own), min(len(ids), window), np.int32))
            owners.append(np.full(len(own), names.setdefault(item, len(names)), np.int32))
        self.names = list(names)
        patterns, lengths, owners = np.concatenate(patterns), np.concatenate(lengths), np.concatenate(owners)
        order = np.lexsort((owners, *patterns.T, lengths))
        patterns, lengths, owners = patterns[order], lengths[order], owners[order]
        first = np.ones(len(order), bool)  # of a window's rows
        first[1:] = (lengths[1:] != lengths[:-1]) | (patterns[1:] != patterns[:-1]).any(axis=1)
        fresh = first.copy()  # of a window's rows for one item
        fresh[1:] |= owners[1:] != owners[:-1]
        self.patterns, self.lengths = patterns[first], lengths[first].astype(np.int64)
        self.owners = owners[fresh]
        self.owned = np.append(np.flatnonzero(first[fresh]), len(self.owners))
        self.least = int(self.lengths.min(initial=window))

    def items(self, pattern: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.owned[pattern] : self.owned[pattern + 1]].tolist()]

    def among(self, present: np.ndarray) -> np.ndarray:
        """Numbers of the windows all of whose words are present (a flag for each word)."""
        out = [np.empty(0, np.int64)]
        for at in range(0, len(self.patterns), 1 << 16):
            some = self.patterns[at : at + (1 << 16)]
            held = present[some] | (np.arange(some.shape[1]) >= self.lengths[at : at + (1 << 16), None])
            out.append(at + np.flatnonzero(held.all(axis=1)))
        return np.concatenate(out)

    def ids(self, data: bytes) -> np.ndarray:
        """Numbers of the words of a text, -1 for words of no phrase."""
        parts = [np.fromiter(map(self.vocabulary.get, p, repeat(-1)), np.int32, len(p)) for p in pieces(data, ALNUM)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


class _Shard:
    """Documents that wait for an index."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        self.docs: list[tuple] = []
        self.runs: list[tuple[int, int, np.ndarray]] = []  # document, first word, symbols
        self.size = 0

    def add(self, key: object, text: bytes) -> None:
        ids = self.phrases.ids(text)
        edge = np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0])))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - first >= self.phrases.least
        for a, b in zip(first[long].tolist(), end[long].tolist(), strict=True):
            self.runs.append((len(self.docs), a, ids[a:b]))
            self.size += b - a + 1
        self.docs.append((key, len(ids)))

    def search(self) -> Iterator[tuple]:
        """(key, words, merged spans, items) of each document."""
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        if self.runs and len(self.phrases.lengths):
            # symbols: 1 separates, words follow from 2
            text = np.concatenate([x for _, _, ids in self.runs for x in (ids + 2, [1])])
            index = FMIndex(text)
            present = np.zeros(len(self.phrases.vocabulary), bool)
            present[text[text > 1] - 2] = True
            tried = self.phrases.among(present)
            low, high = index.search(self.phrases.patterns[tried] + 2, self.phrases.lengths[tried])
            found = np.flatnonzero(high > low)
            counts = (high - low)[found]
            which = np.repeat(found, counts)
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            at, which = index.locate(low[which] + within), tried[which]
            starts = np.cumsum([0, *(len(ids) + 1 for _, _, ids in self.runs)])
            run = np.searchsorted(starts, at, side="right") - 1
            doc = np.array([d for d, _, _ in self.runs])[run]
            first = np.array([a for _, a, _ in self.runs])[run] + at - starts[run]
            end = first + self.phrases.lengths[which]
            order = np.lexsort((first, doc))
            for d, a, b in zip(doc[order].tolist(), first[order].tolist(), end[order].tolist(), strict=True):
                own = spans.setdefault(d, [])
                if own and a <= own[-1][1]:
                    own[-1] = (own[-1][0], max(b, own[-1][1]))
                else:
                    own.append((a, b))
            pairs = np.unique(np.stack((doc, which)), axis=1)
            for d, w in pairs.T.tolist():
                items.setdefault(d, set()).update(self.phrases.items(w))
        for d, (key, n) in enumerate(self.docs):
            yield key, n, spans.get(d, []), sorted(items.get(d, ()))


_WORD = re.compile(rb"[^ ]+")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between those words."""
    if not spans:
        return text
    at = [m.span() for m in _WORD.finditer(text.translate(ALNUM))]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, text[end:]])


def _finder(phrases, shard_words: int):
    def find(batches):
        value = phrases.value

        def table(shard: _Shard) -> pa.RecordBatch:
            rows = list(shard.search())
            columns = [
                pa.array([r[0][0] for r in rows], pa.int64()),
                pa.array([r[0][1] for r in rows], pa.string()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array([r[3] for r in rows], pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_words", "spans", "items"])

        shard = _Shard(value)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, key in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(), strict=True)):
                shard.add(key, texts[i].as_py() or b"")
                if shard.size >= shard_words or len(shard.docs) >= 50_000:
                    yield table(shard)
                    shard = _Shard(value)
        if shard.docs:
            yield table(shard)

    return find


def _keeper(phrases, shard_words: int):
    """Passes on the rows of documents without occurrences."""

    def keep(batches):
        shard, held, size = _Shard(phrases.value), [], 0

        def clean():
            mask = pa.array([not spans for _, _, spans, _ in shard.search()], pa.bool_())
            at = 0
            for b in held:
                yield b.filter(mask.slice(at, len(b)))
                at += len(b)

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i in range(len(batch)):
                shard.add(None, texts[i].as_py() or b"")
            held.append(batch)
            size += batch.nbytes
            if shard.size >= shard_words or size >= 1 << 25:
                yield from clean()
                shard, held, size = _Shard(phrases.value), [], 0
        if held:
            yield from clean()

    return keep


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 1 << 20, block_words: int = 1 << 20) -> DataFrame:
    """docs without the rows in which a benchmark window occurs; null texts stay.

    A benchmark of several blocks is searched block by block: what a block leaves is written
    to the shared folder before the next one goes out, so one block is held at a time.
    """
    ship(docs.sparkSession)
    out, named = guarded(docs, ("text",))
    held = None
    for block in _blocks(benchmark, window, block_words):
        if held is not None:
            out = materialize(out, "uncontaminated")
            held.unpersist()
        out, held = out.mapInArrow(_keeper(block, shard_words), out.schema), block
    return named(out)


def _blocks(benchmark: DataFrame, window: int, block_words: int):
    """The benchmark's phrases, broadcast in blocks of bounded size, one at a time."""
    sc = benchmark.sparkSession.sparkContext
    rows: list[tuple[str, bytes]] = []
    size = 0
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    parts = 1 + (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // (4 << 20)  # what the driver reads ahead
    sent = False
    for item, text in items.repartition(int(parts)).toLocalIterator():
        for piece in _overlapping(text.encode(), window, block_words):
            n = len(words(piece, ALNUM))
            if rows and size + n > block_words:
                yield sc.broadcast(Phrases(rows, window))
                rows, size, sent = [], 0, True
            rows.append((item, piece))
            size += n
    if rows or not sent:
        yield sc.broadcast(Phrases(rows, window))


def _overlapping(text: bytes, window: int, most: int) -> Iterator[bytes]:
    """A text whole, or in pieces of at most `most` words of which neighbours share all but one of a window's, so that each window is in one of them."""
    own = words(text, ALNUM)
    if len(own) <= max(most, window):
        yield text
        return
    step = max(most, window) - window + 1
    for at in range(0, len(own) - window + 1, step):
        yield b" ".join(own[at : at + step + window - 1])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 1 << 20, block_words: int = 1 << 20, cut: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items), one row for each row of docs; with cut, clean_text too.

    spans are merged word ranges [start, end) that occurrences of benchmark windows cover,
    items the ids (as strings, sorted, each once) of items with such a window. A null or
    empty text has no words and no spans; so has any text where the benchmark is empty.
    A null item_id reads as an empty string. Items that share an id count as one. clean_text
    is the text without its spans, null where the text is.

    The benchmark goes out in blocks of at most block_words words (so about as many windows; a longer item is cut into pieces that share windows' words), each searched in all documents, one
    held at a time: what a block finds is written to the shared folder before the next. Then
    each text's spans are merged over the blocks, and cut out of the texts in a last pass.
    """
    ship(docs.sparkSession)
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    found: list[DataFrame] = []
    held = None
    for block in _blocks(benchmark, window, block_words):
        if held is not None:
            found[-1] = materialize(found[-1], "contamination")
            held.unpersist()
        found.append(need.mapInArrow(_finder(block, shard_words), _FOUND))
        held = block
    if len(found) == 1 and not cut:
        return found[0].drop("digest")
    per = _merged([found[0], *(materialize(f, "contamination") for f in found[1:])] if len(found) > 1 else found)
    if not cut:
        return copies_of(per, "copies", "_copy").select("doc_id", "n_words", "spans", "items")
    per = per.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n_words", "spans", "items")
    rows = need.join(per, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    return rows.select("doc_id", "n_words", "spans", "items", "text").mapInArrow(_cutter, f"doc_id long, n_words long, spans {_SPANS}, items array<string>, clean_text string")


def _cutter(batches):
    for batch in batches:
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        clean = [t if t is None else without_spans(t.encode(), [(x["start"], x["end"]) for x in s]).decode() for t, s in zip(texts, spans, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "spans", "items")), pa.array(clean, pa.string())], ["doc_id", "n_words", "spans", "items", "clean_text"])


def _merged(found: list[DataFrame]) -> DataFrame:
    """(doc_id, digest, n_words, spans, items, copies): the union of what the blocks find, a row for each id and text.

    Rows of one id and one text find the same, so a block keeps one of them and their number,
    and a row repeated however often meets the other blocks once.
    """
    keys = ["doc_id", "digest"]
    each = [f.groupBy(*keys).agg(F.first("n_words").alias("n_words"), F.first("spans").alias("spans"), F.first("items").alias("items"), F.count(F.lit(1)).alias("copies")) for f in found]
    every = each[0]
    for f in each[1:]:
        every = every.unionByName(f)
    per = every.groupBy(*keys).agg(
        F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("copies").alias("copies"),
    )
    spans = F.expr(
        f"aggregate(all, cast(array() as {_SPANS}), (acc, x) -> "
        "CASE WHEN size(acc) > 0 AND x.start <= acc[size(acc) - 1].end "
        "THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'end', greatest(acc[size(acc) - 1].end, x.end)))) "
        "ELSE concat(acc, array(x)) END)"
    )
    return per.select(*keys, "n_words", spans.alias("spans"), "items", "copies")


def digests(found: DataFrame) -> DataFrame:
    """Per document what `contamination` found, as counts and a digest."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
