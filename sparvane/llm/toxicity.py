"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored words.

A character trigram model is counted over all documents. What a reader may have meant by
a disguised word is a lattice: a digit or sign may stand for letters or nothing, a letter drawn
out may be one, a sign or space between letters may be nothing or a word's end. Viterbi
decoding takes the reading of least channel cost plus model cost. Words of letters alone
with no letter twice in a row have one reading and are left as they are; doubled letters are undone
only where the model gains more than that costs. Numbers are no words. Restored
words are scored by character n-grams with weights learnt from labelled documents.
"""

from __future__ import annotations

import math
import re
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import guarded, materialize, ship
from .held import held
from .textstats import bounded_texts, sample_by_hash, training_fold

CLASSES = 64
# What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¥": "y", "¢": "c"}
SUBSTITUTE, DROP_LEET, DROP_SIGN, DROP_REPEAT, BREAK, DROP_LAST, WIDE = 1.5, 9.0, 0.7, 0.3, 1.0, 0.5, 4.0
#: for a word whose doubled letters are undone, and for each of them
DOUBLED, DROP_DOUBLE = 6.0, 1.5
_EDGE = ".,;:?()[]{}<>\"'`«»“”„‘’…&%#*^=~/\\-_–—¿¡"
_DOUBLE = re.compile(r"([^\W_@$!|+])\1|([@$!|+])\2")
_TRIPLE = re.compile(r"(.)\1\1")
_NUMBER = re.compile(r"[+$€£¥¢]*[0-9][0-9.,:;/()%*-]*[+$€£¥¢!]*")
_ONE, _GAP = r"(?:[^\W_]|[@$!|+€£¥¢])", re.compile(r"[\s._*-]+")
#: three or more single characters parted by white space or signs, in punctuation or not
_SPACED = re.compile(rf"(?<!\S)[{re.escape(_EDGE)}]*+({_ONE}(?:[\s._*-]++{_ONE}){{2,}})[{re.escape(_EDGE)}!]*(?!\S)")
#: signs that end a sentence
_LAST = "!.,?"
#: bytes of tokens, and of what is known of them, that a worker remembers
_MOST = 48 << 20


def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(97, 123):
        table[c] = c - 96
    for c in range(0xDF, 0x100):
        table[c] = 0 if c == 0xF7 else 27 + c - 0xDF
    table[0x100:] = 60
    table[0x2000:0x2070] = table[0x3000:0x3040] = 0
    return table


_CLASS = _classes()


_CLASS_BYTES = _CLASS.tobytes()


def _class(ch: str) -> int:
    return _CLASS_BYTES[ord(ch)]


def count_trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of class trigrams over every text, summed by the executors; CLASSES**3 numbers, however many texts."""
    ship(docs.sparkSession)

    def count(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 200):
                joined = "  ".join(t for t in texts[at : at + 200] if t).lower()
                codes = np.frombuffer(f"  {joined}  ".encode("utf-32-le", "surrogatepass"), np.uint32)
                for a in range(0, len(codes) - 2, 1 << 20):
                    k = _CLASS[codes[a : a + (1 << 20) + 2]].astype(np.int32)
                    total += np.bincount((k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:], minlength=CLASSES**3)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(CLASSES**3, np.int64)
    for gram, n in rows.collect():
        out[gram] = n
    return out


def model_costs(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """-log P(c | a, b), each order smoothed by the one below, flat by (a, b, c)."""
    n3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + CLASSES)
    p2 = (n2 + weight * p1) / (n2.sum(axis=1, keepdims=True) + weight)
    p3 = (n3 + weight * p2[None]) / (n3.sum(axis=2, keepdims=True) + weight)
    return -np.log(p3).ravel()


class Decoder:
    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()

    def options(self, text: str, i: int, spaced: bool, doubled: bool = False, end: int | None = None) -> list[tuple[str, float]]:
        """What the i-th character may stand for, with costs; `end` is where the text's last signs begin, found here if not given."""
        ch = text[i]
        if _class(ch):
            if i and text[i - 1] == ch and (text[i - 2 : i - 1] == ch or text[i + 1 : i + 2] == ch):
                return [(ch, 0.0), ("", DROP_REPEAT)]
            if doubled and i and text[i - 1] == ch:
                return [(ch, 0.0), ("", DROP_DOUBLE)]
            return [(ch, 0.0)]
        if ch in LEET:
            drop = DROP_LAST if ch == "!" and i >= (len(text.rstrip(_LAST)) if end is None else end) else DROP_SIGN if ch * 3 in text[max(0, i - 2) : i + 3] else DROP_LEET
            if doubled and i and text[i - 1] == ch:
                drop = min(drop, DROP_DOUBLE)
            return [*((x, SUBSTITUTE) for x in LEET[ch]), ("", drop)]
        if spaced and ch == "\n":  # a gap wider than others, likely a word's end
            return [("", WIDE), (" ", 0.1)]
        return [("", DROP_SIGN if not spaced else 0.1), (" ", BREAK)]

    def decode(self, text: str, spaced: bool = False) -> str:
        """The best reading; spaces part its words."""
        return self.best(text, spaced)[1]

    def best(self, text: str, spaced: bool = False, doubled: bool = False) -> tuple[float, str]:
        """The cost of the best reading, and the reading. A state is the last two classes read; readings are linked backwards."""
        costs, k2 = self.costs, CLASSES
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        end = len(text.rstrip(_LAST))
        for i in range(len(text)):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options = [(x, more, _class(x) if x else -1) for x, more in self.options(text, i, spaced, doubled, end)]
            for (a, b), (cost, path) in states.items():
                base = (a * k2 + b) * k2
                for x, more, c in options:
                    if c >= 0:
                        key, total, way = (b, c), cost + more + costs[base + c], (path, x)
                    else:
                        key, total, way = (a, b), cost + more, path
                    if key not in new or total < new[key][0]:
                        new[key] = (total, way)
            states = new
        total, _, path = min(((cost + costs[(a * k2 + b) * k2], (a, b), way) for (a, b), (cost, way) in states.items()), key=lambda s: s[:2])
        out = []
        while path is not None:
            path, x = path
            out.append(x)
        return total, "".join(reversed(out))

    def line_cost(self, word: str) -> float:
        """The model's cost of a word as it stands, which is `best` of a lattice without choices."""
        costs, at, total = self.costs, 0, 0.0
        for c in map(_class, word):
            total += costs[at + c]
            at = (at // CLASSES % CLASSES * CLASSES + c) * CLASSES
        return total + costs[at]

    def token(self, token: str) -> str:
        """The reading of a lower-case token without white space."""
        core = token.strip(_EDGE)
        if core.isalpha():
            doubles = _DOUBLE.findall(core)
            if not doubles:
                return core
            if len(doubles) == 1 and not _TRIPLE.search(core) and all(map(_class, core)):
                # one choice in all: two readings, each without a lattice
                at = _DOUBLE.search(core).start()
                undone = core[:at] + core[at + 1 :]
                return undone if self.line_cost(undone) + DROP_DOUBLE + DOUBLED < self.line_cost(core) else core
        elif sum(map(str.isalpha, core)) < 2:
            signs = LEET.keys() & set(core)
            if not signs or len(set(core)) < 2 or _NUMBER.fullmatch(core):
                return ""
        cost, reading = self.best(core)
        if _DOUBLE.search(core):
            other, undone = self.best(core, doubled=True)
            if other + DOUBLED < cost:
                return undone
        return reading

    def _run(self, m: re.Match) -> str:
        if not re.search(r"[^\W\d_]|[@$!|+€£¥¢]", m[1]):
            return m[0]  # numbers are no words
        least = min(map(len, _GAP.findall(m[1])))
        return self.decode(_GAP.sub(lambda g: " " if len(g[0]) == least else "\n", m[1]), True)

    def joined(self, text: str) -> str:
        """A text in lower case with runs of single characters read as words."""
        return _SPACED.sub(self._run, text.lower())

    def restore(self, text: str) -> str:
        """A text's words as read, single spaces between."""
        return " ".join(filter(None, map(self.token, self.joined(text).split())))


def ngrams(word: str) -> set[str]:
    """^ and $ mark a word's ends: its starts of 3 to 6 letters, itself, and all of its 4- and 5-grams."""
    out = {f"^{word[:n]}" for n in range(3, 7) if len(word) >= n} | {f"^{word}$"}
    return out | {word[i : i + n] for n in (4, 5) for i in range(len(word) - n + 1)}


@dataclass
class Model:
    costs: np.ndarray
    grams: list[str]
    weights: np.ndarray
    bias: float


class Scorer:
    """Scores texts; each distinct token is read and matched once, and what has n-grams is remembered apart."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.decoder = model, Decoder(model.costs)
        self.clean: set[str] = set()
        self.hot: dict[str, tuple[int, ...]] = {}
        self.size = 0
        self.trie = ahocorasick.Automaton()
        for i, g in enumerate(model.grams):
            self.trie.add_word(g, i)
        if model.grams:
            self.trie.make_automaton()

    def _learn(self, tokens: list[str]) -> dict[str, tuple[int, ...]]:
        """The n-grams of tokens that have some; all tokens are remembered, up to _MOST bytes."""
        readings = [self.decoder.token(t) for t in tokens]
        lines = ["^" + r.replace(" ", "$^") + "$" for r in readings]
        ends = np.cumsum([len(x) + 1 for x in lines])
        found: dict[int, set[int]] = {}
        if self.model.grams:
            at: list[int] = []
            own: list[int] = []
            for end, gram in self.trie.iter("\n".join(lines)):
                at.append(end)
                own.append(gram)
            for i, gram in zip(np.searchsorted(ends, np.array(at, np.int64), side="right").tolist(), own, strict=True):
                found.setdefault(i, set()).add(gram)
        hot = {tokens[i]: tuple(v) for i, v in found.items()}
        size = sum(map(_held_bytes, tokens)) + sum(120 + 8 * len(v) for v in hot.values())
        if self.size + size > _MOST:
            self.clean, self.hot, self.size = set(), {}, 0
        if size <= _MOST:
            self.clean.update(t for t in tokens if t not in hot)
            self.hot |= hot
            self.size += size
        return hot

    def features(self, texts: list[str]) -> list[set[int]]:
        out = []
        for at in range(0, len(texts), 256):
            sets = []
            for t in texts[at : at + 256]:
                sets.append(set(self.decoder.joined(t).split()))
            odd = [s.difference(self.clean) for s in sets]
            known = {t: self.hot[t] for t in set().union(*odd) if t in self.hot}
            new = set().union(*odd).difference(known)
            if new:
                known |= self._learn(list(new))
            out += [set().union(*(known[t] for t in s if t in known)) for s in odd]
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        w, bias = self.model.weights, self.model.bias
        z = np.array([bias + sum(w[i] for i in f) for f in self.features(texts)], float)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _held_bytes(token: str) -> int:
    """A remembered token's own bytes and its place in a table."""
    return sys.getsizeof(token) + 64


def _scorer(model: Model) -> Scorer:
    return held(("scorer", hash(model.costs.tobytes()), tuple(model.grams), model.bias), lambda: Scorer(model))


def _logistic(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, rounds: int = 500, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of least penalised logistic loss (Adam); rows, cols are the ones of a 0/1 matrix."""
    w = np.zeros(width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(y)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.bincount(cols, g[rows], width + 1).astype(float)
        grad[:-1] += decay * w[:-1]
        grad[-1] = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000, most_grams: int = 3000, support: int = 3) -> Model:
    """The model from all texts (characters) and at most `most_rows` labelled documents of the training fold, those of least hash.

    Rows of one doc_id are its documents: each different text of it counts once, and texts beyond `most_rows` in all are left out by hash.

    n-grams are chosen by how surely toxic documents have them more often (log-odds over
    its error), down to a score that follows from how many were tried. Without toxic or without other documents all scores are the prior's.
    """
    costs = model_costs(count_trigrams(docs))
    own = labels.filter("doc_id is not null and toxic is not null").filter(training_fold()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(sample_by_hash(own, most_rows, "toxicity").select(F.col("doc_id").alias("_id"), "toxic"))
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", "text")
    rows = bounded_texts(rows, most_rows, "toxicity").select("toxic", "text")

    def read(batches):
        decoder = Decoder(costs)
        known: dict[str, str] = {}
        size = 0
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                tokens = set(decoder.joined(t or "").split())
                if size > _MOST:
                    known, size = {}, 0
                for x in tokens:
                    if x not in known:
                        known[x] = decoder.token(x)
                        size += 2 * _held_bytes(x)
                out.append(sorted({w for x in tokens for w in known[x].split()}))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(out, pa.list_(pa.string()))], ["toxic", "words"])

    seen = materialize(rows.mapInArrow(read, "toxic int, words array<string>"), "toxicity-words")
    n = {r[0]: r[1] for r in seen.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(costs, [], np.zeros(0), math.log((n1 + 1) / (n0 + 1)) if n1 + n0 else 0.0)
    words = seen.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum((F.col("toxic") == 1).cast("int")).alias("a"), F.sum((F.col("toxic") != 1).cast("int")).alias("b"))
    size = F.length("w")
    starts = F.transform(F.expr("filter(array(3, 4, 5, 6), n -> length(w) >= n)"), lambda k: F.concat(F.lit("^"), F.substring(F.col("w"), F.lit(1), k)))
    none = F.array().cast("array<string>")
    parts = lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring(F.col("w"), i, F.lit(k)))
    inner = [F.when(size >= k, parts(k)).otherwise(none) for k in (4, 5)]
    grams = words.select(F.explode(F.array_distinct(F.concat(starts, F.array(F.concat(F.lit("^"), "w", F.lit("$"))), *inner))).alias("g"), "a", "b")
    sums = grams.groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") >= support)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    surely = (F.log(a / n1) - F.log(b / n0)) / F.sqrt(1 / a + 1 / b)
    sums = materialize(sums.withColumn("z", surely), "toxicity-grams")
    # what the largest of so many scores without meaning would reach
    bar = math.sqrt(2 * math.log(max(2, sums.count())))
    best = sums.filter(F.col("z") > bar).orderBy(F.desc("z"), "g").limit(most_grams)
    chosen_grams = [r[0] for r in best.select("g").collect()]
    place = {g: i for i, g in enumerate(chosen_grams)}

    def mark(batches):
        for batch in batches:
            sets = [sorted({place[g] for w in words for g in ngrams(w) if g in place}) for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sets, pa.list_(pa.int32()))], ["toxic", "f"])

    marked = seen.mapInArrow(mark, "toxic int, f array<int>").toPandas()
    cols = np.concatenate([np.asarray(f, np.int64) for f in marked["f"]])
    rows_ = np.repeat(np.arange(len(marked)), [len(f) for f in marked["f"]])
    y = (marked["toxic"].to_numpy() == 1).astype(float)
    weights, _ = _logistic(rows_, cols, y, len(chosen_grams))
    strong = np.flatnonzero(np.abs(weights) >= 0.1 * np.abs(weights).max(initial=0))  # the rest add next to nothing; fit again without
    renumber = np.full(len(chosen_grams), -1)
    renumber[strong] = np.arange(len(strong))
    kept = renumber[cols] >= 0
    weights, bias = _logistic(rows_[kept], renumber[cols[kept]], y, len(strong))
    return Model(costs, [chosen_grams[i] for i in strong], weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row for each row of docs. A null text counts as empty."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = _scorer(shared.value).score([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """docs' rows that score below `most`, whatever their columns are called. A null text counts as empty."""
    ship(docs.sparkSession)
    docs, named = guarded(docs, ("text",))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = _scorer(shared.value).score([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(got < most))

    return named(docs.mapInArrow(run, docs.schema))


def deobfuscate(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, restored): every text as the decoder reads it."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        decoder = Decoder(shared.value.costs)
        for batch in batches:
            texts = [decoder.restore(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts)], ["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, restored string")
