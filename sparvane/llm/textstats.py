"""Statistics of whole texts, for quality rules and the quality classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .words import SPACED_CASED

_SYMBOLS = b"#*$%&|<>"
_ASCII_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_UPPER, _DIGITS, _SPACE = bytes(range(65, 91)), b"0123456789", bytes([32, *range(9, 14)])
_NEITHER = bytes(c for c in range(128) if c not in _SPACE and not chr(c).isalnum())
_LATER = bytes(range(0x80, 0xC0))

#: whole numbers that the contract names, then ratios that describe a text whatever its length
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "mean_word", "upper_ratio", "digit_ratio", "punct_ratio", "bar_ratio", "bang_ratio", "line_words", "distinct_ratio", "log_words", "long_word_ratio")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)


def _count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def _repeats(words: list[bytes]) -> tuple[int, int]:
    """Words that lie in a 3-word window found twice or more, and the number of distinct words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
    n = len(ids)
    if n < 4:
        return 0, len(number)
    k = len(number)
    pairs = ids[:-1] * k + ids[1:]
    if k >= 1 << 20:  # three numbers would not fit in one
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs[:-1] * k + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, k
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum()), k


def _dup_lines(data: bytes) -> tuple[int, int]:
    """Lines that hold a word and equal an earlier line, and all lines that hold a word."""
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines)), len(lines)


def stats(data: bytes) -> tuple[list[int], list[float]]:
    words = data.translate(SPACED_CASED).split()
    n = len(words)
    chars = sum(map(len, words)) - _count(data, _LATER)  # continuation bytes are no characters
    symbols = _count(data, _SYMBOLS)
    dup, lines = _dup_lines(data)
    repeated, distinct = _repeats(words)
    per, ascii_letters = max(1, chars), max(1, _count(data, _ASCII_LETTERS))
    ratios = [
        symbols / per, dup / max(1, lines), repeated / max(1, n), chars / max(1, n), _count(data, _UPPER) / ascii_letters, _count(data, _DIGITS) / per,
        _count(data, _NEITHER) / per, data.count(b"|") / max(1, n), data.count(b"!") / max(1, n), n / max(1, lines), distinct / max(1, n), float(np.log1p(n)), sum(1 for w in words if len(w) > 12) / max(1, n),
    ]
    return [n, chars, symbols, dup, repeated], ratios


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        rows = [stats(texts[i].as_py() or b"") for i in range(len(batch))]
        counts = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
        ratios = np.array([r[1] for r in rows], np.float64).reshape(-1, len(RATIOS))
        columns = [batch.column("doc_id"), *(pa.array(c.copy()) for c in counts.T), *(pa.array(c.copy()) for c in ratios.T)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, *RATIOS])


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and RATIOS, one row for each row of docs. A null text counts as empty, with zeros throughout."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stats, SCHEMA)


def training_fold() -> object:
    """crc32 of doc_id as text, mod 5, is not 0."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0


def sample_by_hash(df: DataFrame, most: int, salt: str) -> DataFrame:
    """At most `most` rows, those of least md5(salt, doc_id): the same at each run.

    Of a larger table only rows below a threshold, about twice as many as are wanted, go on to be
    sorted, so the task that ends the sort reads about that many however many partitions there are.
    """
    digest = F.md5(F.concat(F.lit(salt), F.col("doc_id").cast("string")))
    share = (2 * most + 100) / max(1, df.count())
    if share < 1:
        df = df.filter(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") < int(share * (1 << 48)))
    return df.orderBy(digest, "doc_id").limit(most)


def bounded_texts(rows: DataFrame, most: int, salt: str) -> DataFrame:
    """One row for each doc_id and text of rows (doc_id, text, …), at most about `most`, those of least hash of both.

    However often an id repeats, copies are gone before anything is gathered; of more than `most` texts those below
    a threshold stay (their number differs from `most` by chance alone), with no order and no single task.
    """
    key = F.xxhash64(F.lit(salt), "doc_id", F.coalesce("text", F.lit("")))
    keyed, share = rows.withColumn("_key", key), 1.0
    if rows.select("doc_id").count() > most:  # without the texts; only then are they read for their number
        share = most / keyed.select("doc_id", "_key").distinct().count()
    if share < 1:
        keyed = keyed.filter(F.pmod("_key", F.lit(1 << 40)) < int(share * (1 << 40)))
    return keyed.dropDuplicates(["doc_id", "_key"]).drop("_key")
