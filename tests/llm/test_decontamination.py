import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparvane.llm import decontamination as D
from sparvane.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, bench, window=10):
    windows = {}
    for item, t in bench:
        w = tokens(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if item is None else str(item))
    out = []
    for i, t in docs:
        w, hit, items = tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                found = windows.get(tuple(w[p : p + n]))
                if found:
                    items |= found
                    hit |= set(range(p, p + n))
        out.append((str(i), len(w), len(hit), tuple(sorted(items))))
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.integers(2, 4), min_size=1, max_size=5))
def test_index_finds_every_place(text, pattern):
    index = FMIndex(np.array(text), sample=3)
    low, high = index.search(np.array([pattern]), np.array([len(pattern)]))
    at = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert at == [i for i in range(len(text) - len(pattern) + 1) if text[i : i + len(pattern)] == pattern]


@pytest.mark.parametrize("options", [{}, {"shard_words": 20}, {"block_words": 12}])
def test_against_brute_force(spark, options):
    rng = random.Random(3)
    words = [*"abcdefg", "é", "B", "x1"]
    bench = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((2, 5, 12, 30))))) for i in range(8)] + [(None, "q r s"), (8, ""), (9, None)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + ("-" + rng.choice(bench[:8])[1] + "." if i % 3 else "")) for i in range(60)]
    docs += [(1, "a b"), (1, "a b"), (None, "q, R! s"), (70, None)]
    found = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), **options)
    got = sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in found.collect())
    assert got == brute(docs, bench)


BENCH = [(1, "one two three four"), (2, "three four five six"), (3, "x y z"), (None, "lonely")]


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.digests(D.contamination(edge_docs, bench)).filter("contaminated").count() == 2
    assert D.contamination(no_docs, bench).count() == 0 == D.contamination(no_docs, bench, cut=True).count()
    assert D.contamination(edge_docs, bench.limit(0)).filter("size(spans) > 0").count() == 0
    kept = D.uncontaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 2


@pytest.mark.parametrize("block_words", [1 << 20, 2, 10, 17])
def test_blocks_and_clashing_columns(spark, block_words):
    bench = spark.createDataFrame([(*r, "u", 2) for r in BENCH], "item_id long, text string, digest string, spans int")
    rows = [(1, "Keep this. One, two; THREE four! and that"), (1, "Keep this. One, two; THREE four! and that"), (2, "one two three four five six."), (None, "a lonely word"), (3, None), (4, ""), (5, "x y"), (6, "x y z " * 20_000)]
    docs = spark.createDataFrame([(*r, "d", 1, "i") for r in rows], "doc_id long, text string, digest string, spans int, items string")
    want = {1: "Keep this. ! and that", 2: ".", None: "a  word", 3: None, 4: "", 5: "x y", 6: " "}
    got = D.contamination(docs, bench, block_words=block_words, cut=True).collect()
    assert sorted((str(r.doc_id), r.clean_text) for r in got) == sorted((str(i), want[i]) for i, _ in rows)
    plain = D.contamination(docs, bench, block_words=block_words).collect()
    assert sorted((str(r.doc_id), r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in plain) == sorted((str(r.doc_id), r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in got)
    assert next(r["items"] for r in plain if r.doc_id == 2) == ["1", "2"]
    kept = D.uncontaminated(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "5"]


def test_windows_of_items_in_arrays_and_pieces():
    """Shared and repeated windows, short items, and items cut into pieces give the same windows and owners."""
    rng = random.Random(2)
    rows = [(f"i{k % 7}", " ".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 3, 9, 30]))).encode()) for k in range(40)]

    def windows(rows):
        out = {}
        for block in rows:
            p = D.Phrases(block, 4)
            names = {i: w.decode() for w, i in p.vocabulary.items()}
            for i in range(len(p.lengths)):
                out.setdefault(tuple(names[x] for x in p.patterns[i, : p.lengths[i]].tolist()), set()).update(p.items(i))
        return out

    want = {}
    for item, text in rows:
        own = text.decode().split()
        for i in range(max(1, len(own) - 3) if own else 0):
            want.setdefault(tuple(own[i : i + 4]), set()).add(item)
    assert windows([rows]) == want
    for most in (1, 4, 5, 11):
        assert windows([[(item, piece)] for item, text in rows for piece in D._overlapping(text, 4, most)]) == want
    p = D.Phrases(rows, 4)
    present = np.zeros(len(p.vocabulary), bool)
    present[p.vocabulary[b"a"]] = present[p.vocabulary[b"b"]] = True
    c = p.vocabulary[b"c"]
    assert p.among(present).tolist() == [i for i in range(len(p.lengths)) if c not in p.patterns[i, : p.lengths[i]].tolist()]
