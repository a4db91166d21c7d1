import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparvane.llm import counting

PATHS = [public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")]
PARTS = [" ", "  ", "\n", "\r\n", "a", "B", "'s", "'LL", "the", "é", "é", "́", "̸", "=", "1", "23", "²", "!", "...", "<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "|>", "<", "\x0b", "\x85", "\xa0", " ", " ", "​", " ", "　", "﻿", "\x1c", "\x00", "日本", "Σ", "İ", "ß", "ﬁ", "ⅷ", ",", "\U0001f600", "힤", "한", "한", "ae" * 40, "ab" * 70, "z" * 131]


@pytest.fixture(scope="module", params=PATHS)
def tools(request):
    return counting.TokenCounter(open(request.param, encoding="utf-8").read(), 300_000), Tokenizer.from_file(request.param)


def want(plain, texts):
    return [len(e.ids) for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_are_the_library_s(tools):
    tool, plain = tools
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "", " ", "a" * 30_000, "ab " * 20_000, " \n" * 3_000, "1" * 3_000]
    texts += ["".join(rng.choice("etaoinsh") for _ in range(n)) for n in (1, 95, 96, 97, 98, 1000, 30_000)]
    for at in (0, 1500, 2500, 0):
        own = texts[at : at + 1510]
        assert tool.count(pa.array(["skipped", *own], pa.string()).slice(1)).tolist() == want(plain, own)
    assert tool.count(pa.array([], pa.string())).tolist() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_any_text(texts):
    tool, plain = test_any_text.tools
    assert tool.count(pa.array(texts, pa.string())).tolist() == want(plain, texts)


test_any_text.tools = counting.TokenCounter(open(PATHS[0], encoding="utf-8").read()), Tokenizer.from_file(PATHS[0])


def test_both_ways_of_merging_agree():
    """Against merging one pair at a time, with runs of equal symbols and boundaries between sequences."""
    pairs = [("a", "a"), ("a", "b"), ("aa", "aa"), ("ab", "ab"), ("aa", "ab"), ("b", "b")]
    ids = {x: i for i, x in enumerate(["a", "b", "c", *(p + q for p, q in pairs)])}
    merges, ranks = counting.Merges(pairs, ids), {p: i for i, p in enumerate(pairs)}
    rng = random.Random(5)
    seqs = ["".join(rng.choice("aaabbc") for _ in range(rng.randint(1, 40))) for _ in range(400)]

    def plain(s):
        s = list(s)
        while True:
            found = min(((ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks), default=None)
            if found is None:
                return len(s)
            i = found[1]
            s[i : i + 2] = [s[i] + s[i + 1]]

    symbols, lengths = np.array([ids[c] for s in seqs for c in s], np.int64), np.array(list(map(len, seqs)))
    expected = list(map(plain, seqs))
    assert merges._rounds(symbols, lengths).tolist() == expected
    assert merges._linked(symbols, lengths).tolist() == expected
    with pytest.raises(ValueError):
        counting.Merges([("ab", "c"), ("a", "b")], {x: i for i, x in enumerate(["a", "b", "c", "ab", "abc"])})


def test_long_pre_tokens_take_no_square_time(tools):
    import time

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    began = time.time()
    assert tools[0].count(pa.array([text]))[0] > 1000
    assert time.time() - began < 30


def test_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = list(map(tuple, docs.select("doc_id", "text").collect()))
    plain = Tokenizer.from_file(PATHS[0])
    expected = sorted((i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, want(plain, [t for _, t in rows]), strict=True))
    assert sorted(map(tuple, counting.count_tokens(docs, PATHS[0]).collect())) == expected
    assert {r.over_limit for r in counting.count_tokens(docs, PATHS[0], 100).collect()} == {True, False}


def test_edges(spark, edge_docs, no_docs):
    out = counting.count_tokens(edge_docs, PATHS[0])
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == edge_docs.count()
    assert {(r.n_bytes, r.n_tokens) for r in out.collect() if r.doc_id in (2, 3)} == {(0, 0)}
    assert sum(r.doc_id is None for r in out.collect()) == 2 and {r.n_tokens for r in out.collect() if r.doc_id == 4} == {0}
    assert counting.count_tokens(no_docs, PATHS[0]).count() == 0
    with pytest.raises(ValueError):
        counting.TokenCounter('{"added_tokens": [], "pre_tokenizer": null, "model": {"type": "WordPiece"}}')
