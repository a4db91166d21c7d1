import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparvane.llm import encoding, rans, token_output
from sparvane.llm.queries import tokenizer_path


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50_256), max_size=40), max_size=12))
def test_segment_round_trip(docs):
    arrays = [np.array(d, np.int64) for d in docs]
    s = rans.Segment(rans.encode(arrays, lanes=4, block=16))
    assert s.decode().tolist() == [x for d in docs for x in d]
    assert all(s.document(i).tolist() == d for i, d in enumerate(docs))


def test_blocks_decode_alone_and_damage_is_seen():
    ids = np.random.default_rng(0).zipf(1.3, 5000) % 3000
    data = rans.encode([ids], lanes=16, block=512)
    s = rans.Segment(data)
    assert s.blocks > 3 and (s.decode(2, 3) == ids[1024:1536]).all()
    for at in (3, 40, len(data) - 2):
        with pytest.raises((rans.Damaged, ValueError)):
            rans.Segment(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


PARTS = [" ", "  ", "\n", " \n", "\r\n", "a", "b", "'s", "the", "é", "1", "23", "!", "<|endoftext|>", "<|end", "oftext|>", "\t", "\x0b", "\x0c", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u202f", "\u205f", "　", "\ufeff", "\x1c", "\x1f", "\x00", "日本", "à", ".", ",", "\U0001f600"]


@pytest.mark.parametrize("controls", [True, False])
@pytest.mark.parametrize("cache", [1 << 26, 400_000])
def test_chunks_give_the_library_s_ids(controls, cache):
    tool, plain = encoding.Encoder(open(tokenizer_path(), encoding="utf-8").read(), controls, cache), Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = not controls
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [None, "", " ", "x <|endoftext|> y", "a" * 20_000, " \n" * 9_000, "ab " * 50_000]
    for at in (0, 1000, 2000, 3000, 0):
        own = texts[at : at + 1500]
        ids, ends = tool.encode(pa.array(["skipped", *own], pa.string()).slice(1))
        got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == [e.ids for e in plain.encode_batch([t or "" for t in own], add_special_tokens=False)]
        text_of = tool.texts(ids)
        assert [text_of(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)] == [t or "" for t in own]
    assert [x.tolist() for x in tool.encode(pa.array([], pa.string()))] == [[], [0]]


def test_the_cache_stays_within_its_bytes():
    cache = encoding.Cache(100_000)
    for i in range(5000):
        cache.put([b"%d" % i], [b"abcd"])
        assert cache.get([b"0"]) == [b"abcd"]  # what is asked for stays
        assert sum(len(k) + len(v) + 160 for g in (cache.young, cache.old) for k, v in g.items()) <= 100_000


def test_short_chunks_have_keys_of_their_own():
    rng = random.Random(3)
    chunks = sorted({bytes(rng.choice(b"\0 ab\xff") for _ in range(n)) for n in range(1, 18) for _ in range(300)})
    rng.shuffle(chunks)
    data, ends = encoding._bytes(pa.array([b"xyz", *chunks], pa.large_binary()).slice(1))
    low, high, short = encoding._keys(data, ends)
    assert short.tolist() == [len(c) <= 15 for c in chunks]
    keys = set(zip(low[short].tolist(), high[short].tolist(), strict=True))
    assert len(keys) == short.sum()
    assert all((a | (b & (1 << 56) - 1) << 64).to_bytes(15, "little")[: b >> 56] == c for a, b, c in zip(low.tolist(), high.tolist(), chunks, strict=True) if len(c) <= 15)


def test_a_table_gives_what_was_put_or_nothing():
    rng = np.random.default_rng(4)
    table, sure = encoding.Table(3000, np.dtype("<u2")), {}
    assert table.rows.nbytes <= 3000
    for _ in range(200):
        low = rng.choice(500, rng.integers(0, 40), replace=False).astype("<u8")
        high, counts = (low % 15 + 1).astype("<u8") << np.uint64(56), rng.integers(1, 12, len(low))
        ids = rng.integers(0, 1 << 16, counts.sum()).astype("<u2")
        table.put(low, high, ids, counts)
        sure |= dict(zip(low.tolist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if len(low) else {}
        every = np.arange(600, dtype="<u8")
        rows, n = table.get(every, (every % 15 + 1) << np.uint64(56))
        held = [i for i in range(600) if n[i]]
        assert len(held) <= len(table.rows) and (n[500:] == 0).all()
        assert not len(low) or n[low[-1]]  # what came last is there
        assert all(n[i] == encoding._ELSEWHERE if len(sure[i]) > 8 else rows[i][: n[i]].tolist() == sure[i].tolist() for i in held)


def test_known_words_are_not_encoded_again():
    tool, rng, asked = encoding.Encoder(open(tokenizer_path(), encoding="utf-8").read(), cache_bytes=4 << 20), random.Random(5), []
    library = tool._ids
    tool._ids = lambda texts: asked.extend(texts) or library(texts)
    words = list({"".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(30_000)})
    spent = []
    for _ in range(2):
        before = sum(map(len, asked))
        for at in range(0, len(words), 5000):
            tool.encode(pa.array([" " + " ".join(words[at : at + 5000])]))
        spent.append(sum(map(len, asked)) - before)
    assert spent[0] == 9 * len(words) and spent[1] < spent[0] / 2


def want(rows):
    plain = Tokenizer.from_file(tokenizer_path())
    out, start = [], 0
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_every_document(spark):
    rows = sorted(map(tuple, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()))
    rows += [(10**9, "a <|endoftext|>\n\n b"), (10**9 + 1, "  <|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    path = token_output.write_tokens(df, tokenizer_path(), segment_tokens=5000)
    assert sorted(map(tuple, token_output.read_tokens(spark, path).collect())) == want(rows)
    ids = token_output.read_tokens(spark, path, with_ids=True).filter("doc_id = 5").first()
    assert len(ids["ids"]) == ids.n_tokens and ids["ids"][-1] == 2


def test_edges(spark, edge_docs, no_docs):
    out = token_output.read_tokens(spark, token_output.write_tokens(edge_docs, tokenizer_path())).orderBy("start").collect()
    assert len(out) == edge_docs.count() and [r.doc_id for r in out][:2] == [None, None]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(out, out[1:], strict=False)) and out[0].start == 0
    assert {r.n_tokens for r in out if r.doc_id in (2, 3)} == {1}
    assert token_output.read_tokens(spark, token_output.write_tokens(no_docs, tokenizer_path())).count() == 0
