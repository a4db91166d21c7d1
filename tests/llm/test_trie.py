import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from sparvane.llm import trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """rows: (conv_id, turn, role, text); nodes as plain dictionaries of paths."""
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        base = [] if c is None else own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])
        rebuilt[c] = base[:h] + ts[h:]
    members, ends = {}, {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
        ends.setdefault(tuple(ts), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    least = {p: min((c for c in cs if c is not None), default=None) for p, cs in members.items()}
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(cs) - 1) * words
    out = []
    for p, cs in members.items():
        line = ",".join("" if c is None else str(c) for c in sorted(ends.get(p, []), key=lambda c: (c is not None, c or 0)))
        out.append((least[p], len(p), least[p[:-1]] if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(line.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == NAMES
    return sorted(map(tuple, df.collect()), key=repr)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert got(trie.prefix_trie(df)) == brute(list(map(tuple, df.select("conv_id", "turn", "role", "text").collect())))


@pytest.mark.parametrize("seed", [0, 1])
def test_shared_prefixes_and_a_hot_conversation(spark, monkeypatch, seed):
    """Bases, some absent, some shorter than what is taken; one conversation over several partitions; many conversations of equal turns."""
    rng = random.Random(seed)
    rows = []
    for c in range(-45, 400):
        if c % 20 == 0 and rng.random() < 0.3:
            continue
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a", "", None, "c\nd e"])))
    rows += [(1000 + i, t, "user", "same  text") for i in range(120) for t in range(2)]
    rows += [(777, t, "user", f"turn {t}") for t in range(900)] + [(797, t, "user", f"turn {t}") for t in range(900)]
    rng.shuffle(rows)
    went_on = []
    monkeypatch.setattr(trie, "_ahead", lambda tails, f=trie._ahead: went_on.append(f(tails)) or went_on[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(went_on[0]) > 3


def test_numbers_are_put_together_from_parts():
    digits = [trie.digit("user", str(i)) for i in range(9)]
    whole = 0
    for x in digits:
        whole = (whole * trie.BASE + x) % trie.PRIME
    first = second = 0
    for x in digits[:4]:
        first = (first * trie.BASE + x) % trie.PRIME
    for x in digits[4:]:
        second = (second * trie.BASE + x) % trie.PRIME
    assert (first * pow(trie.BASE, 5, trie.PRIME) + second) % trie.PRIME == whole
    assert trie.digit("a", "bc") != trie.digit("ab", "c") and trie.digit("", "") > 0


def test_many_tables_are_merged_in_rounds(spark):
    rows = [(bytes([1]) * 16, trie.ROOT, 1, 2, c, 1, p) for p in range(600) for c in (p, p + 1)]
    df = spark.createDataFrame(rows, "node binary, parent binary, depth long, words long, conv_id long, n_convs long, part int")
    assert [(r.conv_id, r.n_convs) for r in trie.merge(df, 600).collect()] == [(0, 1200)]


def test_long_lists_of_ends_are_digested_in_runs(spark, monkeypatch):
    monkeypatch.setattr(trie, "_CHUNK", 100)
    ids = [*range(5000), None, -3]
    df = spark.createDataFrame([(b"x", c) for c in ids] + [(b"y", 4)], "node binary, conv_id long")
    want = ",".join(["", "-3", *map(str, range(5000))])
    assert {bytes(r.node): r.ends_sha256 for r in trie.end_digests(df).collect()} == {b"x": hashlib.sha256(want.encode()).hexdigest(), b"y": hashlib.sha256(b"4").hexdigest()}


def test_edges(spark):
    rows = [(None, 1, "user", "x"), (None, None, None, None), (3, 0, None, None), (3, 0, None, None), (20, None, "user", "long " * 100_000), (21, 5, "user", "long " * 100_000), (40, 0, "", "")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], f"{SCHEMA}, node string, depth int")
    assert got(trie.prefix_trie(df)) == brute(rows)
    assert got(trie.prefix_trie(df.limit(0))) == []
