import random
import re

import numpy as np
import xxhash

from sparvane.llm import simhash as S


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(fps, ids, most=3):
    a, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= most) + i + 1:
            u, v = root(i), root(int(j))
            if u != v:
                parent[max(u, v)] = min(u, v)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(ids[i]), f"{fps[i]:016x}", str(least.get(root(i)))) for i in range(len(a)))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64))
    m = S.manhattan(S.embed(a), S.embed(b))
    assert (m <= np.bitwise_count(a ^ b)).all()
    count = lambda x: np.array([[bin(int(v) >> 2 * s & 3).count("1") for s in range(32)] for v in x[:200]])
    assert (np.abs(count(a) - count(b)).sum(axis=1) == m[:200]).all()


def test_every_link_shares_a_cell():
    rng = random.Random(2)
    masks = S.cell_masks(3)
    for _ in range(500):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not bits & m for m in masks)


def test_against_brute_force(spark, edge_rows):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        docs.append((i * 3, " ".join(w)))
        for c in range(i % 4):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(words)
            docs.append((1000 + i * 4 + c, " ".join(v).upper()))
    docs += [r[:2] for r in edge_rows]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute([plain_fingerprint(t) for _, t in docs], [i for i, _ in docs])
    assert got(S.near_duplicates(df)) == want
    assert got(S.near_duplicates(df, block=2)) == want  # cells in blocks lose nothing


def test_one_row_of_each_component_stays(edge_docs, no_docs):
    kept = S.representatives(edge_docs).collect()
    n = len({r.component_id if r.component_id is not None else r.fingerprint for r in S.near_duplicates(edge_docs).collect()})
    assert len(kept) == n and sum(r.doc_id == 1 for r in kept) == 1 and not any(r.doc_id == 7 for r in kept)
    assert S.representatives(no_docs).count() == 0 == S.near_duplicates(no_docs).count()


def test_long_chain_is_one_component(spark):
    df = spark.range(500).selectExpr("id as u", "id + 1 as v")
    assert {r.root for r in S.components(df).collect()} == {0}


def test_representatives_of_clashing_columns(spark):
    df = spark.createDataFrame([(2, "a b c d", 1, "u"), (1, "a b c d", 2, "v"), (1, "a b c d", 2, "v")], "doc_id long, text string, _id int, _digest string")
    assert S.representatives(df).collect() == [(1, "a b c d", 2, "v")]
