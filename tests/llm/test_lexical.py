import math
import re
from collections import Counter

import pytest

from sparvane.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    """docs and items are (id, text) lists; rows as search gives them."""
    counts = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in counts:
            score = 0
            for t, times in Counter(TERM.findall((text or "").translate(UPPER))).items():
                if c[t]:
                    m = 100 - 75 + 75 * c.total() * n_docs // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


def rows(df):
    return sorted(repr((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


@pytest.mark.parametrize("shard_bytes, parts, k", [(2_000, 7, 10), (16 << 20, 2, 3)])
def test_all_documents_by_brute_force(spark, shard_bytes, parts, k):
    docs = list(map(tuple, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()))
    docs += [(10**6 + i, docs[3][1]) for i in range(30)] + [(None, docs[3][1]), (3, docs[3][1])]  # ties, and repeated ids
    items = list(map(tuple, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").limit(40).collect()))
    items += [(-1, docs[3][1]), (-2, "the The THE of"), (-3, None), (-4, " .,! "), (-5, "nowhereatall")]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), shard_bytes)
    assert rows(lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k)) == brute(docs, items, k)


def test_blocks_give_the_same_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(30)
    index = lexical.build_index(docs, 5_000)
    assert rows(lexical.search(index, items)) == rows(lexical.search(index, items, block_items=7)) == rows(lexical.search(index, items, block_bytes=3_000))


def test_pivots_skip_documents():
    """A frequent term alone can't reach the heap once rare ones are in it."""
    often, rare = list(range(10_000)), [5, 6, 17, 9_000]
    best = []
    scored = lexical.wand([(often, [10] * len(often), 1, 10), (rare, [900] * 4, 10, 900)], often, 3, best)
    assert sorted(best, reverse=True) == [(9010, -5), (9010, -6), (9010, -17)] and scored < 20


def test_edges(spark, edge_rows, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "a b", 7), (1, "x", 7), (None, "é 日本", 7), (2, "", 7)], "item_id long, text string, score int")
    got = rows(lexical.search(lexical.build_index(edge_docs), items))
    assert got == brute([r[:2] for r in edge_rows], [(1, "a b"), (1, "x"), (None, "é 日本"), (2, "")], 10)
    empty = lexical.search(lexical.build_index(no_docs), items)
    assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(lexical.build_index(edge_docs), items.limit(0)).count() == 0
