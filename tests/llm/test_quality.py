import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvane.llm import pu, queries, rules, textstats

DATA = "/root/testdata/sf0.01"


def plain(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)]


def test_counts(edge_rows):
    rows = [r[1] for r in edge_rows] + ["a", "a a a a", "a b c a b c", " \n\n x\n x\nx", "é ü a\x0b b", "# $| <b>\r\n# $| <b>\r\n"]
    for t in rows:
        assert textstats.stats((t or "").encode())[0] == plain(t)


def test_rules_are_learnt_and_expressed(spark):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(2000), "b": rng.random(2000), "c": rng.random(2000)}
    bad = ((x["a"] > 0.7) & (x["b"] < 0.4)) | (x["c"] > 0.9)
    found = rules.learn(x, bad)
    mark = np.zeros(2000, bool)
    for r in found:
        mark |= rules.covers(r, x, 2000)
    assert (mark == bad).mean() > 0.98
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(*x.values(), strict=True)], "a double, b double, c double")
    assert [not r[0] for r in df.select(rules.verdict(found)).collect()] == mark.tolist()
    assert rules.learn(x, np.zeros(2000, bool)) == []


def test_rules_do_not_depend_on_the_order_of_rows(spark):
    """Ids that repeat with other statistics, in two orders and partitionings; equal rows count once, and one id's rows are bounded."""
    rng = np.random.default_rng(4)
    rows = [(int(i % 150), *map(int, rng.integers(1, 900, len(textstats.COUNTS))), *map(float, rng.random(len(textstats.RATIOS)))) for i in range(1200)]
    rows += [(3, *rows[3][1:])] * 40
    schema = "doc_id long, " + ", ".join([f"{c} long" for c in textstats.COUNTS] + [f"{c} double" for c in textstats.RATIOS])
    x = {c: np.array([r[1 + len(textstats.COUNTS) + k] for r in rows]) for k, c in enumerate(textstats.RATIOS)}
    mark = x[textstats.RATIOS[0]] > 0.8
    lab = spark.createDataFrame([(i, int(not mark[[j for j, r in enumerate(rows) if r[0] == i][0]])) for i in range(150)], "doc_id long, quality int")
    one = rules.fit(spark.createDataFrame(rows, schema).repartition(3), lab, precision=0.1)
    two = rules.fit(spark.createDataFrame(rows[::-1], schema).repartition(7), lab, precision=0.1)
    assert one == two
    few = rules.fit(spark.createDataFrame(rows + [(5, *r[1:]) for r in rows], schema), lab.filter("doc_id < 40"), most_rows=60, precision=0.1)
    assert few == rules.fit(spark.createDataFrame([(5, *r[1:]) for r in rows] + rows, schema), lab.filter("doc_id < 40"), most_rows=60, precision=0.1)


def test_kept_follows_the_base(spark):
    out = queries.op9_rules(spark, DATA)
    wrong = out.filter(F.col("base_failed") & F.col("kept")).count()
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    assert wrong == 0 and out.filter(base != F.col("base_failed")).count() == 0


def pool(positive, unlabelled, seed=3):
    kind = np.repeat([pu.POSITIVE, pu.UNLABELLED], [len(positive), len(unlabelled)])
    return pu.Arrays(kind, np.random.default_rng(seed).integers(0, 2, len(kind)), pu.cells(np.concatenate([positive, unlabelled])))


def test_cells_rise_with_values():
    x = np.sort(np.random.default_rng(0).normal(0, 100, 5000))
    assert (np.diff(pu.cells(x)) >= 0).all() and pu.cells(np.array([-1e30, -1.0, 0.0, 1e-9, 1.0, 1e30])).tolist() == sorted(set(pu.cells(np.array([-1e30, -1.0, 0.0, 1e-9, 1.0, 1e30])).tolist()))


def test_prior_and_scores_from_positives_alone():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.5, 1, (6000, 3)), rng.normal(-1.5, 1, (6000, 3))
    model = pu.fit(pool(good[:3000], np.concatenate([good[3000:5000], bad[:2000]])), 3)
    assert abs(model.prior - 0.5) < 0.1
    s = model.score(np.concatenate([good[5000:], bad[3000:4000]]))
    assert ((s >= 0.5) == (np.arange(2000) < 1000)).mean() > 0.95


@pytest.mark.parametrize("apart", [False, True])
def test_the_weights_are_a_minimum_of_the_risk(apart):
    """Also where the unlabelled hold few of the positives, so that the negatives' part would fall below zero."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(0.7, 1, (4000, 2)), np.concatenate([rng.normal(0.7, 1, (1600, 2)), rng.normal(-0.7, 1, (2400, 2))])
    if apart:
        u = rng.normal(0, 1, (1500, 2))
    model = pu.fit(pool(p, u), 2, bins=4, decay=1e-4, rounds=40, halvings=16)

    def risk(w):
        m = pu.Model(model.edges, w, model.prior)
        fp, fu = (np.array([sum(w[j] for j in row) + w[-1] for row in m.bins(pu.cells(x)).tolist()]) for x in (p, u))
        loss = lambda z: np.log1p(np.exp(-z))
        positive, negative = model.prior * loss(fp).mean(), loss(-fu).mean() - model.prior * loss(-fp).mean()
        return positive + max(0, negative) + 0.5e-4 * (w[:-1] ** 2).sum()

    best = risk(model.weights)
    for _ in range(60):
        assert risk(model.weights + rng.normal(0, 0.05, len(model.weights))) > best - 1e-5


def test_table_and_arrays_give_one_model(spark):
    stats = textstats.text_stats(spark.read.parquet(f"{DATA}/documents.parquet"))
    lab = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = stats.toPandas()
    known = {r.doc_id: r.quality for r in lab.collect() if r.quality is not None}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    kind = np.array([pu.POSITIVE if known.get(i) == 1 and fold(i) else pu.UNLABELLED if i not in known else 9 for i in rows["doc_id"].tolist()])
    half = np.array([zlib.crc32(f"half:{i}".encode()) % 2 for i in rows["doc_id"].tolist()])
    x = rows[list(textstats.RATIOS)].to_numpy()
    own = kind != 9
    want = pu.fit(pu.Arrays(kind[own], half[own], pu.cells(x[own])), x.shape[1])
    got = pu.train(stats, lab)
    assert all((a == b).all() for a, b in zip(got.edges, want.edges, strict=True)) and np.allclose(got.weights, want.weights, atol=1e-6) and got.prior == want.prior
    scored = {r.doc_id: r for r in pu.classify(spark.read.parquet(f"{DATA}/documents.parquet"), lab).collect()}
    for i, row in zip(rows["doc_id"].tolist(), pu.cells(x).tolist(), strict=True):  # every row by plain lookup
        z, base = want.weights[-1], 0
        for e, c in zip(want.edges, row, strict=True):
            z += want.weights[base + sum(t <= c for t in e.tolist())]
            base += len(e) + 1
        s = 1 / (1 + math.exp(-z))
        assert abs(scored[i].score - s) < 1e-6 and scored[i].predicted == (scored[i].score >= 0.3)


def test_rules_against_numpy(spark):
    docs, lab = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    stats = textstats.text_stats(docs)
    found = rules.fit(stats, lab)
    assert found
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.apply_rules(docs, lab).collect()}
    for r in docs.collect():
        counts, ratios = textstats.stats((r.text or "").encode())
        x = dict(zip(textstats.RATIOS, ratios, strict=True))
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        marked = any(all((x[c.name] >= c.threshold) == c.above for c in rule) for rule in found)
        assert got[r.doc_id] == (failed, not failed and not marked)


def test_held_out_quality(spark):
    lab = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    rows = queries.op10_quality(spark, DATA).filter("held_out").join(lab, "doc_id").collect()
    pos, neg = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([p > n for p in pos for n in neg]) > 0.95


def test_a_sample_reads_no_more_than_it_needs(spark):
    df = spark.range(100_000).withColumnRenamed("id", "doc_id").repartition(50)
    own = textstats.sample_by_hash(df, 100, "x")
    want = sorted(range(100_000), key=lambda i: hashlib.md5(f"x{i}".encode()).hexdigest())[:100]
    assert sorted(r.doc_id for r in own.collect()) == sorted(want)
    assert "Filter" in own._jdf.queryExecution().optimizedPlan().toString() and textstats.sample_by_hash(df.limit(50), 100, "x").count() == 50


def test_edges(spark, edge_docs, no_docs, labels):
    for f in (lambda d, l: rules.apply_rules(d, l), lambda d, l: pu.classify(d, l)):
        assert f(edge_docs, labels).count() == edge_docs.count()
        assert f(no_docs, labels).count() == 0 and f(edge_docs, labels.limit(0)).count() == edge_docs.count()
    assert {r.score for r in pu.classify(edge_docs, labels.limit(0)).collect()} == {0.5}
    rows = [(None, "a a a a"), (1, "a a a a"), (1, "a a a a"), (2, None), (3, ""), (4, "word " * 60), (5, " ".join(f"w{i}" for i in range(60))), (6, "# | " * 30_000 + "\nx\nx")]
    df = spark.createDataFrame([(*r, True, 7) for r in rows], "doc_id long, text string, kept boolean, n_words int")
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rules.apply_rules(df, labels.limit(0)).collect())
    same = (4, 4, 0, 0, 4, True, False)
    assert got == [("1", *same), ("1", *same), ("2", 0, 0, 0, 0, 0, True, False), ("3", 0, 0, 0, 0, 0, True, False), ("4", 60, 240, 0, 0, 60, True, False), ("5", 60, 170, 0, 0, 0, False, True), ("6", 60_002, 60_002, 60_000, 1, 60_000, True, False), ("None", *same)]
    scored = pu.classify(df, labels).collect()
    assert len(scored) == 8 and len({r.score for r in scored if r.doc_id in (None, 1)}) == 1
