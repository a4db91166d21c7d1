import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparvane.operators import relational, retrieval, statistics
from sparvane.plans import retrieval as plans


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 6)).astype(np.float32)
    x[10] = x[40] = x[70]  # ties across blocks
    rows = [(i, x[i].tolist(), i % 4 if i < 80 else 9) for i in range(90)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").persist(), x, np.array([r[2] for r in rows])


@pytest.mark.parametrize("size", [64 << 20, 800, 300])
@pytest.mark.parametrize("include_self", [True, False])
def test_nearest_against_brute_force(corpus, monkeypatch, size, include_self):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", size)
    df, x, _ = corpus
    u = x.astype(float) / (np.linalg.norm(x.astype(float), axis=1, keepdims=True) + 1e-8)
    s = np.round(u @ u.T, 12)
    want = set()
    for i in range(len(u)):
        order = [j for j in np.lexsort((np.arange(len(u)), -s[i])).tolist() if include_self or j != i][:7]
        want |= {(i, j, r + 1) for r, j in enumerate(order)}
    got = retrieval.nearest(df, df, 7, include_self=include_self)
    assert {(r.src, r.dst, r["rank"]) for r in got.collect()} == want
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [64 << 20, 1500])
def test_evaluate_against_brute_force(spark, corpus, monkeypatch, size):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", size)
    df, x, label = corpus
    own = df.filter("vec_id < 30 or label = 9")
    s = np.round(x.astype(float) @ x.astype(float).T, 12)
    np.fill_diagonal(s, -1)
    got = {r.src: r for r in retrieval.evaluate(own, df, (1, 5)).collect()}
    assert set(got) == {i for i in range(90) if i < 30 or label[i] == 9}
    for i, r in got.items():
        at = np.flatnonzero(label[np.lexsort((np.arange(len(x)), -s[i]))] == label[i])
        assert r.ap == pytest.approx(np.mean(np.arange(1, len(at) + 1) / (at + 1))) and (r.hit_1, r.hit_5) == (int(at[0] < 1), int(at[0] < 5))
    # a class without rows in the corpus
    alone = retrieval.evaluate(own.filter("vec_id = 3").withColumn("label", F.lit(77)), df.filter("vec_id > 50"), (1,)).collect()
    assert [(r.src, r.hit_1, r.ap) for r in alone] == [(3, 0, 0.0)]


@pytest.mark.parametrize("size", [64 << 20, 3000])
def test_evaluate_ranks_ties_by_id(spark, monkeypatch, size):
    """Many equal scores of rows of several classes, classes without a name, scores too large for quarters."""
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", size)
    rng = np.random.default_rng(8)
    x = rng.choice([-1.0, 0.0, 0.5, 1e8], (180, 3), p=[0.4, 0.29, 0.3, 0.01])
    label = [None if i % 41 == 0 else "abc"[i % 3] for i in range(180)]
    df = spark.createDataFrame([(i * 7 % 181, x[i].tolist(), label[i]) for i in range(180)], "vec_id long, embedding array<double>, label string").repartition(5)
    ids = np.arange(180) * 7 % 181
    s = x @ x.T
    np.fill_diagonal(s, -1)
    got = {r.src: r for r in retrieval.evaluate(df, df, (1, 10)).collect()}
    assert set(got) == set(ids.tolist())
    for i in range(180):
        order = np.lexsort((ids, -s[i]))
        at = np.array([n for n, j in enumerate(order) if label[i] is not None and label[j] == label[i]])
        r = got[int(ids[i])]
        want = (int((at < 1).any()), int((at < 10).any()), np.mean(np.arange(1, len(at) + 1) / (at + 1)) if len(at) else 0.0)
        assert (r.hit_1, r.hit_10) == want[:2] and r.ap == pytest.approx(want[2])


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty tight groups, one of them a third of all rows and half copies; zero vectors; a group in the opposite direction."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3
    centres[39] = -centres[0]
    group = np.where(np.arange(1500) % 3 == 0, 0, rng.integers(0, 40, 1500))
    x = centres[group] + rng.normal(size=(1500, 16)) * 0.05
    x[:300:6] = x[0]
    x[[7, 70, 700]] = 0
    return spark.createDataFrame([(i, x[i].tolist()) for i in range(1500)], "vec_id long, embedding array<double>").repartition(5).persist()


@pytest.mark.parametrize("size", [64 << 20, 20_000])
@pytest.mark.parametrize("include_self", [True, False])
def test_pruned_neighbours_are_the_nearest(clustered, monkeypatch, size, include_self):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", size)
    report = {}
    got = retrieval.nearest_pruned(clustered, clustered, 9, include_self=include_self, report=report)
    want = retrieval.nearest(clustered, clustered, 9, include_self=include_self)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert report["pairs"] == 1500**2 and report["compared"] < 0.3 * report["pairs"]


def test_pruning_without_cells_falls_back(corpus, clustered):
    df, report = corpus[0], {}
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(retrieval.nearest_pruned(df, df, 7, report=report), retrieval.nearest(df, df, 7)) and report["compared"] > report["pairs"] / 2
    some = clustered.filter("vec_id % 100 = 0")
    assert same(retrieval.nearest_pruned(some, clustered, 1600), retrieval.nearest(some, clustered, 1600))  # more than there are
    assert same(retrieval.nearest_pruned(some, clustered.limit(0), 3), some.limit(0)) and same(retrieval.nearest_pruned(some.limit(0), clustered, 3), some.limit(0))
    assert same(retrieval.nearest_pruned(some, clustered, 5, pivots=1), retrieval.nearest(some, clustered, 5))


def python_rows(df):
    """How many rows each step in Python left in the plan that ran."""
    written, nodes = [], [df._jdf.queryExecution().executedPlan().finalPhysicalPlan()]
    while nodes:
        node = nodes.pop()
        if "InArrow" in node.nodeName() or "InPandas" in node.nodeName():
            written.append(node.metrics().apply("pythonNumRowsReceived").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            nodes.append(node.plan())
    return written


@pytest.mark.parametrize("size", [64 << 20, 3000])
def test_evaluate_makes_no_row_for_each_pair(spark, monkeypatch, size):
    """300 rows of one class: what the tasks that count leave is a row for each query, block of relevant rows and block of the corpus."""
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", size)
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"), F.lit(1).alias("label"))
    out = retrieval.evaluate(df, df, (1,))
    assert [r.ap for r in out.collect()] == [1.0] * 300
    blocks = 1 if size > 3000 else -(-300 * 3 * 8 // size)
    assert max(python_rows(out)) <= 300 * blocks * max(blocks, spark.sparkContext.defaultParallelism)


@pytest.mark.parametrize("size", [64 << 20, 400])
def test_a_task_holds_three_blocks_at_most(spark, corpus, monkeypatch, size):
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", size)
    df, x, _ = corpus
    seen = []
    monkeypatch.setattr(retrieval, "_counted", lambda forms, schema: lambda batches: iter(()))
    monkeypatch.setattr(type(df), "repartitionById", lambda self, n, task: seen.append((n, self)) or self, raising=False)
    retrieval.evaluate(df.filter("vec_id % 10 = 0"), df)
    n, parts = seen[0]
    rows = parts.groupBy("task", "side").agg(F.sum(F.size("v") * 8).alias("bytes")).collect()
    assert max(r.task for r in rows) < n
    assert all(r.bytes <= 3 * size for r in rows)  # dealt by hashes, so about a block


def test_one_class_over_many_blocks(spark, monkeypatch):
    """A class with most rows and equal scores on both sides, cut over several blocks of relevant rows."""
    rng = np.random.default_rng(3)
    x = rng.choice([-1.0, 0.0, 0.5, 1.0], (240, 3))
    label = np.where(np.arange(240) % 5 == 0, "b", "a")
    df = spark.createDataFrame([(i, x[i].tolist(), str(label[i])) for i in range(240)], "vec_id long, embedding array<double>, label string").repartition(4)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 1000)
    got = {r.src: r for r in retrieval.evaluate(df.filter("vec_id % 3 = 0"), df, (1, 5)).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -1)
    assert set(got) == set(range(0, 240, 3))
    for i, r in got.items():
        at = np.flatnonzero(label[np.lexsort((np.arange(240), -s[i]))] == label[i])
        assert (r.hit_1, r.hit_5) == (int(at[0] < 1), int(at[0] < 5)) and r.ap == pytest.approx(np.mean(np.arange(1, len(at) + 1) / (at + 1)))


def test_registered_evaluations_ask_with_every_row(spark):
    """Every row is a query, in the queries and in their SQL."""
    data = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    per = plans.average_precision(spark, data).collect()
    assert sorted(r.src for r in per) == sorted(r.vec_id for r in e.select("vec_id").collect())
    got = plans.recall_map(spark, data).first()
    assert got.mean_ap == pytest.approx(np.mean([r.ap for r in per]), abs=1e-6) and got.recall_at_1 == pytest.approx(np.mean([r.hit_1 for r in per]), abs=1e-6)
    want = {r.weights: r for r in retrieval.tune(e.select("vec_id", "label", F.slice("embedding", 1, 16).alias("a"), F.slice("embedding", 17, 48).alias("b")), ["a", "b"], [(0.5, 1.0), (1.0, 1.0), (2.0, 1.0)]).collect()}
    assert all(r.mean_ap == pytest.approx(want[r.weights].mean_ap, abs=1e-6) for r in plans.weight_tuning(spark, data).collect())
    assert not any("% 100" in plans.SQL[q] for q in ("average_precision", "recall_map", "weight_tuning"))


def test_counts_survive_packing():
    for counts in ([], [0], [3, 3, 258], [0, 400, 10**12]):
        assert retrieval._unpacked(retrieval._packed(np.array(counts, np.int64))).tolist() == counts


def test_counts_take_bits_where_they_rise_slowly():
    """A block's counts for a row of the class each: about a bit for each row that is counted, not a byte."""
    counts = np.cumsum(np.random.default_rng(1).integers(0, 4, 10_000))
    data = retrieval._packed(counts)
    assert len(data) <= (counts[-1] + len(counts)) // 8 + 2 < len(counts) / 2 and (retrieval._unpacked(data) == counts).all()


def test_counts_stay_in_their_task(spark, monkeypatch):
    """Queries are cut before the corpus: with one block of the corpus no counts are shuffled, only totals."""
    monkeypatch.setattr(retrieval, "LEAST_QUERIES", 10)
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    out = retrieval.evaluate(df, df, (1,))
    assert len(out.collect()) == 300 and python_rows(out) == [300]


def test_ranks_are_whole_in_their_task(spark, monkeypatch):
    """However many blocks the corpus has, no counts of a query and a block are shuffled: one Python step, a row for each query."""
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 900)
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.5)).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    out = retrieval.evaluate(df, df, (1,))
    assert len(out.collect()) == 300 and python_rows(out) == [300]


def test_a_task_reads_its_corpus_in_parts(monkeypatch, tmp_path):
    """Queries, then blocks of the corpus with ties, in a file of which a few rows are read at a time; the file goes."""
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    monkeypatch.setattr(retrieval._Held, "STEP", 7 * 3 * 8)
    monkeypatch.setattr(retrieval, "LEAST_SCORED", 4)
    rng = np.random.default_rng(2)
    x, ids, label = rng.choice([-1.0, 0.0, 0.5, 1.25], (100, 3)), rng.permutation(100), rng.integers(0, 3, 100)
    table = pa.table({"side": pa.array([0] * 10, pa.int32()), "k": ids[:10], "v": pa.array(x[:10].tolist()), "l": label[:10]})
    table = pa.concat_tables([table, pa.table({"side": pa.array([1 + i // 30 for i in range(100)], pa.int32()), "k": ids, "v": pa.array(x.tolist()), "l": label})])
    schema = pa.schema({"form": pa.int32(), "src": pa.int64(), "n": pa.int64(), "best": pa.int64(), "total": pa.float64()})
    forms = [lambda m: m * 1.0, lambda m: m[:, 1:]]
    seen = []
    for b in retrieval._counted(forms, schema)(iter(table.to_batches(16))):
        seen += [tuple(r.values()) for r in b.to_pylist()]
    assert [r[:2] for r in seen] == [(f, k) for f in range(2) for k in ids[:10]] and not list(tmp_path.iterdir())
    for f, k, n, best, total in seen:
        i, y = ids.tolist().index(k), forms[f](x)
        s = y @ y[i]
        s[i] = -1
        at = np.flatnonzero(label[np.lexsort((ids, -s))] == label[i]) + 1
        assert (n, best) == (len(at), at[0]) and total == pytest.approx((np.arange(1, len(at) + 1) / at).sum())


def test_batches_are_bounded_in_bytes(spark, corpus):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    retrieval.evaluate(corpus[0], corpus[0])
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_tuning_sends_floats_as_they_are(spark, corpus, monkeypatch):
    seen = []
    whole = retrieval.evaluate
    monkeypatch.setattr(retrieval, "evaluate", lambda q, c, *a: seen.append((dict(q.dtypes)["_v"], dict(c.dtypes)["_v"])) or whole(q, c, *a))
    df = corpus[0].select("vec_id", "label", F.slice("embedding", 1, 2).alias("a"), F.slice("embedding", 3, 4).alias("b"))
    floats, doubles = (retrieval.tune(d, ["a", "b"], [(0.3, 1.0), (2.0, 1.0)]).collect() for d in (df, df.select("vec_id", "label", *[F.col(c).cast("array<double>").alias(c) for c in "ab"])))
    assert seen == [("array<float>",) * 2, ("array<double>",) * 2] and floats == doubles


def test_each_pair_of_blocks_is_a_task(spark, corpus, monkeypatch):
    """Which shuffle partitions are merged makes no task longer."""
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 600)
    seen = []
    whole = type(corpus[0]).repartitionById
    monkeypatch.setattr(type(corpus[0]), "repartitionById", lambda self, n, task: seen.append((n, self.select("task").distinct().count())) or whole(self, n, task))
    got = retrieval.nearest(corpus[0], corpus[0], 7).collect()
    assert len(got) == 90 * 7 and seen[0][0] >= 64 and seen[0][1] > 0.9 * seen[0][0]


@pytest.mark.parametrize("metric, include_self", [("cosine", True), ("cosine", False), ("l2", True)])
def test_best_of_groups_against_a_sort(metric, include_self):
    """Enough rows that groups' best scores bound the k-th, with ties at the edge."""
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (1500, 3)).astype(np.float64)
    t = pa.table({"k": np.arange(1500)[::-1], "v": pa.array(x.tolist())})
    got = retrieval._best(t.slice(0, 40), t, 5, include_self, metric).to_pydict()
    u = retrieval._unit(x) if metric == "cosine" else x
    ids = np.arange(1500)[::-1]
    want = []
    for i in range(40):
        s = np.round(u @ u[i] if metric == "cosine" else np.minimum(2 * x @ x[i] - (x**2).sum(axis=1) - (x[i] ** 2).sum(), 0), 12)
        s[i] = s[i] if include_self else -np.inf
        want += [(ids[i], ids[j]) for j in np.lexsort((ids, -s))[:5]]
    assert list(zip(got["src"], got["dst"], strict=True)) == want


def test_forms_beyond_a_block(spark, corpus, monkeypatch):
    df = corpus[0].filter("label < 4")
    alone = [retrieval.evaluate(d, d).collect() for d in (df, df.withColumn("embedding", F.slice("embedding", 2, 3)))]
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 500)
    got = retrieval.evaluate(df, df, forms=[lambda x: x, lambda x: x[:, 1:4]]).collect()
    got = sorted(tuple(r)[:-1] + (round(r.ap, 12),) for r in got)  # blocks add in another order
    assert got == sorted((f, *tuple(r)[:-1], round(r.ap, 12)) for f, rows in enumerate(alone) for r in rows)


def test_a_length_is_made_once_a_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<double>")
    out = df.select(retrieval.normalized(F.transform("v", lambda x: x * 2.0)).alias("v"))
    assert [r.v and pytest.approx(r.v) for r in out.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert "/ (sqrt" not in out._jdf.queryExecution().optimizedPlan().toString().lower()  # inside the division it is made for each place


def test_quantiles_against_numpy(spark):
    rng = random.Random(2)
    rows = [(rng.choice([rng.gauss(0, 9), 4.0, None]), float(i % 3), 5.0, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(6)
    shares = [0, 0.1, 1 / 3, 0.5, 0.875, 1]
    got = statistics.quantiles(df, ["a", "b", "c", "d"], shares)
    for i, name in enumerate("abc"):
        assert got[name] == pytest.approx(np.quantile([r[i] for r in rows if r[i] is not None], shares).tolist())
    assert got["d"] == [] and statistics.quantiles(df.limit(0), ["a"], shares) == {"a": []}
    coded = statistics.codes(df, {"a": "x", "b": "y", "c": "z"}, 4).select("a", "x", "y", "z").collect()
    edges = sorted(set(np.quantile([r[0] for r in rows if r[0] is not None], [0, 0.25, 0.5, 0.75, 1]).tolist()))
    assert all(r.x == (0 if r.a is None else sum(e <= r.a for e in edges[1:-1])) and r.z == 0 for r in coded)


@pytest.mark.parametrize("accuracy, within", [(10_000, 200_000), (50, 200), (50, 3)])
def test_quantiles_by_brackets(spark, monkeypatch, accuracy, within):
    """Coarse sketches and few values at a time: brackets are narrowed until they fit, whatever repeats."""
    monkeypatch.setattr(statistics, "ACCURACY", accuracy)
    monkeypatch.setattr(statistics, "WITHIN", within)
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=4000), np.where(rng.random(4000) < 0.4, 7.0, rng.integers(0, 50, 4000))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double").repartition(3)
    shares = [0.5] if within == 3 else [0, 0.001, 0.25, 0.5, 0.5, 0.999, 1]
    got = statistics.quantiles(df, ["a"] if within == 3 else ["a", "b"], shares)
    assert got["a"] == pytest.approx(np.quantile(a, shares).tolist(), abs=1e-12)
    assert within == 3 or got["b"] == pytest.approx(np.quantile(b, shares).tolist())
    odd = spark.createDataFrame([(math.nan,), (1.0,), (math.inf,), (-math.inf,), (None,)], "v double")
    assert statistics.quantiles(odd, ["v"], [0, 1 / 3, 2 / 3])["v"] == [-math.inf, 1.0, math.inf] and math.isnan(statistics.quantiles(odd, ["v"], [1])["v"][0])


def test_codes_make_a_value_finite_once(spark):
    """Repeated for every edge, the tests made a method too long for the JVM to compile."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=500), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(math.nan, 1.0), (math.inf, None)], "x double, y double")
    out = statistics.codes(df, {"x": "cx", "y": "cy"})
    assert out.columns == ["x", "y", "cx", "cy"] and out._jdf.queryExecution().optimizedPlan().toString().lower().count("isnan(x") <= 2
    edges = np.quantile(x, np.arange(1, 8) / 8)
    half = np.median([*y, 1.0])
    assert [(r.cx, r.cy) for r in out.collect()] == [*((int((edges <= a).sum()), int(b > half)) for a, b in zip(x, y, strict=True)), (0, int(1.0 > half)), (0, 0)]


def test_edge_values_take_no_part(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (3.0,), (math.nan,), (math.inf,), (None,)], "v double")
    assert [r.code for r in statistics.discretize(df, "v", "code", 1).collect()] == [0, 0, 0, 0, 0, 0]
    assert statistics.distribution(df.limit(0), "v", 1.0).first().q50 is None


def test_a_sample_sorts_no_more_than_it_needs(spark):
    df = spark.range(50_000).repartition(40)
    own = relational.sample_rows(df, "id", 20)
    import hashlib

    want = sorted(range(50_000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:20]
    assert sorted(r.id for r in own.collect()) == sorted(want) and "Filter" in own._jdf.queryExecution().optimizedPlan().toString()
