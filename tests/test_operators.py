import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvane.functions import text
from sparvane.operators import fitting, relational, retrieval, statistics, store, sums


def test_last_duplicate_landmark_wins(spark):
    df = spark.createDataFrame([(1, 2, 5.0, 0), (1, 2, 7.0, 1), (2, 3, 1.0, 2)], "k int, part int, x double, at int")
    out = {r.k: r.x2 for r in relational.last_value_per_key(df, "k", {"x2": (F.col("part") == 2, F.col("x"))}, "at").collect()}
    assert out == {1: 7.0, 2: None}


def test_majority_of_exactly_half_is_true(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, False), (3, None)], "c int, f boolean")
    assert dict(relational.majority(df, "c", F.col("f")).collect()) == {1: True, 2: False}


def test_names_never_lose_digits(spark):
    df = spark.createDataFrame([(7, "a/b.jpg"), (123456, "c.jpg")], "i int, p string")
    assert [r[0] for r in df.select(text.output_name(F.col("i"), F.col("p"))).collect()] == ["00007_b.jpg", "123456_c.jpg"]


def test_ratio_over_zero_is_null(spark):
    assert spark.range(1).select(relational.ratio(F.lit(1.0), F.lit(0.0))).first()[0] is None


def test_stratified_sample_keeps_every_class(spark):
    df = spark.range(500).select("id", F.when(F.col("id") < 3, "rare").otherwise("common").alias("c"))
    out = relational.stratified_sample(df, "c", "id", 40)
    assert out.count() == 40 and out.select("c").distinct().count() >= 1
    assert sorted(out.collect()) == sorted(relational.stratified_sample(df, "c", "id", 40).collect())


def test_dense_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert all(r.k == r.idx for r in relational.dense_ids(df, ["k"]).collect())


def test_constant_column(spark):
    df = spark.createDataFrame([(i, 3.0, i % 2) for i in range(10)], "id int, x double, y int")
    assert {r.c for r in statistics.discretize(df, "x", "c").collect()} == {0}
    assert {r.x for r in statistics.zscore_columns(df.select("id", "x"), ["x"]).collect()} == {0.0}
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,)], "x double")
    assert [r.c for r in statistics.discretize(nan, "x", "c").collect()][2:] == [0, 0]


def test_single_class_scores_nothing(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(5)], "y int, x double").withColumn("g", F.lit(0))
    assert statistics.fisher_score(df, ["g"], "y", "x").first().fisher_score == 0.0
    assert statistics.mutual_information(df.select(F.col("y").alias("a"), F.col("x").alias("b"))).first()[0] == pytest.approx(0.0, abs=1e-6)


def test_min_max_of_equal_scores_is_half(spark):
    df = spark.createDataFrame([(1, 0.2, 0.1, 0.9), (2, 0.2, 0.5, 0.9)], "id int, t1 double, t2 double, t3 double").withColumn("label", F.lit(0))
    rows = {r.id: r for r in retrieval.rerank(df, adaptive=False).collect()}
    assert rows[2].fused == pytest.approx(0.15 * 0.5 + 0.7 + 0.15 * 0.5) and rows[2]["rank"] == 1


def test_rerank_weights():
    assert retrieval.rerank_weights((0, 0, 0)) == (0.10, 0.80, 0.10)
    assert sum(retrieval.rerank_weights((1, 2, 5))) == pytest.approx(1)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]], int(i % 4)) for i in range(200)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_in_blocks_are_the_same(vectors, monkeypatch):
    _, df = vectors
    whole = sorted(tuple(r) for r in retrieval.nearest(df, df, 7).collect())
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 1500)
    parts = sorted(tuple(r) for r in retrieval.nearest(df, df, 7).collect())
    assert [(a[0], a[1], a[3]) for a in whole] == [(a[0], a[1], a[3]) for a in parts]
    assert all(r[0] == r[1] for r in whole if r[3] == 1)


def test_graph_rows_sum_to_one(vectors):
    _, df = vectors
    g = retrieval.similarity_graph(retrieval.nearest(df, df, 5))
    assert all(r.s == pytest.approx(1) for r in g.groupBy("src").agg(F.sum("w").alias("s")).collect())


def test_pca_agrees_with_svd(spark, vectors):
    x, df = vectors
    model = fitting.fit_pca(df, "embedding", 3)
    c = x - x.mean(axis=0)
    axes = np.linalg.svd(c, full_matrices=False)[2][:3]
    assert np.allclose(np.abs((model.axes * axes).sum(axis=1)), 1, atol=1e-5)
    assert np.allclose(np.abs(fitting.pca_of(x, 3).axes), np.abs(model.axes), atol=1e-5)
    assert fitting.fit_pca(df, "embedding", 8) is None and fitting.fit_pca(df, "embedding", 0) is None
    out = fitting.apply_pca(df, "embedding", model, "p").first()
    assert len(out.p) == 3


def turned(a, b):
    """The sine of the largest angle between two subspaces, an orthonormal axis each row."""
    return np.linalg.norm(a.T - b.T @ (b @ a.T), 2)


@pytest.mark.parametrize("rows, columns, dim", [(300, 1500, 12), (90, 16_384, 20), (60, 2000, 100)])
def test_wide_pca_takes_all_rows(spark, rows, columns, dim):
    """The subspace of an SVD of all rows, with a spectrum that falls slowly; fewer rows than axes as well."""
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(rows, rows)) * 0.93 ** np.arange(rows)) @ rng.normal(size=(rows, columns)) + 5
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(3)
    model = fitting.fit_pca(df, "v", dim)
    axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][: len(model.axes)]
    assert len(model.axes) == min(dim, rows) and np.allclose(model.mean, x.mean(axis=0))
    keep = min(dim, rows - 1)  # centred rows have one direction less
    assert turned(model.axes[:keep], axes[:keep]) < 1e-6 and np.allclose(model.axes @ model.axes.T, np.eye(len(model.axes)), atol=1e-8)


def test_sums_are_added_slice_by_slice(spark):
    df = spark.range(100).repartition(7)
    width = 3 * sums.SLICE + 5
    make = lambda batches: sum(float(b["id"].sum()) for b in batches) * np.arange(width)
    assert np.array_equal(sums.add_up(df, make, width), 4950 * np.arange(width))
    assert np.array_equal(sums.add_up(df, lambda batches: [b for b in batches] and None, 4), np.zeros(4))
    rolled = lambda batches: np.full(2, sum(float(np.sin(b["id"]).sum()) for b in batches) / 3)
    assert np.array_equal(sums.add_up(df, rolled, 2), sums.add_up(df, rolled, 2))


def test_mixture_finds_two_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-4, 1, (300, 2)), rng.normal(4, 0.5, (300, 2))])
    m = fitting.fit_mixture(spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>"), "v", 2)
    assert sorted(np.round(m.means[:, 0])) == [-4, 4] and m.weights.sum() == pytest.approx(1)


def test_mixture_starts_from_all_rows(spark):
    """Rows stored by class: the first 6,000 all belong to one."""
    rng = np.random.default_rng(2)
    where = [(0, 0), (30, 0), (34, 0), (30, 4)]
    x = np.concatenate([rng.normal(c, 0.5, (n, 2)) for c, n in zip(where, (6000, 300, 300, 300), strict=True)])
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "v array<double>")
    m = fitting.fit_mixture(df.coalesce(1), "v", 4)
    assert all(np.abs(m.means - c).sum(axis=1).min() < 0.3 for c in where)
    assert np.allclose(np.sort(m.weights), [300 / 6900] * 3 + [6000 / 6900], atol=1e-3)


def test_store_round_trip(spark, tmp_path):
    meta = spark.createDataFrame([(i, f"{i}.jpg", 1, "a.b") for i in (5, 3, 9)], "img_id int, filename string, class_id int, class_name string")
    attrs = spark.createDataFrame([(3, 1, 0), (5, 0, 1)], "img_id int, attr_1 int, attr_2 int")
    vecs = spark.createDataFrame([(3, [1.0, 0.0]), (5, [0.0, 1.0]), (9, [1.0, 1.0])], "img_id int, embedding array<double>")
    s = store.build_store(meta, attrs, vecs, f"file://{tmp_path}/s")
    assert [(r.id, r.idx, r.attributes) for r in s.orderBy("idx").collect()] == [(3, 0, "[1,0]"), (5, 1, "[0,1]")]
    assert store.lookup(s, 1).first().species_name == "a.b" and store.check(s).first().rows == 2


def test_hits_without_metadata_are_dropped(vectors):
    _, df = vectors
    hits = retrieval.top_k(df, [1.0] * 8, 5)
    kept = retrieval.with_metadata(hits, df.filter("vec_id % 2 = 0").select("vec_id", "label"))
    assert kept.count() <= 5 and all(r.vec_id % 2 == 0 for r in kept.collect())


def test_text_functions(spark):
    df = spark.createDataFrame([("  Bill Color::Red! ",), ("***",), (None,)], "t string")
    assert [r[0] for r in df.select(text.slugify(F.col("t"))).collect()] == ["bill_color_red", "attr", "attr"]
    assert [r[0] for r in df.select(text.matches_any(F.col("t"), ["red"])).collect()] == [True, False, False]
    line = spark.range(1).select(text.progress(F.lit("T2: 42%|## | 264/629 [00:08<00:12, 29.71it/s]")).alias("p")).first().p
    assert (line.percent, line.done, line.total, line.eta) == (42, 264, 629, "00:12") and math.isclose(line.rate, 29.71)
    assert text.numbers("1, 5,,10", int) == [1, 5, 10]


def test_landmarks_take_one_aggregate(spark):
    """Flags and places of landmarks come together: the master is joined with them and with the attributes, and nothing else is."""
    from sparvane.plans import posture

    master = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 20.0), (2, 0.0, 0.0, 10.0, 20.0)], "img_id int, x double, y double, width double, height double")
    labels = spark.createDataFrame([(1, 5, 1, 4)], "img_id int, attr_id int, is_present int, certainty_id int")
    parts = spark.createDataFrame([(1, posture.BEAK, 1.0, 2.0, 1, 1), (1, posture.BEAK, 3.0, 2.0, 1, 2), (1, posture.TAIL, 9.0, 12.0, 1, 3), (1, 7, 1.0, 1.0, 0, 4)], "img_id int, part_id int, x double, y double, visible int, source_at int")
    out = posture.scored(master, labels, parts, [5])
    got = {r.img_id: (r.beak_visible, r.tail_visible, r.left_eye_visible, r.beak_tail_dx_norm, r.attr_perching) for r in out.collect()}
    assert got == {1: (True, True, False, 0.6, True), 2: (False, False, False, -1.0, False)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.count("max_by") and plan.count("Aggregate") == 2
