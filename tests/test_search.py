import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparvane import catalog
from sparvane.config import SPEEDS
from sparvane.functions import kernels as K
from sparvane.operators import fitting, retrieval
from sparvane.plans import search, tuning


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        centre = np.eye(12)[i % 4] * 3
        v = centre + rng.normal(size=12) * 0.4
        rows.append((i, i % 4, v[:4].tolist(), v.tolist(), v[8:].tolist(), {"head": v[:3].tolist(), "tail": v[3:6].tolist()}))
    return spark.createDataFrame(rows, "id long, label int, tier1 array<double>, tier2 array<double>, tier3 array<double>, parts map<string,array<double>>").persist()


def query(corpus, i, external=False):
    r = corpus.filter(F.col("id") == i).first()
    return search.Query(r.tier1, r.tier2, r.tier3, r.parts, external)


def test_a_sure_query_finds_its_class(corpus):
    flat = corpus.select(F.col("id").alias("vec_id"), F.col("tier2").alias("embedding"))
    graph = retrieval.similarity_graph(retrieval.nearest(flat, flat, 6))
    hits = search.adaptive_search(corpus, query(corpus, 5), 5, graph, {"head": 0.6, "tail": 0.4}).orderBy("rank").collect()
    assert [h["rank"] for h in hits] == [1, 2, 3, 4, 5] and {h.label for h in hits} == {1}


def test_an_unsure_outsider_is_ranked_by_tier_two(corpus):
    q = search.Query([0.1] * 4, [1.0] * 12, [0.3] * 4, None, True)
    hits = search.adaptive_search(corpus, q, 3).orderBy("rank").collect()
    top = retrieval.top_k(corpus, q.tier2, 3, "id", "tier2").orderBy("rank").collect()
    assert [h.id for h in hits] == [t.id for t in top]


def test_a_table_of_queries_gives_each_one_s_rows(spark, corpus):
    """Sure and unsure queries, with and without parts and from outside, searched together as alone."""
    graph = retrieval.similarity_graph(retrieval.nearest(corpus, corpus, 6, "id", "tier2"))
    own = corpus.filter("id in (3, 5, 40)").select(F.col("id").alias("query"), "tier1", "tier2", "tier3", "parts", (F.col("id") == 5).alias("external"))
    odd = spark.createDataFrame([(1000, [0.1] * 4, [1.0] * 12, [0.3] * 4, None, True), (1001, [0.1] * 4, [1.0] * 12, [0.3] * 4, None, None)], own.schema)
    table = own.unionByName(odd)
    got = search.search_table(corpus, table, 6, graph, {"head": 0.6, "tail": 0.4}).collect()
    assert len(got) == 5 * 6
    for r in table.collect():
        alone = search.adaptive_search(corpus, search.Query(r.tier1, r.tier2, r.tier3, r.parts, bool(r.external)), 6, graph, {"head": 0.6, "tail": 0.4})
        assert sorted((x["rank"], x.id, x.label, round(x.fused, 9)) for x in got if x.query == r.query) == sorted((x["rank"], x.id, x.label, round(x.fused, 9)) for x in alone.collect())


def test_first_species(spark, corpus):
    hits = search.adaptive_search(corpus, query(corpus, 2), 5)
    names = spark.createDataFrame([(2, "Groove_Billed_Ani"), (1, "Other")], "label int, name string")
    assert search.species_rank(hits, names, "groove").first()["rank"] == 1
    assert search.species_rank(hits, names, "absent").count() == 0


def test_grid(corpus):
    tiers = corpus.select("id", "label", F.col("tier1").alias("t1"), F.col("tier2").alias("t2"), F.col("tier3").alias("t3"))
    runs = tuning.grid(tiers, dims=(0, 4), hu=(1.0, 2.0), first=(0.5,), hu_places=(1, 2)).collect()
    assert len(runs) == 5 and sum(r.best for r in runs) == 1 and max(r.mean_ap for r in runs) == pytest.approx(next(r.mean_ap for r in runs if r.best))


def test_registered_grid_is_whole(spark):
    """All 60 runs and the baseline, against brute force."""
    data = "/root/testdata/sf0.001"
    got = {(r.pca_dim, r.hu_weight, r.tier1_weight): r for r in catalog.QUERIES["weight_grid"](spark, data).collect()}
    e = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, label, ids = np.stack(e["embedding"]).astype(float), e["label"].to_numpy(), e["vec_id"].to_numpy()
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd < 1e-8, 1, sd)
    grid = [(0, 1.0, 1.0), *itertools.product((4, 6, 8), (1.0, 1.25, 1.5, 1.75), (2.0, 2.5, 3.0, 3.5, 4.0))]
    assert set(got) == set(grid) and len(got) == 61
    want = {}
    for d, h, w in grid:
        a, b = z[:, :16] * w, z[:, 16:48]
        a[:, 2:5] *= h
        v = np.concatenate([a, fitting.pca_of(b, d).apply(b) if d else b, z[:, 48:]], axis=1)
        v = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)
        s = v @ v.T
        np.fill_diagonal(s, -1)
        aps = []
        for i in np.flatnonzero(ids % 100 == 0):
            at = np.flatnonzero(label[np.lexsort((ids, -s[i]))] == label[i])
            aps.append(np.mean(np.arange(1, len(at) + 1) / (at + 1)))
        want[d, h, w] = np.mean(aps)
    assert all(got[k].mean_ap == pytest.approx(want[k], abs=1e-6) for k in grid)
    assert [k for k in grid if got[k].best] == [max(grid, key=lambda k: got[k].mean_ap)]


def test_component_association(corpus):
    df = corpus.select(F.get("tier2", 0).alias("a"), F.lit(1.0).alias("constant"), "tier2")
    rows = {r.attribute: r for r in tuning.component_association(df, ["a", "constant"], "tier2", 3).collect()}
    assert rows["constant"].max_abs == 0 and 0.5 < rows["a"].max_abs <= 1 + 1e-9


def test_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, 64, 64, rng.integers(0, 256, (64, 64, 3)).astype(np.uint8).tobytes()) for i in range(6)]
    images = spark.createDataFrame(rows, "img_id int, height int, width int, rgb binary")
    model = fitting.fit_tier2(images, {k: (0, 0, 40, 40) for k in K.PARTS}, SPEEDS["fast"], (4, 4, 4), 6, words=8, per_image=50, final_dim=4)
    fitting.save_tier2(spark, model, f"file://{tmp_path}/m")
    again = fitting.load_tier2(spark, f"file://{tmp_path}/m")
    r = K.Raster(np.frombuffer(rows[0][3], np.uint8).reshape(64, 64, 3))
    assert np.allclose(model.encode(r)[0], again.encode(r)[0]) and np.allclose(model.encode(r)[1], again.encode(r)[1])
