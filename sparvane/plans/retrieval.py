"""Queries over the embeddings: search, graphs, reranking, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval as V
from ..operators import vectors
from . import tuning
from .relational import _t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _e(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings")


def _queries(e):
    """The queries of all searches: every row whose id is divisible by 100, against all rows."""
    return e.filter(F.col("vec_id") % 100 == 0)


_Q = "(SELECT vec_id AS src, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0)"
_COS = "list_dot_product(embedding::DOUBLE[], q) / ((sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8) * (sqrt(list_dot_product(q, q)) + 1e-8))"
_TOP = f"SELECT src, vec_id, label, {_COS} AS s, row_number() OVER (PARTITION BY src ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings, {_Q}"


@query(f"SELECT src, vec_id, label, round(s, 6) AS score, rank::INTEGER AS rank FROM ({_TOP}) WHERE rank <= 25")
def vector_topk_cosine(spark, sf_dir):
    """V2, O2, J10, J12, V20, V21."""
    e = _e(spark, sf_dir)
    hits = V.nearest(_queries(e), e, 25).withColumnRenamed("dst", "vec_id")
    return V.with_metadata(hits, e.select("vec_id", "label")).select("src", "vec_id", "label", F.round("score", 6).alias("score"), "rank")


@query(f"""SELECT src, vec_id, round(d, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, vec_id) AS rank FROM (SELECT src, vec_id, list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]) ** 2)) AS d
FROM embeddings, {_Q})) WHERE rank <= 25""")
def vector_topk_l2(spark, sf_dir):
    """V3: squared distances."""
    e = _e(spark, sf_dir)
    return V.nearest(_queries(e), e, 25, metric="l2").select("src", F.col("dst").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("""SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(embedding[i]::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8), 6) AS x FROM embeddings, range(1, 65) r(i)""")
def vector_l2_normalize(spark, sf_dir):
    """V1."""
    n = _e(spark, sf_dir).select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("v"))
    return n.select("vec_id", F.posexplode("v").alias("pos", "x")).withColumn("x", F.round("x", 6))


_PROTO = """SELECT label, list(m ORDER BY i) AS p, any_value(n) AS n FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m, count(*) AS n FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label"""


@query(f"""SELECT label, n, CAST(i - 1 AS INTEGER) AS pos, round(p[i] / (sqrt(list_dot_product(p, p)) + 1e-8), 6) AS x FROM ({_PROTO}), range(1, 65) r(i)""")
def class_prototypes(spark, sf_dir):
    """A16."""
    p = V.prototypes(_e(spark, sf_dir))
    return p.select("label", "n", F.posexplode("prototype").alias("pos", "x")).withColumn("x", F.round("x", 6))


_UNIT_PROTO = f"(SELECT label, list_transform(p, lambda x: x / (sqrt(list_dot_product(p, p)) + 1e-8)) AS p FROM ({_PROTO}))"
_PROTO_TOP = f"SELECT src, label, list_dot_product(p, q) / ((sqrt(list_dot_product(p, p)) + 1e-8) * (sqrt(list_dot_product(q, q)) + 1e-8)) AS s FROM {_UNIT_PROTO}, {_Q}"


@query(f"""SELECT src, label, round(s, 6) AS score, row_number() OVER (PARTITION BY src ORDER BY s DESC, label)::INTEGER AS rank, round(s - lead(s) OVER (PARTITION BY src ORDER BY s DESC, label), 6) AS margin FROM ({_PROTO_TOP})""")
def prototype_scores(spark, sf_dir):
    """J14, V14, W4."""
    e = _e(spark, sf_dir)
    s = V.prototype_scores(V.prototypes(e), _queries(e))
    return s.select("src", "label", F.round("score", 6).alias("score"), "rank", F.round("margin", 6).alias("margin"))


_KNN = """SELECT src, dst, s, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rank FROM (SELECT a.vec_id AS src, b.vec_id AS dst,
 list_dot_product(a.u, b.u) AS s FROM n a, n b)"""
_UNIT = """n AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8)) AS u FROM embeddings)"""


@query(f"WITH {_UNIT} SELECT src, dst, round(s, 5) AS score, rank::INTEGER AS rank FROM ({_KNN}) WHERE rank <= 25")
def knn_per_item(spark, sf_dir):
    """25 neighbours of every row, itself included."""
    e = _e(spark, sf_dir)
    return V.nearest(e, e, 25).select("src", "dst", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {_UNIT} SELECT src, dst, round(s, 5) AS score, rank::INTEGER AS rank FROM ({_KNN}) WHERE rank <= 25")
def knn_pruned(spark, sf_dir):
    """The same 25 neighbours, with cells that can't hold one left out of the comparison."""
    e = _e(spark, sf_dir)
    return V.nearest_pruned(e, e, 25).select("src", "dst", F.round("score", 5).alias("score"), "rank")


_GRAPH = f"""k AS (SELECT src, dst, greatest(s, 0) AS w FROM ({_KNN}) WHERE rank <= 25), b AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM k UNION ALL SELECT dst, src, w FROM k) GROUP BY 1, 2),
g AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM b)"""


@query(f"WITH {_UNIT}, {_GRAPH} SELECT src, dst, round(w, 6) AS w FROM g")
def knn_graph(spark, sf_dir):
    """V9."""
    e = _e(spark, sf_dir)
    return V.similarity_graph(V.nearest(e, e, 25)).withColumn("w", F.round("w", 6))


@query(f"""WITH {_UNIT}, {_GRAPH}, s AS (SELECT src, vec_id AS id, s AS score FROM ({_TOP}) WHERE rank <= 50),
p AS (SELECT t.src, g.src AS id, sum(g.w * t.score) AS x FROM g JOIN s t ON g.dst = t.id GROUP BY 1, 2)
SELECT src, id, round(0.75 * score + 0.25 * coalesce(x, 0), 6) AS score FROM s LEFT JOIN p USING (src, id)""")
def graph_diffusion(spark, sf_dir):
    """V10."""
    e = _e(spark, sf_dir)
    seeds = V.nearest(_queries(e), e, 50).select("src", F.col("dst").alias("id"), "score")
    return V.diffuse(V.similarity_graph(V.nearest(e, e, 25)), seeds.withColumnRenamed("src", "query"), by=["query"]).select(F.col("query").alias("src"), "id", F.round("score", 6).alias("score"))


_EXP = f"""h AS (SELECT src, q, embedding::DOUBLE[] AS v FROM embeddings JOIN ({_TOP}) t USING (vec_id) JOIN {_Q} USING (src) WHERE rank <= 5),
m AS (SELECT src, i, 0.6 * any_value(q[i]) + 0.4 * avg(v[i]) AS x FROM h, range(1, 65) r(i) GROUP BY src, i), x AS (SELECT src, list(x ORDER BY i) AS q FROM m GROUP BY src)"""


@query(f"""WITH {_EXP} SELECT src, vec_id, round(s, 6) AS score, rank::INTEGER AS rank FROM (SELECT src, vec_id, {_COS} AS s, row_number() OVER (PARTITION BY src ORDER BY {_COS} DESC, vec_id) AS rank FROM embeddings, x) WHERE rank <= 25""")
def query_expansion(spark, sf_dir):
    """V8: search again with the mean of the first five hits mixed in."""
    e = _e(spark, sf_dir)
    q = _queries(e)
    wider = V.expand_queries(q, e, V.nearest(q, e, 20))
    return V.nearest(wider, e, 25).select("src", F.col("dst").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


_TIERS = "list_slice({v}, 1, 16) AS a{n}, list_slice({v}, 17, 48) AS b{n}, list_slice({v}, 49, 64) AS c{n}"
_TC = "list_dot_product({x}1, {x}2) / ((sqrt(list_dot_product({x}1, {x}1)) + 1e-8) * (sqrt(list_dot_product({x}2, {x}2)) + 1e-8)) AS {t}"
_SCALED = "coalesce(({t} - min({t}) OVER (PARTITION BY src)) / nullif(max({t}) OVER (PARTITION BY src) - min({t}) OVER (PARTITION BY src), 0), 0.5) AS {n}"
_CAND = f"""c AS (SELECT src, vec_id AS id, label, {_TC.format(x='a', t='t1')}, {_TC.format(x='b', t='t2')}, {_TC.format(x='c', t='t3')} FROM
 (SELECT t.src, vec_id, e.label, {_TIERS.format(v='embedding::DOUBLE[]', n=1)} FROM embeddings e JOIN ({_TOP}) t USING (vec_id) WHERE t.rank <= 120) JOIN (SELECT src, {_TIERS.format(v='q', n=2)} FROM {_Q}) USING (src)),
s AS (SELECT src, id, label, t2, {', '.join(_SCALED.format(t=f't{i}', n=f'n{i}') for i in (1, 2, 3))} FROM c)"""


def _tiers(v):
    parts = {"t1": (1, 16), "t2": (17, 32), "t3": (49, 16)}
    return {k: F.slice(v, a, n) for k, (a, n) in parts.items()}


def _candidates(e, hits):
    """Cosines of three slices for each hit (src, dst)."""
    own = e.select(F.col("vec_id").alias("dst"), "label", F.col("embedding").alias("_v"))
    query = _queries(e).select(F.col("vec_id").alias("src"), F.col("embedding").alias("_q"))
    scores = {t: vectors.cosine(part, _tiers(F.col("_q"))[t]) for t, part in _tiers(F.col("_v")).items()}
    return hits.select("src", "dst").join(own, "dst").join(query, "src").select("src", F.col("dst").alias("id"), "label", *[c.alias(t) for t, c in scores.items()])


@query(f"""WITH {_CAND} SELECT src, id, round(0.15 * n1 + 0.70 * n2 + 0.15 * n3, 6) AS fused, row_number() OVER (PARTITION BY src ORDER BY 0.15 * n1 + 0.70 * n2 + 0.15 * n3 DESC, t2 DESC, id)::INTEGER AS rank FROM s""")
def minmax_rerank(spark, sf_dir):
    """W7, V12, O4 with fixed weights."""
    e = _e(spark, sf_dir)
    hits = V.nearest(_queries(e), e, 120)
    return V.rerank(_candidates(e, hits), group=["src"], adaptive=False).select("src", "id", F.round("fused", 6).alias("fused"), "rank")


_SURE = f"""pt AS ({_PROTO_TOP}),
best AS (SELECT * FROM (SELECT src, label AS bl, s AS bs, s - lead(s) OVER w AS bm, row_number() OVER w AS r FROM pt WINDOW w AS (PARTITION BY src ORDER BY s DESC, label)) WHERE r = 1),
sure AS (SELECT src, s < 0.80 OR s - coalesce(n, 0) < 0.03 AS low FROM (SELECT src, s, rank, lead(s) OVER (PARTITION BY src ORDER BY rank) AS n FROM ({_TOP}) WHERE rank <= 20) WHERE rank = 1)"""


@query(f"""WITH {_CAND}, {_SURE}, f AS (SELECT src, id, t2, CASE WHEN low THEN n2 WHEN bs >= 0.70 AND bm >= 0.02 AND label = bl THEN 0.25 * n1 + 0.62 * n2 + 0.13 * n3 ELSE 0.15 * n1 + 0.70 * n2 + 0.15 * n3 END AS fused FROM s JOIN best USING (src) JOIN sure USING (src))
SELECT src, id, round(fused, 6) AS fused, row_number() OVER (PARTITION BY src ORDER BY fused DESC, t2 DESC, id)::INTEGER AS rank FROM f""")
def adaptive_rerank(spark, sf_dir):
    """Weights that follow the first hits' confidence and the best prototype's score and lead."""
    e = _e(spark, sf_dir)
    hits = V.nearest(_queries(e), e, 120)
    sure = V.confidence(hits.filter(F.col("rank") <= 20), by=["src"]).select("src", "low")
    best = V.prototype_scores(V.prototypes(e), _queries(e)).filter("rank = 1").select("src", F.col("label").alias("_label"), F.col("score").alias("_score"), F.col("margin").alias("_margin"))
    known = _candidates(e, hits).join(sure, "src", "left").join(best, "src", "left")
    out = V.rerank(known, V.rerank_weights((0.15, 0.70, 0.15)), ["src"], F.col("low"), F.col("_label"), F.col("_score"), F.col("_margin"))
    return out.select("src", "id", F.round("fused", 6).alias("fused"), "rank")


@query(f"""SELECT src, round(s, 6) AS top1, round(s - n, 6) AS gap, s < 0.80 OR s - n < 0.03 AS low, s < 0.80 OR s - n < 0.03 AS risk FROM (SELECT src, s, lead(s) OVER (PARTITION BY src ORDER BY rank) AS n, rank FROM ({_TOP}) WHERE rank <= 20) WHERE rank = 1""")
def confidence_flags(spark, sf_dir):
    """V13."""
    e = _e(spark, sf_dir)
    c = V.confidence(V.nearest(_queries(e), e, 20), external=True, by=["src"])
    return c.withColumn("top1", F.round("top1", 6)).withColumn("gap", F.round("gap", 6))


@query(f"""WITH s AS (SELECT src, vec_id, s AS score FROM ({_TOP}) WHERE rank <= 30),
d AS (SELECT src, vec_id, 1.2 * sqrt(list_sum(list_transform(range(1, 17), lambda i: (embedding[i]::DOUBLE - q[i]) ** 2))) + 1.0 * sqrt(list_sum(list_transform(range(17, 33), lambda i: (embedding[i]::DOUBLE - q[i]) ** 2))) AS d FROM embeddings, {_Q})
SELECT src, vec_id AS id, round(0.7 * score + 0.3 / (1 + d), 6) AS score FROM s JOIN d USING (src, vec_id)""")
def part_adjustment(spark, sf_dir):
    """Named parts (here two slices of the vector) moderate a score."""
    e = _e(spark, sf_dir)
    items = V.nearest(_queries(e), e, 30).select("src", F.col("dst").alias("id"), "score")
    parts = F.explode(F.array(F.struct(F.lit("head").alias("part"), F.slice("embedding", 1, 16).alias("vec")), F.struct(F.lit("wing").alias("part"), F.slice("embedding", 17, 16).alias("vec"))))
    corpus = e.select(F.col("vec_id").alias("id"), parts.alias("p")).select("id", "p.part", "p.vec")
    own = _queries(e).select(F.col("vec_id").alias("src"), parts.alias("p")).select("src", "p.part", "p.vec")
    return V.part_adjust(items, own, corpus, {"head": 1.2, "wing": 1.0}, by=["src"]).withColumn("score", F.round("score", 6))


_RANK = """SELECT src, rel, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rank FROM (SELECT a.vec_id AS src, b.vec_id AS dst, CASE WHEN a.vec_id = b.vec_id THEN -1.0 ELSE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END AS s, (a.label = b.label)::INTEGER AS rel FROM embeddings a, embeddings b)"""
_AP = f"""SELECT src, max(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS hit_1, max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS hit_5, max(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS hit_10, avg(hits / rank) FILTER (rel = 1) AS ap
FROM (SELECT *, sum(rel) OVER (PARTITION BY src ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits FROM ({_RANK})) GROUP BY src"""


@query(f"SELECT src, hit_1, hit_5, hit_10, round(ap, 6) AS ap FROM ({_AP})")
def average_precision(spark, sf_dir):
    """Per query."""
    e = _e(spark, sf_dir)
    return V.evaluate(e, e).withColumn("ap", F.round("ap", 6))


@query(f"SELECT round(avg(hit_1), 6) AS recall_at_1, round(avg(hit_5), 6) AS recall_at_5, round(avg(hit_10), 6) AS recall_at_10, round(avg(ap), 6) AS mean_ap FROM ({_AP})")
def recall_map(spark, sf_dir):
    """The summary."""
    e = _e(spark, sf_dir)
    s = V.summary(V.evaluate(e, e))
    return s.withColumns({c: F.round(c, 6) for c in s.columns})


@query("""SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CASE WHEN i <= 16 THEN embedding[i]::DOUBLE * 0.5 * CASE WHEN i IN (3, 4, 5) THEN 2.0 ELSE 1.0 END ELSE embedding[i]::DOUBLE * 1.5 END, 6) AS x FROM embeddings, range(1, 65) r(i)""")
def weighted_fusion(spark, sf_dir):
    """Weighted blocks joined end to end, three named places boosted."""
    e = _e(spark, sf_dir).select("vec_id", F.slice("embedding", 1, 16).alias("a"), F.slice("embedding", 17, 48).alias("b"))
    v = V.boost(V.fuse({"a": 0.5, "b": 1.5}), [2, 3, 4], 2.0)
    return e.select("vec_id", F.posexplode(v).alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("""SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(sign(embedding[i]) * sqrt(abs(embedding[i]::DOUBLE) + 1e-8), 6) AS power, round(sqrt(greatest(embedding[i]::DOUBLE, 0) / (list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))) + 1e-8)), 6) AS root FROM embeddings, range(1, 65) r(i)""")
def power_root_norm(spark, sf_dir):
    """V17."""
    e = _e(spark, sf_dir)
    v = e.select("vec_id", F.arrays_zip(V.power_norm(F.col("embedding")).alias("p"), V.root_norm(F.col("embedding")).alias("r")).alias("z"))
    return v.select("vec_id", F.posexplode("z").alias("pos", "z")).select("vec_id", "pos", F.round(F.col("z")["p"], 6).alias("power"), F.round(F.col("z")["r"], 6).alias("root"))


def weight_tuning(spark, sf_dir):
    """Recall@K and mAP over three weights of one block; `weight_grid` has all axes of M8."""
    e = _e(spark, sf_dir).select("vec_id", "label", F.slice("embedding", 1, 16).alias("a"), F.slice("embedding", 17, 48).alias("b"))
    grid = [(x, 1.0) for x in (0.5, 1.0, 2.0)]
    t = V.tune(e, ["a", "b"], grid)
    return t.withColumns({c: F.round(c, 6) for c in t.columns if c.startswith(("recall", "mean"))})


QUERIES["weight_tuning"] = weight_tuning
_RUN = """SELECT {i} AS run, '{n}' AS weights, round(avg(hit_1), 6) AS recall_at_1, round(avg(hit_5), 6) AS recall_at_5, round(avg(hit_10), 6) AS recall_at_10, round(avg(ap), 6) AS mean_ap FROM ({ap})"""


def _tune_sql() -> str:
    runs = []
    for i, (w, n) in enumerate(((0.5, "0.5,1"), (1.0, "1,1"), (2.0, "2,1"))):
        vec = f"(SELECT vec_id, label, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * CASE WHEN i <= 16 THEN {w} ELSE 1.0 END) AS f FROM embeddings)"
        unit = f"(SELECT vec_id, label, list_transform(f, lambda x: x / (sqrt(list_dot_product(f, f)) + 1e-8)) AS embedding FROM {vec})"
        runs.append(_RUN.format(i=i, n=n, ap=_AP.replace("embeddings a, embeddings b", f"{unit} a, {unit} b")))
    return f"SELECT *, row_number() OVER (ORDER BY mean_ap DESC, run) = 1 AS best FROM ({' UNION ALL '.join(runs)})"


SQL["weight_tuning"] = _tune_sql()


def weight_grid(spark, sf_dir):
    """M8: the reference's 3 x 4 x 5 runs and the baseline; three slices as tiers, PCA to an eighth, 3/16 and a quarter of tier 2 (64, 96, 128 of 512)."""
    tiers = _e(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.slice("embedding", 1, 16).alias("t1"), F.slice("embedding", 17, 32).alias("t2"), F.slice("embedding", 49, 16).alias("t3"))
    return tuning.grid(tiers, (4, 6, 8), (1.0, 1.25, 1.5, 1.75), (2.0, 2.5, 3.0, 3.5, 4.0), [2, 3, 4], asked=F.col("id") % 100 == 0)


QUERIES["weight_grid"] = weight_grid


@query("""SELECT label, n, margin_rank::INTEGER AS margin_rank FROM (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS margin_rank FROM embeddings GROUP BY 1)""")
def class_sizes(spark, sf_dir):
    """W1 over classes."""
    g = _e(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("margin_rank", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
