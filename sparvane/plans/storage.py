"""Queries that write a table in some form and read it back, and queries over fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fitting, retrieval, stages, store
from ..shared import shared_path
from ..sources import annotations, tables
from .relational import _t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    """CSV with a header, read by an explicit schema."""
    path = shared_path(spark, "csv")
    tables.write_csv(_t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return tables.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT l_orderkey AS img_id, l_linenumber AS part_id, l_quantity AS x FROM lineitem")
def delimited_scan(spark, sf_dir):
    """Space-separated, no header; a column that nobody asks for is not parsed."""
    path = shared_path(spark, "delimited")
    _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax").write.option("sep", " ").csv(path)
    return annotations.scan(spark, path, "img_id long, part_id int, x double, y double").select("img_id", "part_id", "x")


@query("SELECT r_regionkey, r_name FROM region")
def json_round_trip(spark, sf_dir):
    """K2."""
    path = shared_path(spark, "json")
    tables.write_json(_t(spark, sf_dir, "region"), path)
    return spark.read.schema("r_regionkey int, r_name string").json(path)


@query("SELECT vec_id, label, len(embedding)::INTEGER AS dim, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vector_round_trip(spark, sf_dir):
    """A vector table, found as the first of several candidates."""
    path = shared_path(spark, "vectors")
    tables.write_vectors(_t(spark, sf_dir, "embeddings"), path)
    v = tables.read_vectors(spark, [f"{path}-absent", path])
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", "label", F.size("embedding").alias("dim"), F.round(total, 5).alias("total"))


@query("""SELECT vec_id::INTEGER AS id, format('{:05d}_{}.jpg', vec_id, label) AS filename, label AS species_id, '[' || label || ',' || (label % 2) || ']' AS attributes, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings""")
def search_store(spark, sf_dir):
    """The store's rows in index order."""
    e = _t(spark, sf_dir, "embeddings").withColumn("img_id", F.col("vec_id").cast("int"))
    meta = e.select("img_id", F.format_string("%05d_%d.jpg", "img_id", "label").alias("filename"), F.col("label").alias("class_id"), F.col("label").cast("string").alias("class_name"))
    attrs = e.select("img_id", F.col("label").alias("attr_1"), (F.col("label") % 2).alias("attr_2"))
    return store.build_store(meta, attrs, e.select("img_id", "embedding"), shared_path(spark, "store")).select("id", "filename", "species_id", "attributes", "idx")


@query("""WITH p AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
u AS (SELECT label, list_transform(c, lambda x: x / (sqrt(list_dot_product(c, c)) + 1e-8)) AS c FROM p)
SELECT vec_id, arg_min(u.label, list_sum(list_transform(list_zip(e.embedding, u.c), lambda z: (z[1]::DOUBLE - z[2]) ** 2))) AS word FROM embeddings e, u GROUP BY vec_id""")
def nearest_codeword(spark, sf_dir):
    """Each vector's nearest centre, by a join with the table of centres."""
    e = _t(spark, sf_dir, "embeddings")
    near = retrieval.nearest(e, retrieval.prototypes(e), 1, metric="l2", corpus_key="label", corpus_vec="prototype")
    return near.select(F.col("src").alias("vec_id"), F.col("dst").alias("word"))


@query("""WITH b AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, row_number() OVER (ORDER BY s_suppkey) - 1 AS idx FROM supplier WHERE s_nationkey < 16),
u AS (SELECT s_suppkey AS id, s_name || '*' AS name, -s_acctbal AS balance FROM supplier WHERE s_nationkey >= 12),
f AS (SELECT id, (SELECT count(*) FROM b) + row_number() OVER (ORDER BY id) - 1 AS idx FROM u WHERE id NOT IN (SELECT id FROM b))
SELECT id, name, balance, idx FROM b WHERE id NOT IN (SELECT id FROM u) AND id % 7 <> 0 UNION ALL SELECT u.id, u.name, u.balance, coalesce(b.idx, f.idx) AS idx FROM u LEFT JOIN b USING (id) LEFT JOIN f USING (id)""")
def store_changes(spark, sf_dir):
    """A store of suppliers, then a snapshot with some of them changed, some added and some deleted; indices stay."""
    supplier = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), "s_nationkey")
    own = store.Store(spark, shared_path(spark, "suppliers"))
    own.create(supplier.filter("s_nationkey < 16").drop("s_nationkey"), 4)
    later = supplier.filter("s_nationkey >= 12")
    gone = supplier.filter("id % 7 = 0").join(later, "id", "left_anti")
    own.change(later.select("id", F.concat("name", F.lit("*")).alias("name"), (-F.col("balance")).alias("balance")), gone)
    return own.read()


_STAGES = [stages.Stage("read", begins="STEP 1:"), stages.Stage("fit", begins="STEP 2:", done="[OK] saved", ends=("read",)), stages.Stage("encode", advances="Tier 1 -")]
_STAGE_SQL = """WITH u AS (SELECT user_id AS run, event_id AS line_no, event_id * 1000 AS o, 'read' AS stage, CASE WHEN event_type = 'view' THEN 'begin' ELSE 'done' END AS kind, NULL::DOUBLE AS p, NULL::BIGINT AS done FROM events WHERE event_type IN ('view', 'signup')
  UNION ALL SELECT user_id, event_id, event_id * 1000 + 1, 'fit', 'begin', NULL, NULL FROM events WHERE event_type = 'signup'
  UNION ALL SELECT user_id, event_id, event_id * 1000, 'fit', 'done', NULL, NULL FROM events WHERE event_type = 'purchase' AND value <= 60
  UNION ALL SELECT user_id, event_id, event_id * 1000, 'encode', CASE WHEN event_id % 101 = 100 THEN 'done' ELSE 'running' END, event_id % 101, event_id % 50 FROM events WHERE event_type = 'click'),
m AS (SELECT run, line_no, o, stage FROM u WHERE kind = 'begin' UNION ALL SELECT user_id, event_id, event_id * 1000 + 100, NULL FROM events WHERE event_type = 'error' AND value > 40),
f AS (SELECT run, line_no, o, now AS stage, 'fail' AS kind, NULL::DOUBLE AS p, NULL::BIGINT AS done FROM (SELECT *, last_value(stage IGNORE NULLS) OVER (PARTITION BY run ORDER BY o) AS now FROM m) WHERE stage IS NULL AND now IS NOT NULL),
g AS (SELECT run, stage, arg_max(kind, o) AS kind, max(o) AS last, arg_max(coalesce(p, CASE WHEN kind = 'done' THEN 100 END), o) FILTER (p IS NOT NULL OR kind = 'done') AS p, min(line_no) AS started, arg_max(done, o) FILTER (done IS NOT NULL) AS done
  FROM (SELECT * FROM u UNION ALL SELECT * FROM f) GROUP BY run, stage),
e AS (SELECT user_id AS run, max(event_id) AS line_no FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY 1),
x AS (SELECT r.run, s.stage, g.*, e.line_no AS closed_at, e.line_no IS NOT NULL AND (g.last IS NULL OR (e.line_no * 1000 > g.last AND g.kind NOT IN ('fail', 'done'))) AS closed
  FROM (SELECT DISTINCT user_id AS run FROM events) r CROSS JOIN (SELECT unnest(['read', 'fit', 'encode']) AS stage) s LEFT JOIN g ON g.run = r.run AND g.stage = s.stage LEFT JOIN e ON e.run = r.run)
SELECT run, stage, CASE WHEN closed OR kind = 'done' THEN 'done' WHEN kind IS NULL THEN 'pending' WHEN kind = 'fail' THEN 'error' ELSE 'running' END AS status,
  CASE WHEN closed THEN 100.0 ELSE coalesce(p, CASE WHEN kind IS NOT NULL THEN 5.0 END, 0.0) END::DOUBLE AS percent, started, CASE WHEN closed THEN closed_at WHEN kind IN ('done', 'fail') THEN last // 1000 END AS ended, done FROM x"""


@query(_STAGE_SQL)
def stage_intervals(spark, sf_dir):
    """log lines made from the events, a run for each user; the state of each run's stages after them."""
    e, kind, n = _t(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    bar = F.concat(F.lit("Tier 1 - encode: "), (n % 101).cast("string"), F.lit("%|##| "), (n % 50).cast("string"), F.lit("/50 [00:08<00:12, 3.5it/s]"))
    line = F.when(kind == "view", F.lit("STEP 1: read")).when(kind == "signup", F.lit("STEP 2: fit")).when(kind == "click", bar)
    line = line.when((kind == "purchase") & (F.col("value") > 60), F.lit("ALL DONE")).when(kind == "purchase", F.lit("[OK] saved 9"))
    line = line.when((kind == "error") & (F.col("value") > 40), F.lit("Traceback (most recent call last):")).otherwise(F.lit("noise"))
    lines = e.select(F.col("user_id").alias("run"), n.alias("at"), line.alias("line"))
    return stages.track(lines, _STAGES, "ALL DONE", "Traceback (most recent call last):").select("run", "stage", "status", "percent", "started", "ended", "done")


@query(None)
def pca_projection(spark, sf_dir):
    """V5: 16 components from partial sums over all rows."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return fitting.apply_pca(e, "embedding", fitting.fit_pca(e, "embedding", 16), "pca").select("vec_id", "pca")


@query(None)
def kmeans_codebook(spark, sf_dir):
    """M2, M7: 16 centres of all vectors."""
    centres = fitting.fit_codebook(_t(spark, sf_dir, "embeddings"), "embedding", 16)
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "word int, centre array<double>")


@query(None)
def diagonal_mixture(spark, sf_dir):
    """M3: EM to its tolerance, from k-means of all rows, with sums of bounded size from each task."""
    m = fitting.fit_mixture(_t(spark, sf_dir, "embeddings"), "embedding", 8)
    return spark.createDataFrame([(i, float(w), [float(x) for x in c]) for i, (w, c) in enumerate(zip(m.weights, m.means, strict=True))], "component int, weight double, mean array<double>")
