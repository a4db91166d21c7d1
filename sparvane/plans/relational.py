"""Queries over the relational fixtures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import relational as R

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS bbox_ratio, l_extendedprice * l_quantity AS bbox_area FROM lineitem""")
def geometry_ratio_area(spark, sf_dir):
    """Ratio and area; a zero denominator gives null."""
    li = _t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", R.ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("bbox_ratio"), (F.col("l_extendedprice") * F.col("l_quantity")).alias("bbox_area"))


@query("""SELECT p_partkey, p_name, coalesce(regexp_matches(p_type, '(?i)steel|brass|small'), false) AS hit FROM part""")
def regex_keyword_flag(spark, sf_dir):
    """Case-insensitive keyword match, null as false."""
    return _t(spark, sf_dir, "part").select("p_partkey", "p_name", T.matches_any(F.col("p_type"), ["steel", "brass", "small"]).alias("hit"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (1, 3, 5) AND l_returnflag IN ('A', 'R')""")
def isin_filter(spark, sf_dir):
    """P3."""
    return _t(spark, sf_dir, "lineitem").filter(F.col("l_linenumber").isin(1, 3, 5) & F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber")


_PARTS = """SELECT l_orderkey AS img_id,
  coalesce(bool_or(l_linenumber = 1), false) AS left_eye, coalesce(bool_or(l_linenumber = 3), false) AS right_eye,
  coalesce(bool_or(l_linenumber = 2), false) AS beak, coalesce(bool_or(l_linenumber IN (4, 5)), false) AS leg,
  max(l_extendedprice) FILTER (l_linenumber = 2) AS beak_x, max(l_extendedprice) FILTER (l_linenumber = 4) AS tail_x,
  arg_max(l_quantity, l_extendedprice) FILTER (l_linenumber = 4) AS leg_l, arg_max(l_quantity, l_extendedprice) FILTER (l_linenumber = 5) AS leg_r FROM lineitem GROUP BY l_orderkey"""


def _parts(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    flags = R.presence_flags(li.withColumnRenamed("l_orderkey", "img_id"), "img_id", {"left_eye": n == 1, "right_eye": n == 3, "beak": n == 2, "leg": n.isin(4, 5)})
    picks = {"beak_x": (n == 2, F.col("l_extendedprice")), "tail_x": (n == 4, F.col("l_extendedprice")), "leg_l": (n == 4, F.col("l_quantity")), "leg_r": (n == 5, F.col("l_quantity"))}
    points = R.last_value_per_key(li.withColumnRenamed("l_orderkey", "img_id"), "img_id", picks, "l_extendedprice")
    return flags.join(points, "img_id")


@query(f"""SELECT o_orderkey, coalesce(left_eye, false) AS left_eye, coalesce(right_eye, false) AS right_eye, coalesce(beak, false) AS beak, coalesce(leg, false) AS leg
FROM orders LEFT JOIN ({_PARTS}) ON o_orderkey = img_id""")
def semi_flag(spark, sf_dir):
    """Membership flags, all from one aggregate."""
    o, p = _t(spark, sf_dir, "orders"), _parts(spark, sf_dir)
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("left_eye", "right_eye", "beak", "leg")]
    return o.join(p, o.o_orderkey == p.img_id, "left").select("o_orderkey", *flags)


@query(f"""SELECT o_orderkey, CASE WHEN beak_x IS NOT NULL AND tail_x IS NOT NULL AND o_totalprice > 0 THEN abs(beak_x - tail_x) / o_totalprice ELSE -1.0::DOUBLE END AS dx,
  CASE WHEN coalesce(greatest(leg_l, leg_r), leg_l, leg_r) IS NOT NULL AND o_totalprice > 0 THEN (greatest(leg_l, leg_r) - 1.0::DOUBLE) / o_totalprice ELSE -1.0::DOUBLE END AS leg_y
FROM orders LEFT JOIN ({_PARTS}) ON o_orderkey = img_id""")
def sentinel_landmarks(spark, sf_dir):
    """Offsets between landmarks, -1 where one is missing; of duplicate landmarks the last wins."""
    o, p = _t(spark, sf_dir, "orders"), _parts(spark, sf_dir)
    dx = R.normalized_offset(F.col("beak_x"), F.col("tail_x"), F.col("o_totalprice"))
    leg = R.largest_offset([F.col("leg_l"), F.col("leg_r")], F.lit(1.0), F.col("o_totalprice"))
    return o.join(p, o.o_orderkey == p.img_id, "left").select("o_orderkey", dx.alias("dx"), leg.alias("leg_y"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey <= 1)""")
def anti_blocklist(spark, sf_dir):
    """Exclusion by a lookup table."""
    c = _t(spark, sf_dir, "customer")
    return R.exclude(c, "c_mktsegment", c.filter("c_custkey <= 1").select("c_mktsegment")).select("c_custkey", "c_name")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def semi_join_filter(spark, sf_dir):
    """J5."""
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    return R.keep(c, "c_nationkey", s.filter("s_acctbal > 5000").select("s_nationkey")).select("c_custkey")


@query("""SELECT p_partkey, coalesce(n, 0) AS n, coalesce(q, 0.0) AS q FROM part LEFT JOIN
(SELECT l_partkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON p_partkey = l_partkey""")
def reindex_fill(spark, sf_dir):
    """Every id, missing facts as zero."""
    li = _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return R.reindex(_t(spark, sf_dir, "part"), "p_partkey", li, {"n": 0, "q": 0.0})


@query("""SELECT count(*) AS n FROM (SELECT l_suppkey FROM lineitem INTERSECT SELECT s_suppkey FROM supplier INTERSECT SELECT c_custkey FROM customer)""")
def key_intersection(spark, sf_dir):
    """J9, U4."""
    a, b, c = _t(spark, sf_dir, "lineitem").select("l_suppkey"), _t(spark, sf_dir, "supplier").select("s_suppkey"), _t(spark, sf_dir, "customer").select("c_custkey")
    return a.intersect(b).intersect(c).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")
def stale_difference(spark, sf_dir):
    """What exists and is not expected."""
    return R.exclude(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", _t(spark, sf_dir, "orders").select("o_custkey"))


@query("""SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) GROUP BY 1""")
def union_chunks(spark, sf_dir):
    """U1, U2."""
    o = _t(spark, sf_dir, "orders")
    chunks = [o.filter(f"o_orderstatus {test}") for test in ("= 'F'", "= 'O'", "NOT IN ('F', 'O')")]
    return chunks[0].unionByName(chunks[1]).unionByName(chunks[2]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_nationkey, avg(CASE WHEN c_acctbal > 4500 THEN 1.0 ELSE 0.0 END) >= 0.5 AS majority FROM customer GROUP BY 1""")
def majority_flag(spark, sf_dir):
    """A4: at least half of a class."""
    return R.majority(_t(spark, sf_dir, "customer"), "c_nationkey", F.col("c_acctbal") > 4500)


@query("""SELECT l_orderkey, l_linenumber, CAST(l_discount >= 0.05 AS DOUBLE) AS present, round_even(l_tax * l_quantity, 4) AS r4, 224 AS target_width FROM lineitem""")
def binarise_round_const(spark, sf_dir):
    """Threshold, rounding half to even at four digits, a constant column."""
    li = _t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_discount") >= 0.05).cast("double").alias("present"), F.bround(F.col("l_tax") * F.col("l_quantity"), 4).alias("r4"), F.lit(224).alias("target_width"))


@query("""SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 100""")
def nsmallest(spark, sf_dir):
    """O1, P14."""
    return R.smallest(_t(spark, sf_dir, "part"), "p_retailprice", "p_partkey", 100).select("p_partkey", "p_retailprice")


@query("""SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey::VARCHAR), c_custkey LIMIT 50""")
def seeded_sample(spark, sf_dir):
    """A sample by hash order."""
    return R.sample_rows(_t(spark, sf_dir, "customer"), "c_custkey", 50).select("c_custkey")


@query("""WITH n AS (SELECT *, count(*) OVER () AS total, count(*) OVER (PARTITION BY c_mktsegment) AS k, md5('42:' || c_custkey::VARCHAR) AS h FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) AS r FROM n)
SELECT c_custkey, c_mktsegment FROM (SELECT * FROM r WHERE r <= greatest(1, round_even((100.0::DOUBLE / total) * k, 0)) OR total <= 100 ORDER BY h, c_custkey) ORDER BY h, c_custkey LIMIT (SELECT CASE WHEN count(*) <= 100 THEN count(*) ELSE 100 END FROM customer)""")
def stratified_sample(spark, sf_dir):
    """O7."""
    return R.stratified_sample(_t(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 100).select("c_custkey", "c_mktsegment")


@query("""SELECT CAST(count(*) AS BIGINT) AS n_groups, round(avg(n), 6) AS mean_size, min(n) AS min_size, max(n) AS max_size FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)""")
def two_level_agg(spark, sf_dir):
    """A2."""
    return R.two_level(_t(spark, sf_dir, "orders"), "o_custkey").withColumn("mean_size", F.round("mean_size", 6))


@query("""SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_cust, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_f, sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END)::BIGINT AS n_not FROM orders""")
def dataset_counts(spark, sf_dir):
    """A1."""
    return _t(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_cust"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"), F.count_if(F.col("o_orderstatus") != "F").alias("n_not"))


@query("""SELECT o_orderpriority, n, row_number() OVER (ORDER BY n DESC, o_orderpriority)::INTEGER AS rank FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def group_sizes_ranked(spark, sf_dir):
    """Sizes, largest first, with their rank."""
    g = _t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "o_orderpriority")))


@query("""SELECT DISTINCT l_shipdate::DATE AS day, l_returnflag FROM lineitem""")
def drop_duplicates(spark, sf_dir):
    """A21."""
    return _t(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), "l_returnflag").dropDuplicates()


@query("""SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS idx FROM customer""")
def dense_position(spark, sf_dir):
    """Gapless positions from per-partition counts."""
    return R.dense_ids(_t(spark, sf_dir, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"]).select("c_custkey", "idx")


@query("""SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS diff FROM events""")
def consecutive_difference(spark, sf_dir):
    """W6."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf_dir, "events").select("event_id", "user_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("diff"))


@query("""SELECT c_mktsegment, min(rank) AS rank, arg_min(c_name, rank) AS name FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE contains(lower(c_name), '7') GROUP BY 1""")
def first_match_rank(spark, sf_dir):
    """The best-ranked row whose name holds a keyword, by group."""
    c = _t(spark, sf_dir, "customer")
    ranked = R.dense_ids(c.withColumn("_neg", -F.col("c_acctbal")).select("_neg", "c_custkey", "c_name", "c_mktsegment"), ["_neg", "c_custkey"], "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.filter(T.contains_fold(F.col("c_name"), "7")).groupBy("c_mktsegment").agg(F.min("rank").alias("rank"), F.min_by("c_name", "rank").alias("name"))


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 48)""")
def top_by_score(spark, sf_dir):
    """A sorted top slice."""
    return _t(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(48)


@query("""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'attr') AS slug,
  printf('attr_%03d__%s', p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'attr')) AS label,
  printf('%05d_%s', p_partkey, p_name) AS filename, split_part(p_type, ' ', -1) AS last_word FROM part""")
def slug_and_names(spark, sf_dir):
    """F1, F2, F4, P10."""
    part = _t(spark, sf_dir, "part")
    path = F.concat(F.lit("a/b/"), "p_name")
    return part.select("p_partkey", T.slugify(F.col("p_type")).alias("slug"), T.attribute_label(F.col("p_partkey"), F.col("p_name")).alias("label"), T.output_name(F.col("p_partkey"), path).alias("filename"), F.element_at(F.split("p_type", " "), -1).alias("last_word"))


@query("""SELECT g.grp AS "group", to_json(list(p_partkey ORDER BY p_partkey))::VARCHAR AS ids FROM part, (VALUES ('metal', 'steel|brass|copper'), ('size', 'small|large')) g(grp, re) WHERE regexp_matches(p_type, '(?i)' || g.re) GROUP BY 1""")
def regex_keyword_groups(spark, sf_dir):
    """ids by keyword group, as JSON."""
    groups = T.keyword_groups(_t(spark, sf_dir, "part"), "p_partkey", "p_type", {"metal": ["steel", "brass", "copper"], "size": ["small", "large"]})
    return groups.select("group", F.to_json("ids").alias("ids"))


@query("""SELECT event_id, CAST(event_id % 101 AS INTEGER) AS percent, event_id AS done, event_id + 100 AS total, round(value, 2) AS rate FROM events""")
def log_progress_parse(spark, sf_dir):
    """progress lines are made from the events and read back."""
    e = _t(spark, sf_dir, "events")
    line = F.concat(F.lit("encode: "), (F.col("event_id") % 101).cast("string"), F.lit("%| "), F.col("event_id").cast("string"), F.lit("/"), (F.col("event_id") + 100).cast("string"), F.lit(" [00:08<00:12, "), F.round("value", 2).cast("decimal(20,2)").cast("string"), F.lit("it/s]"))
    p = e.select("event_id", T.progress(line).alias("p"))
    return p.select("event_id", "p.percent", "p.done", "p.total", F.round("p.rate", 2).alias("rate"))


@query("""SELECT event_id, NOT contains(props, '/images/') AS external FROM events""")
def path_substring(spark, sf_dir):
    """F6, F7."""
    return _t(spark, sf_dir, "events").select("event_id", (~F.contains(F.col("props"), F.lit("/images/"))).alias("external"))


@query("""SELECT n_species, n_images, least_images, most_images FROM (SELECT count(*) AS n_species, sum(n)::BIGINT AS n_images, min(n) AS least_images, max(n) AS most_images FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label))""")
def dataset_stats_sql(spark, sf_dir):
    """SQL over a registered table."""
    _t(spark, sf_dir, "embeddings").createOrReplaceTempView("sparvane_images")
    return spark.sql("""SELECT count(*) AS n_species, sum(n) AS n_images, min(n) AS least_images, max(n) AS most_images FROM (SELECT label, count(*) AS n FROM sparvane_images GROUP BY label)""")


@query("""SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 1""")
def lowest_id(spark, sf_dir):
    """The default query row."""
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label").orderBy("vec_id").limit(1)
