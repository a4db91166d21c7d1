"""Queries over numeric columns: moments, quantiles, information scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as S
from .relational import _t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, count(l_quantity) AS l_quantity_count,
round(avg(l_tax), 8) AS l_tax_mean, round(stddev_samp(l_tax), 8) AS l_tax_std, count(l_tax) AS l_tax_count FROM lineitem GROUP BY 1, 2""")
def class_stats(spark, sf_dir):
    """A5: sample deviation."""
    out = S.class_stats(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_tax"])
    return out.withColumns({c: F.round(c, 6 if "quantity" in c else 8) for c in out.columns if c.endswith(("_mean", "_std"))})


@query("""SELECT round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, round(avg(CASE WHEN l_extendedprice < 20000 THEN 1.0::DOUBLE ELSE 0.0 END), 8) AS below FROM lineitem""")
def distribution_stats(spark, sf_dir):
    """Exact linear quantiles."""
    out = S.distribution(_t(spark, sf_dir, "lineitem"), "l_extendedprice", 20000.0)
    return out.withColumns({c: F.round(c, 8 if c == "below" else 4) for c in out.columns})


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem""")
def zscore_columns(spark, sf_dir):
    """Population deviation."""
    out = S.zscore_columns(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"])
    return out.withColumn("l_quantity", F.round("l_quantity", 6))


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem WHERE l_returnflag = 'R')) / (SELECT stddev_pop(l_quantity) FROM lineitem WHERE l_returnflag = 'R'), 6) AS l_quantity FROM lineitem""")
def zscore_reference(spark, sf_dir):
    """V4 against a reference pool."""
    li = _t(spark, sf_dir, "lineitem")
    out = S.zscore_columns(li.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], li.filter("l_returnflag = 'R'"))
    return out.withColumn("l_quantity", F.round("l_quantity", 6))


@query("""WITH e AS (SELECT i - 1 AS pos, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))
SELECT CAST(pos AS INTEGER) AS pos, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std, round(var_pop(x), 8) AS variance, round(min(x), 8) AS low, round(max(x), 8) AS high FROM e GROUP BY pos""")
def vector_moments(spark, sf_dir):
    """Moments of each place of a vector column."""
    out = S.vector_moments(_t(spark, sf_dir, "embeddings"), "embedding")
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "std", "variance", "low", "high")})


@query("""WITH e AS (SELECT i - 1 AS pos, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i))
SELECT CAST(pos AS INTEGER) AS pos, round(var_pop(x), 10) AS variance FROM e GROUP BY pos ORDER BY round(var_pop(x), 10) DESC, pos LIMIT 22""")
def top_variance_places(spark, sf_dir):
    """A9, O3."""
    m = S.vector_moments(_t(spark, sf_dir, "embeddings"), "embedding")
    return m.select("pos", F.round("variance", 10).alias("variance")).orderBy(F.desc("variance"), "pos").limit(22)


@query("""WITH e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), m AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e GROUP BY i)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round((x - m) / s, 5) AS z FROM e JOIN m USING (i)""")
def vector_zscore(spark, sf_dir):
    """V4 on vectors."""
    z = S.zscore_vectors(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return z.select("vec_id", F.posexplode("embedding").alias("pos", "z")).withColumn("z", F.round("z", 5))


_EDGES = "SELECT unnest(list_distinct(quantile_cont(l_extendedprice, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS e FROM lineitem"


@query(f"""WITH g AS ({_EDGES}), k AS (SELECT list(e) FILTER (e > (SELECT min(e) FROM g) AND e < (SELECT max(e) FROM g)) AS es FROM g)
SELECT l_orderkey, l_linenumber, CAST(len(list_filter(es, lambda x: x <= l_extendedprice)) AS INTEGER) AS code FROM lineitem, k""")
def quantile_discretize(spark, sf_dir):
    """V15."""
    return S.discretize(_t(spark, sf_dir, "lineitem"), "l_extendedprice", "code").select("l_orderkey", "l_linenumber", "code")


@query("""SELECT l_returnflag, l_shipmode_code, count(*) AS n FROM (SELECT l_returnflag, l_linenumber AS l_shipmode_code FROM lineitem) GROUP BY 1, 2""")
def crosstab(spark, sf_dir):
    """A12."""
    return S.crosstab(_t(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "l_shipmode_code"), "l_returnflag", "l_shipmode_code")


_MI = """SELECT {g} round(greatest(0, sum(p * log2(p / (px * py + 1e-12)))), 6) AS mutual_information FROM (SELECT {g} n / sum(n) OVER ({w}) AS p,
 sum(n) OVER (PARTITION BY {g} a) / sum(n) OVER ({w}) AS px, sum(n) OVER (PARTITION BY {g} b) / sum(n) OVER ({w}) AS py FROM (SELECT {g} a, b, count(*) AS n FROM {src} GROUP BY ALL)) {by}"""


@query(_MI.format(g="", w="", by="", src="(SELECT l_returnflag AS a, l_linestatus AS b FROM lineitem)"))
def mutual_information(spark, sf_dir):
    """A13, in bits."""
    pairs = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return S.mutual_information(pairs).withColumn("mutual_information", F.round("mutual_information", 6))


@query("""WITH x AS (SELECT l_returnflag AS y, l_quantity AS v FROM lineitem), c AS (SELECT y, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY y)
SELECT round(sum(n * (m - (SELECT avg(v) FROM x)) ** 2) / sum(n * s), 9) AS fisher_score FROM c""")
def fisher_score(spark, sf_dir):
    """A14."""
    out = S.fisher_score(_t(spark, sf_dir, "lineitem").withColumn("g", F.lit(1)), ["g"], "l_returnflag", "l_quantity")
    return out.select(F.round("fisher_score", 9).alias("fisher_score"))


def _info_sql() -> str:
    long = " UNION ALL ".join(f"SELECT '{a}' AS attribute, l_returnflag AS b, {a} AS x FROM lineitem" for a in NUMERIC)
    return f"""WITH l AS ({long}),
g AS (SELECT attribute, unnest(list_distinct(quantile_cont(x, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]))) AS e FROM l GROUP BY attribute),
k AS (SELECT attribute, list(e) FILTER (e > lo AND e < hi) AS es FROM (SELECT *, min(e) OVER (PARTITION BY attribute) AS lo, max(e) OVER (PARTITION BY attribute) AS hi FROM g) GROUP BY attribute),
d AS (SELECT attribute, b, x, len(list_filter(es, lambda q: q <= x)) AS a FROM l JOIN k USING (attribute)),
m AS ({_MI.format(g="attribute,", w="PARTITION BY attribute", by="GROUP BY attribute", src="d").replace("round(greatest(0, ", "greatest(0, ").replace("+ 1e-12)))), 6)", "+ 1e-12))))")}),
c AS (SELECT attribute, b, count(*) AS n, avg(x) AS mu, var_pop(x) AS s FROM l GROUP BY ALL),
f AS (SELECT attribute, sum(n * (mu - t) ** 2) / sum(n * s) AS fisher_score FROM (SELECT *, sum(n * mu) OVER (PARTITION BY attribute) / sum(n) OVER (PARTITION BY attribute) AS t FROM c) GROUP BY attribute),
z AS (SELECT attribute, fisher_score, mutual_information, (fisher_score - min(fisher_score) OVER ()) / (max(fisher_score) OVER () - min(fisher_score) OVER ()) AS fn,
 (mutual_information - min(mutual_information) OVER ()) / (max(mutual_information) OVER () - min(mutual_information) OVER ()) AS mn FROM f JOIN m USING (attribute))
SELECT attribute, round(fisher_score, 9) AS fisher_score, round(mutual_information, 6) AS mutual_information, round(fn, 5) AS fisher_score_norm, round(mn, 5) AS mutual_information_norm, round(0.55 * fn + 0.45 * mn, 5) AS combined FROM z"""


@query(_info_sql())
def attribute_info(spark, sf_dir):
    """A15, W8."""
    out = S.attribute_information(_t(spark, sf_dir, "lineitem"), NUMERIC, "l_returnflag")
    digits = {"fisher_score": 9, "mutual_information": 6}
    return out.withColumns({c: F.round(c, digits.get(c, 5)) for c in out.columns if c != "attribute"})


@query("""SELECT user_id, round(-sum((n / t) * log2(n / t + 1e-12)), 6) AS entropy FROM (SELECT user_id, n, sum(n) OVER (PARTITION BY user_id) AS t FROM (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)) GROUP BY 1""")
def entropy_hist(spark, sf_dir):
    """Entropy of each user's histogram of events."""
    n = _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.collect_list("n").alias("h")).select("user_id", F.round(S.entropy_bits(F.col("h")), 6).alias("entropy"))


@query("""SELECT user_id, max(CASE WHEN event_type = 'click' AND value > 10 THEN 1 ELSE 0 END) AS attr_click, max(CASE WHEN event_type = 'purchase' AND value > 10 THEN 1 ELSE 0 END) AS attr_purchase, max(CASE WHEN event_type = 'none' AND value > 10 THEN 1 ELSE 0 END) AS attr_none FROM events GROUP BY 1""")
def pivot_binary(spark, sf_dir):
    """A 0/1 column per value, also of values that never occur."""
    e = _t(spark, sf_dir, "events").withColumn("flag", (F.col("value") > 10).cast("int"))
    return S.binary_pivot(e, "user_id", "event_type", ["click", "purchase", "none"], "flag")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) AS r FROM lineitem" for a in ("l_quantity", "l_tax") for b in ("l_extendedprice", "l_discount")))
def correlation(spark, sf_dir):
    """A24."""
    out = S.correlations(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"], ["l_extendedprice", "l_discount"])
    return out.withColumn("r", F.round("r", 8))


@query("""SELECT CAST(least(15, floor(l_quantity / (51.0 / 16))) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 51 GROUP BY 1""")
def histogram(spark, sf_dir):
    """The data of a chart."""
    return S.width_histogram(_t(spark, sf_dir, "lineitem"), "l_quantity", 0.0, 51.0, 16)


@query("""SELECT l_partkey AS word, count(DISTINCT l_orderkey) AS df, round(ln(((SELECT count(DISTINCT l_orderkey) FROM lineitem) + 1) / (count(DISTINCT l_orderkey) + 1)), 8) AS idf FROM lineitem GROUP BY 1""")
def document_frequency(spark, sf_dir):
    """A17."""
    w = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("word"))
    return S.inverse_document_frequency(w, "l_orderkey", "word").withColumn("idf", F.round("idf", 8))
