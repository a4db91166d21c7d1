from pyspark.sql import functions as F

from sparvane.llm import mixing


def levels(sizes, share=1.5, repeats=2, weights=(5, 2, 1)):
    """Targets by the definition: share by weight, stop at the cap, reshare what exceeds it until none is above."""
    names = sorted(sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(target.values())
        over = {n for n in open_ if left * w[n] / sum(w[m] for m in open_) > repeats * sizes[n]}
        if not over:
            target |= {n: left * w[n] / sum(w[m] for m in open_) for n in open_}
            break
        target |= {n: repeats * sizes[n] for n in over}
        open_ -= over
    return target


def test_targets_by_definition(spark):
    sizes = {"a": 10, "b": 500, "c": 3000, "d": 7, "e": 0, "f": 900}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert all(abs(got[k] - v) < 1e-6 for k, v in levels(sizes).items())


def test_budget_is_exact_and_reruns_agree(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"), F.when(F.col("id") < 2000, "hot").otherwise((F.col("id") % 3).cast("string")).alias("source"))
    a = mixing.mix(df)
    per = a.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(r.t == int(r.g) for r in per)
    assert a.filter("taken > 2 * size").count() == 0
    assert sorted(a.collect()) == sorted(mixing.mix(df.repartition(5)).collect())
    words = mixing.mixture(df).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    assert {r.source: r.n for r in words.collect()} == {r.source: r.t for r in per}


def test_edges(edge_docs, no_docs):
    m = mixing.mix(edge_docs)
    assert m.count() == edge_docs.count() and {r.taken for r in m.filter("size = 0").collect()} == {0}
    assert mixing.mixture(edge_docs).columns == edge_docs.columns
    assert mixing.mix(no_docs).count() == 0 == mixing.mixture(no_docs).count()


def test_cut_inside_equal_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", "s")] * 7, "doc_id long, text string, source string")
    assert mixing.mixture(df).agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == 42


def test_a_row_repeated_often_is_one_row_of_the_sort(spark):
    rows = spark.range(3000).selectExpr("cast(if(id % 3 = 0, null, id) as long) as doc_id", "if(id % 3 = 0, 'a b', repeat('w ', int(id % 5))) as text", "'s' as source")
    m = mixing.mix(rows)
    got = m.collect()
    assert len(got) == 3000 and sum(r.taken for r in got) == int(got[0].target)
    places = sorted((r.before, r.size) for r in got if r.size)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))  # a gapless order
    again = mixing.mixture(rows).agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert again == int(got[0].target)


def test_clashing_columns(spark):
    rows = [(i, f"a b {i}", "st"[i % 2], 5, i, "x", 0.5, True) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, _key long, _source string, _rest double, _tie boolean")
    out = mixing.mixture(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert out.select("doc_id", "_key").filter("doc_id <> _key").count() == 0


def test_copies_come_by_ranges(spark):
    from sparvane.llm.common import copies_of

    df = spark.createDataFrame([("a", 1), ("b", 7), ("c", 200_000), ("d", 6)], "k string, n long")
    got = {r.k: (r.rows, r.low, r.high, r.different) for r in copies_of(df, "n", "i", 6).groupBy("k").agg(F.count("*").alias("rows"), F.min("i").alias("low"), F.max("i").alias("high"), F.countDistinct("i").alias("different")).collect()}
    assert got == {k: (n, 0, n - 1, n) for k, n in (("a", 1), ("b", 7), ("c", 200_000), ("d", 6))}
